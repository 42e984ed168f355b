"""Keys stay apart whatever the turn numbers, rows without tokens stay, and streams read folders of part files."""

import os
import tempfile

from corpusforge.operators import vocab
from corpusforge.sources import tables
from corpusforge.streaming import requests as rs


def conversations(spark):
    turns = [(1, 1000, "user", "a"), (1, 1001, "assistant", "b"), (2, 0, "user", "c"), (2, 1, "assistant", "d"),
             (2, 5_000_000, "user", "e"), (2, 5_000_001, "assistant", "f")]
    folder = tempfile.mkdtemp(prefix="cf-keys-")
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3) \
        .write.parquet(os.path.join(folder, "conversations.parquet"))
    return folder


def test_large_turn_numbers(spark):
    folder = conversations(spark)
    pairs = {r["pair_id"]: (r["pos"], r["deu"], r["nds"]) for r in tables.conversation_pairs(spark, folder).collect()}
    assert pairs == {"1:001000": (1, "a", "b"), "2:000000": (2, "c", "d"), "2:5000000": (2, "e", "f")}
    assert sorted(r["sent_id"] for r in tables.request_sentences(spark, folder).collect()) == sorted(pairs)


def test_stream_over_a_folder_of_parts(spark):
    path = os.path.join(conversations(spark), "conversations.parquet")
    schema = spark.read.parquet(path).schema
    best = spark.createDataFrame([("a", "A"), ("e", "E")], "e string, best string")
    for source, want in ((path, {"1:001000": "A", "2:000000": "c", "2:5000000": "E"}), (None, {})):
        if source is None:
            source = os.path.join(tempfile.mkdtemp(prefix="cf-none-"), "t.parquet")
            spark.createDataFrame([], schema).write.parquet(source)
        stream = rs.table_stream(spark, source, schema).filter("role = 'user'")
        reqs = stream.select(tables.compound_key("conv_id", "turn").alias("sent_id"), stream["text"].alias("deu"))
        sink = os.path.join(tempfile.mkdtemp(prefix="cf-sink-"), "out")
        rs.translate_stream(reqs, best, sink).awaitTermination()
        assert {r["sent_id"]: r["ai_nds"] for r in rs.read_translations(spark, sink).collect()} == want


def test_rows_without_tokens_stay(spark):
    v = spark.createDataFrame([("<unk>", 0), ("x", 4)], "token string, id int")
    df = spark.createDataFrame([(1, ["x", "y"]), (2, []), (3, None)], "k long, t array<string>")
    ids = vocab.numericalize(df, ["k"], "t", v)
    assert {r["k"]: r["ids"] for r in ids.collect()} == {1: [4, 0], 2: [], 3: []}
    assert {r["k"]: r["tokens"] for r in vocab.denumericalize(ids, ["k"], "ids", v).collect()} == {1: ["x", "<unk>"], 2: [], 3: []}
