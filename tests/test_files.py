import os
import tempfile

from pyspark.sql import functions as F

from corpusforge.sources import files


def fresh(name):
    return os.path.join(tempfile.mkdtemp(prefix="cf-files-"), name)


def test_pairs_csv_roundtrip_keeps_quotes_and_newlines(spark):
    rows = [(1, 'Er sä: "Moin, Moin"', "een\ntwee"), (2, None, "a,b"), (3, "", 'x "y" z')]
    df = spark.createDataFrame(rows, "pair_id long, deu string, nds string")
    path = fresh("pairs")
    files.write_pairs_csv(df, path)
    back = sorted(map(tuple, files.read_pairs(spark, path).collect()), key=lambda r: r[0])
    # an empty field and a missing field both read back as null in CSV, as in pandas
    assert back == [(1, 'Er sä: "Moin, Moin"', "een\ntwee"), (2, None, "a,b"), (3, None, 'x "y" z')]
    pos = files.read_positional(spark, path)
    assert pos.columns == ["src", "trg"] and pos.count() == 3


def test_sides_by_position(spark):
    df = spark.createDataFrame([(1, "a", "b", "extra")], "idx long, x string, y string, z string")
    assert files.sides_by_position(df).first().asDict() == {"deu": "a", "nds": "b"}


def test_snapshot_and_pruned_read(spark):
    base = fresh("run")
    df = spark.createDataFrame([(1, "a")], "pair_id long, deu string")
    files.snapshot(df, base, "r1", 0, "train")
    files.snapshot(df.withColumn("pair_id", F.lit(2)), base, "r1", 1, "train")
    got = files.read_run_table(spark, base, "train", "r1", 1)
    assert [r["pair_id"] for r in got.collect()] == [2]


def test_vocab_save_load_and_export(spark):
    v = spark.createDataFrame([("<unk>", 0), ("a", 4)], "token string, id int")
    path = fresh("vocab")
    files.save_vocab(v, path)
    assert sorted(map(tuple, files.load_vocab(spark, path).collect())) == [("<unk>", 0), ("a", 4)]
    out = fresh("side")
    files.export_side(spark.createDataFrame([("x, y",), ("z",)], "deu string"), "deu", out)
    assert sorted(r["value"] for r in spark.read.text(out).collect()) == ["x, y", "z"]


def test_loss_summary_wide(spark):
    long = spark.createDataFrame([(1, 0, 2.0), (1, 1, 1.5), (2, 0, 3.0)], "pair_id long, round int, loss double")
    w = {r["pair_id"]: (r["0"], r["1"]) for r in files.loss_summary_wide(long, [0, 1], ["pair_id"]).collect()}
    assert w == {1: (2.0, 1.5), 2: (3.0, None)}


def test_white_space_at_the_ends_is_text(spark):
    df = spark.createDataFrame([("1:000002", "  lead", "trail  "), ("1:000004", "\ttab", " ")], "pair_id string, deu string, nds string")
    for write, read in ((files.write_pairs_csv, files.read_pairs), (files.write_pairs_tsv, files.read_pairs_tsv)):
        path = fresh("spaces")
        write(df, path)
        assert sorted(map(tuple, read(spark, path, files.KEYED_PAIR_FILE_SCHEMA).collect())) == sorted(map(tuple, df.collect()))


def test_a_round_that_runs_again_replaces_its_rows(spark):
    base = fresh("again")
    df = spark.createDataFrame([(1, 0.5)], "round int, loss double")
    for _ in range(2):
        files.snapshot(df, base, "r1", 0, "train")
        files.append_round_stats(df, os.path.join(base, "stats"), 1)
    files.append_round_stats(df, os.path.join(base, "stats"), 2)
    assert files.read_run_table(spark, base, "train", "r1", 0).count() == 1
    assert sorted(r["round"] for r in spark.read.parquet(os.path.join(base, "stats")).collect()) == [1, 2]
