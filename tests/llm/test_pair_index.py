"""The pair occurrence index against the library and against merging each piece alone."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusforge.llm import pair_index, queries
from corpusforge.llm.common import read

from cases import EDGES

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return pair_index.Vocabulary.from_file(PATH)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(data):
    return np.frombuffer(data, dtype="<u4").tolist()


def test_random_texts_as_the_library(vocabulary, library):
    rng = random.Random(12)
    signs = list("aaaabcdeéßłжд日本ॐ🙂 \n\t\r\x0b\x1c\x1f\x85\xa0  　՘\U0001e6c0\U00010940'’.,!?-_0189٣Ⅷ")
    words = ["<|endoftext|>", "<|endof", "'s", " the", "ing", "aaaaaaaaaaaaaaaa", "  ", "don't", "I'LL", "\n\n\n"]
    texts = ["".join(rng.choice(words) if rng.random() < 0.2 else rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(20_000)]
    got = pair_index.Encoder(vocabulary).encode(texts)
    for text, mine, theirs in zip(texts, got, library.encode_batch(texts, add_special_tokens=False)):
        assert ids_of(mine) == theirs.ids, text


def test_every_character_as_the_library(vocabulary, library):
    """Each code point between letters, digits, signs and spaces, whatever the Unicode versions."""
    encoder = pair_index.Encoder(vocabulary)
    texts = [f"a{c}1{c}!{c} {c}{c} b" for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000, 7)))]
    for a in range(0, len(texts), 20_000):
        part = texts[a:a + 20_000]
        assert [ids_of(x) for x in encoder.encode(part)] == [x.ids for x in library.encode_batch(part, add_special_tokens=False)]


def one_by_one(piece, ranks):
    """Plain BPE: again and again the leftmost pair of the smallest rank."""
    s = list(piece)
    while True:
        best = min(((ranks[p], i) for i, p in enumerate(zip(s, s[1:])) if p in ranks), default=None)
        if best is None:
            return s
        (_, product), i = best
        s[i:i + 2] = [product]


def test_index_merges_as_each_piece_alone():
    rng = random.Random(3)
    for _ in range(200):
        ranks, made = {}, list(range(3))
        for rank in range(rng.randint(1, 25)):
            pair = (rng.choice(made), rng.choice(made))
            if pair not in ranks:
                made.append(100 + rank)
                ranks[pair] = (rank, 100 + rank)
        pieces = [[rng.randrange(3) for _ in range(rng.randint(0, 30))] for _ in range(20)]
        line = [x for p in pieces for x in (*p, -1)]
        back = {rank: (*pair, product) for pair, (rank, product) in ranks.items()}
        assert pair_index.PairIndex(line, ranks, back).merge() == [one_by_one(p, ranks) for p in pieces]


def test_few_pieces_kept(vocabulary, library, monkeypatch):
    monkeypatch.setattr(pair_index, "PIECES", 5)
    encoder = pair_index.Encoder(vocabulary)
    for text in ("one two three four five six seven", "six seven eight nine one", "one two", "", "two two two"):
        assert [ids_of(x) for x in encoder.encode([text])] == [library.encode(text, add_special_tokens=False).ids]


def test_edges(docs_of, vocabulary, library):
    rows = EDGES + [(20, "a<|endoftext|>b"), (21, "🙂 " * 500)]
    out = pair_index.decode(pair_index.encode(docs_of(rows), vocabulary), vocabulary).collect()
    want = sorted((str(i), library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in rows)
    assert sorted((str(r.doc_id), ids_of(r.ids), r.decoded) for r in out) == want
    assert pair_index.decimal_digests(docs_of([]), vocabulary).count() == 0


def test_decode_joins_bytes_before_reading(spark, vocabulary):
    smile = pair_index.Encoder(vocabulary).encode(["🙂"])[0]
    assert len(ids_of(smile)) > 1
    rows = [(1, smile), (2, smile[:4]), (3, b""), (4, None), (5, np.array([50256], dtype="<u4").tobytes())]
    df = spark.createDataFrame(rows, "k long, ids binary").withColumn("decoded", F.lit("clash"))
    assert {r.k: r.decoded for r in pair_index.decode(df, vocabulary).collect()} == {1: "🙂", 2: "�", 3: "", 4: None, 5: "<|endoftext|>"}


def test_other_models_are_refused():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f, pytest.raises(ValueError):
        pair_index.Vocabulary(f.read())


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op12_pair_index_bpe(spark, sf).collect()}
    texts = {r.doc_id: r.text or "" for r in read(spark, sf, "documents").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    ids = {k: library.encode(t, add_special_tokens=False).ids for k, t in texts.items()}
    assert got == {k: (len(ids[k]), sha(",".join(map(str, ids[k]))), sha(library.decode(ids[k], skip_special_tokens=False))) for k in texts}
