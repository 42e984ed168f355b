"""Hand fixtures for the count models, the lexical model and BLEU (FIXTURES.md §3)."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusforge.functions import text as T
from corpusforge.operators import bleu, lexical, lm, vocab

TRUSTED = "he hett mi lang töven . se wüllt riek warrn ."


def tok_frame(spark, rows):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "pair_id long, text string")
    return df.withColumn("tokens", T.tokenize_nds("text"))


def test_vocab_fixture(spark):
    v = vocab.build_vocab(tok_frame(spark, [TRUSTED]), "tokens")
    got = {r["token"]: (r["freq"], r["id"]) for r in v.collect()}
    assert [t for t, _ in sorted(got.items(), key=lambda kv: kv[1][1])][:4] == ["<unk>", "<pad>", "<sos>", "<eos>"]
    assert got["."] == (2, 4)
    rest = sorted(["he", "hett", "lang", "mi", "riek", "se", "töven", "warrn", "wüllt"])
    assert [got[t][1] for t in rest] == list(range(5, 14))


def test_numericalize_roundtrip(spark):
    v = vocab.build_vocab(tok_frame(spark, [TRUSTED]), "tokens")
    q = tok_frame(spark, ["se hett nüms ."])
    ids = vocab.numericalize(q, ["pair_id"], "tokens", v)
    assert ids.first()["ids"] == [10, 6, 0, 4]
    back = vocab.denumericalize(ids, ["pair_id"], "ids", v).first()["tokens"]
    assert back == ["se", "hett", "<unk>", "."]


def test_unigram_fixture(spark):
    model = lm.fit_unigram(tok_frame(spark, [TRUSTED]))
    assert (model.n_tokens, model.n_types) == (11, 10)
    sc = lm.score_unigram(model, tok_frame(spark, ["se hett mi .", "nüms hett dissen satz ."]), ["pair_id"])
    got = {r["pair_id"]: r["loss"] for r in sc.collect()}
    assert got == {0: 2.296529, 1: 2.732691}


def test_incremental_unigram_equals_refit(spark):
    a, b = tok_frame(spark, [TRUSTED]), tok_frame(spark, ["se hett mi ."])
    inc = lm.update_unigram(lm.fit_unigram(a), b)
    full = lm.fit_unigram(a.unionByName(b))
    assert (inc.n_tokens, inc.n_types) == (full.n_tokens, full.n_types)
    assert sorted(map(tuple, inc.counts.collect())) == sorted(map(tuple, full.counts.collect()))


def test_bigram_matches_brute_force(spark):
    train = ["a b a c", "b a", "c c a b"]
    test = ["a b", "c a d", ""]
    model = lm.fit_bigram(tok_frame(spark, train))
    got = {r["pair_id"]: r["loss"] for r in lm.score_bigram(model, tok_frame(spark, test), ["pair_id"]).collect()}
    pairs, hist = Counter(), Counter()
    for t in train:
        s = ["<sos>"] + t.split() + ["<eos>"]
        for u, w in zip(s, s[1:]):
            pairs[(u, w)] += 1
            hist[u] += 1
    v = len({w for (_, w) in pairs})
    for i, t in enumerate(test):
        s = ["<sos>"] + t.split() + ["<eos>"]
        nll = [-math.log((pairs[(u, w)] + 1) / (hist[u] + v + 1)) for u, w in zip(s, s[1:])]
        assert got[i] == round(sum(nll) / len(nll), 6)


def test_ibm1_fixture(spark):
    pairs = spark.createDataFrame([(0, ["a", "b"], ["x", "y"]), (1, ["a"], ["x"])],
                                  "pair_id long, src array<string>, trg array<string>")
    model = lexical.fit(pairs, ["pair_id"], "src", "trg", iterations=2)
    t = {(r["e"], r["f"]): r["t"] for r in model.table.collect()}
    assert round(t[("a", "x")], 5) == 0.42675
    assert round(t[("a", "y")], 4) == 0.1465
    assert round(t[("b", "y")], 5) == 0.47619
    assert round(t[("b", "x")], 6) == 0.261905
    sc = {r["pair_id"]: r["loss"] for r in lexical.score(model, pairs, ["pair_id"], "src", "trg").collect()}
    assert sc == {0: 1.121088, 1: 0.873691}


def test_ibm1_cells_salted_split_is_exact(spark):
    pairs = spark.createDataFrame([(0, ["a", "b", "a", "c"], ["x", "y", "x"]), (1, ["a"], ["z"])],
                                  "pair_id long, src array<string>, trg array<string>")
    whole = sorted(map(tuple, lexical.build_cells(pairs, ["pair_id"], "src", "trg").collect()))
    split = sorted(map(tuple, lexical.build_cells(pairs, ["pair_id"], "src", "trg", cells_per_split=2).collect()))
    assert whole == split and len(whole) == 5 * 3 + 3 * 2


def test_ibm1_best_keeps_first_iteration_on_ties(spark):
    pairs = spark.createDataFrame([(0, ["a"], ["x"])], "pair_id long, src array<string>, trg array<string>")
    m = lexical.fit(pairs, ["pair_id"], "src", "trg", iterations=3, valid=pairs)
    assert [it for it, _ in m.history] == [1, 2, 3]


def test_translate_copies_unknown_and_caps(spark):
    best = spark.createDataFrame([("a", "x"), ("b", "y")], "e string, best string")
    s = spark.createDataFrame([(0, ["a", "q", "b"]), (1, ["a"] * 60), (2, [])], "k long, t array<string>")
    got = {r["k"]: r["hyp"] for r in lexical.translate(best, s, ["k"], "t").collect()}
    assert got[0] == ["x", "q", "y"] and len(got[1]) == 60 and got[2] == []
    capped = {r["k"]: r["hyp"] for r in lexical.translate(best, s, ["k"], "t", max_len=50).collect()}
    assert len(capped[1]) == 50


def test_bleu_tokens_fixture(spark):
    df = spark.createDataFrame([
        (0, "He hett mi lang töven .", "He hett mi lang töven laten ."),
        (1, "Se wüllt riek ween .", "Se wüllt riek warrn .")], "k long, h string, r string")
    df = df.select("k", F.split("h", " ").alias("h"), F.split("r", " ").alias("r"))
    r = bleu.corpus_bleu(df, ["k"], "h", "r").first()
    assert [(r[f"m{n}"], r[f"t{n}"]) for n in range(1, 5)] == [(10, 11), (6, 9), (4, 7), (2, 5)]
    assert r["bp"] == 0.913101 and r["bleu"] == 0.557062


def test_bleu_chars_fixture(spark):
    df = spark.createDataFrame([(0, "Se wüllt riek ween.", "Se wüllt riek warrn.")], "k long, h string, r string")
    df = df.select("k", bleu.char_units("h").alias("h"), bleu.char_units("r").alias("r"))
    r = bleu.corpus_bleu(df, ["k"], "h", "r").first()
    assert [(r[f"m{n}"], r[f"t{n}"]) for n in range(1, 5)] == [(17, 19), (15, 18), (13, 17), (12, 16)]
    assert r["bp"] == 0.948729 and r["bleu"] == 0.767202


def test_bleu_zero_precision_is_zero(spark):
    df = spark.createDataFrame([(0, ["a", "b"], ["c", "d"])], "k long, h array<string>, r array<string>")
    assert bleu.corpus_bleu(df, ["k"], "h", "r").first()["bleu"] == 0.0
