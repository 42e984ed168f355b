import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusforge.operators import bpe_train, subword

CORPUS = ["low lower lowest low", "newer newest new wider", "low new newer", "a aa aaa aaaa"]


def plain_bpe(texts, n_merges, min_count=2):
    words = Counter()
    for t in texts:
        for w in t.split():
            words[tuple(subword.WORD_START + w)] += 1
    merges = []
    for _ in range(n_merges):
        pairs = Counter()
        for w, f in words.items():
            for a, b in zip(w, w[1:]):
                pairs[(a, b)] += f
        cand = [(n, p) for p, n in pairs.items() if n >= min_count]
        if not cand:
            break
        n, (a, b) = sorted(cand, key=lambda x: (-x[0], x[1]))[0]
        merges.append((a, b))
        nw = Counter()
        for w, f in words.items():
            out, i = [], 0
            while i < len(w):
                if i < len(w) - 1 and w[i] == a and w[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(w[i])
                    i += 1
            nw[tuple(out)] += f
        words = nw
    return merges, words


def frame(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(CORPUS)], "k long, text string")


@pytest.mark.parametrize("merges_per_round", [1, 3, 1000])
def test_any_number_of_merges_per_round_is_plain_bpe(spark, merges_per_round):
    df = frame(spark)
    n_chars = len(set("".join(CORPUS).replace(" ", "") + subword.WORD_START))
    model = subword.train_bpe(df, "text", vocab_size=len(subword.SPECIAL_PIECES) + n_chars + 12, merges_per_round=merges_per_round)
    want, words = plain_bpe(CORPUS, 12)
    assert [(a, b) for _, a, b in model.merges] == want
    seg = {r["word"]: (r["freq"], tuple(r["pieces"])) for r in model.words.collect()}
    assert seg == {"".join(w): (n, w) for w, n in words.items()}
    assert model.rounds == 12 if merges_per_round == 1 else model.rounds < 12


def rounds_of(texts, n_merges, top, per_round, most=10 ** 6, least=False):
    """Merges and number of rounds by ``leading_merges`` and ``merge_block``, without Spark."""
    words = Counter(w for t in texts for w in t.split())
    names = sorted(set("".join(words)) | {subword.WORD_START})
    number = {c: i for i, c in enumerate(names)}
    line, freq = [], []
    for w, n in words.items():
        line += [number[c] for c in subword.WORD_START + w] + [-1]
        freq.append(n)
    line, freq, merges, rounds = np.array(line, dtype=np.int32), np.array(freq), [], 0
    while len(merges) < n_merges:
        weight = bpe_train._weights(line, freq)
        pairs, triples = Counter(), Counter()
        for i in range(len(line) - 1):
            if line[i] >= 0 and line[i + 1] >= 0:
                pairs[int(line[i]), int(line[i + 1])] += int(weight[i])
                if line[i + 2] >= 0:
                    triples[int(line[i]), int(line[i + 1]), int(line[i + 2])] += int(weight[i])
        index = object.__new__(bpe_train.PairIndex)
        index.codes, index.n = (np.array(x, dtype=np.int64) for x in zip(*(((a << 32) | b, n) for (a, b), n in pairs.items()))) if pairs else (np.zeros(0, np.int64),) * 2
        index.least = sorted(pairs.values())[len(pairs) // 3] if least and len(pairs) > 6 and max(pairs.values()) > sorted(pairs.values())[len(pairs) // 3] else 0
        found, last, closed = index.leading(names, top, most)
        if not found or found[0][2] < 2:
            break
        known = {p[:2] for p in found}
        near = [(*t, n) for t, n in triples.items() if (t[:2] in known and t[1:] in known) or (not closed and (t[:2] in known or t[1:] in known) and n >= found[-1][2])]
        step, born = bpe_train.leading_merges(found, near, names, last, min(per_round, n_merges - len(merges)), 2)
        assert step
        rounds += 1
        numbered = []
        for a, b in step:
            if names[a] + names[b] not in number:
                number[names[a] + names[b]] = len(names)
                names.append(names[a] + names[b])
            numbered.append((a, b, number[names[a] + names[b]]))
            merges.append((names[a], names[b]))
        line = bpe_train.merge_block(line, numbered)
    return merges, rounds


@given(st.lists(st.text(alphabet="abc", min_size=1, max_size=12), min_size=1, max_size=30), st.integers(1, 25), st.integers(1, 40),
       st.integers(1, 30), st.booleans())
@settings(max_examples=500, deadline=None)
def test_rounds_are_plain_bpe(words, top, per_round, most, least):
    texts = [" ".join(words)]
    assert rounds_of(texts, 40, top, per_round, most, least)[0] == plain_bpe(texts, 40)[0]


def test_rounds_take_many_merges():
    rng = random.Random(1)
    stems = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 5))) for _ in range(60)]
    texts = [" ".join(rng.choice(stems) + rng.choice(stems) + rng.choice(["", "en", "er"]) for _ in range(3000))]
    merges, rounds = rounds_of(texts, 250, 500, 500)
    assert merges == plain_bpe(texts, 250)[0] and rounds < 125


def slow_merges(word, ranks):
    s = list(word)
    while True:
        best = min(((ranks[p], i) for i, p in enumerate(zip(s, s[1:])) if p in ranks), default=None)
        if best is None:
            return s
        s[best[1]:best[1] + 2] = ["".join(s[best[1]:best[1] + 2])]


@given(st.text(alphabet="abc", max_size=40), st.lists(st.tuples(st.text(alphabet="abc", min_size=1, max_size=3), st.text(alphabet="abc", min_size=1, max_size=3)), max_size=12))
@settings(max_examples=300, deadline=None)
def test_words_are_cut_by_rank(word, merges):
    """A pair that is in the list twice has its first rank."""
    ranks = subword.merge_ranks([(i, a, b) for i, (a, b) in enumerate(merges)])
    assert all(merges.index(p) == r for p, r in ranks.items())
    assert subword._apply_merges(word, ranks) == slow_merges(word, ranks)


def test_segmentation_of_training_words_is_by_rank(spark):
    model = subword.train_bpe(frame(spark), "text", vocab_size=40)
    ranks = subword.merge_ranks(model.merges)
    for r in model.words.collect():
        assert subword._apply_merges(r["word"], ranks) == list(r["pieces"])


def test_long_word_and_empty_table(spark):
    model = subword.train_bpe(spark.createDataFrame([], "k long, text string"), "text", vocab_size=40)
    assert model.merges == [] and {r["piece"] for r in model.vocab.collect()} == set(subword.SPECIAL_PIECES)
    model = subword.train_bpe(frame(spark), "text", vocab_size=40)
    q = spark.createDataFrame([(0, "low" * 50_000), (1, None), (2, "zzz low"), (2, "zzz low")], "k long, text string")
    rows = sorted((r["k"], len(r["ids"]), r["ids"][:4]) for r in subword.encode(model, q, ["k"], "text").collect())
    assert [r[0] for r in rows] == [0, 1, 2, 2] and rows[1][1] == 0 and rows[2] == rows[3] and subword.SUBWORD_UNK_ID in rows[2][2]


def test_encode_decode_roundtrip(spark):
    model = subword.train_bpe(frame(spark), "text", vocab_size=40)
    q = spark.createDataFrame([(0, "lowest  newer\nwider"), (1, "new lows"), (2, "")], "k long, text string")
    enc = subword.encode(model, q, ["k"], "text")
    dec = subword.decode(model, enc, ["k"], "ids", "back")
    got = {r["k"]: r["back"] for r in dec.collect()}
    assert got == {0: "lowest newer wider", 1: "new lows", 2: ""}
    ids = {r["k"]: r["ids"] for r in enc.collect()}
    assert all(i >= 4 for i in ids[0])


def test_training_tasks_follow_the_words_not_the_shuffle_partitions(spark):
    text = " ".join(f"w{i % 97}x{i % 13}" for i in range(500))
    df = spark.createDataFrame([(text,), (None,), ("",)], "text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        model = subword.train_bpe(df, "text", vocab_size=80)
        blocks = bpe_train.pack(spark.createDataFrame([("ab", 2), ("abc", 1)], "word string, freq bigint").coalesce(1), list("abc"))
        assert bpe_train._counted(blocks, []).rdd.getNumPartitions() == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert model.words.rdd.getNumPartitions() == 1  # a few words are one block, whose every round is one task


def test_many_words_are_spread_over_tasks(spark):
    df = spark.createDataFrame([(" ".join(f"{i:06d}" for i in range(j, j + 500)),) for j in range(0, 4000, 500)], "text string")
    words = subword.word_table(df, "text", 1000, 4000)
    assert words.rdd.getNumPartitions() == 8 and words.count() == 4000  # 4000 words of 8 symbols with their ends
    assert words.agg({"freq": "sum"}).first()[0] == 4000
