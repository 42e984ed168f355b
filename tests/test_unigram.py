"""The unigram subword model against enumerations and a plain training run."""

import itertools
import math
import random
from collections import Counter

import pytest

from corpusforge.operators import subword
from corpusforge.operators import subword_unigram as uni

CORPUS = ["low lower lowest low", "newer newest new wider", "low new newer slow slower", "a aa aaa aaaa"]


def cuttings(word):
    for cuts in itertools.product((False, True), repeat=max(0, len(word) - 1)):
        out, begin = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                out.append(word[begin:i])
                begin = i
        yield out + [word[begin:]]


def by_enumeration(word, logp, floor):
    score = lambda ps: sum(logp.get(p, floor if len(p) == 1 else -math.inf) for p in ps)
    every = [(score(ps), ps) for ps in cuttings(word)]
    total = math.log(sum(math.exp(s) for s, _ in every))
    counts = Counter()
    for s, ps in every:
        for p in ps:
            counts[p] += math.exp(s - total)
    return total, {p: c for p, c in counts.items() if c > 0}, max(s for s, _ in every), score


def test_lattice_sums_match_enumeration():
    rng = random.Random(6)
    for _ in range(150):
        pieces = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(8)} | {"a"}
        logp = {p: math.log(rng.uniform(0.01, 1)) for p in pieces}
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        floor = uni._floor(logp)
        longest = max(map(len, logp))
        total, counts, best, score = by_enumeration(word, logp, floor)
        got, expected = uni.expected_counts(word, logp, longest, floor)
        assert math.isclose(got, total, rel_tol=1e-9)
        assert all(math.isclose(expected.get(p, 0.0), c, rel_tol=1e-6, abs_tol=1e-9) for p, c in counts.items())
        assert math.isclose(score(uni.best_pieces(word, logp, longest, floor)), best, rel_tol=1e-9)


def test_digamma():
    assert math.isclose(uni.digamma(1.0), -0.5772156649015329, rel_tol=1e-9)
    for x in (0.5, 1.5, 3.0, 20.0):
        assert math.isclose(uni.digamma(x + 1) - uni.digamma(x), 1 / x, rel_tol=1e-9)


def plain_training(texts, vocab_size, seeds_per_piece, em_steps=uni.EM_STEPS, keep=uni.KEEP):
    """The same training, word after word in one process."""
    words = Counter(subword.WORD_START + w for t in texts for w in t.split())
    chars = set("".join(words))
    found = Counter()
    for w, n in words.items():
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + uni.MAX_PIECE) + 1):
                found[w[i:j]] += n
    longer = sorted((p for p, n in found.items() if len(p) > 1 and n > 1), key=lambda p: (-found[p] * len(p), p))[:seeds_per_piece * vocab_size]
    total = sum(found[p] for p in [*longer, *chars])
    logp = {p: math.log(found[p] / total) for p in [*longer, *chars]}
    wanted, history = max(len(chars), vocab_size - len(subword.SPECIAL_PIECES)), []
    while True:
        for _ in range(em_steps):
            size, like, counts = len(logp), 0.0, Counter()
            for w, n in words.items():
                s, c = uni.expected_counts(w, logp, max(map(len, logp)), uni._floor(logp))
                like += s * n
                for p, x in c.items():
                    counts[p] += x * n
            logp = uni.reestimated({p: counts[p] for p in logp}, chars)
            history.append((size, like / sum(words.values())))
        if len(logp) <= wanted:
            return logp, history
        best = Counter()
        for w, n in words.items():
            for p in uni.best_pieces(w, logp, max(map(len, logp)), uni._floor(logp)):
                best[p] += n
        lost = {}
        for p in logp:
            if len(p) > 1:
                other = uni.best_pieces(p, logp, max(map(len, logp)), uni._floor(logp), without=p)
                lost[p] = best[p] * (logp[p] - sum(logp.get(x, uni._floor(logp)) for x in other))
        room = max(wanted, int(keep * len(logp))) - len(chars)
        stay = sorted(lost, key=lambda p: (-round(lost[p], 6), p))[:room]
        logp = {p: logp[p] for p in (*chars, *stay)}


@pytest.mark.parametrize("seeds_per_piece", [1, 10])
def test_training_matches_plain(spark, seeds_per_piece):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CORPUS)] + [(9, None), (10, "")], "k long, text string")
    model = uni.train_unigram(df, "text", vocab_size=30, seeds_per_piece=seeds_per_piece)
    logp, history = plain_training(CORPUS, 30, seeds_per_piece)
    assert model.logp.keys() == logp.keys() and len(logp) <= 26
    assert all(math.isclose(model.logp[p], logp[p], abs_tol=1e-4) for p in logp)
    assert [n for n, _ in model.history] == [n for n, _ in history]
    assert all(math.isclose(a, b, abs_tol=1e-4) for (_, a), (_, b) in zip(model.history, history))
    # the second EM step of a round never lowers the likelihood by more than the damping does
    assert all(b[1] > a[1] - 0.2 for a, b in zip(model.history[::2], model.history[1::2]))


def test_same_model_under_any_partitioning(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CORPUS * 3)], "k long, text string")
    a, b = (uni.train_unigram(df.repartition(n), "text", vocab_size=30).logp for n in (1, 7))
    assert a == b


def test_encode_decode(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CORPUS)], "k long, text string")
    model = uni.train_unigram(df, "text", vocab_size=40)
    q = spark.createDataFrame([(0, "lowest  newer\nwider"), (1, "zow"), (2, None), (3, "")], "k long, text string")
    enc = {r["k"]: r["ids"] for r in uni.encode(model, q, ["k"], "text").collect()}
    back = {i: p for p, i in model.ids.items()}
    assert "".join(back[i] for i in enc[0]).replace("▁", " ").strip() == "lowest newer wider"
    assert enc[2] == enc[3] == [] and subword.SUBWORD_UNK_ID in enc[1] and min(enc[0]) >= 4
    wrapped = subword.BpeModel([], model.vocab(spark), None)
    assert subword.decode(wrapped, uni.encode(model, q, ["k"], "text"), ["k"], "ids", "t").filter("k = 0").first()["t"] == "lowest newer wider"


def test_empty_table(spark):
    model = uni.train_unigram(spark.createDataFrame([], "text string"), "text", vocab_size=30)
    assert model.logp == {} and list(model.ids) == list(subword.SPECIAL_PIECES)
