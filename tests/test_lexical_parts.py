"""EM and scores over parts against a plain implementation, with spread target types, many parts and no broadcast."""

import math
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from corpusforge.operators import lexical, lexical_parts

SCHEMA = "k long, src array<string>, trg array<string>"


def plain_em(pairs, steps):
    t = None
    tables = []
    for _ in range(steps):
        c = defaultdict(float)
        for _, src, trg in pairs:
            ce, cf = Counter(["<sos>", *src, "<eos>"]), Counter([*trg, "<eos>"])
            for f, n in cf.items():
                w = {e: m * (1.0 if t is None else t.get((e, f), 0.0)) for e, m in ce.items()}
                z = sum(w.values())
                for e, x in w.items():
                    c[e, f] += n * x / z
        total = defaultdict(float)
        for (e, _), x in c.items():
            total[e] += x
        t = {(e, f): x / total[e] for (e, f), x in c.items()}
        tables.append(t)
    return tables


def plain_loss(t, v, src, trg, lam=0.1):
    s, out = ["<sos>", *src, "<eos>"], 0.0
    labels = [*trg, "<eos>"]
    for f in labels:
        out -= math.log((1 - lam) * sum(t.get((e, f), 0.0) for e in s) / len(s) + lam / v)
    return len(labels), out


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(4)
    es, fs = [f"e{i}" for i in range(12)], [f"f{i}" for i in range(12)] + ["."] * 8
    rows = [(i, [rng.choice(es) for _ in range(rng.randint(0, 9))], [rng.choice(fs) for _ in range(rng.randint(0, 9))]) for i in range(60)]
    return rows + [(100, [], []), (101, ["e1"] * 50, ["f1"] * 50)]


@pytest.mark.parametrize("cells", [1_000_000, 60])
def test_em_and_scores_match_plain(spark, pairs, cells, monkeypatch):
    monkeypatch.setattr(lexical_parts, "CELLS_PER_PART", cells)
    df = spark.createDataFrame(pairs, SCHEMA)
    lay = lexical_parts.layout(df, "src", "trg", cells)
    assert bool(lay.salts) == (cells == 60) and (cells > 60 or (lay.parts > 20 and lay.salts["<eos>"] > 1))
    want = plain_em(pairs, 3)
    job = lexical_parts.training(df, ["k"], "src", "trg", cells_per_part=cells)
    for t in want:
        assert job.step()
        got = {(r["e"], r["f"]): r["t"] for r in job.table().collect()}
        assert got.keys() == t.keys() and all(abs(got[c] - t[c]) < 1e-12 for c in t)
    v = len({f for _, _, trg in pairs for f in trg} | {"<eos>"})
    others = spark.createDataFrame([*pairs, (200, ["new", "e1"], ["f1", "other"]), (201, None, None)], SCHEMA)
    scored = lexical_parts.losses(job.table(), v, others, ["k"], "src", "trg", 0.1, cells)
    rows = {r["k"]: (r["n_tok"], r["sum_nll"]) for r in scored.collect()}
    assert len(rows) == len(pairs) + 2 and rows[201][0] == 1
    for k, src, trg in [*pairs, (200, ["new", "e1"], ["f1", "other"])]:
        n, x = plain_loss(want[2], v, src, trg)
        assert rows[k][0] == n and abs(rows[k][1] - x) < 1e-9


def test_steps_without_broadcast_join_cells(spark, pairs):
    """Totals too large for every task: the same tables by the cell join, also from the middle of a run on."""
    df = spark.createDataFrame(pairs, SCHEMA)
    want = plain_em(pairs, 2)[-1]
    spark.conf.set("corpusforge.broadcast.maxBytes", "0")
    try:
        model = lexical.fit(df, ["k"], "src", "trg", iterations=2)
        got = {(r["e"], r["f"]): r["t"] for r in model.table.collect()}
    finally:
        spark.conf.unset("corpusforge.broadcast.maxBytes")
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-12 for c in want)


def test_a_step_has_one_shuffle(spark, pairs):
    job = lexical_parts.training(spark.createDataFrame(pairs, SCHEMA), ["k"], "src", "trg")
    assert job.step()
    table = job.table()
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_best_iteration_by_a_given_loss(spark, pairs):
    df = spark.createDataFrame(pairs, SCHEMA)
    seen = iter([2.0, 1.5, 1.5, 1.75])
    model = lexical.fit(df, ["k"], "src", "trg", iterations=4, valid=df, loss_of=lambda scored: next(seen))
    assert model.history == [(1, 2.0), (2, 1.5), (3, 1.5), (4, 1.75)]
    want = plain_em(pairs, 2)[-1]
    assert all(abs(r["t"] - want[r["e"], r["f"]]) < 1e-12 for r in model.table.collect())


def test_no_pairs(spark):
    none = spark.createDataFrame([], SCHEMA)
    model = lexical.fit(none, ["k"], "src", "trg", iterations=2, valid=none)
    assert model.table.count() == 0
    some = spark.createDataFrame([(1, ["a"], ["b"])], SCHEMA)
    assert lexical.score(lexical.LexicalModel(model.table, 1), some, ["k"], "src", "trg").first()["n_tok"] == 2


def test_a_table_is_sent_as_lists_and_by_its_own_size(spark, pairs, monkeypatch):
    """A long table reaches a scoring task as few rows, in as many parts as it has need of, even for one pair."""
    train = spark.createDataFrame(pairs, SCHEMA)
    model = lexical.fit(train, ["k"], "src", "trg", 1)
    seen = []
    packed = lexical_parts.packed
    monkeypatch.setattr(lexical_parts, "packed", lambda *a: seen.append(a[4].parts) or packed(*a))
    one = spark.createDataFrame(pairs[:1], SCHEMA)
    n = model.table.count()
    got = lexical_parts.losses(model.table, model.n_target_types, one, ["k"], "src", "trg", 0.1, cells_per_part=20)
    assert seen == [max(seen[0], -(-n // 20))] and seen[0] >= n / 20
    t = {(r["e"], r["f"]): r["t"] for r in model.table.collect()}
    r = got.first()
    size, loss = plain_loss(t, model.n_target_types, *pairs[0][1:])
    assert r["n_tok"] == size and r["sum_nll"] == pytest.approx(loss, rel=1e-9)

    entries = pa.RecordBatch.from_arrays([pa.array([1, 0, 1], pa.int32()), pa.array(["a", "b", "c"]), pa.array(["x", "y", "z"]), pa.array([.1, .2, .3])], ["part", "e", "f", "t"])
    lists = list(lexical_parts._listed(iter([entries, entries.slice(0, 0), entries])))
    assert [b.to_pylist() for b in lists] == [[{"part": 0, "e": ["b", "b"], "f": ["y", "y"], "t": [.2, .2]},
                                               {"part": 1, "e": ["a", "c", "a", "c"], "f": ["x", "z", "x", "z"], "t": [.1, .3, .1, .3]}]]


@pytest.mark.parametrize("cells", [1_000_000, 60])
def test_best_translations_without_the_table(spark, pairs, cells):
    """The best target of each source type comes from the parts' leading cells; the table is not made, and most cells stay where they are."""
    df = spark.createDataFrame(pairs, SCHEMA)
    job = lexical_parts.training(df, ["k"], "src", "trg", cells_per_part=cells)
    assert job.step() and job.step()
    v = job.lay.targets
    assert v == len({f for _, _, trg in pairs for f in trg} | {"<eos>"})
    model = lexical.LexicalModel(None, v, job=job)
    got = {r["e"]: r["best"] for r in lexical.best_translation(model).collect()}
    assert model.made is None
    t = plain_em(pairs, 2)[-1]
    by_e = defaultdict(list)
    for (e, f), x in t.items():
        if f != "<eos>":
            by_e[e].append((-round(x, 12), f))
    assert got == {e: min(xs)[1] for e, xs in by_e.items()}
    if cells == 1_000_000:
        assert job.leading(("<eos>",), 2e-12).count() < len(t) / 2
    fitted = lexical.fit(df, ["k"], "src", "trg", iterations=2)
    assert fitted.made is None
    table = {(r["e"], r["f"]): r["t"] for r in fitted.table.collect()}
    assert table.keys() == t.keys() and fitted.table is fitted.table


def test_equal_probabilities_keep_the_smallest_target(spark):
    rows = [(1, ["a", None], ["y", "x", None, "é"]), (2, None, ["z"]), (3, ["b", "<sos>"], None), (1, ["a"], ["x", "y", "é"])]
    model = lexical.fit(spark.createDataFrame(rows, SCHEMA), ["k"], "src", "trg", iterations=2)
    best = {r["e"]: r["best"] for r in lexical.best_translation(model).collect()}
    assert best["a"] == "x" and "b" not in best
