"""Pairs scored where the training pairs are: the same losses as a plain implementation, without a table."""

import random

import pytest

from corpusforge.operators import lexical, lexical_parts
from test_lexical_parts import SCHEMA, plain_em, plain_loss


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(7)
    es, fs = [f"e{i}" for i in range(15)], [f"f{i}" for i in range(15)] + ["."] * 9
    rows = [(i, [rng.choice(es) for _ in range(rng.randint(0, 9))], [rng.choice(fs) for _ in range(rng.randint(0, 9))]) for i in range(70)]
    return rows + [(100, [], []), (101, ["e1"] * 50, ["f1"] * 50)]


@pytest.mark.parametrize("cells", [1_000_000, 60])
def test_losses_match_plain(spark, pairs, cells):
    df = spark.createDataFrame(pairs, SCHEMA)
    others = [*pairs, (200, ["new", "e1", "<sos>"], ["f1", "other", "."]), (201, [], [])]
    scored = spark.createDataFrame([*others[:-1], (201, None, None), (None, ["e1", None], ["f1"]), (5, ["e2"], ["f2", None])], SCHEMA)
    job = lexical_parts.training(df, ["k"], "src", "trg", cells_per_part=cells)
    assert bool(job.lay.salts) == (cells == 60)
    v = len({f for _, _, trg in pairs for f in trg} | {"<eos>"})
    kept = []
    for t in plain_em(pairs, 3):
        assert job.step()
        kept.append((t, job.now()))
    for t, then in kept:  # a model stays as it was when later steps are made
        got = {r["k"]: (r["n_tok"], r["sum_nll"]) for r in then.losses(scored, ["k"], "src", "trg", 0.1).collect()}
        want = {k: plain_loss(t, v, src, trg) for k, src, trg in [*others, (None, ["e1"], ["f1"])]}
        want[5] = tuple(a + b for a, b in zip(want[5], plain_loss(t, v, ["e2"], ["f2"])))  # rows of a key are summed
        assert got.keys() == want.keys()
        assert all(got[k][0] == n and abs(got[k][1] - x) < 1e-9 for k, (n, x) in want.items())


def test_no_table_is_made_for_scores(spark, pairs, monkeypatch):
    """The table has nearly as many rows as there are cells: neither fitting with validation pairs nor scoring writes it."""
    def made(*args):
        raise AssertionError("the table was made")

    monkeypatch.setattr(lexical_parts.Training, "table", made)
    df = spark.createDataFrame(pairs, SCHEMA)
    model = lexical.fit(df, ["k"], "src", "trg", 3, valid=df)
    assert len(model.history) == 3 and lexical.score(model, df, ["k"], "src", "trg").count() == len(pairs)
    assert model.made is None


def test_blocks_are_much_smaller_than_their_cells(spark):
    """In very many parts a pair comes once for each of its targets: its source types are compressed numbers there."""
    rng = random.Random(3)
    words = [f"word{i}" for i in range(300)]
    pairs = spark.createDataFrame([(i, rng.choices(words, k=30), rng.choices(words, k=60)) for i in range(400)], SCHEMA)
    job = lexical_parts.training(pairs, ["k"], "src", "trg", cells_per_part=5000)
    assert job.lay.parts > 100
    size = job.rows.selectExpr("sum(octet_length(data))").first()[0]
    cells = pairs.selectExpr("sum((size(array_distinct(src)) + 2) * (size(array_distinct(trg)) + 1))").first()[0]
    assert size < 3 * cells
