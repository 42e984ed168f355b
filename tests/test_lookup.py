"""Look-ups of arrays in place and by join give the same rows."""

from pyspark.sql import functions as F

from corpusforge.operators import lookup, normalise, vocab

ROWS = [(1, ["a", "b", "zz", "a"]), (2, []), (3, None), (4, ["b", None, "q"]), (5, ["zz"] * 3), (None, ["a"])]


def frames(spark):
    df = spark.createDataFrame(ROWS, "k long, t array<string>")
    table = spark.createDataFrame([("a", 10), ("b", 11), ("b", 12), (None, 13)], "token string, id int")
    return df, table


def found(df, col):
    return sorted(((r["k"], r[col]) for r in df.collect()), key=str)


def both_ways(spark, df, table, value, **how):
    here = lookup.share(table, "token", value)
    assert here.shared is not None
    in_place = lookup.map_arrays(df, "t", here, "out", **how)
    plan = in_place._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    joined = lookup.by_join(df, "t", here, "out", key_cols=["k"], **how)
    a, b = found(in_place, "out"), found(joined, "out")
    assert a == b and in_place.columns == [*df.columns, "out"]
    return dict(a)


def test_default_for_unknown(spark):
    df, table = frames(spark)
    got = both_ways(spark, df, table, "id", default=0)
    assert got == {1: [10, 11, 0, 10], 2: [], 3: [], 4: [11, 0, 0], 5: [0, 0, 0], None: [10]}


def test_unknown_stay_themselves(spark):
    df, _ = frames(spark)
    table = spark.createDataFrame([("a", "A"), ("b", None)], "token string, v string")
    got = both_ways(spark, df, table, "v", keep=True)
    assert got == {1: ["A", "b", "zz", "A"], 2: [], 3: [], 4: ["b", "q"], 5: ["zz"] * 3, None: ["A"]}


def test_empty_frame(spark):
    df, table = frames(spark)
    assert lookup.map_arrays(df.limit(0), "t", lookup.share(table, "token", "id"), "out", 0).count() == 0
    assert found(lookup.map_arrays(df, "t", lookup.share(table.limit(0), "token", "id"), "out", 0), "out")[0] == (1, [0, 0, 0, 0])


def test_no_shuffle_by_row_key_in_the_operators(spark):
    df, table = frames(spark)
    dictionary = spark.createDataFrame([("a", "A")], "variant string, preferred string")
    for out in (vocab.numericalize(df, ["k"], "t", table), normalise.normalise_tokens(df, ["k"], "t", dictionary)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Generate" not in plan
    n = {r["k"]: (r["normalised"], r["n_tokens"], r["n_changed"]) for r in normalise.normalise_tokens(df, ["k"], "t", dictionary).collect()}
    assert n[1] == (["A", "b", "zz", "A"], 4, 2) and n[3] == ([], 0, 0) and n[4] == (["b", "q"], 2, 0)


def test_large_tables_are_joined(spark):
    df, table = frames(spark)
    spark.conf.set("corpusforge.broadcast.maxBytes", "0")
    try:
        shared = lookup.share(table, "token", "id")
        assert shared.shared is None
        got = found(lookup.map_arrays(df.withColumn("x", F.lit(1)), "t", shared, "out", 0, key_cols=["k"]), "out")
    finally:
        spark.conf.unset("corpusforge.broadcast.maxBytes")
    assert dict(got) == {1: [10, 11, 0, 10], 2: [], 3: [], 4: [11, 0, 0], 5: [0, 0, 0], None: [10]}


def test_entries_are_small_and_tell_equal_codes_apart(monkeypatch):
    """A task's copy of a table takes few bytes an entry; keys of one code are told apart."""
    import pickle

    import numpy as np
    import pyarrow as pa

    n = 20_000
    words = [f"wort{i * 7919 % n}" for i in range(n)]
    entries = lookup.Entries(pa.array(words), pa.array(range(n), pa.int32()))
    held = sum(x.nbytes for x in (entries.codes, entries.keys, entries.values))
    assert held < 30 * n and len(pickle.dumps(entries)) < 30 * n
    wanted = pa.array([words[5], "other", "", words[n - 1]])
    assert [None if p < 0 else entries.values[p].as_py() for p in entries.find(wanted)] == [5, None, None, n - 1]

    numbers = lookup.Entries(pa.array([7, -1, 2**40]), pa.array(["a", "b", "c"]))
    assert numbers.find(pa.array([2**40, 0, -1])).tolist() == [2, -1, 0]

    monkeypatch.setattr(lookup, "_codes", lambda v: np.zeros(len(v), dtype=np.uint32))
    same = lookup.Entries(pa.array(["a", "b", "c"]), pa.array([1, 2, 3]))
    assert same.find(pa.array(["c", "x", "a", "b"])).tolist() == [2, -1, 0, 1]
