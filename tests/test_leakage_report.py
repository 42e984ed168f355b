from pyspark.sql import functions as F

from corpusforge.operators import leakage
from corpusforge.plans import report


def test_remove_leaks_null_safe(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", "b"), (3, None, None)], "k long, deu string, nds string")
    test = spark.createDataFrame([("a", None), ("a", "b")], "deu string, nds string")
    assert [r["k"] for r in leakage.remove_leaks(df, test, ["deu", "nds"]).collect()] == [3]
    assert leakage.leak_matches(df, test, ["deu", "nds"]).count() == 1


def test_leak_probe_literal_and_regex(spark):
    df = spark.createDataFrame([(1, "se hett (dat) seggt"), (2, "se hett dat seggt")], "k long, text string")
    test = spark.createDataFrame([(0, "(dat)")], "item_id long, text string")
    assert [r["k"] for r in leakage.leak_probe(df, test, "text", ["item_id"]).collect()] == [1]
    assert sorted(r["k"] for r in leakage.leak_probe(df, test, "text", ["item_id"], regex=True).collect()) == [1, 2]


def test_report(spark):
    st = spark.createDataFrame(
        [("m", i, t, l) for i, (t, l) in enumerate([(100, 5.0), (164, 4.0), (300, 3.5)])]
        + [("b", i, t, l) for i, (t, l) in enumerate([(100, 5.0), (150, 4.5)])],
        "run_id string, round int, total_samples long, test_loss double")
    ns = {(r["run_id"], r["round"]): r["new_samples"] for r in report.with_new_samples(st).collect()}
    assert ns[("m", 0)] is None and ns[("m", 1)] == 64 and ns[("m", 2)] == 136
    sh = {r["run_id"]: (r["pct_first"], r["pct_all_but_last"]) for r in report.absorbed_shares(st, 400).collect()}
    # 100 * 200 / 400 = 50 ; all but last: 100 * 64 / 400 = 16
    assert sh["m"] == (50.0, 16.0)
    # half to even: 100 * 50 / 400 = 12.5 -> 12
    assert sh["b"] == (12.0, 0.0) or sh["b"] == (12.0, None)
    cmp = {r["round"]: r["loss_delta"] for r in report.compare_runs(st, "m", "b").collect()}
    assert cmp[0] == 0.0 and cmp[1] == -0.5 and cmp[2] is None
