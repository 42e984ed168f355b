"""The loop's count model grows by the accepted rows; it is not refitted on the whole pool each round."""

from pyspark.sql import functions as F

from corpusforge.operators import lm
from corpusforge.plans import selection

SCHEMA = "source string, pair_id long, pos long, tokens array<string>"


def test_counts_without_rows_equal_a_fit_on_the_rest(spark):
    rows = [("s", i, i, [f"w{i % 7}", f"w{i % 3}", "."] if i % 5 else None) for i in range(60)] + [("s", 60, 60, ["only"]), ("s", 60, 60, ["only", "here"])]
    df = spark.createDataFrame(rows, SCHEMA)
    out = (F.col("pair_id") % 4 == 0)
    got, want = lm.without_rows(lm.fit_unigram(df), df.filter(out)), lm.fit_unigram(df.filter(~out))
    assert (got.n_tokens, got.n_types) == (want.n_tokens, want.n_types)
    assert sorted(map(tuple, got.counts.collect())) == sorted(map(tuple, want.counts.collect()))
    assert not lm.without_rows(got, df.filter(~out)).n_types


def test_the_pool_is_counted_once(spark, monkeypatch, tmp_path):
    trusted = spark.createDataFrame([("t", i, i, [f"a{i % 5}", f"b{i % 3}"]) for i in range(40)], SCHEMA)
    cands = spark.createDataFrame([("c", i, i, [f"a{i % 9}", f"c{i % 4}"] * (1 + i % 3)) for i in range(2000)], SCHEMA)
    fits, models = [], []
    fit, without = lm.fit_unigram, lm.without_rows
    monkeypatch.setattr(lm, "fit_unigram", lambda df, col="tokens": fits.append(1) or fit(df, col))
    monkeypatch.setattr(lm, "without_rows", lambda *a: models.append(without(*a)) or models[-1])
    run = selection.run_selection(trusted, cands, None, rounds=2, run_id="grown", out_dir=str(tmp_path / "run"))
    assert len(fits) == 1 and len(run.stats) == 2
    split = spark.read.parquet(str(tmp_path / "run" / "split" / "round=1")).filter("split = 'train'").select("source", "pair_id")
    want = fit(trusted.unionByName(cands).join(split, ["source", "pair_id"], "left_semi"))
    assert sorted(map(tuple, models[1].counts.collect())) == sorted(map(tuple, want.counts.collect()))
    resumed = selection.run_selection(trusted, cands, None, rounds=3, run_id="grown", out_dir=str(tmp_path / "run"), resume=True)
    assert len(fits) == 2 and resumed.stats[:2] == run.stats and len(resumed.stats) == 3


def test_only_rare_tokens_are_shuffled_to_large_counts(spark):
    """Past the broadcast limit the frequent types are still looked up in place, and the losses are the same."""
    tokens = [[f"w{i % 400}", *["the", "of", "."] * 8] for i in range(500)]
    df = spark.createDataFrame([("s", i, i, t) for i, t in enumerate(tokens)], SCHEMA)
    odd = spark.createDataFrame([("s", 1000, 0, []), ("s", 1001, 0, None), ("s", 1002, 0, ["new", "the", None, "s:1002"]), (None, None, 0, ["w1", "of"])], SCHEMA)
    rows = df.unionByName(odd)
    want = {(r["source"], r["pair_id"]): r for r in lm.score_unigram(lm.fit_unigram(df), rows, ["source", "pair_id"]).collect()}
    for limit, hot in (("2000", True), ("0", False)):
        spark.conf.set("corpusforge.broadcast.maxBytes", limit)
        try:
            model = lm.fit_unigram(df)
            assert not model.broadcastable
            scored = lm.score_unigram(model, rows, ["source", "pair_id"])
            frequent = {r["token"] for r in model.frequent.collect()} if hot else set()
            assert hot and {"the", "of", "."} <= frequent and "w1" not in frequent or model.frequent is None
            got = scored.collect()
        finally:
            spark.conf.unset("corpusforge.broadcast.maxBytes")
        assert len(got) == len(want)
        for r in got:
            w = want[r["source"], r["pair_id"]]
            assert (r["n_tok"], r["loss"]) == (w["n_tok"], w["loss"]) and (w["n_tok"] is None) == (r["sum_nll"] is None)
