import math

import pytest
from pyspark.sql import functions as F

from corpusforge.operators import sampling


def frame(spark, n, parts):
    return spark.range(n).select(F.lit("s").alias("source"), F.col("id").alias("pair_id"),
                                 F.col("id").alias("pos")).repartition(parts)


def test_split_disjoint_complete_and_stable(spark):
    results = []
    for parts in (1, 4, 16):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        s = sampling.train_valid_split(frame(spark, 1000, parts), ["source", "pair_id"])
        valid = {r["pair_id"] for r in s.filter("split = 'valid'").collect()}
        train = {r["pair_id"] for r in s.filter("split = 'train'").collect()}
        assert len(valid) == 100 and len(train) == 900 and not (valid & train)
        results.append(valid)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1] == results[2]


def test_split_size_is_ceil(spark):
    s = sampling.train_valid_split(frame(spark, 341, 3), ["source", "pair_id"])
    assert s.filter("split = 'valid'").count() == math.ceil(0.1 * 341)


def test_sample_n(spark):
    df = frame(spark, 300, 3)
    a = sampling.sample_n(df, 50, ["source", "pair_id"], seed=42)
    assert a.count() == 50 and a.select("pair_id").distinct().count() == 50
    with pytest.raises(ValueError):
        sampling.sample_n(df, 301, ["source", "pair_id"])


def test_window_and_accept_count(spark):
    assert sampling.window_size(0) == 501
    assert sampling.accept_count(500) == 125 and sampling.accept_count(501) == 125
    assert sampling.candidate_window(frame(spark, 1000, 4), 0).count() == 501
    assert sampling.candidate_window(frame(spark, 400, 4), 0).count() == 400
    # the window is by rank among remaining rows, not by pos <= size
    gappy = frame(spark, 2000, 4).filter(F.col("pair_id") % 2 == 0)
    w = sampling.candidate_window(gappy, 0)
    assert w.count() == 501 and w.agg(F.max("pos")).first()[0] == 1000


def test_shuffle_reindex_dense(spark):
    out = sampling.shuffle_reindex(frame(spark, 200, 5), ["source", "pair_id"]).collect()
    assert sorted(r["idx"] for r in out) == list(range(200))
