import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusforge.operators import ordering


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(7)
    vals = [rnd.choice([rnd.random() * 10, 2.5, 2.5, 7.0]) for _ in range(3000)]
    ids = list(range(3000))
    rnd.shuffle(ids)
    return vals, spark.createDataFrame(list(zip(ids, vals)), "k long, v double")


def test_order_statistic_matches_sort(spark, data):
    vals, df = data
    srt = sorted(vals)
    ranks = [1, 2, 750, 1500, 2999, 3000]
    assert ordering.order_statistics(df, ["v"], ranks) == [(srt[k - 1],) for k in ranks]
    assert ordering.order_statistic(df, "v", 3001) is None and ordering.order_statistic(df, "v", 0) is None


def test_order_statistic_ties_by_key(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(500)], "k long, v double")
    assert ordering.order_statistic(df, "v", 123, ["k"])[1] == 122


def test_many_ties_on_string_keys(spark):
    """More rows with one value than a driver should sort, over several sources."""
    df = spark.range(60_000).select(F.lit(7).alias("pos"), F.concat(F.lit("src"), F.col("id") % 3).alias("source"), F.col("id").alias("pair_id"))
    assert ordering.order_statistic(df, "pos", 20_001, ["source", "pair_id"]) == (7, "src1", 1)
    assert ordering.first_n(df, 40_001, "pos", ["source", "pair_id"]).filter("source = 'src2'").count() == 1


def test_exact_quantile(spark, data):
    vals, df = data
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        assert math.isclose(ordering.exact_quantile(df, "v", q), float(np.quantile(vals, q)), rel_tol=1e-12)
    small = spark.createDataFrame([(float(x),) for x in (5, 1, 9, 2, 7, 7)], "v double")
    assert ordering.exact_quantile(small, "v", 0.25) == 2.75


def test_dense_index_and_first_n(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    out = ordering.dense_index(df, ["x"], "i").collect()
    assert sorted((r["i"], r["x"]) for r in out) == [(i, i) for i in range(1000)]
    assert sorted(r["x"] for r in ordering.first_n(df, 10, "x").collect()) == list(range(10))
