"""A hot token holding a third of all token rows, with broadcasting off: the token
join must stay correct, and AQE must split the skewed partition."""

import math
import random
from collections import Counter

import pytest

from corpusforge.operators import lm


@pytest.fixture()
def skew_conf(spark):
    conf = {
        "corpusforge.broadcast.maxBytes": "0",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k in conf:
        spark.conf.unset(k)


def test_hot_token_join(skew_conf):
    spark = skew_conf
    rnd = random.Random(3)
    docs = []
    for i in range(400):
        words = [f"w{rnd.randrange(2000)}" for _ in range(2)] + ["."] * 4
        docs.append((i, words))
    df = spark.createDataFrame(docs, "pair_id long, tokens array<string>")
    train, test = df.filter("pair_id < 200"), df.filter("pair_id >= 200")
    model = lm.fit_unigram(train)
    scored = lm.score_unigram(model, test, ["pair_id"])
    got = {r["pair_id"]: r["loss"] for r in scored.collect()}
    counts = Counter(t for _, ws in docs[:200] for t in ws)
    den = sum(counts.values()) + len(counts) + 1
    for i, ws in docs[200:]:
        want = sum(-math.log((counts[t] + 1) / den) for t in ws) / len(ws)
        assert got[i] == round(want, 6)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan
    assert "skew=true" in plan
