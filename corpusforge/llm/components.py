"""Connected components of an edge table, without collecting edges or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` for every node of ``edges`` (``a, b``): the smallest node that can be reached.

    Each round hooks every node to its smallest neighbour, shortens the paths to
    their roots by doubling and contracts the edges, which at least halves the nodes that
    still have edges.
    """
    left = stored(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    labels = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("p")), "hooks")
        while True:
            up = hooks.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            jumped = stored(hooks.join(up, "p").select("a", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "hooks")
            hooks = jumped.select("a", "p")
            if jumped.filter("moved").isEmpty():
                break
        if labels is None:
            labels = hooks.select(F.col("a").alias("node"), F.col("p").alias("comp"))
        else:
            up = hooks.select(F.col("a").alias("comp"), F.col("p").alias("top"))
            labels = stored(labels.join(up, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")), "labels")
        up = hooks.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        left = stored(left.join(hooks, "a").select("b", F.col("p").alias("pa")).join(up, "b")
                      .filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("comp")).filter("false")
    return labels
