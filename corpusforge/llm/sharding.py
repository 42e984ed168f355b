"""Balanced shards by vector bin packing.

Every group of equal texts is a vector (bytes, tokens, rows).  Groups that hold
more than one ``CELLS``-th of any total are packed one by one; the others are
first summed into ``CELLS`` cells by the hash of their text, and a cell is packed
as one item.  So the driver packs at most ``4 * CELLS`` items (plus the parts of
oversized groups) however large the corpus is, and no shard can be off by more
than about one cell.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import stored

CELLS = 4096
# A group with more than a shard's fair share is cut into parts of this share of the total.
PART_SHARE = 1 / 64
_WORD = r"[^\x20\x09-\x0D]+"


def pack(vectors: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard of each row of ``vectors``: largest first, each to the shard where the dot
    product of its vector and the shard's residual capacity is highest (ties: lowest shard)."""
    total = vectors.sum(axis=0)
    share = vectors / np.where(total > 0, total, 1)
    residual = np.full((n_shards, vectors.shape[1]), 1.0 / n_shards)
    out = np.zeros(len(vectors), dtype=np.int64)
    for i in np.lexsort((np.arange(len(vectors)), -share.max(axis=1))):
        out[i] = int(np.argmax(residual @ share[i]))
        residual[out[i]] -= share[i]
    return out


def shard(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col, size, text_crc32, shard, slot``.

    ``size`` is the UTF-8 length plus 1, ``slot`` counts from 0 in each shard without gaps.
    Equal texts share a shard, except that a group with more than a shard's
    fair share of the bytes, tokens or rows is cut by the hash of the id into parts of about
    ``PART_SHARE`` of the total, as otherwise no balance would exist.  Null texts
    count as empty texts of no bytes; null ids are allowed; repeated rows get slots of
    their own; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.regexp_count(text, F.lit(_WORD)).cast("long").alias("tokens"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.unhex(F.md5(text)).alias("text_key")), "shard-rows")
    groups = stored(rows.groupBy("text_key").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"),
                                                 F.count(F.lit(1)).alias("rows")), "shard-groups")
    dims = ("size", "tokens", "rows")
    total = groups.agg(*(F.sum(d).alias(d) for d in dims)).first()
    totals = {d: total[d] or 0 for d in dims}
    # at most CELLS groups per dimension can be this large
    large = groups.filter(" or ".join(f"{d} * {CELLS} > {totals[d]}" for d in dims)).collect()
    keys, cell = [], CELLS
    for g in sorted(large, key=lambda g: bytes(g.text_key)):
        share = max(g[d] / totals[d] for d in dims if totals[d])
        parts = math.ceil(share / PART_SHARE) if share * n_shards > 1 else 1
        keys.append((bytearray(g.text_key), cell, parts))
        cell += parts
    own = F.broadcast(spark.createDataFrame(keys, "text_key binary, first_cell int, parts int"))
    spread = F.xxhash64("id")
    # rows of one cell are numbered in sub-cells of at most about 1/CELLS of all rows
    placed = rows.join(own, "text_key", "left").withColumn("cell", F.coalesce(
        F.col("first_cell") + F.pmod(spread, F.col("parts")).cast("int"),
        F.pmod(F.xxhash64("text_key"), F.lit(CELLS)).cast("int")))
    sums = placed.groupBy("cell").agg(*(F.sum(F.lit(1) if d == "rows" else F.col(d)).alias(d) for d in dims)).orderBy("cell").collect()
    chosen = pack(np.array([[s[d] for d in dims] for s in sums], dtype=float).reshape(-1, 3), n_shards)
    salts = [(int(s.cell), int(p), max(1, math.ceil(s["rows"] * CELLS / max(1, totals["rows"]) / 2)))
             for s, p in zip(sums, chosen, strict=True)]
    plan = F.broadcast(spark.createDataFrame(salts, "cell int, shard int, salts int"))
    placed = placed.join(plan, "cell").withColumn("salt", F.pmod(F.xxhash64("id", F.lit(7)), F.col("salts")).cast("int"))
    counts = placed.groupBy("shard", "cell", "salt").agg(F.count(F.lit(1)).alias("n")).orderBy("shard", "cell", "salt").collect()
    starts, at = [], dict.fromkeys(range(n_shards), 0)
    for c in counts:
        starts.append((c.cell, c.salt, at[c.shard]))
        at[c.shard] += c.n
    start = F.broadcast(spark.createDataFrame(starts, "cell int, salt int, start long"))
    within = Window.partitionBy("cell", "salt").orderBy("id", "text_crc32", "size")
    return (placed.join(start, ["cell", "salt"])
            .select(F.col("id").alias(id_col), "size", "text_crc32", "shard",
                    (F.col("start") + F.row_number().over(within) - 1).cast("long").alias("slot")))
