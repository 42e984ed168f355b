"""Exact de-duplication by progressive refinement (DataFrame functions only).

Rows are grouped by text length, then by a hash of the text's first characters,
then by a SHA-256 of the whole text.  Only rows whose group still has two
members go on to the next level, so most unique texts are never hashed whole
and never shuffled by their full hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import broadcast_if_small, stored

PREFIX_CHARS = 64


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     hash_all: bool = False, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Equal texts form a group; the row with the largest id is kept.  Defined cases:
    a null text counts as the empty text; a null id loses against any other id,
    and a group of null ids keeps one row with a null ``keep_id``; of rows that repeat
    the kept id *and* text exactly one is kept; an empty table gives an empty result.
    Other input columns are ignored.  ``text_sha256`` is null for texts ruled out
    before the full hash, unless ``hash_all`` asks for every hash (then it is
    taken in the first scan and the text is read once).
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", "text", F.octet_length("text").alias("len"),
                       F.xxhash64(F.substring("text", 1, prefix_chars)).alias("pfx"))
    sha = F.sha2(F.col("text"), 256)
    small = stored(rows.select("id", "len", "pfx", (sha if hash_all else F.lit(None).cast("string")).alias("sha")),
                   "dedup-rows")

    # level 1: lengths that occur twice; level 2: prefixes that occur twice among them
    prefixes = stored(small.groupBy("len", "pfx").agg(F.count(F.lit(1)).alias("n")), "dedup-prefixes")
    lengths = prefixes.groupBy("len").agg(F.sum("n").alias("n_len")).filter("n_len > 1").select("len")
    open_groups = prefixes.filter("n > 1").join(lengths, "len", "left_semi").select("len", "pfx")

    # level 3: whole texts of the rows that are left
    if hash_all:
        left = small.join(open_groups, ["len", "pfx"], "left_semi")
    else:
        left = rows.select("id", "len", "pfx", sha.alias("sha")).join(open_groups, ["len", "pfx"], "left_semi")
    copies = stored(left.groupBy("len", "pfx", "sha", "id").agg(F.count(F.lit(1)).alias("c")), "dedup-copies")
    groups = stored(copies.groupBy("len", "pfx", "sha").agg(F.max("id").alias("keep_id"),
                                                            F.sum("c").alias("group_size")), "dedup-groups")
    # a row with the same id and text as another one stands for ``c`` rows
    in_groups = (copies.join(groups, ["len", "pfx", "sha"])
                 .select("id", "keep_id", "group_size", "sha", F.col("id").eqNullSafe(F.col("keep_id")).alias("top"),
                         F.explode(F.sequence(F.lit(1).cast("long"), F.col("c"))).alias("i"))
                 .select("id", "keep_id", "group_size", (F.col("top") & (F.col("i") == 1)).alias("kept"), "sha"))
    alone = small.join(open_groups, ["len", "pfx"], "left_anti").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    out = in_groups.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_duplicates`` drops (all columns kept).

    Where an id occurs with several texts, the kept ``(id, text)`` pairs stay; exact
    repeats of such a pair leave one row.
    """
    marks = exact_duplicates(docs, id_col, text_col).filter("text_sha256 IS NOT NULL")  # texts ruled out before the full hash stay
    pairs = stored(marks.groupBy(F.col(id_col).alias("id"), F.col("text_sha256").alias("sha")).agg(
        F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("n")), "dedup-marks")
    twice = pairs.filter("kept AND n > 1")
    repeats = not twice.isEmpty()
    concerned = pairs.filter("NOT kept OR n > 1").select(F.col("id").alias("_id"), F.lit(True).alias("_open")).distinct()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    key, text = F.col(f"_row.`{id_col}`"), F.coalesce(F.col(f"_row.`{text_col}`"), F.lit(""))
    # only texts of ids that lose a row are hashed again
    tagged = whole.join(broadcast_if_small(concerned), key.eqNullSafe(F.col("_id")), "left") \
                  .select("_row", F.when(F.col("_open"), F.sha2(text, 256)).alias("_sha"))
    gone = pairs.filter("NOT kept").select(F.col("id").alias("_gone_id"), F.col("sha").alias("_gone_sha"))
    out = tagged.join(broadcast_if_small(gone), key.eqNullSafe(F.col("_gone_id")) & (F.col("_sha") == F.col("_gone_sha")), "left_anti")
    if repeats:
        out = stored(out, "dedup-kept")
        again = twice.select(F.col("id").alias("_twice_id"), F.col("sha").alias("_twice_sha"))
        same = key.eqNullSafe(F.col("_twice_id")) & (F.col("_sha") == F.col("_twice_sha"))
        once = out.join(again, same, "left_semi").withColumn("_key", key).dropDuplicates(["_key", "_sha"]).select("_row")
        out = out.join(again, same, "left_anti").select("_row").unionByName(once)
    return out.select("_row.*")
