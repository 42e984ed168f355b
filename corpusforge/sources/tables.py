"""Role tables derived from the parquet inputs.

The corpus tools work on two shapes:

* text table  ``(source STRING, pair_id LONG, pos LONG, text STRING)``
* pair table  ``(source STRING, pair_id STRING, pos LONG, deu STRING, nds STRING)``

``(source, pair_id)`` is the row key; ``pos`` (then the key) is the file order, which the
growing candidate window depends on (a DataFrame has no order of its own).
Pairs and requests are keyed by conversation and turn, test lines by item and line.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.functions.text import split_lines
from corpusforge.operators.joins import join_small
from corpusforge.operators.sampling import SEED, train_valid_split

# Fixed value: a quarter of the conversations are the trusted pairs.
TRUSTED_SHARE = 0.25


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def table_stamp(spark: SparkSession, sf_dir: str, name: str) -> tuple[int, int, int]:
    """Bytes, files and time of the last change of a table's folder or file; another stamp means other data."""
    path = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(sf_dir, f"{name}.parquet"))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    size = fs.getContentSummary(path)
    return size.getLength(), size.getFileCount(), fs.getFileStatus(path).getModificationTime()


def compound_key(outer: str, inner: str) -> Column:
    """One key of two numbers, whatever their size: ``outer:inner``, the inner one filled up to six digits."""
    return F.format_string("%d:%06d", F.col(outer).cast("long"), F.col(inner).cast("long"))


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence pairs: a user turn (``deu``) and the assistant turn after it (``nds``).

    Expressed as an equi-join on ``(conv_id, turn + 1)`` rather than a
    ``lead`` window, so a very long conversation does not land in one task.
    """
    conv = read_table(spark, sf_dir, "conversations")
    u = conv.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("deu"))
    a = conv.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("nds"))
    return (u.join(a, ["conv_id", "turn"], "inner")
            .select(F.lit("conversations").alias("source"), compound_key("conv_id", "turn").alias("pair_id"),
                    F.col("conv_id").alias("pos"), "deu", "nds"))


def trusted_conversations(spark: SparkSession, sf_dir: str, share: float = TRUSTED_SHARE) -> DataFrame:
    """A seeded exact ``share`` of the conversations (hash of seed and ``conv_id``)."""
    conv = read_table(spark, sf_dir, "conversations").select("conv_id").filter(F.col("conv_id").isNotNull()).distinct()
    split = train_valid_split(conv, ["conv_id"], SEED, share, salt="trusted")
    return split.filter(F.col("split") == "valid").select("conv_id")


def with_roles(spark: SparkSession, sf_dir: str, pairs: DataFrame) -> DataFrame:
    """Adds ``trusted``: the pair belongs to a trusted conversation; all others are candidates."""
    t = trusted_conversations(spark, sf_dir).select(F.col("conv_id").alias("_cid"), F.lit(True).alias("_t"))
    p = pairs.withColumn("_cid", F.col("pos"))
    return join_small(p, t, ["_cid"], "left") \
        .withColumn("trusted", F.coalesce(F.col("_t"), F.lit(False))).drop("_cid", "_t")


def trusted_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs of trusted conversations (``pairs`` from ``with_roles``)."""
    return pairs.filter(F.col("trusted"))


def candidate_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.filter(~F.col("trusted"))


def _docs_as_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.lit("documents").alias("source"), F.col("doc_id").alias("pair_id"),
                       F.col("doc_id").alias("pos"), "text")


def trusted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled ``quality = 1``: the trusted text table.  Only ids of labels are sent around, texts stay where they are."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    good = read_table(spark, sf_dir, "labels").filter(F.col("quality") == 1).select("doc_id")
    return _docs_as_text(join_small(docs, good, "doc_id", "left_semi"))


def candidate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without any label: the candidate text table, ordered by ``doc_id``."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labelled = read_table(spark, sf_dir, "labels").select("doc_id")
    return _docs_as_text(join_small(docs, labelled, "doc_id", "left_anti"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, line_no, line)`` for every line of every document (1-based)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.posexplode(split_lines("text")).alias("line_no", "line")) \
               .withColumn("line_no", F.col("line_no") + 1)


def test_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test set as ``(item_id, line_no, line)``, one row per benchmark line."""
    b = read_table(spark, sf_dir, "benchmark").select("item_id", "text")
    return b.select("item_id", F.posexplode(split_lines("text")).alias("line_no", "line")) \
            .withColumn("line_no", F.col("line_no") + 1)


def request_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Untranslated sentences: every user turn, ``(sent_id, deu)``."""
    conv = read_table(spark, sf_dir, "conversations")
    return conv.filter(F.col("role") == "user").select(
        compound_key("conv_id", "turn").alias("sent_id"),
        F.col("text").alias("deu"))
