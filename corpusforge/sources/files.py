"""File sources and sinks (SRC1-SRC5, SNK1-SNK8).

Readers take an explicit schema (no inference on a cluster).  CSV options
match what pandas writes: a header line, the row index as first column,
quotes doubled inside quoted fields, newlines allowed inside quotes.
Writers never overwrite silently unless asked; run outputs are partitioned
by ``run_id`` and ``round`` so later reads prune by partition, and a round that
is run again replaces its own partition.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

PAIR_FILE_SCHEMA = StructType([
    StructField("pair_id", LongType(), True),
    StructField("deu", StringType(), True),
    StructField("nds", StringType(), True),
])

KEYED_PAIR_FILE_SCHEMA = StructType([StructField(c, StringType(), True) for c in ("pair_id", "deu", "nds")])
# White space at the ends of a field is text, and quotes are doubled.
_WRITE = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
          "emptyValue": '""'}


def _csv(spark: SparkSession, schema: StructType, sep: str = ","):
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("quote", '"').option("escape", '"').option("sep", sep).option("mode", "FAILFAST"))


def read_pairs(spark: SparkSession, path: str, schema: StructType = PAIR_FILE_SCHEMA) -> DataFrame:
    """SRC1: CSV with header; the first column is the row id."""
    return _csv(spark, schema).csv(path)


def read_pairs_tsv(spark: SparkSession, path: str, schema: StructType = PAIR_FILE_SCHEMA) -> DataFrame:
    """SRC2: tab-separated variant."""
    return _csv(spark, schema, "\t").csv(path)


def read_positional(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """SRC3: header skipped, column 1 dropped, column 2 -> ``src``, column 3 -> ``trg``."""
    schema = StructType([StructField(f"_c{i}", StringType(), True) for i in range(3)])
    return _csv(spark, schema, sep).csv(path).toDF("id", "src", "trg").drop("id")


def sides_by_position(df: DataFrame) -> DataFrame:
    """SRC4: a frame whose id is data column 0; sides are columns 1 and 2."""
    return df.select(F.col(df.columns[1]).alias("deu"), F.col(df.columns[2]).alias("nds"))


def write_pairs_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write ``(pair_id, deu, nds)`` the way pandas does (header, index first)."""
    df.select("pair_id", "deu", "nds").write.mode(mode).options(**_WRITE).csv(path)


def write_pairs_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.select("pair_id", "deu", "nds").write.mode(mode).options(sep="\t", **_WRITE).csv(path)


def snapshot(df: DataFrame, base: str, run_id: str, round_i: int, name: str) -> str:
    """SRC5 / SNK1 / SNK2: copy an input next to a run's results.

    A retried round replaces its own copy; those of other runs and rounds stay.
    """
    path = os.path.join(base, name)
    df.write.mode("overwrite").parquet(os.path.join(path, f"run_id={run_id}", f"round={round_i}"))
    return path


def read_run_table(spark: SparkSession, base: str, name: str, run_id: str | None = None,
                   round_i: int | None = None) -> DataFrame:
    """SNK8 read side: partition pruning on ``run_id`` / ``round`` replaces path building."""
    df = spark.read.parquet(os.path.join(base, name))
    if run_id is not None:
        df = df.filter(F.col("run_id") == run_id)
    if round_i is not None:
        df = df.filter(F.col("round") == round_i)
    return df


def export_side(df: DataFrame, col: str, path: str) -> None:
    """SNK3: one text column, no header, no quoting (subword training input)."""
    df.select(F.col(col).cast("string")).write.mode("errorifexists").text(path)


def append_round_stats(stats: DataFrame, path: str, round_i: int) -> None:
    """SNK4: one statistics row per round; a retried round replaces its row.  The round is a partition column."""
    stats.drop("round").write.mode("overwrite").parquet(os.path.join(path, f"round={round_i}"))


def loss_summary_wide(losses: DataFrame, rounds: list[int], key_cols: list[str]) -> DataFrame:
    """SNK5: long ``(key, round, loss)`` -> one column per round (pivot with known values)."""
    return losses.groupBy(*key_cols).pivot("round", rounds).agg(F.first("loss"))


def write_translations(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """SNK6: ``(key, deu, ai_nds)``."""
    df.write.mode(mode).parquet(path)


def save_vocab(vocab: DataFrame, path: str) -> None:
    """SNK7: the vocabulary is a table."""
    vocab.write.mode("errorifexists").parquet(path)


def load_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
