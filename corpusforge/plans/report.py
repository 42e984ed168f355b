"""Run comparison report over round statistics (PIP3: WIN1, AGG10, JOI5, MTH3).

Input: a round-statistics table ``(run_id, round, total_samples, test_loss,
...)`` holding one or more runs.  Windows are partitioned by run, and a run
has one row per round (14 in the reference), so they stay small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_new_samples(stats: DataFrame) -> DataFrame:
    """WIN1: ``new_samples = total_samples.diff()`` per run; first round is null."""
    w = Window.partitionBy("run_id").orderBy("round")
    return stats.withColumn("new_samples", F.col("total_samples") - F.lag("total_samples").over(w))


def absorbed_shares(stats: DataFrame, n_candidates: int, first_rows: int = 6) -> DataFrame:
    """AGG10: percent of candidates absorbed, rounded half to even.

    ``pct_first``: sum of ``new_samples`` over the first ``first_rows`` rows
    (the original's "first 5 rounds" slice ``[0:6]``); ``pct_all_but_last``:
    over all rows except the last (``[:-1]``).  ``n_candidates`` is a count.
    """
    w = Window.partitionBy("run_id").orderBy("round")
    ns = with_new_samples(stats).withColumn("_rn", F.row_number().over(w)) \
        .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("run_id")))
    agg = ns.groupBy("run_id").agg(
        F.sum(F.when(F.col("_rn") <= first_rows, F.col("new_samples"))).alias("_first"),
        F.sum(F.when(F.col("_rn") < F.col("_n"), F.col("new_samples"))).alias("_but_last"))
    total = F.lit(float(n_candidates))
    return agg.select("run_id",
                      F.bround(100 * F.col("_first") / total, 0).alias("pct_first"),
                      F.bround(100 * F.col("_but_last") / total, 0).alias("pct_all_but_last"))


def compare_runs(stats: DataFrame, model_run: str, baseline_run: str) -> DataFrame:
    """JOI5 + MTH3: per round, model minus baseline, aligned on ``round``.

    Rounds present in only one run give nulls (full outer join).
    """
    m = stats.filter(F.col("run_id") == model_run).select(
        "round", F.col("test_loss").alias("m_loss"), F.col("total_samples").alias("m_samples"))
    b = stats.filter(F.col("run_id") == baseline_run).select(
        "round", F.col("test_loss").alias("b_loss"), F.col("total_samples").alias("b_samples"))
    j = m.join(b, "round", "full_outer")
    return j.select("round",
                    (F.col("m_loss") - F.col("b_loss")).alias("loss_delta"),
                    (100 * (F.col("m_loss") - F.col("b_loss")) / F.col("b_loss")).alias("loss_delta_pct"),
                    F.col("m_samples").alias("samples"))
