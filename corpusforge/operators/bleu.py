"""Corpus BLEU over token lists or characters (AGG8, AGG9).

One reference per row.  For n = 1..4 the clipped n-gram matches and the
hypothesis n-gram totals are pooled over the corpus; brevity penalty
``exp(1 - r/c)`` when the hypotheses are shorter than the references.
A zero precision gives BLEU 0.0 (no smoothing).

Clipping is within a row, so rows are counted where they are and only sums are exchanged.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.session import map_arrow

MAX_N = 4


def char_units(text) -> Column:
    """AGG9: a string as a list of characters."""
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(t, ""), lambda x: F.length(x) > 0)


def row_counts(hyp: list, ref: list, max_n: int) -> tuple[list[int], list[int]]:
    """Clipped matches and totals of a row's n-grams, for n from 1."""
    m, t = [], []
    for n in range(1, max_n + 1):
        of_hyp, of_ref = (Counter(zip(*(x[i:] for i in range(n)))) for x in (hyp, ref))
        m.append(sum(min(c, of_ref[g]) for g, c in of_hyp.items() if g in of_ref))
        t.append(max(0, len(hyp) - n + 1))
    return m, t


def corpus_bleu(df: DataFrame, key_cols: list[str], hyp_col: str, ref_col: str,
                max_n: int = MAX_N) -> DataFrame:
    """One row: ``bleu, bp, hyp_len, ref_len, m1..m4, t1..t4``.

    N-grams are clipped row by row, so they are counted where the row is, in Arrow batches, one n at a time; only each
    task's sums are aggregated and no n-gram is shuffled.  Missing hypotheses and references count as empty.
    """
    names = ["hyp_len", "ref_len", *[f"m{n}" for n in range(1, max_n + 1)], *[f"t{n}" for n in range(1, max_n + 1)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * len(names)
        for b in batches:
            for hyp, ref in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                hyp, ref = hyp or [], ref or []
                m, t = row_counts(hyp, ref, max_n)
                total = [x + y for x, y in zip(total, (len(hyp), len(ref), *m, *t))]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in total], names)

    sums = map_arrow(df.select(F.col(hyp_col).alias("h"), F.col(ref_col).alias("r")), run, ", ".join(f"{n} bigint" for n in names))
    out = sums.agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in names])
    logp = sum(F.log(F.col(f"m{n}") / F.greatest(F.col(f"t{n}"), F.lit(1))) for n in range(1, max_n + 1)) / max_n
    any_zero = F.greatest(*[F.col(f"m{n}") == 0 for n in range(1, max_n + 1)])
    bp = F.when(F.col("hyp_len") > F.col("ref_len"), F.lit(1.0)) \
          .when(F.col("hyp_len") == 0, F.lit(0.0)) \
          .otherwise(F.exp(1 - F.col("ref_len") / F.col("hyp_len")))
    return out.select(
        F.round(F.when(any_zero, F.lit(0.0)).otherwise(bp * F.exp(logp)), 6).alias("bleu"),
        F.round(bp, 6).alias("bp"), "hyp_len", "ref_len",
        *[F.col(f"m{n}") for n in range(1, max_n + 1)], *[F.col(f"t{n}") for n in range(1, max_n + 1)])
