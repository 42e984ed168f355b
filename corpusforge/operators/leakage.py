"""Test-set leakage: match, removal and probe (JOI1, JOI2, FLT5, PIP5).

The test set is matched on *all* text columns; pandas merges match a missing
value to a missing value, so removal uses the null-safe ``<=>`` comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.operators.joins import fits_broadcast, join_small
from corpusforge.operators.sampling import SEED, sample_n
from corpusforge.session import materialize


def leak_matches(df: DataFrame, test: DataFrame, text_cols: list[str]) -> DataFrame:
    """JOI1: inner equi-join on the text columns; one output row per match."""
    t = test.select(*text_cols)
    return join_small(df, t, text_cols, "inner")


def remove_leaks(df: DataFrame, test: DataFrame, text_cols: list[str]) -> DataFrame:
    """JOI2: drop every row that equals a test row on all text columns (nulls equal)."""
    t = test.select(*[F.col(c).alias(f"_t_{c}") for c in text_cols]).distinct()
    t = materialize(t)  # measured and then joined
    cond = None
    for c in text_cols:
        e = F.col(c).eqNullSafe(F.col(f"_t_{c}"))
        cond = e if cond is None else cond & e
    return df.join(F.broadcast(t) if fits_broadcast(t) else t, cond, "left_anti")


def leak_probe(df: DataFrame, test: DataFrame, text_col: str, test_key: list[str],
               seed: int = SEED, regex: bool = False) -> DataFrame:
    """FLT5: take one seeded test row and find candidates containing its text.

    ``regex=True`` reproduces the original behaviour (the text is used as a
    regular expression); the default treats it as a literal.
    """
    probe = sample_n(test, 1, test_key, seed).select(text_col).first()[0]
    if probe is None:
        return df.limit(0)
    if regex:
        return df.filter(F.col(text_col).rlike(probe))
    return df.filter(F.col(text_col).contains(F.lit(probe)))
