"""Reproducible splits, samples and shuffles (SMP1-SMP5, WIN2, WIN5).

Randomness is a hash of ``seed`` and the row key, never a task-local RNG, so
results do not depend on partitioning or on task retries.  A row's hash is
``md5(seed ':' [round ':'] source ':' pair_id)``; its first 15 hex digits
give a 60-bit integer that orders rows the same way as the full digest
(ties broken by the digest and then the key).  Exact-size picks use a
distributed order statistic on that number instead of a global sort.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.operators.ordering import _le_tuple, dense_index, first_n, order_statistic

# Fixed values from the reference's runs.
SEED = 1234
VALID_SHARE = 0.1
WINDOW_BASE = 500
ACCEPT_SHARE = 0.25


def hash_key(seed: int, key_cols: list[str], salt: str | None = None) -> Column:
    parts = [F.lit(str(seed))]
    if salt is not None:
        parts.append(F.lit(str(salt)))
    parts += [F.col(c).cast("string") for c in key_cols]
    return F.md5(F.concat_ws(":", *parts))


def with_rank_hash(df: DataFrame, seed: int, key_cols: list[str], salt: str | None = None) -> DataFrame:
    h = hash_key(seed, key_cols, salt)
    return (df.withColumn("_hash", h)
              .withColumn("_h60", F.conv(F.substring("_hash", 1, 15), 16, 10).cast("long")))


def train_valid_split(df: DataFrame, key_cols: list[str], seed: int = SEED,
                      valid_share: float = VALID_SHARE, salt: str | None = None) -> DataFrame:
    """SMP1: adds ``split`` = 'valid' for ceil(share * n) rows, else 'train'."""
    n = df.count()
    n_valid = math.ceil(valid_share * n)
    hd = with_rank_hash(df, seed, key_cols, salt)
    if n_valid == 0:
        return hd.withColumn("split", F.lit("train")).drop("_hash", "_h60")
    cut = order_statistic(hd, "_h60", n_valid, ["_hash"] + key_cols)
    return (hd.withColumn("split", F.when(_le_tuple(["_h60", "_hash"] + key_cols, cut), "valid")
                          .otherwise("train"))
              .drop("_hash", "_h60"))


def sample_n(df: DataFrame, n: int, key_cols: list[str], seed: int = SEED,
             salt: str | None = None) -> DataFrame:
    """SMP3: exactly ``n`` rows without replacement; raises when n > rows."""
    total = df.count()
    if n > total:
        raise ValueError(f"cannot take a sample of {n} rows from {total}")
    hd = with_rank_hash(df, seed, key_cols, salt)
    if n == 0:
        return hd.limit(0).drop("_hash", "_h60")
    return first_n(hd, n, "_h60", ["_hash"] + key_cols).drop("_hash", "_h60")


def accept_count(window_size: int, share: float = ACCEPT_SHARE) -> int:
    """SMP4: ``int(share * size)`` (truncation)."""
    return int(share * window_size)


def window_size(round_i: int, base: int = WINDOW_BASE) -> int:
    """WIN2: candidate window of round i holds ``base * 2**i + 1`` rows (inclusive slice)."""
    return base * 2 ** round_i + 1


def candidate_window(candidates: DataFrame, round_i: int, order_col: str = "pos",
                     tie_cols: list[str] | None = None, base: int = WINDOW_BASE) -> DataFrame:
    """WIN2: the first ``base * 2**i + 1`` remaining candidates in file order, or all."""
    return first_n(candidates, window_size(round_i, base), order_col,
                   tie_cols if tie_cols is not None else ["source", "pair_id"])


def shuffle_reindex(df: DataFrame, key_cols: list[str], seed: int = SEED,
                    index_col: str = "idx") -> DataFrame:
    """SMP5 + WIN5: random permutation by key hash, then dense 0-based index."""
    hd = with_rank_hash(df, seed, key_cols)
    return dense_index(hd, ["_h60", "_hash"] + key_cols, index_col).drop("_hash", "_h60")
