"""Count language models trained and applied as Spark aggregations (PIP6a, AGG5, AGG6).

The selection loop needs "a model that gives a loss per row".  Here the
model is a table of token counts: training is ``explode`` + ``groupBy``,
scoring is a join of exploded tokens with that table followed by a per-row
mean of negative log probabilities.

Unigram, add-one:  p(w) = (c(w) + 1) / (N + V + 1)
    N training tokens, V distinct training tokens, the extra 1 is the unknown word.
Bigram, add-one:   p(w | u) = (c(u, w) + 1) / (c(u) + V' + 1)
    over ``<sos> tokens <eos>`` (teacher forcing pairs, WIN7); c(u) counts u as a
    history and V' is the number of distinct tokens that follow one (training
    tokens plus ``<eos>``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.functions.text import EOS, SOS, add_specials
from corpusforge.operators.joins import broadcast_limit, fits_broadcast, row_bytes
from corpusforge.session import materialize

LOSS_DECIMALS = 6


@dataclass
class UnigramModel:
    counts: DataFrame  # (token, c)
    n_tokens: int
    n_types: int
    broadcastable: bool | None = None   # decided once per model, reused by every scoring call
    frequent: DataFrame | None = None   # of counts that are too large for that, the highest, once they are asked for

    @property
    def denominator(self) -> float:
        return float(self.n_tokens + self.n_types + 1)


@dataclass
class BigramModel:
    pairs: DataFrame    # (prev, token, c)
    history: DataFrame  # (prev, h)
    n_types: int


def _measured(counts: DataFrame) -> UnigramModel:
    """The model of materialised ``counts``: tokens, types and bytes in one pass."""
    r = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), row_bytes(counts).alias("b")).first()
    return UnigramModel(counts, int(r["n"] or 0), int(r["v"] or 0), int(r["b"] or 0) <= broadcast_limit(counts))


def fit_unigram(df: DataFrame, tokens_col: str = "tokens") -> UnigramModel:
    counts = materialize(df.select(F.explode(tokens_col).alias("token"))
                         .groupBy("token").agg(F.count(F.lit(1)).alias("c")))
    return _measured(counts)


def update_unigram(model: UnigramModel, extra: DataFrame, tokens_col: str = "tokens") -> UnigramModel:
    """Incremental refit: counts of the old set plus counts of the added rows."""
    add = extra.select(F.explode(tokens_col).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("c"))
    counts = materialize(model.counts.unionByName(add).groupBy("token").agg(F.sum("c").alias("c")))
    return _measured(counts)


def without_rows(model: UnigramModel, rows: DataFrame, tokens_col: str = "tokens") -> UnigramModel:
    """The model of the set without ``rows``, all of which are in it; tokens that are left nowhere are no types."""
    less = rows.select(F.explode(tokens_col).alias("token")).groupBy("token").agg((-F.count(F.lit(1))).alias("c"))
    counts = materialize(model.counts.unionByName(less).groupBy("token").agg(F.sum("c").alias("c")).filter(F.col("c") > 0))
    return _measured(counts)


def _mean_nll(per_token: DataFrame, key_cols: list[str], n_col: str, nll) -> DataFrame:
    """Per row: token count, summed and mean negative log probability."""
    return (per_token.groupBy(*key_cols)
            .agg(F.sum(F.col(n_col)).alias("n_tok"),
                 F.sum(F.col(n_col) * nll).alias("sum_nll"))
            .withColumn("loss", F.round(F.col("sum_nll") / F.col("n_tok"), LOSS_DECIMALS)))


def score_unigram(model: UnigramModel, df: DataFrame, key_cols: list[str],
                  tokens_col: str = "tokens") -> DataFrame:
    """AGG5: per-row mean negative log probability; rows without tokens get null."""
    toks = df.select(*key_cols, F.explode_outer(tokens_col).alias("token"))
    nll = -F.log((F.coalesce(F.col("c"), F.lit(0)) + 1) / F.lit(model.denominator))
    counts = model.counts
    if model.broadcastable is None:
        model.broadcastable = fits_broadcast(counts)
    if model.broadcastable:
        joined = toks.join(F.broadcast(counts), "token", "left") \
                     .withColumn("_n", F.when(F.col("token").isNotNull(), F.lit(1)))
        return _mean_nll(joined, key_cols, "_n", nll)
    # tokens of the most frequent types, nearly all there are, find their counts where they are and leave one sum for each row
    if model.frequent is None:
        model.frequent = _frequent(counts)
    if model.frequent is None:  # not even one power of two fits
        per = toks.groupBy(*key_cols, "token").agg(
            F.count(F.col("token")).alias("_n"))
        joined = per.join(counts, "token", "left") \
                    .withColumn("_n", F.when(F.col("_n") > 0, F.col("_n")))
        return _mean_nll(joined, key_cols, "_n", nll)
    known = -F.log((F.col("_h") + 1) / F.lit(model.denominator))
    rare = F.when(F.col("_h").isNull(), F.col("token"))
    per = (toks.join(F.broadcast(model.frequent.withColumnRenamed("c", "_h")), "token", "left")
           .groupBy(*key_cols, rare.alias("_rare")).agg(F.count("token").alias("_n"), F.sum(known).alias("_s")))
    # sums are not looked up: no null key that one task would get, but the row's own key, which matches nothing
    own = F.concat_ws(":", *[F.col(c).cast("string") for c in key_cols])
    per = per.withColumn("_look", F.col("_rare").isNotNull()).withColumn("token", F.coalesce("_rare", own))
    joined = per.join(counts.withColumn("_look", F.lit(True)), ["token", "_look"], "left")
    value = F.when(F.col("_look"), F.col("_n") * nll).otherwise(F.col("_s"))
    return (joined.groupBy(*key_cols).agg(F.sum(F.when(F.col("_n") > 0, F.col("_n"))).alias("n_tok"), F.sum(value).alias("sum_nll"))
            .withColumn("loss", F.round(F.col("sum_nll") / F.col("n_tok"), LOSS_DECIMALS)))


def _frequent(counts: DataFrame) -> DataFrame | None:
    """The types of ``counts`` with the highest counts, as many powers of two as fit the broadcast limit; None if none does."""
    level = F.floor(F.log2(F.col("c"))).cast("int")
    sizes = counts.groupBy(level.alias("level")).agg(row_bytes(counts).alias("b")).collect()  # at most 63 rows
    least, room = 64, broadcast_limit(counts)
    for r in sorted(sizes, key=lambda r: -r["level"]):
        room -= r["b"]
        if room < 0:
            break
        least = r["level"]
    return counts.filter(level >= least) if least < 64 else None


def bigram_tokens(df: DataFrame, key_cols: list[str], tokens_col: str) -> DataFrame:
    """WIN7: ``(prev, token)`` pairs over ``<sos> tokens <eos>``."""
    seq = add_specials(F.col(tokens_col), SOS, EOS)
    return (df.select(*key_cols, seq.alias("_s"))
            .select(*key_cols, F.explode_outer(F.arrays_zip(
                F.slice("_s", 1, F.size("_s") - 1).alias("prev"),
                F.slice("_s", 2, F.size("_s") - 1).alias("token"))).alias("_b"))
            .select(*key_cols, F.col("_b.prev").alias("prev"), F.col("_b.token").alias("token")))


def fit_bigram(df: DataFrame, tokens_col: str = "tokens") -> BigramModel:
    bi = bigram_tokens(df, [], tokens_col)
    pairs = materialize(bi.groupBy("prev", "token").agg(F.count(F.lit(1)).alias("c")))
    history = materialize(pairs.groupBy("prev").agg(F.sum("c").alias("h")))
    # distinct tokens that can follow (training tokens plus <eos>)
    v = pairs.select("token").distinct().count()
    return BigramModel(pairs, history, int(v))


def score_bigram(model: BigramModel, df: DataFrame, key_cols: list[str],
                 tokens_col: str = "tokens") -> DataFrame:
    bi = bigram_tokens(df, key_cols, tokens_col).withColumn("_n", F.lit(1))
    j = bi.join(model.pairs, ["prev", "token"], "left").join(model.history, "prev", "left")
    nll = -F.log((F.coalesce("c", F.lit(0)) + 1) / (F.coalesce("h", F.lit(0)) + F.lit(model.n_types + 1)))
    return _mean_nll(j, key_cols, "_n", nll)


def mean_of_rounded(col: str, decimals: int = LOSS_DECIMALS):
    """Mean of values already rounded to ``decimals`` places, summed as exact integers
    (units of ``10**-decimals``), so the result does not depend on summation order."""
    scale = float(10 ** decimals)
    return F.sum(F.round(F.col(col) * scale).cast("long")) / F.count(col) / scale


def split_loss(scored: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """AGG6: token-weighted mean inside a batch, unweighted mean over batches.

    ``scored`` has one row per example with ``sum_nll`` and ``n_tok``; the
    result is one row ``(n_batches, split_loss, token_loss)``, where
    ``token_loss`` is the plain token-weighted mean over the whole split.
    """
    per_batch = scored.groupBy(batch_col).agg(
        F.sum("sum_nll").alias("_s"), F.sum("n_tok").alias("_n"))
    return per_batch.agg(
        F.count(F.lit(1)).alias("n_batches"),
        F.round(F.avg(F.col("_s") / F.col("_n")), LOSS_DECIMALS).alias("split_loss"),
        F.round(F.sum("_s") / F.sum("_n"), LOSS_DECIMALS).alias("token_loss"))
