"""Spelling normalisation by dictionary and edit-distance autocorrection (JOI8, AGG11, PIP9, PIP10).

A spelling dictionary is a table ``(variant, preferred)``.  ``case_variants``
derives one from token counts: within tokens that are equal after
lower-casing, the most frequent form (ties: smallest) is preferred and the
other forms are its variants.

Autocorrection finds, for a token outside the vocabulary, the most frequent
vocabulary word within Levenshtein distance 1 (ties: smallest word).  It
uses deletion keys: two words are at distance <= 1 exactly when one equals
the other with one character deleted, or both equal after deleting the
character at the same position.  Joining on those keys only produces pairs
that are real matches, so no candidate list is generated and filtered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.operators.lookup import map_arrays, share
from corpusforge.session import materialize


def case_variants(counts: DataFrame, token_col: str = "token", freq_col: str = "freq") -> DataFrame:
    """``(variant, preferred)`` from ``(token, freq)``: spelling that differs only by case."""
    key = F.lower(F.col(token_col))
    pref = counts.groupBy(key.alias("_k")).agg(
        F.min_by(F.col(token_col), F.struct((-F.col(freq_col)).alias("nf"), F.col(token_col))).alias("preferred"))
    return (counts.withColumn("_k", key).join(pref, "_k")
            .filter(F.col(token_col) != F.col("preferred"))
            .select(F.col(token_col).alias("variant"), "preferred"))


def normalise_tokens(df: DataFrame, key_cols: list[str], tokens_col: str, dictionary: DataFrame,
                     out_col: str = "normalised") -> DataFrame:
    """JOI8: replace every known variant by its preferred form, in place, keep token order.

    Adds ``out_col`` (array without null tokens), ``n_tokens`` and ``n_changed``.
    """
    rows = df.select(*key_cols, F.col(tokens_col).alias("_a"))
    out = map_arrays(rows, "_a", share(dictionary, "variant", "preferred"), "_w", keep=True, key_cols=key_cols, changed_col="_n")
    return out.select(*key_cols, F.col("_w").alias(out_col), F.size("_w").cast("long").alias("n_tokens"), F.col("_n").alias("n_changed"))


def changed_share(normalised: DataFrame) -> DataFrame:
    """AGG11: share of words replaced (one row)."""
    return normalised.agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_changed").alias("n_changed")) \
        .withColumn("share_changed", F.round(F.col("n_changed") / F.col("n_tokens"), 6))


_DELETES = ("transform(sequence(1, char_length({c})), "
            "i -> named_struct('i', i, 'k', concat(substring({c}, 1, i - 1), substring({c}, i + 1))))")


def _deletions(df: DataFrame, col: str) -> DataFrame:
    return df.select("*", F.explode(F.expr(_DELETES.format(c=col))).alias("_d")) \
             .select("*", F.col("_d.i").alias("i"), F.col("_d.k").alias("k")).drop("_d")


def autocorrect(tokens: DataFrame, vocab: DataFrame, token_col: str = "token",
                word_col: str = "token", freq_col: str = "freq") -> DataFrame:
    """PIP10: ``(token, correction, freq)`` for tokens outside ``vocab`` that have a
    vocabulary word within edit distance 1."""
    v = vocab.select(F.col(word_col).alias("w"), F.col(freq_col).alias("wf")).filter(F.col("w").isNotNull())
    # the vocabulary and the unknown tokens each feed three joins: compute them once
    v = materialize(v)
    unknown = materialize(tokens.select(F.col(token_col).alias("t")).distinct()
                          .join(v.select(F.col("w").alias("t")), "t", "left_anti"))
    td = _deletions(unknown, "t")
    wd = _deletions(v, "w")
    # token minus one character == word (token has an extra character)
    m1 = td.select("t", "k").join(v, td["k"] == v["w"]).select("t", "w", "wf")
    # word minus one character == token (token misses a character)
    m2 = unknown.join(wd.select("w", "wf", "k"), unknown["t"] == wd["k"]).select("t", "w", "wf")
    # same position deleted on both sides (one substitution)
    m3 = td.select("t", "i", "k").join(wd.select("w", "wf", "i", "k"), ["i", "k"]).select("t", "w", "wf")
    cand = m1.unionByName(m2).unionByName(m3)
    return cand.groupBy("t").agg(
        F.min_by(F.struct("w", "wf"), F.struct((-F.col("wf")).alias("nf"), F.col("w"))).alias("_b")) \
        .select(F.col("t").alias("token"), F.col("_b.w").alias("correction"), F.col("_b.wf").alias("freq"))
