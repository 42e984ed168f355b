"""Scalar text, array and arithmetic helpers (STR*, ARR*, FLT1, MTH*).

All helpers map Column -> Column and use built-in expressions only, so they
stay inside whole-stage code generation.  The regular expressions below are
written so that Java's engine (Spark) and RE2 (the SQL oracle) read them the
same way: whitespace is an explicit character list instead of ``\\s``, whose
meaning differs between engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour)
# ---------------------------------------------------------------------------
# Characters that Python's ``\s`` matches in ``str`` patterns, which is what
# the reference's splitters use.
WHITESPACE_CHARS = (
    r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
WHITESPACE = "[" + WHITESPACE_CHARS + "]"
# Low German tokenizer: a space is put before each of these characters.
NDS_PUNCT = r'([.,"\-;*:\(\)%?!&#])'
# Word-length splitter of the untranslated-sentence filter.  In the original
# class ``!-"`` is a range that covers only ``!`` and ``"``, so the hyphen is
# *not* a separator; the class below lists the same set.
LENGTH_SPLIT = "[" + WHITESPACE_CHARS + r""".,;:?!"']+"""
# Stand-in for the German rule tokenizer: letters (with inner apostrophes and
# hyphens), digit runs, or any other single non-space character.
DE_TOKEN = (r"([\p{L}][\p{L}\p{M}'’\-]*|\p{N}+|[^" + WHITESPACE_CHARS
            + r"\p{L}\p{N}])")
# Special tokens, in vocabulary id order 0..3.
UNK, PAD, SOS, EOS = "<unk>", "<pad>", "<sos>", "<eos>"
SPECIALS = (UNK, PAD, SOS, EOS)
# Subword vocabularies: unk, bos, eos ids and the padding id.
SUBWORD_UNK_ID, SUBWORD_BOS_ID, SUBWORD_EOS_ID, SUBWORD_PAD_ID = 0, 1, 2, 3
# Subword word-start marker.
WORD_START = "▁"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokenize_nds(text, lower: bool = False) -> Column:
    """STR1: space before punctuation, split on single whitespace, drop empties."""
    t = _c(text)
    if lower:
        t = F.lower(t)
    spaced = F.regexp_replace(t, NDS_PUNCT, " $1")
    return F.filter(F.split(spaced, WHITESPACE), lambda x: F.length(x) > 0)


def tokenize_de(text, lower: bool = False) -> Column:
    """STR2: Unicode word / number / punctuation tokens."""
    t = _c(text)
    if lower:
        t = F.lower(t)
    return F.regexp_extract_all(t, F.lit(DE_TOKEN), 0)


def join_tokens(tokens, sep: str = " ") -> Column:
    """STR4: ``' '.join(tokens)``."""
    return F.array_join(_c(tokens), sep)


def word_count(text) -> Column:
    """FLT1: number of parts after the regex split (trailing empty part counts)."""
    return F.size(F.split(_c(text), LENGTH_SPLIT, -1))


def add_specials(tokens, sos: str = SOS, eos: str = EOS) -> Column:
    """ARR1: ``[sos] + tokens + [eos]``."""
    return F.concat(F.array(F.lit(sos)), _c(tokens), F.array(F.lit(eos)))


def add_specials_if_missing(ids, bos: int = SUBWORD_BOS_ID, eos: int = SUBWORD_EOS_ID) -> Column:
    """ARR1, subword form: add both ends only when *both* ends lack them."""
    a = _c(ids)
    missing = (F.element_at(a, 1) != bos) & (F.element_at(a, -1) != eos)
    return F.when((F.size(a) == 0) | missing,
                  F.concat(F.array(F.lit(bos)), a, F.array(F.lit(eos)))).otherwise(a)


def drop_last(tokens) -> Column:
    """ARR2 ``[:-1]``."""
    a = _c(tokens)
    return F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))


def drop_first(tokens) -> Column:
    """ARR2 ``[1:]``."""
    a = _c(tokens)
    return F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))


def pad_to(tokens, width, pad) -> Column:
    """ARR3: right-pad to ``width`` with ``pad``."""
    a = _c(tokens)
    return F.concat(a, F.array_repeat(F.lit(pad), F.greatest(_c(width) - F.size(a), F.lit(0))))


def pad_mask(ids, pad) -> Column:
    """ARR3: ``id != pad``."""
    return F.transform(_c(ids), lambda x: x != F.lit(pad))


def perplexity(loss) -> Column:
    """MTH1."""
    return F.exp(_c(loss))


def elapsed_minutes(seconds) -> Column:
    """MTH2 ``int(e / 60)``."""
    return F.floor(_c(seconds) / 60).cast("int")


def elapsed_seconds(seconds) -> Column:
    """MTH2 ``int(e - 60 * mins)``."""
    s = _c(seconds)
    return F.floor(s - 60 * F.floor(s / 60)).cast("int")


def split_lines(text) -> Column:
    """Split a text into lines (used for line-level leakage checks)."""
    return F.split(_c(text), "\n", -1)
