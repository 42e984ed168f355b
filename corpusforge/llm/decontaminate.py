"""Benchmark decontamination by winnowing (DataFrame functions only).

A window is ``WINDOW`` consecutive words of a benchmark item (the whole item if it
is shorter).  Of every ``WINDOW - GRAM + 1`` consecutive hashes of ``GRAM`` words the
smallest is a fingerprint, on both sides, so a text that holds a window shares at
least one fingerprint with the item.  Fingerprints are joined; each hit is extended to the
windows around it, whose words are compared; windows that match cover words.

All results depend on a text alone, so the work is keyed by the text's MD5.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import broadcast_if_small, stored, without

WINDOW = 13
GRAM = 8
# What separates words once A-Z is lower-cased.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text; only A-Z is lower-cased."""
    ascii_only = F.octet_length(text) == F.length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.filter(F.split(low, _BETWEEN), lambda w: w != "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it for each element of an array."""
    return F.transform(F.array(value), body)[0]


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _numbers(first: Column | int, last: Column) -> Column:
    first = F.lit(first) if isinstance(first, int) else first
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _gram_size(window: int) -> int:
    return max(1, window - (WINDOW - GRAM))


def _grams(hashes: Column, window: int) -> Column:
    """Hashes of all runs of ``_gram_size(window)`` words."""
    k = _gram_size(window)
    return F.transform(_numbers(1, F.size(hashes) - (k - 1)), lambda i: F.xxhash64(F.slice(hashes, i, k), F.lit(window)))


def _fingerprints(hashes: Column, window: int) -> Column:
    """The smallest gram hash of each window."""
    n = window - _gram_size(window) + 1
    return _let(_grams(hashes, window), lambda grams: F.array_distinct(
        F.transform(_numbers(1, F.size(grams) - (n - 1)), lambda i: F.array_min(F.slice(grams, i, n)))))


def matched_windows(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
                    item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``text_key, first, size, item``: every item window that occurs in a text, from word ``first`` (1-based) on.

    ``text_key`` is the MD5 of the text; equal texts are reported once.
    """
    text = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(F.unhex(F.md5("text")).alias("text_key"), "text")
    words = items.select(F.col(item_col).alias("item"), words_of(F.coalesce(F.col(item_text_col), F.lit(""))).alias("w")) \
        .withColumn("size", F.least(F.lit(window), F.size("w"))).filter("size > 0")
    lists = stored(words, "bench-words")
    sizes = sorted(r["size"] for r in lists.select("size").distinct().collect())  # at most ``window`` rows
    item_windows = stored(lists.withColumn("i", F.explode(_numbers(1, F.size("w") - F.col("size") + 1)))
                          .select("item", "size", F.array_join(F.slice("w", F.col("i"), F.col("size")), " ").alias("words")).distinct(), "bench-windows")
    if not sizes:
        empty = item_windows.select(F.lit(None).cast("binary").alias("text_key"), F.lit(0).alias("first"), "size", "item")
        return empty.filter("false")

    def marks_of(words: Column, chosen: list[int]) -> Column:
        return _let(_hashes(words), lambda h: F.concat(*(_fingerprints(h, n) for n in chosen)))

    marks = None
    for n in sizes:
        own = lists.filter(F.col("size") == n).select(F.explode(marks_of(F.col("w"), [n])).alias("mark"))
        marks = own if marks is None else marks.unionByName(own)
    marks = broadcast_if_small(stored(marks.distinct(), "bench-marks"))
    # 1. texts that share a fingerprint with an item
    own = text.select("text_key", F.explode(marks_of(words_of(F.col("text")), sizes)).alias("mark"))
    suspects = stored(own.join(marks, "mark", "left_semi").select("text_key").distinct(), "suspects")
    # 2. in these, the words around every gram that is a fingerprint
    texts = text.join(broadcast_if_small(suspects), "text_key", "left_semi")
    found = None
    for n in sizes:
        k = _gram_size(n)

        def around(w: Column, n: int = n, k: int = k) -> Column:
            """Each gram's hash, the windows that hold it and their words."""
            return _let(_hashes(w), lambda h: F.transform(_grams(h, n), lambda g, i: F.struct(
                g.alias("mark"), F.greatest(F.lit(1), i + 1 - (n - k)).alias("first"), F.least(i + 1, F.size(w) - (n - 1)).alias("last"),
                F.slice(w, F.greatest(F.lit(1), i + 1 - (n - k)), F.lit(2 * n - k)).alias("near"))))

        spread = texts.select("text_key", F.inline(_let(words_of(F.col("text")), lambda w: around(w))))
        hits = spread.filter("last >= first").join(marks, "mark", "left_semi")
        # 3. extension: every window that the gram lies in, by its words
        spans = hits.select("text_key", "near", F.col("first").alias("from"), F.explode(_numbers(F.col("first"), F.col("last"))).alias("first")) \
            .select("text_key", "first", F.lit(n).alias("size"), F.array_join(F.slice("near", F.col("first") - F.col("from") + 1, F.lit(n)), " ").alias("words"))
        found = spans if found is None else found.unionByName(spans)
    return found.join(broadcast_if_small(item_windows), ["size", "words"]).select("text_key", "first", "size", "item").distinct()


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", window: int = WINDOW, least_share: int = 20) -> DataFrame:
    """``id_col, n_words, n_hit, n_items, items_sha256, contaminated``, one row per input row.

    A word is hit if it lies in an occurrence of an item's window; a text is contaminated
    if ``least_share * n_hit >= n_words`` and a word is hit.  Null and empty texts have no words; an item
    without words has no window; items with a null id hit words but are not listed;
    repeated documents and items count as they stand (an item id once); empty tables on either side
    give no hits; null document ids pass through; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(text)).alias("text_key"),
                       F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long").alias("n_words"))
    found = stored(matched_windows(docs, items, text_col, item_col, item_text_col, window), "matched-windows")
    before = Window.partitionBy("text_key").orderBy("first", "size").rowsBetween(Window.unboundedPreceding, -1)
    covered = (found.select("text_key", "first", "size").distinct()
               .withColumn("done", F.coalesce(F.max(F.col("first") + F.col("size")).over(before), F.lit(0)))
               .groupBy("text_key").agg(F.sum(F.greatest(F.lit(0), F.col("first") + F.col("size") - F.greatest("done", "first"))).alias("n_hit")))
    listed = (found.select("text_key", F.col("item").cast("string").alias("item")).distinct()
              .groupBy("text_key").agg(F.count("item").alias("n_items"), F.sort_array(F.collect_list("item")).alias("items")))
    result = stored(covered.join(listed, "text_key").select(
        "text_key", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256")), "contaminated-texts")
    zero = F.lit(0).cast("long")
    return rows.join(result, "text_key", "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", zero) > 0).alias("any")).withColumn(
            "contaminated", F.col("any") & (least_share * F.col("n_hit") >= F.col("n_words"))).drop("any")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without contaminated texts, all columns kept."""
    marks = contamination(docs.select(F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("id"), F.col(text_col).alias("text")),
                          items, "id", "text")
    bad = stored(marks.filter("contaminated").select("id").distinct(), "contaminated")
    return without(docs, bad, lambda c: F.unhex(F.md5(F.coalesce(c(text_col), F.lit("")))) == F.col("_gone_id"))
