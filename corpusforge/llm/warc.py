"""Resolution of not-modified revisit records against earlier full responses.

A revisit is joined as of its time with the latest earlier full response of the same
canonical URL.  Validators decide whether the two belong together, and the headers that a
304 response may update are merged into the stored ones.  Payloads stay where they are: the
result names the record that holds the payload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import broadcast_if_small, stored

# URLs with more records are cut into stretches of time.
LONG_HISTORY = 20_000
STRETCHES = 256
# So many URLs with a long history are broadcast at most.
LONG_URLS = 1000
# Headers of a 304 response that replace the stored ones; query parameters that only track.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
TRACKING = r"^(utm_[a-z]+|gclid|fbclid|ref)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.``, user and default port; path without trailing slashes; parameters sorted, those that track dropped; no scheme, no fragment."""
    pattern = r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?\s*$"
    scheme = F.lower(F.regexp_extract(url, pattern, 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(url, pattern, 2)), r"^[^@]*@", "")
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    host = F.regexp_replace(F.regexp_replace(host, r"\.(?=$|:)", ""), r"^www\.", "")
    path = F.concat(F.regexp_replace(F.regexp_extract(url, pattern, 3), "/+$", ""), F.lit("/"))
    params = F.array_sort(F.filter(F.split(F.regexp_extract(url, pattern, 4), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    query = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise("")
    return F.when(host != "", F.concat(host, path, query)).otherwise(F.trim(url))


def _header(headers: Column, name: str) -> Column:
    return F.trim(headers[name])


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit: ``record_id, url_key, ts, refers_to, response_ts, outcome, status, headers``.

    ``records`` has ``record_id, url, ts`` (microseconds, long), ``kind`` ('response' or 'revisit'), ``status``
    and ``headers`` (map of strings).  A full response is a 'response' with status 200.  The outcome is

    * ``resolved``: entity tags are equal (weakly), or one side has none and the modification dates are equal.  ``refers_to`` names the
      response, ``status`` is its status and ``headers`` are its headers, updated by the revisit's permitted ones;
    * ``validator mismatch``, ``no validator``: the latest earlier response is another version, or nothing says which; it is named all the same;
    * ``no earlier response``: none of the URL is strictly earlier (one of the same time is not), or URL or time is null.

    Unresolved revisits keep their own status and headers.  Header names are compared in lower case; null headers are
    none; of responses at the same time the largest ``record_id`` counts; repeated revisits are resolved alike; an empty table gives an empty
    result; other columns are ignored.
    """
    lower = F.map_from_entries(F.transform(F.array_distinct(F.transform(F.map_entries("headers"), lambda e: F.struct(F.lower(e["key"]).alias("key")))),
                                           lambda k: F.struct(k["key"].alias("key"), F.array_max(F.transform(F.filter(
                                               F.map_entries("headers"), lambda e: F.lower(e["key"]) == k["key"]), lambda e: e["value"])).alias("value"))))
    rows = stored(records.select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), F.col("ts").cast("long").alias("ts"), "kind", F.col("status").cast("int").alias("status"),
        F.coalesce(F.when(F.col("headers").isNotNull(), lower), F.create_map().cast("map<string,string>")).alias("headers"))
        .filter("kind = 'revisit' OR kind = 'response' AND status = 200"), "warc-rows")
    known = rows.filter("url_key IS NOT NULL AND ts IS NOT NULL")
    full = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "status", F.map_entries("headers").alias("headers")))
    known = known.withColumn("full", full)

    # long histories are cut where their quantiles lie, so that no task holds a whole one
    long = known.groupBy("url_key").count().filter(F.col("count") > LONG_HISTORY).select("url_key")
    long = stored(long, "warc-long")
    cuts = [i / STRETCHES for i in range(1, STRETCHES)]
    many = known.join(long, "url_key", "left_semi").groupBy("url_key").agg(F.percentile_approx("ts", cuts, 10_000).alias("cuts"))
    many = stored(many, "warc-cuts")
    many = broadcast_if_small(many, LONG_URLS)
    known = known.join(many, "url_key", "left").withColumn(
        "stretch", F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("ts"))), F.lit(0))).drop("cuts")
    before = Window.partitionBy("url_key", "stretch").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    found = known.withColumn("found", F.max("full").over(before)).filter("kind = 'revisit'")
    # what earlier stretches of a long history hand on
    earlier = Window.partitionBy("url_key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    handed = (known.join(long, "url_key", "left_semi").groupBy("url_key", "stretch").agg(F.max("full").alias("last"))
              .withColumn("handed", F.max("last").over(earlier)).select("url_key", "stretch", "handed"))
    found = found.join(handed, ["url_key", "stretch"], "left").withColumn("found", F.coalesce("found", "handed"))
    lost = rows.filter("kind = 'revisit' AND (url_key IS NULL OR ts IS NULL)")

    stored_headers = F.map_from_entries(F.col("found.headers"))
    tag, old_tag = (F.regexp_replace(_header(h, "etag"), "^[Ww]/", "") for h in (F.col("headers"), stored_headers))
    when, old_when = (_header(h, "last-modified") for h in (F.col("headers"), stored_headers))
    outcome = (F.when(F.col("found").isNull(), "no earlier response")
               .when(tag.isNotNull() & old_tag.isNotNull(), F.when(tag == old_tag, "resolved").otherwise("validator mismatch"))
               .when(when.isNotNull() & old_when.isNotNull(), F.when(when == old_when, "resolved").otherwise("validator mismatch"))
               .otherwise("no validator"))
    update = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    kept = F.map_filter(stored_headers, lambda k, v: ~F.array_contains(F.map_keys(update), k))
    out = found.withColumn("outcome", outcome)
    out = out.select("record_id", "url_key", "ts", F.col("found.record_id").alias("refers_to"), F.col("found.ts").alias("response_ts"), "outcome",
                     F.when(F.col("outcome") == "resolved", F.col("found.status")).otherwise(F.col("status")).alias("status"),
                     F.when(F.col("outcome") == "resolved", F.map_concat(kept, update)).otherwise(F.col("headers")).alias("headers"))
    id_type = rows.schema["record_id"].dataType
    return out.unionByName(lost.select(
        "record_id", "url_key", "ts", F.lit(None).cast(id_type).alias("refers_to"), F.lit(None).cast("long").alias("response_ts"),
        F.lit("no earlier response").alias("outcome"), "status", "headers"))


def captures(pages: DataFrame) -> DataFrame:
    """Capture records that the pages stand for: each page fetched four times, a day apart.

    The first fetch, and the third of every fifth page, are full responses; the others are
    revisits, by varied spellings of the URL, with the entity tag or the modification date of
    the version last fetched, a weak or an outdated tag, or neither.
    """
    day = 86_400_000_000
    page = F.coalesce(F.col("page_id"), F.lit(-1))
    fetch = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("digest"), F.length(F.coalesce("html", F.lit(""))).alias("n"),
                         F.explode(F.array(*(F.lit(i) for i in range(4)))).alias("k"))
    version = F.when((F.col("k") >= 2) & (page % 5 == 0), 2).otherwise(1)
    full = (F.col("k") == 0) | (F.col("k") == 2) & (page % 5 == 0)
    tag = F.concat(F.lit('"'), F.substring("digest", 1, 12), F.lit("-"), version, F.lit('"'))
    shown = (F.when(~full & (page % 7 == 3), F.lit('"outdated"')).when(~full & (page % 3 == 1), F.concat(F.lit("W/"), tag))
             .when(page % 4 != 2, tag))
    changed = F.when(page % 6 != 4, F.concat(F.lit("day "), page % 1000 + version))
    headers = F.map_filter(F.create_map(
        F.lit("ETag"), shown, F.lit("Last-Modified"), changed, F.lit("Date"), F.concat(F.lit("day "), page % 1000 + F.col("k")),
        F.lit("Cache-Control"), F.concat(F.lit("max-age="), F.col("k") * 60), F.lit("Content-Type"), F.when(full, "text/html"),
        F.lit("Content-Length"), F.when(full, F.col("n").cast("string")).otherwise("0")), lambda k, v: v.isNotNull())
    spelling = F.when(F.col("k") == 1, F.concat("url", F.when(F.col("url").contains("#"), "").otherwise("#again"))) \
        .when(F.col("k") == 3, F.regexp_replace("url", "^http://", "https://")).otherwise(F.col("url"))
    return fetch.select((F.col("page_id") * 4 + F.col("k")).alias("record_id"), spelling.alias("url"),
                        ((page % 1000 + F.col("k")) * day).alias("ts"), F.when(full, "response").otherwise("revisit").alias("kind"),
                        F.when(full, 200).otherwise(304).alias("status"), headers.alias("headers"))
