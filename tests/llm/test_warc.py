"""Revisit resolution against a plain search, with long histories cut into stretches."""

import random

import pytest

from corpusforge.llm import warc

SCHEMA = "record_id long, url string, ts long, kind string, status int, headers map<string,string>, payload string"


def plain(records):
    full = [r for r in records if r[3] == "response" and r[4] == 200]
    out = {}
    for rid, url, ts, kind, status, headers, _ in records:
        if kind != "revisit":
            continue
        h = {k.lower(): v for k, v in (headers or {}).items()}
        before = [r for r in full if url is not None and ts is not None and r[1] == url and r[2] is not None and r[2] < ts]
        if not before:
            out[rid] = ("no earlier response", None, status, h)
            continue
        old = max(before, key=lambda r: (r[2], r[0]))
        o = {k.lower(): v for k, v in (old[5] or {}).items()}
        strip = lambda t: t[2:] if t and t[:2] in ("W/", "w/") else t
        if h.get("etag") and o.get("etag"):
            outcome = "resolved" if strip(h["etag"]) == strip(o["etag"]) else "validator mismatch"
        elif h.get("last-modified") and o.get("last-modified"):
            outcome = "resolved" if h["last-modified"] == o["last-modified"] else "validator mismatch"
        else:
            outcome = "no validator"
        if outcome == "resolved":
            h = {**o, **{k: v for k, v in h.items() if k in warc.PERMITTED}}
        out[rid] = (outcome, old[0], 200 if outcome == "resolved" else status, h)
    return out


@pytest.mark.parametrize("long", [10 ** 9, 50])
def test_against_plain_search(spark, monkeypatch, long):
    monkeypatch.setattr(warc, "LONG_HISTORY", long)
    rng = random.Random(1)
    records = []
    for i in range(900):
        url = "example.org/hot/" if rng.random() < 0.5 else f"example.org/{rng.randrange(30)}/"
        kind = rng.choice(["response", "revisit", "revisit"])
        headers = {k: v for k, v in (("ETag", rng.choice(['"a"', 'W/"a"', '"b"', None])), ("Last-Modified", rng.choice(["m1", "m2", None])),
                                     ("Cache-Control", f"max-age={i}"), ("Content-Length", str(i)), ("X-Own", "x")) if v}
        records.append((i, url, rng.choice([rng.randrange(60), rng.randrange(10 ** 6)]), kind, 200 if kind == "response" else 304, headers, "p"))
    records += [(2000, None, 5, "revisit", 304, {}, "p"), (2001, "example.org/hot/", None, "revisit", 304, None, "p"),
                (2002, "example.org/hot/", 10 ** 9, "revisit", 304, {"Last-Modified": "m1"}, "p"), (2003, "example.org/hot/", 1, "response", 404, {}, "p")]
    out = warc.resolve_revisits(spark.createDataFrame(records, SCHEMA)).collect()
    assert {r.record_id: (r.outcome, r.refers_to, r.status, dict(r.headers)) for r in out} == plain(records)
    assert len({r.outcome for r in out}) == 4


def test_canonical_urls(spark):
    same = ["http://www.Example.org/a/b/?utm_source=x&b=2&a=1#top", "https://example.org:443/a/b?a=1&b=2", "HTTP://example.org:80/a/b/?a=1&b=2&ref=z",
            "http://user@example.org/a/b?b=2&a=1"]
    rows = spark.createDataFrame([(u,) for u in [*same, "http://example.org:8080/a/b?a=1&b=2", "not a url", None, ""]], "u string")
    got = [r[0] for r in rows.select(warc.canonical_url(rows["u"])).collect()]
    assert got[:4] == ["example.org/a/b/?a=1&b=2"] * 4 and got[4] == "example.org:8080/a/b/?a=1&b=2" and got[5:] == ["not a url", None, ""]


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert warc.resolve_revisits(empty).count() == 0
    twice = spark.createDataFrame([(1, "http://e.org/", 1, "response", 200, {"ETag": '"a"'}, "p"), *[(2, "http://e.org", 2, "revisit", 304, {"etag": '"a"'}, "p")] * 2], SCHEMA)
    assert [(r.outcome, r.refers_to) for r in warc.resolve_revisits(twice).collect()] == [("resolved", 1)] * 2
    pages = spark.createDataFrame([(None, None, None), (3, "http://e.org/x", "")], "page_id long, url string, html string")
    assert warc.captures(pages).count() == 8
