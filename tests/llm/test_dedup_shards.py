"""Exact dedup and sharding: edges, ties, brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusforge.llm import exact_dedup, sharding

from cases import EDGES


@pytest.mark.parametrize("hash_all", [True, False])
def test_exact_duplicates(docs_of, hash_all):
    rows = EDGES + [(20 + i, "x" * (i % 3)) for i in range(9)] + [(40, "same start " * 20 + "a"), (41, "same start " * 20 + "b"), (42, "same start " * 20 + "a")]
    out = exact_dedup.exact_duplicates(docs_of(rows), hash_all=hash_all).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    assert len(out) == len(rows)
    want = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for n, i in enumerate(sorted(ids, key=lambda x: (x != keep, x is None, x or 0))):
            sha = hashlib.sha256(t.encode()).hexdigest() if hash_all or len(ids) > 1 else None
            want[(i, keep, len(ids), n == 0, sha)] += 1
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in out)
    if not hash_all:  # texts of one prefix and length are hashed though they differ
        got = Counter({(*k[:4], k[4] if k[2] > 1 else None): 0 for k in got}) + Counter((*k[:4], k[4] if k[2] > 1 else None) for k in got.elements())
    assert got == want


def test_drop_exact_duplicates(docs_of):
    rows = EDGES + [(5, "other text")]
    out = exact_dedup.drop_exact_duplicates(docs_of(rows))
    assert out.columns == docs_of(rows).columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(
        [(2, ""), (3, " \n\t"), (5, "one"), (6, "a b c d e f g"), EDGES[8], EDGES[9], (5, "other text")])


def test_empty_tables(docs_of):
    assert exact_dedup.exact_duplicates(docs_of([])).count() == 0
    assert sharding.shard(docs_of([])).count() == 0


def test_shards(docs_of):
    rows = EDGES + [(100 + i, f"text {i % 300} " * (1 + i % 7)) for i in range(2100)]
    out = sharding.shard(docs_of(rows), 8).collect()
    assert len(out) == len(rows)
    size = Counter()
    slots, shards_of = defaultdict(list), defaultdict(set)
    for r in out:
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
        shards_of[(r.size, r.text_crc32)].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    assert Counter((r.size, r.text_crc32) for r in out) == texts
    assert all(len(s) == 1 for s in shards_of.values())


def test_pack_balances_all_dimensions():
    rng = np.random.default_rng(1)
    v = np.column_stack([rng.lognormal(0, 1, 4000), rng.lognormal(0, 1, 4000), np.ones(4000)])
    where = sharding.pack(v, 8)
    load = np.array([v[where == s].sum(axis=0) for s in range(8)])
    assert (load.max(axis=0) / load.mean(axis=0) < 1.02).all()


def test_oversized_group_is_cut(docs_of):
    out = sharding.shard(docs_of([(i, "hot text") for i in range(4000)] + [(10_000 + i, f"t{i}") for i in range(1000)]), 8).collect()
    size = Counter()
    for r in out:
        size[r.shard] += r.size
    assert max(size.values()) < 1.1 * sum(size.values()) / 8


def test_drops_keep_columns_of_any_name(docs_of):
    """Columns with the names that the operators use stay as they are, and texts of one id go or stay one by one."""
    from pyspark.sql import functions as F

    from corpusforge.llm import decontaminate, exact_dedup
    rows = [(1, "same text"), (2, "same text"), (2, "same text"), (2, "another text of the id"), (3, None), (4, ""), (None, "same text"), (None, "lonely"), (5, "own")]
    df = docs_of(rows)
    for name in ("_text_sha", "_bad", "_gone", "_row", "_sha", "_id", "_open", "text_sha256", "keep_id", "n", "sha"):
        df = df.withColumn(name, F.lit("mine"))
    kept = exact_dedup.drop_exact_duplicates(df)
    assert kept.columns == df.columns
    got = kept.collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(2, "same text"), (2, "another text of the id"), (4, ""), (None, "lonely"), (5, "own")], key=str)
    assert all(r[c] == "mine" for r in got for c in ("_text_sha", "_bad", "_row", "sha"))
    items = df.sparkSession.createDataFrame([(1, "same text")], "item_id long, text string")
    clean = decontaminate.drop_contaminated(df, items)
    assert clean.columns == df.columns and sorted((r.text or "" for r in clean.collect())) == ["", "", "another text of the id", "lonely", "own"]
