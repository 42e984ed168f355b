"""Decontamination and the n-gram join against brute force."""

import random
import re

import pytest

from corpusforge.llm import components, decontaminate, ngram_join, words

from cases import EDGES

ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_contamination(docs, items):
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = split.findall((t or "").translate(ASCII_LOWER))
        n = min(13, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[a:a + n]), set()).add(str(i))
    out = []
    for i, t in docs:
        w = split.findall((t or "").translate(ASCII_LOWER))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if (x := tuple(w[a:a + n])) in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[x]
        out.append((i, len(w), len(hit), len(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_contamination(spark, docs_of):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(40)] + ["Äpfel", "ÉTÉ"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 8, 13, 14, 40])))) for i in range(12)] + [(3, None), (77, "the same " * 30)]
    docs = list(EDGES)
    for i in range(60):
        parts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60)))]
        if i % 2:
            w = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(0, len(w) - 5))
            parts.insert(rng.randint(0, 1), "-".join(w[a:a + rng.randint(10, 30)]).upper())
        docs.append((100 + i, " ".join(parts)))
    docs += [(300, "THE same, " * 25), (301, "x " * 200 + "the same " * 7)]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.contamination(docs_of(docs), table).collect()), key=str)
    assert got == brute_contamination(docs, items)
    assert any(x[4] for x in got)
    kept = decontaminate.drop_contaminated(docs_of(docs), table)
    assert kept.columns == docs_of(docs).columns
    assert sorted((r.doc_id or -1 for r in kept.collect())) == sorted(x[0] or -1 for x in brute_contamination(docs, items) if not x[4])


def test_contamination_empty(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.contamination(docs_of([(1, "a b")]), none).collect()] == [0]
    assert decontaminate.contamination(docs_of([]), none).count() == 0


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER)) if x]
    return frozenset() if not w else frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def near_copies(rng, n_families, size, words_in):
    rows, at = [], 1000
    for f in range(n_families):
        base = [f"f{f}w{rng.randrange(500)}" for _ in range(rng.randint(*words_in))]
        for _ in range(rng.randint(1, size)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10 ** 6)}"
            rows.append((at, " ".join(w[:len(w) - rng.randint(0, len(w) // 8)])))
            at += 1
    return rows


@pytest.mark.parametrize("case", ["mixed", "one large family", "shared passage"])
def test_components_match_brute_force(docs_of, case):
    rng = random.Random(len(case))
    if case == "mixed":
        rows = EDGES + near_copies(rng, 40, 4, (3, 120))
    elif case == "one large family":  # buckets of more than HOT nodes
        rows = near_copies(rng, 1, 150, (80, 80)) + near_copies(rng, 5, 3, (10, 40))[3:]
    else:
        passage = " ".join(f"p{i}" for i in range(30))
        rows = [(i, passage + " " + " ".join(f"u{rng.randrange(10 ** 6)}" for _ in range(rng.randint(3, 60)))) for i in range(150)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_components(docs_of(rows)).collect()), key=str)
    assert got == brute_components(rows)


def test_short_copies_among_longer_rows_with_the_same_passage(docs_of):
    """Nodes met only in large buckets, whose smallest node is of an unlike size, are still linked."""
    rng = random.Random(1)
    passage = " ".join(f"p{i}" for i in range(64))

    def own(n):
        return " ".join(f"u{rng.randrange(10 ** 9)}" for _ in range(n))
    rows = [(i, passage + " " + own(rng.randint(36, 44))) for i in range(900)] + [(2000 + i, passage + " " + own(8)) for i in range(4)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_components(docs_of(rows)).collect()), key=str)
    assert got == brute_components(rows)


def test_blocks_hand_on_rows_by_member_not_by_pair(docs_of, monkeypatch):
    """Rows that share a passage just short of a link: no table of pairs that only their sketches bring together."""
    rng = random.Random(7)
    passage = " ".join(f"p{i}" for i in range(84))

    def own(n):
        return " ".join(f"u{rng.randrange(10 ** 9)}" for _ in range(n))
    rows = [(i, passage + " " + own(16)) for i in range(300)]
    rows += [(1000 + i, t + " more") for i, t in rows[50:53]] + [(2000 + i, passage + " " + own(3)) for i in range(3)]
    made, stored = {}, ngram_join.stored

    def counted(df, name):
        out = stored(df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out
    monkeypatch.setattr(ngram_join, "stored", counted)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_components(docs_of(rows)).collect()), key=str)
    assert got == brute_components(rows)
    assert max(made["join-checks"], made.get("join-blocks", 0), made["join-edges"]) <= 10 * len(rows), made


def test_keys_and_sketches_at_once_match_one_by_one():
    """The first keys of a document, and distances of pairs of sketches of mixed lengths."""
    import numpy as np
    rng = np.random.default_rng(9)
    doc = np.sort(rng.integers(0, 40, 1500))
    key, late, most = rng.integers(0, 2 ** 63, 1500).astype(np.uint64) * np.uint64(2), rng.random(1500) < 0.3, rng.integers(0, 60, 40)
    got = ngram_join._leading(doc, key, late, most)
    for d in range(40):
        order = sorted(np.flatnonzero(doc == d).tolist(), key=lambda i: (late[i], key[i]))
        assert set(np.flatnonzero(got & (doc == d)).tolist()) == set(order[:most[d] + 1])
    sets = [np.unique(words.mix(rng.integers(0, 400, int(rng.integers(1, 700))).astype(np.uint64))) for _ in range(60)]
    a, b = [ngram_join.sketch(x) for x in sets[:30]], [ngram_join.sketch(x) for x in sets[30:]]
    assert ngram_join.sketch_distances(a, b).tolist() == [ngram_join.sketch_distance(x, y) for x, y in zip(a, b)]


def test_links_at_the_threshold_share_a_key():
    """Pairs at the smallest similarity allowed are always candidates, for any sizes."""
    import numpy as np
    rng = np.random.default_rng(3)
    none = np.zeros(0, dtype=np.uint64)
    for _ in range(400):
        union = int(rng.integers(1, 200))
        common = -(-3 * union // 4)
        pool = np.unique(words.mix(rng.integers(0, 2 ** 62, union + 8).astype(np.uint64)))[:union]
        rng.shuffle(pool)
        only_a = int(rng.integers(0, union - common + 1))
        a, b = np.sort(np.concatenate([pool[:common], pool[common:common + only_a]])), np.sort(np.concatenate([pool[:common], pool[common + only_a:]]))
        keys = []
        for s in (a, b):
            d, k = ngram_join.block_keys(np.zeros(len(s), dtype=np.int64), s, np.array([len(s)]), none)
            keys.append(set(k.tolist()))
        assert keys[0] & keys[1], (len(a), len(b), common)
        assert ngram_join.sketch_distance(ngram_join.sketch(a), ngram_join.sketch(b)) <= len(set(a.tolist()) ^ set(b.tolist()))


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(60)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    got = {r.node: r.comp for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}
    assert ngram_join.similar_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_drop_similar_goes_by_row(spark, docs_of):
    """A kept or dropped id never takes another text of the same id with it; null ids and clashing columns are handled."""
    base = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(base)), (5, " ".join(base + ["tail"])), (5, "an unrelated text of the same id"), (5, "an unrelated text of the same id"),
            (None, " ".join(["head"] + base)), (None, "alone without any id"), (7, None), (8, ""), (1, " ".join(base))]
    df = docs_of(rows)
    for name in ("_gone", "text_digest", "row", "n_shingles", "component_id"):
        df = df.withColumn(name, df["source"])
    kept = ngram_join.drop_similar(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(1, " ".join(base)), (1, " ".join(base)), (5, rows[2][1]), (5, rows[2][1]), (None, rows[5][1]), (7, None), (8, "")], key=str)


def test_sketches_in_blocks_match_one_by_one():
    """Distances of blocks of sketches, folded where lengths differ, and none near enough left out."""
    import numpy as np
    rng = np.random.default_rng(8)

    def table(n):
        sets = [np.unique(words.mix(rng.integers(0, 400, int(rng.integers(1, 400))).astype(np.uint64))) for _ in range(n)]
        return sets, ngram_join._Sketches(np.arange(n), np.array([len(s) for s in sets]), rng.integers(0, 3, n), [ngram_join.sketch(s) for s in sets])
    for _ in range(5):
        (x, a), (y, b) = table(40), table(30)
        i, j, d = a.near(b, 75, 100)
        got = dict(zip(zip(i.tolist(), j.tolist()), d.tolist()))
        for p in range(40):
            for q in range(30):
                s, t = len(x[p]), len(y[q])
                apart = ngram_join.sketch_distance(ngram_join.sketch(x[p]), ngram_join.sketch(y[q]))
                near = 100 * min(s, t) >= 75 * max(s, t) and a.comp[p] != b.comp[q] and apart * 175 <= 25 * (s + t)
                assert ((p, q) in got) == near and (not near or got[p, q] == apart)
