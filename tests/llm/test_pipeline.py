"""The whole pipeline against plain versions of its stages, and on empty, null and repeated rows."""

import hashlib
import os
import tempfile

import numpy as np
import public_tokenizers

import corpus_pipeline
from corpusforge.llm import quality, queries
from corpusforge.llm.common import read

from cases import EDGES
from test_joins import brute_components, brute_contamination

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def folder_of(spark, docs, labels, items):
    base = tempfile.mkdtemp(prefix="cf-pipeline-")
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in docs], DOCS).write.parquet(os.path.join(base, "documents.parquet"))
    spark.createDataFrame(labels, LABELS).write.parquet(os.path.join(base, "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(os.path.join(base, "benchmark.parquet"))
    return base


def plain(docs, rejected, items):
    """``docs`` without rejected texts, exact copies (the largest id stays), near copies (the smallest stays) and contaminated texts, encoded."""
    import tiktoken
    rows = [(i, t) for i, t in docs if (t or "") not in rejected]
    largest = {}
    for i, t in rows:
        if (t or "") not in largest or (i is not None and (largest[t or ""] is None or i > largest[t or ""])):
            largest[t or ""] = i
    rows = sorted({(i, t) for i, t in rows if largest[t or ""] == i}, key=str)
    places = {}
    for (i, t), (j, n, c) in zip(sorted(rows, key=lambda r: str((r[0],))), sorted(brute_components(rows), key=lambda r: str((r[0],)))):
        assert i == j
        places[i, t] = (n, c)
    rows = [(i, t) for i, t in rows if not (places[i, t][0] > 0 and places[i, t][1] is not None and places[i, t][1] != i)]
    bad = {x[0] for x in brute_contamination(rows, items) if x[4]}
    from corpusforge.llm.bpe_codec import read_ranks
    ranks = read_ranks(public_tokenizers.path(queries.VOCABULARY))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for i, t in rows:
        if i not in bad:
            ids = enc.encode_ordinary(t or "")
            sha = lambda b: hashlib.sha256(b).hexdigest()
            out.append((i, len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha((t or "").encode())))
    return sorted(out, key=str)


def test_run_matches_plain_stages(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted((tuple(r) for r in corpus_pipeline.run(spark, sf).collect()), key=str)
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    scores = quality.score(docs, labels).filter(f"score < {queries.THRESHOLD}").select("text_key")
    bad = {r.text_key for r in scores.collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rejected = {t or "" for _, t in rows if hashlib.md5((t or "").encode()).hexdigest() in bad}
    items = [(r.item_id, r.text) for r in read(spark, sf, "benchmark").collect()]
    assert got == plain(rows, rejected, items) and 0 < len(got) < len(rows)


def test_run_on_edges(spark):
    """Null and empty texts, null ids, repeated rows; without labels nothing is learnt and nothing rejected."""
    docs = [r for r in EDGES if r[0] is not None or r[1] is not None] + [(9, "the same words " * 30)]
    base = folder_of(spark, docs, [], [(1, "the same words " * 10), (2, None)])
    got = sorted((tuple(r) for r in corpus_pipeline.run(spark, base).collect()), key=str)
    assert got == plain(docs, set(), [(1, "the same words " * 10), (2, None)])


def test_run_on_empty_tables(spark):
    assert corpus_pipeline.run(spark, folder_of(spark, [], [], [])).count() == 0


def test_stages_keep_the_columns(spark):
    base = folder_of(spark, [(1, "a b c"), (2, "a b c")], [(1, 1, 0)], [])
    docs = read(spark, base, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, base).columns == docs.columns
