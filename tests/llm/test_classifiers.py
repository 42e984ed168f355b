"""Quality and toxicity: restored words, held-out accuracy, edges; the pipeline against plain stages."""

import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from cases import EDGES
from corpusforge.llm import decontaminate, quality, toxicity, words
from corpusforge.llm.common import read

MID = "/root/testdata/sf0.01"


def auc(score, y):
    rank = np.argsort(np.argsort(score)) + 1.0
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize("module, label, parts, held, least", [(quality, "quality", 5, 0, 0.95), (toxicity, "toxic", 4, 2, 0.7)])
def test_held_out_accuracy(spark, module, label, parts, held, least):
    out = module.score(read(spark, MID, "documents"), read(spark, MID, "labels")).collect()
    known = {r.doc_id: r[label] for r in read(spark, MID, "labels").collect()}
    assert len(out) == 1000 and all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == held) for r in out)
    test = [(r.score, known[r.doc_id]) for r in out if r.held_out and r.doc_id in known]
    assert auc(np.array([s for s, _ in test]), np.array([y for _, y in test])) > least


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_edges(spark, docs_of, module, label):
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    assert {r.score for r in module.score(docs_of(EDGES), none).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(1, 9)] + [(4, None), (None, 0)], f"doc_id long, {label} int")
    out = module.score(docs_of(EDGES), one).collect()
    assert len(out) == len(EDGES) and {r.held_out for r in out if r.doc_id is None} == {True} and min(r.score for r in out) > 0.5
    assert module.score(docs_of([]), one).count() == 0


@pytest.fixture(scope="module")
def decoder(spark):
    docs = read(spark, MID, "documents")
    return toxicity.Decoder(toxicity.log_model(toxicity.gram_counts(docs)))


@pytest.mark.parametrize("span, word", [("1d10t", "idiot"), ("i d i o t", "idiot"), ("w0rthles5", "worthless"), ("clooown", "clown"), ("p.a.t.h.e.t.i.c", "pathetic"),
                                        ("w-o-r-t-h-l-e-s-s", "worthless"), ("id*ot", "idiot"), ("stuuupid", "stupid")])
def test_restored_words(decoder, span, word):
    assert decoder.restore(span) == word


@pytest.mark.parametrize("text, out", [("a worthles5.", "a worthless."), ("w0rthles5, too", "worthless, too"), ("scu* here", "scum here"), ("idio+", "idiot"), ("idio+.", "idiot."),
                                       ("id***t", "idiot"), ("path****c", "pathetic"), ('"$tupid"', '"stupid"'), ("$tup1d?", "stupid?"),
                                       ("What? Yes! Well-known words* and 100%", "What? Yes! Well-known words* and 100%")])
def test_look_alikes_and_masks_at_the_end(decoder, text, out):
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    assert toxicity.restored(raw, np.array([0, len(raw)]), decoder)[0].tobytes().decode() == out


def test_three_spaced_letters_are_read(decoder):
    raw = np.frombuffer("see t h e man; 1 2 3".encode(), dtype=np.uint8)
    assert [raw[a:b].tobytes() for a, b in toxicity.suspicious(raw, np.array([0, len(raw)]))] == [b"t h e"]
    assert toxicity.restored(raw, np.array([0, len(raw)]), decoder)[0].tobytes() == b"see the man; 1 2 3"


def test_only_suspicious_spans_change(decoder):
    text = "Plain words, 42 of them; it's 10:30. A 1d10t and s c u m here é è."
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    data, offsets = toxicity.restored(raw, np.array([0, len(raw)]), decoder)
    assert data.tobytes().decode().replace("idiot", "1d10t").replace("scum", "s c u m") == text and offsets[-1] == len(data)
    assert toxicity.suspicious(np.zeros(0, dtype=np.uint8), np.array([0])) == []


def test_other_letters_stay(docs_of):
    decoder = toxicity.Decoder(toxicity.log_model(toxicity.gram_counts(docs_of([(1, "blödmann идиот crème l'été " * 50)]))))
    for span, out in [("blödm4nn", "blödmann"), ("blödma*n", "blödmann"), ("blöödmann", "blödmann"), ("ид1идиот", "ид1идиот"), ("crèm3", "crème"), ("l'ét€m4", "l'ét€m4")]:
        assert decoder.restore(span) == out or out == span and "?" not in decoder.restore(span)


def test_word_hashes():
    texts = ["Ab ab, ABC abc 12!! é", "", "x" * 5000 + " " + "x" * 5000, "ab"]
    raw = [t.encode() for t in texts]
    w = words.split(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]), words.text_classes())
    spans = [(int(d), b"".join(raw)[s:s + n]) for d, s, n in zip(w.doc, w.start, w.length)]
    assert [b for d, b in spans if d == 0] == [b"Ab", b"ab", b",", b"ABC", b"abc", b"12", b"!!", "é".encode()]
    codes = dict(zip(w.code.tolist(), (b.lower() for _, b in spans)))
    assert len(codes) == len({b.lower() for _, b in spans}) and len({c for c, (_, b) in zip(w.code.tolist(), spans) if b.lower() == b"ab"}) == 1


def test_pipeline_stages(spark):
    """Each stage against a plain version on its own input."""
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    sf = "/root/testdata/sf0.001"
    scores = quality.score(docs, read(spark, sf, "labels"))
    good = {r.doc_id for r in scores.collect() if r.score >= 0.3}
    one = corpus_pipeline.good_quality(spark, docs, sf)
    assert {r.doc_id for r in one.collect()} == good and one.columns == docs.columns
    best = {}
    for r in one.collect():
        best[r.text or ""] = max(best.get(r.text or "", -1), r.doc_id)
    two = corpus_pipeline.exact_copies(spark, one, sf)
    assert sorted(r.doc_id for r in two.collect()) == sorted(best.values())
    four = corpus_pipeline.uncontaminated(spark, two, sf)
    bad = {r.doc_id for r in decontaminate.contamination(two, read(spark, sf, "benchmark")).collect() if r.contaminated}
    assert {r.doc_id for r in four.collect()} == {r.doc_id for r in two.collect()} - bad
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE"]


def test_memory_of_the_neighbour_counts():
    """Little beside the counts themselves, whatever the batch holds; the counts do not depend on how it is cut."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 3000, 400)) for _ in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    tracemalloc.start()
    got = quality.neighbours(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak - got.nbytes < 30e6
    assert np.array_equal(got, quality.neighbours(iter([batch.slice(i, 1) for i in range(len(texts))])))
    assert got.sum() == 4 * 799 * len(texts)  # letters and digits are words of their own
