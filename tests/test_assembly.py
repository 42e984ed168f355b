"""Corpus assembly against a direct computation on a small fixture."""

from pyspark.sql import functions as F

from corpusforge.operators import subword
from corpusforge.plans import assembly


def test_assembly_invariants(spark):
    def pairs(source, rows):
        return spark.createDataFrame([(source, i, d, n) for i, (d, n) in enumerate(rows)],
                                     "source string, pair_id long, deu string, nds string")
    train = pairs("train", [("ik bün hier", "ich bin hier"), ("wo geiht dat", "wie geht es")] * 3)
    train = train.withColumn("pair_id", F.monotonically_increasing_id())
    book = pairs("wordbook", [("Huus", "Haus"), ("Boom", "Baum")])
    long_text = " ".join(["hier"] * 70)
    mono = pairs("mono", [("dat geiht", "das geht"), (long_text, long_text), ("nee", "nein")])
    a = assembly.assemble(train, book, mono, vocab_size=40, max_pieces=60)
    rows = a.corpus.collect()
    assert sorted(r["idx"] for r in rows) == list(range(len(rows)))
    ranks = {(x, y): r for r, x, y in a.deu_model.merges}
    keep = [d for d in ["dat geiht", long_text, "nee"]
            if sum(len(subword._apply_merges(subword.WORD_START + w, ranks)) for w in d.split()) < 60]
    assert a.n_mono_dropped == 3 - len(keep) == 1
    got = sorted((r["source"], r["deu"]) for r in rows)
    want = sorted([("train", r["deu"]) for r in train.collect()] + [("wordbook", "Huus"), ("wordbook", "Boom")]
                  + [("mono", d) for d in keep])
    assert got == want


def test_both_sides_are_trained_at_once(spark, monkeypatch):
    """Each training waits until the other one has begun, and gives the model that it gives alone."""
    import threading

    from corpusforge.operators import subword
    from corpusforge.plans import assembly

    rows = [("t", str(i), f"een twee drie {i % 3}", f"one two three {i % 2}") for i in range(12)]
    df = spark.createDataFrame(rows, "source string, pair_id string, deu string, nds string")
    begun = threading.Barrier(2, timeout=60)
    train = subword.train_bpe

    def both(*a, **k):
        begun.wait()
        return train(*a, **k)

    alone = [train(df, side, 30) for side in ("deu", "nds")]
    monkeypatch.setattr(subword, "train_bpe", both)
    made = assembly.assemble(df, None, None, vocab_size=30)
    for one, other in zip(alone, (made.deu_model, made.nds_model)):
        assert one.merges == other.merges and sorted(map(tuple, one.vocab.collect())) == sorted(map(tuple, other.vocab.collect()))
