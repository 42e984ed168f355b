from pyspark.sql import functions as F

from corpusforge.operators import batching


def test_length_batches_and_padding(spark):
    rows = [("s", i, list(range(1 + i % 5))) for i in range(130)]
    df = spark.createDataFrame(rows, "source string, pair_id long, ids array<int>")
    b = batching.length_batches(df, ["source", "pair_id"], F.size("ids"), batch_size=64)
    got = b.collect()
    sizes = {}
    for r in got:
        sizes.setdefault(r["batch_id"], []).append(r["batch_len"])
    assert sorted(len(v) for v in sizes.values()) == [2, 64, 64]
    # batches follow length order: every length in batch k is <= every length in batch k + 1
    ks = sorted(sizes)
    assert all(max(sizes[a]) <= min(sizes[b]) for a, b in zip(ks, ks[1:]))
    assert all(r["width"] == max(sizes[r["batch_id"]]) for r in got)
    p = batching.pad_batch(b, "ids", 3).collect()
    for r in p:
        assert len(r["padded"]) == r["width"]
        assert r["padded"][:len(r["ids"])] == r["ids"] and set(r["padded"][len(r["ids"]):]) <= {3}
        assert r["mask"] == [x != 3 for x in r["padded"]]
