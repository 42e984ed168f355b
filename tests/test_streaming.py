"""The request stream restarts from its checkpoint: files already processed are not
translated again, new files are, and each micro-batch writes its own output once."""

import os
import tempfile

from pyspark.sql import functions as F

from corpusforge.streaming import requests as rs


def test_stream_restarts_from_checkpoint(spark):
    base = tempfile.mkdtemp(prefix="cf-stream-")
    inbox, sink, ckpt = (os.path.join(base, d) for d in ("inbox", "sink", "ckpt"))
    best = spark.createDataFrame([("Moin", "Hallo"), ("Welt", "Welt!")], "e string, best string")
    schema = "sent_id long, deu string"
    spark.createDataFrame([(1, "Moin Welt"), (2, "Moin")], schema).coalesce(1) \
        .write.mode("append").parquet(inbox)

    def run():
        q = rs.translate_stream(rs.request_stream(spark, inbox, spark.read.parquet(inbox).schema), best,
                                sink, checkpoint=ckpt)
        q.awaitTermination()
        return {r["sent_id"]: (r["ai_nds"], r["batch_id"]) for r in spark.read.parquet(sink).collect()}

    first = run()
    assert {k: v[0] for k, v in first.items()} == {1: "Hallo Welt!", 2: "Hallo"}
    spark.createDataFrame([(3, "Welt Moin unbekannt")], schema).coalesce(1).write.mode("append").parquet(inbox)
    second = run()
    assert {k: v[0] for k, v in second.items()} == {1: "Hallo Welt!", 2: "Hallo", 3: "Welt! Hallo unbekannt"}
    # rows of the first batch were not reprocessed: their batch id is unchanged
    assert second[1][1] == first[1][1] and second[3][1] != first[1][1]
    assert spark.read.parquet(sink).groupBy("sent_id").count().filter(F.col("count") > 1).count() == 0
