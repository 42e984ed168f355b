"""Translate a stream of requests (PIP8).

Each request is a row ``(sent_id, deu)``; translation is stateless, so every
micro-batch runs the batch translator (``lexical.translate``) through
``foreachBatch`` and writes its result under ``batch_id=<n>`` with
overwrite, which makes a retried batch idempotent.  The file source and the
checkpoint folder make the query restartable after a failure.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corpusforge.functions.text import join_tokens, tokenize_de
from corpusforge.operators import lexical
from corpusforge.session import checkpoint_dir


def request_stream(spark: SparkSession, folder: str, schema: StructType, file_glob: str | None = None,
                   max_files: int | None = None) -> DataFrame:
    """File stream over ``folder`` (new files are picked up as they land)."""
    r = spark.readStream.schema(schema)
    if file_glob:
        r = r.option("pathGlobFilter", file_glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(folder)


def table_stream(spark: SparkSession, path: str, schema: StructType, max_files: int | None = None) -> DataFrame:
    """File stream over a table's own path: a folder of part files, or one file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return request_stream(spark, path, schema, max_files=max_files)
    return request_stream(spark, os.path.dirname(path), schema, file_glob=os.path.basename(path), max_files=max_files)


def read_translations(spark: SparkSession, sink: str) -> DataFrame:
    """What ``translate_stream`` has written; empty before the first batch."""
    return spark.read.parquet(sink)


def translate_stream(requests: DataFrame, best: DataFrame, sink: str, checkpoint: str | None = None,
                     key: str = "sent_id", text_col: str = "deu", available_now: bool = True):
    """Start the streaming translation; returns the ``StreamingQuery``.

    ``best`` is the (static, checkpointed) best-translation table.
    """
    spark = requests.sparkSession
    # an empty part gives the sink its schema before the first batch, and on an empty stream
    spark.createDataFrame([], StructType([requests.schema[key], requests.schema[text_col], StructField("ai_nds", StringType())])) \
        .write.mode("overwrite").parquet(os.path.join(sink, "batch_id=-1"))
    checkpoint = checkpoint or os.path.join(checkpoint_dir(spark), "streams", hashlib.md5(sink.encode()).hexdigest())

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        toks = batch.select(key, text_col, tokenize_de(text_col).alias("_toks"))
        out = lexical.translate(best, toks, [key], "_toks")
        res = toks.select(key, text_col).join(out, key, "left") \
                  .select(key, text_col, join_tokens("hyp").alias("ai_nds"), F.lit(batch_id).alias("batch_id"))
        res.write.mode("overwrite").parquet(os.path.join(sink, f"batch_id={batch_id}"))

    w = requests.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start()
