"""Keep-first over micro-batches (W-05, W-06).

The state of the stream is one row per key, the one with the smallest order
so far: a streaming aggregate, so Spark keeps it in its state store, combines
a batch on the map side before the state is touched and recovers it from the
checkpoint.  A smaller order that comes late replaces the earlier row.  Every
batch appends the keys whose row changed to a log; rows of the log only ever get
smaller, so the table is the smallest row per key of the log, whatever the
split into batches and whichever batch was written twice.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators.joins import keep_first, text_digest


def first_rows(stream: DataFrame, key, order) -> DataFrame:
    """The streaming form of ``keep_first``: same columns, in update mode."""
    return keep_first(stream, key, order)


def first_texts(stream: DataFrame, text_col: str, order) -> DataFrame:
    """The streaming form of ``dedup_text``: rows without the text, by its
    ``digest``, so that the state holds no texts."""
    narrow = stream.withColumn("digest", text_digest(text_col)).drop(text_col)
    return keep_first(narrow, "digest", order)


def log_changes(changed: DataFrame, log: str, checkpoint: str, wait: bool = True) -> StreamingQuery:
    """Drain the stream's backlog: each batch writes its changed rows below
    ``log`` in a folder of its own, which a replayed batch overwrites."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(log, f"batch={batch_id}"))

    query = (changed.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
             .trigger(availableNow=True).start())
    if wait:
        query.awaitTermination()
    return query


def table_of(spark: SparkSession, log: str, key, order) -> DataFrame:
    """The deduplicated table of a log."""
    return keep_first(spark.read.parquet(log).drop("batch"), key, order)
