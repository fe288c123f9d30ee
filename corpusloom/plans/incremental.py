"""Named queries over runs and micro-batches: the tables are written as files to
the shared folder and worked off in parts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T_

from corpusloom.plans.common import T
from corpusloom.session import ensure_checkpoint_dir
from corpusloom.sources import derived
from corpusloom.streaming import dedup
from corpusloom.streaming.ledger import Ledger

#: Files that a table is dealt to, and files of a micro-batch.
FILES, PER_BATCH = 12, 4


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _as_stream(spark, df, folder: str):
    """``df`` dealt to files by the hash of its rows, a few of them a batch."""
    df.repartition(FILES, F.xxhash64(*df.columns)).write.parquet(f"{folder}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", PER_BATCH).parquet(f"{folder}/in")


def stream_key_first(spark, sf_dir):
    """W-05 over micro-batches: first metadata row per key in (ord, doc_id) order."""
    meta, folder = derived.metadata(T(spark, sf_dir, "labels")), _folder(spark, "key-first")
    stream = _as_stream(spark, meta, folder)
    dedup.log_changes(dedup.first_rows(stream, "key", ["ord", "doc_id"]), f"{folder}/log", f"{folder}/checkpoint")
    return dedup.table_of(spark, f"{folder}/log", "key", ["ord", "doc_id"]).select(*meta.columns)


def stream_text_first(spark, sf_dir):
    """W-06 over micro-batches: first document of every distinct text."""
    docs, folder = T(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars"), _folder(spark, "text-first")
    stream = _as_stream(spark, docs, folder)
    dedup.log_changes(dedup.first_texts(stream, "text", "doc_id"), f"{folder}/log", f"{folder}/checkpoint")
    return dedup.table_of(spark, f"{folder}/log", "digest", "doc_id").select("doc_id", "lang", "n_chars")


def ledger_outcomes(spark, sf_dir):
    """R-01 + R-02 + S-16: pages converted in runs with a ledger of attempts.
    Some fail at their first attempt, some always; after three attempts these are
    dead letters.  Every page has one outcome."""
    pages = T(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("key"), "page_id", "html")
    ledger = Ledger(spark, _folder(spark, "ledger"), T_.StructType([T_.StructField("n_chars", T_.IntegerType())]))

    def convert(df):
        kind = F.col("page_id") % 10
        fails = (kind == 3) | ((kind == 5) & (F.col("attempt") < 2))
        return df.withColumn("error", F.when(fails, "no conversion")).withColumn("n_chars", F.when(~fails, F.length("html")))

    while ledger.run(pages, convert):  # at most as many runs as attempts
        pass
    ledger.compact()
    done = ledger.outputs().select("key", F.lit("done").alias("outcome"), "attempt", "n_chars")
    dead = ledger.dead_letters().select("key", F.lit("dead").alias("outcome"), F.col("failed").cast("int").alias("attempt"),
                                        F.lit(None).cast("int").alias("n_chars"))
    return done.unionByName(dead)
