"""Named queries over files: the tables are written to the shared folder in each
format the library reads, with planted damage, and read back."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T_

from corpusloom.operators.joins import broadcast_if_small
from corpusloom.plans.common import T
from corpusloom.session import cut_lineage, ensure_checkpoint_dir
from corpusloom.sources import files as FS
from corpusloom.streaming.incremental import convert_pages


#: Files of a lot of pages, at most.
LOT_FILES = 12
#: Pages of 2 to this power of ids are a folder.
RANGE_BITS = 10


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def csv_roundtrip(spark, sf_dir):
    """S-01 + S-02 + S-03 + S-05 + S-15: orders as CSV files with a header in a
    tree of folders, every 97th line with a field too many, read by a declared
    schema; good rows and how many were quarantined by file kind."""
    o, folder = T(spark, sf_dir, "orders"), _folder(spark, "csv")
    rows = o.select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    FS.write_csv(rows.where("o_orderkey % 97 <> 0"), f"{folder}/a/b")
    FS.write_csv(rows.where("o_orderkey % 97 = 0").withColumn("extra", F.lit("x")), f"{folder}/c")
    schema = T_.StructType([T_.StructField("o_orderkey", T_.LongType()), T_.StructField("o_custkey", T_.LongType()),
                            T_.StructField("o_orderpriority", T_.StringType()), T_.StructField("o_totalprice", T_.DoubleType())])
    assert FS.header_probe(spark, f"{folder}/a/b") == rows.columns
    good, bad = FS.read_csv(spark, folder, schema)
    return (good.groupBy("o_orderpriority").agg(F.count("*").alias("good"), F.sum("o_orderkey").alias("keys"),
                                                F.round(F.sum("o_totalprice"), 2).alias("price"))
            .unionByName(bad.agg(F.lit("quarantine").alias("o_orderpriority"), F.count("*").alias("good"),
                                 F.sum(F.split("_corrupt_record", ",")[0].cast("long")).alias("keys"), F.lit(None).cast("double").alias("price"))))


def json_records_roundtrip(spark, sf_dir):
    """S-06 + S-07: conversation turns as JSON lines with a cut line in every
    eleventh conversation; good rows, and the quarantined lines."""
    c, folder = T(spark, sf_dir, "conversations"), _folder(spark, "json")
    FS.write_jsonl(c, f"{folder}/good")
    c.where("conv_id % 11 = 0").select(F.concat(F.lit('{"conv_id": '), "conv_id", F.lit(', "turn": '), "turn").alias("value")).write.text(f"{folder}/bad")
    good, bad = FS.read_json_records(spark, folder, c.schema, multi_line=False, glob="*.*")
    return (good.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"), F.lit("good").alias("status"))
            .unionByName(bad.select(F.regexp_extract("_corrupt_record", r"conv_id\": (\d+)", 1).cast("long").alias("conv_id"),
                                    F.regexp_extract("_corrupt_record", r"turn\": (\d+)", 1).cast("long").alias("turn"),
                                    F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text_md5"),
                                    F.lit("quarantine").alias("status"))))


def text_tree_scan(spark, sf_dir):
    """S-09 + S-10 + S-11: pages as one text file each, in folders by site range,
    read back whole with the key of their folder."""
    p, folder = T(spark, sf_dir, "pages").select("page_id", "html"), _folder(spark, "tree")
    # rows that repeat an id share its file, so they meet in one task; all others are written where they are read
    again = cut_lineage(p.groupBy("page_id").count().where("count > 1 or page_id is null").select(F.col("page_id").alias("again")))
    if again.isEmpty():
        lots = [p]
    else:
        again = broadcast_if_small(again)
        lots = [p.join(again, F.col("page_id") == F.col("again"), "left_anti").where("page_id is not null"),
                p.join(again, F.col("page_id").eqNullSafe(F.col("again")), "left_semi").repartition("page_id").sortWithinPartitions("page_id")]
    for rows in lots:
        FS.write_text_tree(rows, folder, F.concat(F.lit("pages="), F.coalesce(F.shiftright("page_id", RANGE_BITS).cast("string"), F.lit("none"))),
                           F.concat(F.lit("part-"), F.coalesce(F.col("page_id").bitwiseAND((1 << RANGE_BITS) - 1).cast("string"), F.lit("none")), F.lit(".txt")), F.col("html"))
    t = FS.read_text_tree(spark, folder, "*.txt", ".txt")
    page = F.shiftleft(F.split("subdir", "=")[1].try_cast("long"), RANGE_BITS) + F.split("key", "-")[1].try_cast("long")
    return t.select(page.alias("page_id"), F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"),
                    F.startswith("key", F.lit("part-")).alias("has_key"))


def partitioned_tables(spark, sf_dir):
    """S-12 + S-13 + S-14 + R-04: documents as Parquet by language; a second
    write of something else leaves the first one as it is."""
    d, folder = T(spark, sf_dir, "documents"), _folder(spark, "parquet")
    FS.write_parquet(d.select("doc_id", "lang", "n_chars"), f"{folder}/t", partition_by=["lang"])
    FS.write_if_absent(d.select("doc_id").limit(1), f"{folder}/t")
    r = spark.read.parquet(f"{folder}/t")
    return r.groupBy("lang").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


def pending_pages(spark, sf_dir):
    """S-16: pages without an output yet, where every third has one."""
    p = T(spark, sf_dir, "pages").select("page_id", "url")
    return FS.pending_inputs(p, p.where("page_id % 3 = 0").select("page_id"), "page_id")


def converted_pages(spark, sf_dir):
    """K-12 + R-01 + S-17: pages arrive as files in two lots and are converted by
    a restarted stream; each is converted once, empty ones are quarantined."""
    p, folder = T(spark, sf_dir, "pages"), _folder(spark, "pages")
    p = p.withColumn("html", F.when(F.col("page_id") % 13 == 0, F.lit("<!-- nothing -->")).otherwise(F.col("html")))
    for part in ("page_id % 2 = 0", "page_id % 2 = 1"):
        # a lot's number of files, and so of micro-batches, does not grow with the table
        p.where(part).coalesce(LOT_FILES).write.mode("append").parquet(f"{folder}/in")
        convert_pages(spark, f"{folder}/in", f"{folder}/out", f"{folder}/empty", f"{folder}/checkpoint", max_files_per_trigger=3)
    done = spark.read.parquet(os.path.join(folder, "out")).select("page_id", F.md5("text").alias("text_md5"))
    none = spark.read.parquet(os.path.join(folder, "empty")).select("page_id", F.lit(None).cast("string").alias("text_md5"))
    return done.unionByName(none)
