"""Exact dedup over an extendible-hash index on shared files (native).

Every text is a key whose 64-bit hash addresses a directory of 2^16 leaves.
Buckets with more distinct keys than fit are split on the next hash bit until
they fit or the directory has its full depth, as directory doubling does; the
local depth of a leaf is the first depth at which its bucket fits.  Map tasks
compare the bytes of their texts, so each sends one entry per text to the
owner of its key; owners merge the entries byte by byte, chain the texts that
collide on one hash, and write the index in key ranges on shared files.  All
rows then probe that index.

Copies, however many, meet as one entry per map task.  Only this entry's text
is shuffled; the probe moves ids and hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import free_names, save, shared_dir

MAX_DEPTH = 16


def directory(keys: DataFrame, capacity: int, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``(leaf, bucket, depth)`` for the hash column ``h`` of ``keys`` (one
    row per distinct key): the buckets after splitting every one that holds
    more than ``capacity`` keys.  At most 2^max_depth rows; ``bucket`` is the
    first leaf of the bucket."""
    leaves = keys.groupBy(F.shiftrightunsigned("h", 64 - max_depth).alias("leaf")).agg(F.count("*").alias("n"))
    at = leaves.select("leaf", "n", F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("d"))
    prefix = F.expr(f"shiftrightunsigned(leaf, {max_depth} - d)")
    held = at.withColumn("held", F.sum("n").over(Window.partitionBy("d", prefix)))
    depth = F.coalesce(F.min(F.when(F.col("held") <= capacity, F.col("d"))), F.lit(max_depth))
    return (held.groupBy("leaf").agg(depth.alias("depth"))
            .withColumn("bucket", F.expr(f"shiftleft(shiftrightunsigned(leaf, {max_depth} - depth), {max_depth} - depth)")))


def index(docs: DataFrame, path: str, capacity: int = 100_000, hash_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """Build the index of ``docs`` (``id`` long, ``t`` string) below ``path``.

    Returns ``(rows, entries)``: the key of every row, and one entry per
    distinct text with its bucket, place in the chain of its hash, largest id
    and number of copies.  ``hash_bits`` below 64 forces collisions (tests)."""
    def key(df):
        return df.withColumn("h", F.shiftleft(F.xxhash64("t"), 64 - hash_bits))

    rows = save(key(docs).select("id", "h", F.sha2("t", 256).alias("sha")), f"{path}/rows")
    leaves = directory(rows.select("h").distinct(), capacity)
    owned = (key(docs).withColumn("leaf", F.shiftrightunsigned("h", 64 - MAX_DEPTH))
             .join(F.broadcast(leaves), "leaf")  # at most 2^16 rows
             .groupBy("bucket", "h", "t").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"),
                                              F.first("depth").alias("depth")))
    entries = owned.select("bucket", "depth", "h", F.sha2("t", 256).alias("sha"), "keep_id", "group_size")
    chain = Window.partitionBy("bucket", "h")
    entries = (entries.withColumn("chain", F.row_number().over(chain.orderBy("sha")))
               .withColumn("same", F.count("*").over(Window.partitionBy("bucket", "h", "sha")))
               # two texts with equal xxhash64 and SHA-256 cannot be told apart by the probe: stop, never merge them
               .withColumn("chain", F.when(F.col("same") > 1, F.raise_error(F.lit("texts collide on both hashes")).cast("int"))
                           .otherwise(F.col("chain"))).drop("same"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    owners = entries.repartitionByRange(n, "bucket", "h").sortWithinPartitions("bucket", "h", "chain")
    return rows, save(owners, f"{path}/index")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 100_000,
                 hash_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``keep_id``, ``group_size``,
    ``kept``, ``text_sha256``, and the ``bucket`` and ``chain`` of its entry.

    Texts are equal when their bytes are; null counts as the empty text.  The
    row with the largest id stays.  A null id never wins over another one; in
    a group of null ids only, ``keep_id`` is null and all are kept, as are all
    repeats of the winning row (equal id and text).  Empty input gives no
    rows; other columns are ignored."""
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    rows, entries = index(base, shared_dir(spark, "exact"), capacity, hash_bits)
    return (rows.join(entries, ["h", "sha"])
            .select(F.col("id").alias("doc_id"), "keep_id", "group_size",
                    F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    F.col("sha").alias("text_sha256"), "bucket", "chain"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_groups`` marks as dropped."""
    id_, sha = free_names(docs, "_id", "_sha")
    lost = (exact_groups(docs, id_col, text_col).where("not kept")
            .select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha)).distinct())
    own = F.sha2(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), 256)
    return docs.join(lost, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(id_)) & (own == F.col(sha)), "left_anti")
