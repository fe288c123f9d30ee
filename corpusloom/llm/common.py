"""Helpers shared by the operators of this package: scratch folders on the
shared storage, atomic file commits, sharding by id, and graph components."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.sources.files import filesystem

ID_BINS = 65_536
#: Spark's setting to remove shuffle files at the end of an execution.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


# --- shared storage ---------------------------------------------------------

def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder for one run of operator ``name`` below
    ``spark.checkpoint.dir`` (shared by driver and executors).  Only a local
    session without that setting gets a temporary folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="corpusloom-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a step run inside go when it ends; else they stay until
    the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def save(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet at ``path`` and read it back: cuts the lineage
    on storage that survives lost executors.  The step's shuffle files go."""
    with shuffles_removed(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_counted(df: DataFrame, path: str) -> tuple[DataFrame, int]:
    """``save``, and the number of rows, taken as they are written: a job less than to count them."""
    seen = Observation()
    return save(df.observe(seen, F.count(F.lit(1)).alias("rows")), path), seen.get["rows"]


def maybe_broadcast(df: DataFrame, row_bytes: int, limit: int = 16 << 20, rows: int | None = None) -> DataFrame:
    """``df``, a saved table (of ``rows``, if known), to be broadcast if its
    rows fit ``limit`` bytes; beyond that the planner shuffles both sides."""
    return F.broadcast(df) if (df.count() if rows is None else rows) * row_bytes <= limit else df


def local_path(path: str) -> str | None:
    """Path usable by mmap, or None when the storage is not a mounted one."""
    from pyarrow import fs

    store, p = filesystem(path)
    return p if isinstance(store, fs.LocalFileSystem) else None


def task_suffix() -> str:
    """Makes the temporary name of an output unique per task attempt."""
    ctx = TaskContext.get()
    return f".tmp-{ctx.taskAttemptId() if ctx else os.getpid()}"


class AtomicFile:
    """Output stream under a temporary name; ``commit`` renames it to its
    final name.  A retried or speculative attempt replaces the file by one of
    equal content, a lost one leaves only its temporary file."""

    def __init__(self, path: str):
        self.store, self.path = filesystem(path)
        self.store.create_dir(os.path.dirname(self.path), recursive=True)
        self.tmp = self.path + task_suffix()
        self.stream = self.store.open_output_stream(self.tmp, compression=None)
        self.size = 0

    def write(self, data) -> None:
        self.stream.write(data)
        self.size += len(data)

    def commit(self) -> None:
        self.stream.close()
        self.store.move(self.tmp, self.path)


class TwoGenerations:
    """A bounded store of results (none is None): when ``size`` are held
    they become the old generation, whose used entries move on to the next."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def lookup(self, keys: list, compute) -> list:
        """The results of ``keys``; ``compute`` gives those of a list of new keys."""
        out = list(map(self.new.get, keys))
        if not all(out):
            lacking, fresh, new, old = [i for i, v in enumerate(out) if v is None], [], self.new, self.old
            for k in {keys[i] for i in lacking}:
                if (v := old.get(k)) is None:
                    fresh.append(k)
                else:
                    new[k] = v
            for k, v in zip(fresh, compute(fresh)):
                new[k] = v
            for i in lacking:
                out[i] = new[keys[i]]
            if len(new) > self.size:
                self.old, self.new = new, {}
        return out


# --- sharding by id ---------------------------------------------------------

def with_shards(df: DataFrame, id_col: str, size: Column, target: int, source: DataFrame | None = None) -> DataFrame:
    """Add ``_shard``: ranges of ``id_col`` in ascending order that hold about
    ``target`` units of ``size`` each.  The bounds come from an exact
    histogram over at most ``ID_BINS`` equal id ranges, so they do not depend
    on how the input is partitioned.  Null ids get the first range of their
    own.  ``source`` (default ``df``) is what the histogram reads: a cheaper
    plan with the same ids and sizes."""
    source = df if source is None else source
    lo, hi = (source.select(fn(id_col).cast("decimal(20,0)").alias("x")).scalar() for fn in (F.min, F.max))
    width = F.greatest(F.ceil((hi - lo + 1) / F.lit(ID_BINS)), F.lit(1))
    bin_ = F.coalesce(F.floor((F.col(id_col).cast("decimal(20,0)") - lo) / width).cast("int"), F.lit(-1))
    binned = df.withColumn("_bin", bin_)
    hist = source.withColumn("_bin", bin_).groupBy("_bin").agg(F.sum(size).cast("long").alias("_n"))
    # at most ID_BINS + 1 bins: offsets of groups of 256, then of the bins in each
    group = F.floor(F.col("_bin") / 256)
    head = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    heads = hist.groupBy(group.alias("_group")).agg(F.sum("_n").alias("_t")).select(
        "_group", F.coalesce(F.sum("_t").over(head), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_group").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    shards = hist.withColumn("_group", group).withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(
        F.broadcast(heads), "_group").select("_bin", F.floor((F.col("_before") + F.col("_in")) / F.lit(target)).cast("long").alias("_shard"))
    return binned.join(F.broadcast(shards), "_bin").drop("_bin")


# --- connected components ---------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (columns ``a``, ``b``, long) by
    alternating large-star and small-star steps.

    Returns ``(node, component)`` with the smallest node of the component for
    every node that is not itself that smallest one.  Each step is two
    aggregates and joins on the node with map-side minima; no component is
    gathered in one task, and each step is saved, with its fingerprint taken
    on the way."""
    folder, step = shared_dir(edges.sparkSession, "components"), 0
    e, seen = _saved_step(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), f"{folder}/0")
    while seen[0]:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
            e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low2 = large.groupBy("hi").agg(F.min("lo").alias("m"))
        nxt = (large.join(low2, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
               .unionAll(low2.select("hi", F.col("m").alias("lo"))).distinct())
        step += 1
        e, now = _saved_step(nxt, f"{folder}/{step}")
        if now == seen:
            break
        seen = now
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))


def _saved_step(e: DataFrame, path: str) -> tuple[DataFrame, tuple]:
    seen = Observation()
    saved = save(e.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("h"),
                           F.sum(F.col("lo").cast("decimal(38,0)")).alias("s")), path)
    return saved, tuple(seen.get[k] for k in ("n", "h", "s"))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores added until ``df`` has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def arrow_schema(schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
