"""File sources and sinks (S-01..S-17).

Readers return lazy DataFrames; malformed input is kept in a quarantine
DataFrame (never deleted).  Paths may be directories: Spark lists and splits
files itself, so there is no per-file Python loop.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def filesystem(path: str):
    """(pyarrow file system, path in it) of a plain path or URI."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _with_corrupt(schema: T.StructType) -> T.StructType:
    if CORRUPT in schema.fieldNames():
        return schema
    return T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())])


def header_probe(spark: SparkSession, path: str) -> list[str]:
    """S-03: column names from the CSV header only (no type inference, no
    data scan beyond the first line)."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).columns


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, glob: str = "*.csv",
             recursive: bool = True, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """S-01 + S-02 + S-04 + S-05: header CSV over a directory tree;
    PERMISSIVE mode keeps malformed rows, which go to the quarantine frame
    with their file path, also when the schema is inferred.  ``multi_line``
    reads quoted fields that span lines, at the price of one task per file.
    Returns (good, quarantine).
    Column pruning is a ``select`` on the result (pushed into the scan)."""
    r = (spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
         .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
         .option("recursiveFileLookup", recursive).option("pathGlobFilter", glob))
    if schema is None:
        inferred = (spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
                    .option("recursiveFileLookup", recursive).option("pathGlobFilter", glob).option("inferSchema", True))
        schema = inferred.csv(path).schema
    df = r.schema(_with_corrupt(schema)).csv(path).withColumn("_source_file", F.col("_metadata.file_path"))
    return _split(df, whole=True)


def _guard(df: DataFrame, whole: bool = False):
    """Spark refuses raw-file queries whose scan would read only the
    corrupt-record column (e.g. a ``count`` after filtering on it).
    ``length(coalesce(x, 'x')) >= 0`` is always true but the optimizer
    does not fold it away, so the scan keeps one parsed column; with
    ``whole`` all of them, as a CSV scan of fewer columns does not notice
    that a row has too many or too few.  Returns (first parsed column,
    guard)."""
    parsed = [c for c in df.columns if c not in (CORRUPT, "_source_file")]
    if not whole:
        return parsed[0], F.length(F.coalesce(F.col(parsed[0]).cast("string"), F.lit("x"))) >= 0
    return parsed[0], F.length(F.concat_ws("", *[F.col(f"`{c}`").cast("string") for c in parsed])) >= 0


def _split(df: DataFrame, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good rows without the corrupt column, quarantined rows with file)."""
    first, keep = _guard(df, whole)
    good = df.where(F.col(CORRUPT).isNull() & keep).drop(CORRUPT)
    bad = df.where(F.col(CORRUPT).isNotNull() & keep).select("_source_file", CORRUPT, first)
    return good, bad


def read_json_records(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True,
                      glob: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """S-06 + S-07: JSON with a declared schema - one object per file
    (``multi_line``) or JSON lines.  Zero-byte files yield no rows;
    malformed files yield one quarantined row each.  Returns (good,
    quarantine)."""
    df = (spark.read.schema(_with_corrupt(schema)).option("multiLine", multi_line)
          .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
          .option("recursiveFileLookup", True).option("pathGlobFilter", glob)
          .json(path).withColumn("_source_file", F.col("_metadata.file_path")))
    return _split(df)


def file_key(path_col, extension: str = ".md"):
    """S-10: file name without directory and extension (trap T-06: taken
    from the file's own path, not from a row index)."""
    name = F.regexp_extract(path_col, r"([^/]+)$", 1)
    ext = extension.replace(".", r"\.")
    return F.regexp_replace(name, f"{ext}$", "")


def parent_dir(path_col):
    """S-11: name of the directory holding the file."""
    return F.regexp_extract(path_col, r"([^/]+)/[^/]+$", 1)


def read_text_tree(spark: SparkSession, root: str, glob: str = "*.md", extension: str = ".md") -> DataFrame:
    """S-09 + S-10 + S-11: one row per file (whole file as ``text``) over a
    directory tree, with the sub-directory and the file-name key.  The
    ``wholetext`` reader option is passed as a keyword: as ``.option`` it is
    overridden by the method default and lines would be split.  Small files come
    a few dozen to a partition; one task reads several of these partitions."""
    df = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    df = df.coalesce(max(4 * spark.sparkContext.defaultParallelism, -(-df.rdd.getNumPartitions() // 16)))
    p = F.col("_metadata.file_path")
    return df.select(file_key(p, extension).alias("key"), parent_dir(p).alias("subdir"),
                     p.alias("path"), F.col("value").alias("text"))


def write_text_tree(df: DataFrame, root: str, folder: Column, name: Column, text: Column) -> None:
    """S-09 sink: each row of ``df`` as the text file ``name`` in ``folder``
    below ``root``, ended by a line feed (a null text is an empty line).  Rows
    that follow each other in a partition with the same folder and name share a
    file; else a file is one row's.  Tasks write their files themselves, each
    under a temporary name first, so a repeated attempt replaces them by equal
    ones and nothing is left for the driver to move."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (store, base), attempt = filesystem(root), TaskContext.get().taskAttemptId()
        made, at, out, n = set(), None, None, 0

        def finish():
            if out:
                out.close()
                store.move(f"{at}.tmp-{attempt}", at)

        for batch in batches:
            for sub, file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if (path := f"{base}/{sub}/{file}") != at:
                    finish()
                    if sub not in made:
                        store.create_dir(f"{base}/{sub}", recursive=True)
                        made.add(sub)
                    at, n = path, n + 1
                    out = store.open_output_stream(f"{path}.tmp-{attempt}", compression=None)
                out.write((data.as_py() or b"") + b"\n")
        finish()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["files"])

    rows = df.select(folder.alias("folder"), name.alias("name"), text.cast("binary").alias("text"))
    rows.mapInArrow(run, "files long").write.format("noop").mode("overwrite").save()


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None):
    """S-13 + S-14: columnar sink."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite"):
    """S-07 sink: JSON lines."""
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, single_file: bool = False, mode: str = "overwrite"):
    """S-15: CSV result table with header; ``single_file`` only for small
    result tables (one task writes it)."""
    (df.coalesce(1) if single_file else df).write.mode(mode).option("header", True).csv(path)


def write_if_absent(df: DataFrame, path: str, fmt: str = "parquet"):
    """R-04: idempotent batch - an existing output is left untouched."""
    df.write.mode("ignore").format(fmt).save(path)


def pending_inputs(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """S-16: inputs whose key has no output yet (anti join)."""
    return inputs.join(done.select(key), key, "left_anti")
