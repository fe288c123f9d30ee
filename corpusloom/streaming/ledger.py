"""Bounded retries with a ledger of attempts (R-01, R-02, R-04, S-16).

A run converts the inputs that are pending and writes one row per input, with
its outcome, as a version of the ledger (see ``manifests``).  The remains of a
run that died between its data and its manifest are never read and its inputs
are pending again: each input's output appears exactly once.  An input that
failed ``attempts`` times is a dead letter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.streaming.manifests import Manifests


class Ledger:
    """Attempts below ``folder`` on the shared storage.

    ``schema`` is that of the converted rows without ``key``.  The key is text."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, attempts: int = 3):
        self.spark, self.manifests, self.attempts = spark, Manifests(spark, folder), attempts
        self.schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("attempt", T.IntegerType()),
                                    T.StructField("error", T.StringType()), *schema.fields])

    # --- reading ----------------------------------------------------------------
    def entries(self) -> DataFrame:
        """All attempts that count: ``key``, ``attempt``, ``error`` (NULL for success), and the converted columns."""
        if not (paths := self.manifests.paths()):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def outputs(self) -> DataFrame:
        """The converted rows."""
        return self.entries().where("error is null").drop("error")

    def standing(self) -> DataFrame:
        """``key``, ``failed`` attempts, ``done``, and the last ``error``, per input tried."""
        e = self.entries().select("key", "attempt", "error")
        return e.groupBy("key").agg(F.count("error").alias("failed"), F.bool_or(F.col("error").isNull()).alias("done"),
                                    F.max_by("error", F.when(F.col("error").isNotNull(), F.col("attempt"))).alias("last_error"))

    def dead_letters(self) -> DataFrame:
        """Inputs given up: ``key``, ``failed``, ``last_error``."""
        return self.standing().where((~F.col("done")) & (F.col("failed") >= self.attempts)).drop("done")

    def pending(self, inputs: DataFrame) -> DataFrame:
        """``inputs`` (with ``key``) that are neither done nor given up, with the number of this ``attempt``."""
        known = self.standing()
        left = inputs.join(known.where(F.col("done") | (F.col("failed") >= self.attempts)).select("key"), "key", "left_anti")
        return left.join(known.select("key", "failed"), "key", "left").withColumn(
            "attempt", (F.coalesce("failed", F.lit(0)) + 1).cast("int")).drop("failed")

    # --- running ------------------------------------------------------------------
    def run(self, inputs: DataFrame, convert: Callable[[DataFrame], DataFrame], before_commit: Callable[[], None] | None = None) -> int:
        """Convert the pending ``inputs`` (one row per ``key``) and commit the
        run; returns the number of inputs tried.  ``convert`` keeps ``key`` and
        ``attempt`` and adds ``error`` and the converted columns; it runs as a
        Spark job, and what it raises ends the run without a trace in the ledger."""
        name, path = self.manifests.new()
        convert(self.pending(inputs)).select(*self.schema.fieldNames()).write.parquet(path)
        tried = self.spark.read.schema(self.schema).parquet(path).count()
        if before_commit:
            before_commit()
        if tried:
            self.manifests.commit(name)
        return tried

    def compact(self) -> None:
        """All runs as one: its manifest alone, once renamed, makes readers skip
        the older ones, whose files stay."""
        name, path = self.manifests.new("all")
        self.entries().write.parquet(path)
        self.manifests.commit(name)
