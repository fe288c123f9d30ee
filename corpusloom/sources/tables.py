"""Table catalog (S-12): named Parquet tables under one directory."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    """Path of a named table: ``<dir>/<name>.parquet`` (file or directory)."""
    return os.path.join(sf_dir, f"{name}.parquet")


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """S-12: load a named table.  Column pruning and filter pushdown reach the
    Parquet scan because nothing here is eager."""
    return spark.read.parquet(table_path(sf_dir, name))
