"""Shared helpers for the named queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.functions.numbers import rounded
from corpusloom.sources import derived
from corpusloom.sources.tables import load_table


def T(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:  # noqa: N802
    return load_table(spark, sf_dir, name)


def votes(spark, sf_dir) -> DataFrame:
    return derived.votes(T(spark, sf_dir, "events"))


def round_cols(df: DataFrame, cols: list[str], digits: int = 9) -> DataFrame:
    """Round derived doubles so the result compares stably across engines."""
    return df.withColumns({c: rounded(c, digits) for c in cols})
