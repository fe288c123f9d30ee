"""Distinct counts from sketches that merge (A-15, opt-in).

An exact distinct count has to move every distinct value.  A HyperLogLog sketch
of a part has a fixed size, is stored beside the part, and sketches merge by a
union that does not depend on order or repetition: the sketch of the whole is
that of its parts.  With ``lg_k`` the relative standard error is about
1.04 / sqrt(2^lg_k).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_K = 12


def relative_error(lg_k: int = LG_K) -> float:
    """Relative standard error of an estimate."""
    return 1.04 / math.sqrt(1 << lg_k)


def part_sketches(df: DataFrame, value_col: str, group_cols: list[str], part_col: str, lg_k: int = LG_K) -> DataFrame:
    """One ``sketch`` per group and part, NULL values left out; map-side sketches
    are all that is shuffled."""
    return df.groupBy(*group_cols, part_col).agg(F.hll_sketch_agg(value_col, F.lit(lg_k)).alias("sketch"))


def merged(sketches: DataFrame, group_cols: list[str]) -> DataFrame:
    """One ``sketch`` per group from those of its parts, in any order and however often."""
    return sketches.groupBy(*group_cols).agg(F.hll_union_agg("sketch", F.lit(True)).alias("sketch"))


def estimated(sketches: DataFrame, out: str = "approx_distinct") -> DataFrame:
    """``out`` in place of ``sketch``."""
    return sketches.withColumn(out, F.hll_sketch_estimate("sketch")).drop("sketch")
