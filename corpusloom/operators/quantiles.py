"""Exact quantiles by distributed selection (A-02..A-04).

Spark's exact ``percentile`` merges the distinct values of a group in one
task.  Here the wanted ranks are bracketed instead: a histogram over fixed,
nearly logarithmic bins finds the bins that hold them, a second one cuts
these bins evenly between their least and greatest value, and only the values
of the cuts that still hold a rank are counted one by one.  Each pass is an
aggregate with map-side combine whose rows are bins, so no values are
shuffled but the few that end inside a cut; nothing is checkpointed and no job
runs before the result is asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of a power of two, and even cuts of a bin.
PER_OCTAVE, CUTS = 256, 4096
#: Bins of the values without a finite logarithm, beyond all others.
NAN_BIN, INF_BIN = (1 << 30) + 1, 1 << 30


def log_bin(v: Column) -> Column:
    """A bin number that never falls as ``v`` (double) grows; NaN is greatest."""
    size = F.floor((F.log2(F.abs(v)) + 1100) * PER_OCTAVE).cast("int")  # the least magnitude is 2^-1074
    size = F.when(F.abs(v) == float("inf"), F.lit(INF_BIN)).otherwise(size)
    return F.when(F.isnan(v), F.lit(NAN_BIN)).when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size)


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"{k}_k"]) for k in keys])


def _keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with its keys renamed, for a join on equal keys, null ones too."""
    return df.withColumnsRenamed({k: f"{k}_k" for k in keys})


def _holding(counts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows of ``counts`` (``_n`` values each, in order within ``keys``) that
    hold one of the ranks in ``_want``, whose ranks become those within the row."""
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    inside = F.transform("_want", lambda w: F.struct(w["i"].alias("i"), (w["rank"] - F.col("_before")).alias("rank")))
    return (counts.withColumn("_before", before)
            .withColumn("_want", F.filter(inside, lambda w: (w["rank"] >= 0) & (w["rank"] < F.col("_n"))))
            .where(F.size("_want") > 0).drop("_before", "_n"))


def exact_quantiles(df: DataFrame, value_col: str, probs: dict[str, float],
                    group_cols: list[str] | None = None) -> DataFrame:
    """One row per group (one row at all without groups) with a column per
    entry of ``probs``, interpolated linearly between neighbours; NULL values
    are skipped, a NULL group key is a group, NaN sorts above all numbers."""
    groups = list(group_cols or [])
    v = F.col(value_col).cast("double")
    src = df.where(F.col(value_col).isNotNull()).select(*groups, v.alias("_v"), log_bin(v).alias("_bin"))
    extremes = [F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]

    bins = src.groupBy(*groups, "_bin").agg(*extremes)
    bins = bins.withColumn("_total", F.sum("_n").over(Window.partitionBy(*groups)))
    ranks = [side((F.col("_total") - 1) * F.lit(p)) for p in probs.values() for side in (F.floor, F.ceil)]
    want = F.array(*[F.struct(F.lit(i).alias("i"), r.cast("long").alias("rank")) for i, r in enumerate(ranks)])
    bins = _holding(bins.withColumn("_want", want), groups, "_bin")

    keys = [*groups, "_bin"]
    edges = _keyed(bins.select(*keys, "_lo", "_hi"), keys)
    cut = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * CUTS)).otherwise(F.lit(0))
    cuts = src.join(edges, _same(src, edges, keys)).select(*keys, "_v", cut.cast("int").alias("_cut")).groupBy(*keys, "_cut").agg(*extremes)
    ranked = _keyed(bins.select(*keys, "_total", "_want"), keys)
    cuts = cuts.join(ranked, _same(cuts, ranked, keys)).select(*cuts.columns, "_total", "_want")
    cuts = _holding(cuts, keys, "_cut")

    edges = _keyed(cuts.select(*keys, "_cut", "_lo", "_hi"), keys)
    inside = _same(src, edges, keys) & (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
    values = src.join(edges, inside).groupBy(*keys, "_cut", "_v").agg(F.count("*").alias("_n"))
    keys = [*keys, "_cut"]
    ranked = _keyed(cuts.select(*keys, "_total", "_want"), keys)
    values = values.join(ranked, _same(values, ranked, keys)).select(*values.columns, "_total", "_want")
    found = _holding(values, keys, "_v").select(*groups, "_v", "_total", F.col("_want.i").alias("_i"))

    def pick(k: int, p: float) -> Column:
        low, high = (F.max(F.when(F.array_contains("_i", 2 * k + side), F.col("_v"))) for side in (0, 1))
        at = (F.max("_total") - 1) * F.lit(p)
        part = at - F.floor(at)
        return F.when(low == high, low).otherwise((1 - part) * low + part * high)

    return found.groupBy(*groups).agg(*[pick(k, p).alias(name) for k, (name, p) in enumerate(probs.items())])


def named_quantiles(df: DataFrame, columns: dict[str, str], probs: list[float]) -> Column:
    """A scalar: map from name to the array of quantiles of its column, for a
    few columns in one pass."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("value"))
                                         for n, c in columns.items()])).alias("e")).select("e.*")
    q = exact_quantiles(long, "value", {f"q{i}": p for i, p in enumerate(probs)}, ["name"])
    entry = F.struct("name", F.array(*[F.col(f"q{i}") for i in range(len(probs))]))
    return q.agg(F.map_from_entries(F.collect_list(entry)).alias("m")).scalar()
