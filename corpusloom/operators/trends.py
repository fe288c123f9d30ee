"""Yearly trends and correlation (A-04, A-06, A-08, A-12, F-06, F-14, F-21,
F-22, J-08, J-09, W-02..W-04, X-08..X-10, X-15, M-04..M-07).

Row-level work (keyword flags, year parsing) is expressions; everything
after the first ``groupBy`` works on per-period series whose size is bounded
by the number of periods, not by the data.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.numbers import clip_lower
from corpusloom.functions.text import contains_term
from corpusloom.operators.prefix import ordered_prefix
from corpusloom.operators.quantiles import exact_quantiles


def keyword_flags(df: DataFrame, text_col: str, terms: list[str],
                  merges: dict[str, list[str]] | None = None) -> tuple[DataFrame, list[str]]:
    """F-06 + F-14: one boolean ``contains_<term>`` column per term on the
    lower-cased text; each merge target is the OR of its present sources,
    which are then dropped.  Returns (frame, flag columns)."""
    low = F.lower(F.col(text_col))
    # target -> its terms; a term that no target takes stands for itself
    named = {f"contains_{t}": t for t in terms}
    grouped = {target: [s for s in sources if s in named] for target, sources in (merges or {}).items()}
    grouped = {target: sources for target, sources in grouped.items() if sources}
    merged = {s for sources in grouped.values() for s in sources}
    wanted = {name: [name] for name in named if name not in merged} | grouped
    flags = {out: reduce(lambda a, b: a | b, [contains_term(low, named[s]) for s in sources]) for out, sources in wanted.items()}
    return df.withColumns(flags), list(flags)


def yearly_rates(df: DataFrame, group_cols: list[str], flag_cols: list[str]) -> DataFrame:
    """A-08: mean of each boolean flag per group, as a long table
    (group..., term, rate).  Aggregated wide in one pass, unpivoted after."""
    wide = df.groupBy(*group_cols).agg(*[F.avg(F.col(c).cast("int")).alias(c) for c in flag_cols])
    return wide.unpivot(group_cols, flag_cols, "term", "rate")


def align_common_years(rates: DataFrame, series_col: str = "corpus", term_col: str = "term",
                       year_col: str = "year") -> DataFrame:
    """J-08: keep (term, year) cells present in every series (inner join of
    all series on year, per term)."""
    n_series = rates.select(F.count_distinct(series_col).alias("n")).scalar()
    common = (rates.groupBy(term_col, year_col).agg(F.count_distinct(series_col).alias("_k"))
              .where(F.col("_k") == n_series).drop("_k"))
    return rates.join(common, [term_col, year_col], "left_semi")


def from_first_above(df: DataFrame, series_cols: list[str], order_col: str, value_col: str,
                     threshold: float = 1e-4) -> DataFrame:
    """X-15: per series, keep rows from the first ``order_col`` whose value
    exceeds ``threshold``; a series that never exceeds it disappears."""
    w = Window.partitionBy(*series_cols)
    first = F.min(F.when(F.col(value_col) > threshold, F.col(order_col))).over(w)
    return df.withColumn("_first", first).where(F.col(order_col) >= F.col("_first")).drop("_first")


def mention_trends(df: DataFrame, text_col: str, series_col: str, terms: list[str],
                   merges: dict[str, list[str]] | None = None, threshold: float = 1e-4) -> DataFrame:
    """M-04: yearly mention rate per (series, term) on the years all series
    share, clipped at 0 and cut before each series' first non-zero year.
    ``df`` must already hold an integer ``year``."""
    flagged, cols = keyword_flags(df, text_col, terms, merges)
    rates = yearly_rates(flagged, [series_col, "year"], cols)
    aligned = align_common_years(rates, series_col, "term", "year")
    clipped = aligned.withColumn("rate", clip_lower("rate", 0.0))
    return from_first_above(clipped, [series_col, "term"], "year", "rate", threshold)


def share_per_group(df: DataFrame, group_col: str, label_col: str) -> DataFrame:
    """M-05 (A-06 + W-03): count per (group, label) and its percent share of
    the group."""
    c = df.groupBy(group_col, label_col).agg(F.count("*").alias("count"))
    return c.withColumn("percent", F.col("count") / F.sum("count").over(Window.partitionBy(group_col)) * 100)


def yearly_median(df: DataFrame, epoch_ms_col: str, value_col: str, scale: float = 1e9) -> DataFrame:
    """M-07 (F-21 + A-04 + F-23): epoch milliseconds -> year, median value
    per year, divided by ``scale``."""
    y = F.year(F.timestamp_millis(F.col(epoch_ms_col).cast("bigint")))
    return (exact_quantiles(df.withColumn("year", y), value_col, {"_m": 0.5}, ["year"]).withColumnRenamed("_m", value_col)
            .withColumn(value_col, F.col(value_col) / F.lit(float(scale))))


def average_rank(df: DataFrame, part_cols: list[str], value_col: str, out: str) -> DataFrame:
    """W-02: average rank of ties (1-based) within each partition."""
    w = Window.partitionBy(*part_cols).orderBy(value_col)
    ties = Window.partitionBy(*part_cols, value_col)
    return df.withColumn(out, F.rank().over(w) + (F.count("*").over(ties) - 1) / 2.0)


def month_index(period) -> Column:
    """Months since year 0 of a ``yyyymm`` number: neighbours differ by one."""
    p = F.col(period) if isinstance(period, str) else period
    return F.floor(p / 100) * 12 + p % 100


def period_gaps(df: DataFrame, index: Column) -> DataFrame:
    """T-25: what lies between the first and the last period and is not there:
    ``before`` and ``after`` (the periods' ``index``) and how many are
    ``missing``.  Each period looks up its successor among the ends of gaps, so
    no window holds all periods."""
    present = df.select(index.cast("long").alias("i")).distinct().where("i is not null")
    no_next = present.join(present.select((F.col("i") - 1).alias("i")), "i", "left_anti").select(F.col("i").alias("before"))
    no_prev = present.join(present.select((F.col("i") + 1).alias("i")), "i", "left_anti").select(F.col("i").alias("after"))
    # the k-th run of periods ends where the next one begins
    ends = ordered_prefix(no_next, ["before"], None, out="k")
    starts = ordered_prefix(no_prev, ["after"], None, out="n").withColumn("k", F.col("n") - 1).drop("n")
    return ends.join(starts, "k").select("before", "after", (F.col("after") - F.col("before") - 1).alias("missing"))


def lagged_spearman(a: DataFrame, b: DataFrame, period_col: str, x_col: str, y_col: str,
                    max_lag: int = 5, calendar: Column | None = None) -> DataFrame:
    """M-06 (W-02 + W-04 + J-09): Spearman correlation of two per-period
    series aligned on their common periods, for positional lags -k..k.

    A negative lag pairs x at position i with y at position i + |lag|; a
    positive lag pairs x at i + lag with y at i (trap T-25: positional, not
    calendar).  Ranks are recomputed inside each lag's overlap.  Positions
    come from :func:`ordered_prefix`; the lag pairing is an equi-join on
    ``pos_y = pos_x - lag``.  With ``calendar``, a whole number per period such
    as ``month_index``, lags count calendar steps: a missing period pairs with
    nothing instead of moving the others.
    """
    j = a.select(period_col, x_col).join(b.select(period_col, y_col), period_col, "inner")
    # the aligned series is one row per common period: materialise it once
    if calendar is not None:
        j = j.withColumn("_pos", calendar.cast("long"))
    else:
        j = ordered_prefix(j, [period_col], None, out="_pos", materialize=True).withColumn("_pos", F.col("_pos") - 1)
    xs = j.select(F.col("_pos").alias("pos_x"), F.col(x_col).alias("x"),
                  F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag"))
    ys = j.select(F.col("_pos").alias("pos_y"), F.col(y_col).alias("y"))
    pairs = xs.join(ys, F.col("pos_y") == F.col("pos_x") - F.col("lag"), "inner")
    r = average_rank(average_rank(pairs, ["lag"], "x", "rx"), ["lag"], "y", "ry")
    return r.groupBy("lag").agg(F.count("*").alias("n"),
                                F.corr("rx", "ry").alias("spearman_correlation"))


def correlation_p_value(r, n) -> Column:
    """Two-sided p-value of a correlation ``r`` of ``n`` pairs under Student's
    t with ``n - 2`` degrees of freedom; NULL below three pairs.

    For whole degrees of freedom the distribution is a finite sum in
    ``sin = |r|`` and ``cos^2 = 1 - r^2``."""
    r, n = (F.col(c) if isinstance(c, str) else c for c in (r, n))
    sin, cos2, df = F.least(F.abs(r), F.lit(1.0)), 1 - F.least(r * r, F.lit(1.0)), n - 2
    even = df % 2 == 0

    def series(first: Column, last: Column, ratio) -> Column:
        """first * (1 + ratio(1) cos^2 (1 + ratio(2) cos^2 (...))) up to term ``last``."""
        start = F.struct(first.alias("sum"), first.alias("term"))
        steps = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))

        def add(a, k):
            term = a["term"] * ratio(k) * cos2
            return F.struct((a["sum"] + term).alias("sum"), term.alias("term"))

        return F.aggregate(steps, start, add, lambda a: a["sum"])

    inside = F.when(even, sin * series(F.lit(1.0), (df / 2 - 1).cast("int"), lambda k: (2 * k - 1) / (2 * k)))
    odd = F.when(df > 1, sin * series(F.sqrt(cos2), ((df - 3) / 2).cast("int"), lambda k: 2 * k / (2 * k + 1))).otherwise(F.lit(0.0))
    inside = inside.otherwise((F.asin(sin) + odd) * (2 / math.pi))
    return F.when((n >= 3) & r.isNotNull() & ~F.isnan(r), F.greatest(1 - inside, F.lit(0.0)))
