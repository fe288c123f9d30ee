"""Vote-share labeling (A-01..A-03, A-17, A-18, W-01, X-05..X-07, F-15,
M-01..M-03).

Global statistics (medians, percentiles, mean/stddev, min/max) are computed
by one aggregate each and attached as a scalar subquery: Spark runs the
aggregate once (partial aggregation on every executor) and inlines the one
row as a literal, so there is no cross join, no collect and no
single-partition window over row data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.arrays import encode_label
from corpusloom.functions.numbers import pct_of, row_sum, smoothed_ratio
from corpusloom.operators.prefix import ordered_prefix
from corpusloom.operators.quantiles import exact_quantiles, named_quantiles
from corpusloom.session import cut_lineage
from corpusloom.sources.schemas import (CONTENT_LABELS, ENGAGEMENT_LABELS, MARKET_LABELS,
                                        VOTE_COLUMNS, VOTE_PAIRS)

LABEL_LISTS = {"market_direction": MARKET_LABELS,
               "engagement_quality": ENGAGEMENT_LABELS,
               "content_characteristics": CONTENT_LABELS}


def threshold_label(value, low, high, low_label: str, high_label: str,
                    neutral: str = "neutral", high_first: bool = True) -> Column:
    """F-15: ``high_label`` when value >= high, ``low_label`` when value <=
    low, else neutral; NULL value -> neutral.  ``high_first`` reproduces the
    reference's overwrite order (trap T-07: when low == high, ties become
    the high label)."""
    v = F.col(value) if isinstance(value, str) else value
    if high_first:
        return (F.when(v >= high, F.lit(high_label))
                .when(v <= low, F.lit(low_label)).otherwise(F.lit(neutral)))
    return (F.when(v <= low, F.lit(low_label))
            .when(v >= high, F.lit(high_label)).otherwise(F.lit(neutral)))


def add_vote_totals(df: DataFrame, vote_cols=VOTE_COLUMNS, pairs=VOTE_PAIRS) -> DataFrame:
    """A-01: six-way ``total_votes`` plus one ``pair_votes_<label>`` per pair
    (trap T-17: the reference overwrites its total once per pair)."""
    out = df.withColumn("total_votes", row_sum(vote_cols).cast("int"))
    for name, neg, pos in pairs:
        out = out.withColumn(f"pair_votes_{name}", row_sum([neg, pos]).cast("int"))
    return out


def quantile_labels(df: DataFrame, pairs=VOTE_PAIRS, low_q: float = 0.25,
                    high_q: float = 0.75, with_ids: bool = True) -> DataFrame:
    """M-01: per pair, pct = votes/(neg+pos)*100 for both labels; the
    positive label's ``low_q``/``high_q`` percentiles (linear interpolation,
    NULLs skipped) split rows into high / low / neutral.

    All percentiles come from one table of distinct values, attached as a
    scalar subquery.
    """
    out = df
    for name, neg, pos in pairs:
        tot = row_sum([neg, pos])
        out = (out.withColumn(f"{neg}_pct", pct_of(neg, tot))
                  .withColumn(f"{pos}_pct", pct_of(pos, tot)))
    out = out.withColumn("_q", named_quantiles(out, {name: f"{pos}_pct" for name, _neg, pos in pairs}, [low_q, high_q]))
    for name, neg, pos in pairs:
        p = F.col("_q")[name]
        out = out.withColumn(name, threshold_label(f"{pos}_pct", p[0], p[1], neg, pos))
        if with_ids and name in LABEL_LISTS:
            out = out.withColumn(f"{name}_id", encode_label(name, LABEL_LISTS[name]))
    return out.drop("_q")


def median_quality_filter(df: DataFrame, pairs=VOTE_PAIRS) -> DataFrame:
    """X-05 + X-06: keep rows with positive total votes and total votes at
    least the minimum of the per-pair vote medians (medians computed after
    the positive-total filter)."""
    base = add_vote_totals(df, pairs=pairs).where(F.col("total_votes") > 0)
    meds = named_quantiles(base, {n: f"pair_votes_{n}" for n, _a, _b in pairs}, [0.5])
    least = F.array_min(F.flatten(F.map_values("_q")))
    return base.withColumn("_q", meds).where(F.col("total_votes") >= least).drop("_q")


def median_filter(df: DataFrame, col: str) -> DataFrame:
    """X-07: keep rows whose ``col`` is at least its median."""
    med = exact_quantiles(df, col, {"m": 0.5}).scalar()
    return df.where(F.col(col) >= med)


def average_pct_rank(df: DataFrame, col: str, out: str = "pct_rank") -> DataFrame:
    """W-01: pandas ``rank(pct=True) * 100`` (average rank of ties / n,
    NULLs stay NULL and are not counted in n).

    Scale plan: aggregate to distinct values with counts (partial
    aggregation), prefix-sum the counts with :func:`ordered_prefix`
    (range-bucketed, no global window), join the per-value rank back.
    """
    counts = (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("_cnt")))
    # the distinct-value table is read by the split points, the prefix and
    # the total: checkpoint it once (shared checkpoint folder)
    counts = cut_lineage(counts)
    ranked = ordered_prefix(counts, [col], "_cnt", out="_below", inclusive=False)
    n = counts.select(F.sum("_cnt").alias("n")).scalar()
    ranked = ranked.select(col, ((F.col("_below") + (F.col("_cnt") + 1) / 2) / n * 100)
                           .alias(out))
    return df.join(ranked, on=col, how="left")


def rank_labels(df: DataFrame, col: str = "bullish_pct", low: float = 25, high: float = 75,
                low_label: str = "bearish", high_label: str = "bullish",
                out: str = "rank_label") -> DataFrame:
    """M-03 (rank variant): label by average percent rank."""
    r = average_pct_rank(df, col, out="sentiment_rank")
    return r.withColumn(out, threshold_label("sentiment_rank", low, high, low_label, high_label))


def zscore_labels(df: DataFrame, pos: str = "bullish", neg: str = "bearish", cut: float = 0.67,
                  out: str = "zscore_label") -> DataFrame:
    """M-03 (z-score variant): ratio = pos/(neg+1); population z-score
    (ddof 0, trap T-13); <= -cut low, >= cut high."""
    r = df.withColumn("sentiment_ratio", smoothed_ratio(pos, neg))
    st = r.select(F.struct(F.avg("sentiment_ratio").alias("mu"),
                           F.stddev_pop("sentiment_ratio").alias("sd")).alias("s")).scalar()
    r = r.withColumn("_s", st)
    z = F.try_divide(F.col("sentiment_ratio") - F.col("_s.mu"), F.col("_s.sd"))
    r = r.withColumn("sentiment_z_score", z).drop("_s")
    return r.withColumn(out, threshold_label("sentiment_z_score", -cut, cut, neg, pos,
                                             high_first=False))


def minmax_labels(df: DataFrame, col: str = "bullish_pct", low: float = 0.25,
                  high: float = 0.75, low_label: str = "bearish", high_label: str = "bullish",
                  out: str = "minmax_label") -> DataFrame:
    """M-03 (min-max variant): scaled = (x - min)/(max - min) in [0, 1]
    (zero range -> 0).  Thresholds default to 0.25/0.75; pass 25/75 for the
    reference's behaviour (every non-NULL row low: trap T-13)."""
    st = df.select(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi")).alias("s")).scalar()
    r = df.withColumn("_s", st)
    rng = F.col("_s.hi") - F.col("_s.lo")
    scaled = F.when(F.col(col).isNull(), F.lit(None).cast("double")) \
        .when(rng == 0, F.lit(0.0)) \
        .otherwise((F.col(col) - F.col("_s.lo")) / rng)
    r = r.withColumn(f"{col}_scaled", scaled).drop("_s")
    return r.withColumn(out, threshold_label(f"{col}_scaled", low, high, low_label, high_label))


def label_distribution(df: DataFrame, label_col: str, labels: list[str] | None = None,
                       include_null: bool = False) -> DataFrame:
    """A-05 + A-07 (+ F-16): count and percent share per label.  The share is
    count / total on the aggregated rows (total via scalar subquery).
    ``include_null`` keeps a NULL-label row and counts it in the total
    (M-20); otherwise NULL labels are dropped like ``value_counts``."""
    src = df if include_null else df.where(F.col(label_col).isNotNull())
    counts = src.groupBy(label_col).agg(F.count("*").alias("count"))
    total = src.select(F.count("*").alias("n")).scalar()
    out = counts.withColumn("percent", F.col("count") / total * 100)
    if labels is not None:
        out = out.withColumn(f"{label_col}_id", encode_label(label_col, labels))
    return out
