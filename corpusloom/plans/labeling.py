"""Named queries: vote labeling and label statistics (IN-1 based)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators.quantiles import exact_quantiles
from corpusloom.functions.numbers import pct_of, row_sum
from corpusloom.operators import labels as L
from corpusloom.plans.common import round_cols, votes
from corpusloom.sources.schemas import MARKET_LABELS, VOTE_COLUMNS, VOTE_PAIRS

KEY = ["user_id", "week"]
PCT_COLS = [c for _n, neg, pos in VOTE_PAIRS for c in (f"{neg}_pct", f"{pos}_pct")]


def vote_quantile_labels(spark, sf_dir):
    """M-01 on IN-1: three quantile labelings in one pass."""
    r = L.quantile_labels(L.add_vote_totals(votes(spark, sf_dir)))
    cols = (KEY + VOTE_COLUMNS + ["total_votes"] + [f"pair_votes_{n}" for n, _a, _b in VOTE_PAIRS]
            + PCT_COLS + [c for n, _a, _b in VOTE_PAIRS for c in (n, f"{n}_id")])
    return round_cols(r.select(*cols), PCT_COLS)


def vote_quality_filter(spark, sf_dir):
    """X-05 + X-06 + A-02: positive totals, at least min of three medians."""
    r = L.median_quality_filter(votes(spark, sf_dir))
    return r.select(*KEY, *VOTE_COLUMNS, "total_votes")


def _market_pct(spark, sf_dir):
    v = votes(spark, sf_dir)
    tot = row_sum(["bearish", "bullish"])
    return v.select(*KEY, "bearish", "bullish",
                    pct_of("bullish", tot).alias("bullish_pct"),
                    pct_of("bearish", tot).alias("bearish_pct"))


def vote_rank_labels(spark, sf_dir):
    """W-01 + F-15: average percent rank of bullish_pct, 25/75 cut."""
    r = L.rank_labels(_market_pct(spark, sf_dir))
    return round_cols(r.select(*KEY, "bullish_pct", "sentiment_rank", "rank_label"),
                      ["bullish_pct", "sentiment_rank"])


def vote_zscore_labels(spark, sf_dir):
    """F-19 + A-17 + F-15: population z-score of bullish/(bearish+1)."""
    r = L.zscore_labels(_market_pct(spark, sf_dir))
    return round_cols(r.select(*KEY, "sentiment_ratio", "sentiment_z_score", "zscore_label"),
                      ["sentiment_ratio", "sentiment_z_score"])


def vote_minmax_labels(spark, sf_dir):
    """A-18 + F-15: min-max scaled bullish_pct, 0.25/0.75 cut."""
    r = L.minmax_labels(_market_pct(spark, sf_dir))
    return round_cols(r.select(*KEY, "bullish_pct", "bullish_pct_scaled", "minmax_label"),
                      ["bullish_pct", "bullish_pct_scaled"])


def label_distribution(spark, sf_dir):
    """A-05 + A-07 + F-16: market_direction counts, shares and ids."""
    r = L.quantile_labels(votes(spark, sf_dir), with_ids=False)
    d = L.label_distribution(r, "market_direction", labels=MARKET_LABELS)
    return round_cols(d, ["percent"])


def struct_pack_unpack(spark, sf_dir):
    """P-09 + P-10: pack the six vote columns into a struct, then expand it
    back next to the key (same row, no index join: trap T-18)."""
    v = votes(spark, sf_dir)
    packed = v.select(*KEY, F.struct(*[F.col(c).cast("int").alias(c) for c in VOTE_COLUMNS])
                      .alias("vote_counts"))
    return packed.select(*KEY, "vote_counts.*")


def vote_pair_study(spark, sf_dir):
    """A-02, A-11, F-20, X-07 and the T-17 switches: per week, sums of
    bullish/bearish among rows whose pair total is at least its median, and
    the mean absolute gap between the two percentages."""
    m = _market_pct(spark, sf_dir).withColumn("votes_mkt", F.col("bullish") + F.col("bearish"))
    m = L.median_filter(m, "votes_mkt")
    m = m.withColumn("sentiment_diff", F.abs(F.col("bullish_pct") - F.col("bearish_pct")))
    out = m.groupBy("week").agg(F.sum("bullish").cast("bigint").alias("sum_bullish"),
                                F.sum("bearish").cast("bigint").alias("sum_bearish"),
                                F.avg("sentiment_diff").alias("avg_diff"),
                                F.count("*").alias("n"))
    med = exact_quantiles(m, "votes_mkt", {"median_votes": 0.5}, ["week"])
    return round_cols(out.join(med, "week"), ["median_votes", "avg_diff"])
