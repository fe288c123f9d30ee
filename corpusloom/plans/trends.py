"""Named queries: yearly mention trends, sentiment shares, market series and
lagged correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators.quantiles import exact_quantiles
from corpusloom.functions.text import valid_year, year_int, year_part
from corpusloom.operators import trends as TR
from corpusloom.plans.common import T, round_cols
from corpusloom.sources import derived

# terms that occur in the supplied prose (the library default is the
# reference's coin list, corpusloom.sources.schemas.COIN_TERMS)
MENTION_TERMS = ["tion", "ment", " der ", " und ", "eau", "qxz"]
MENTION_MERGES = {"contains_tion_or_ment": ["contains_tion", "contains_ment"]}


def _dated_years(spark, sf_dir):
    d = derived.dated_documents(T(spark, sf_dir, "documents"))
    y = year_part("date_text")
    ok = F.when(F.col("corpus") == "literature", valid_year(y, "notnull")).otherwise(valid_year(y, "len4_2"))
    return d.withColumn("year", F.when(ok, year_int(y))).where(F.col("year").isNotNull())


def yearly_mentions(spark, sf_dir):
    """M-04: yearly keyword mention rates per corpus on common years, cut
    before each series' first non-zero year."""
    r = TR.mention_trends(_dated_years(spark, sf_dir), "text", "corpus", MENTION_TERMS, MENTION_MERGES)
    return round_cols(r, ["rate"])


def sentiment_share(spark, sf_dir):
    """M-05 (A-06 + W-03): sentiment label share per year in the social
    corpus; labels from the ``labels`` table."""
    d = _dated_years(spark, sf_dir).where(F.col("corpus") == "social")
    lab = T(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("toxic") == 1, F.lit("bearish"))
        .when(F.col("quality") == 1, F.lit("bullish")).otherwise(F.lit("neutral")).alias("sentiment_label"))
    r = TR.share_per_group(d.join(lab, "doc_id"), "year", "sentiment_label")
    return round_cols(r, ["percent"])


def _market(spark, sf_dir):
    o = T(spark, sf_dir, "orders")
    return o.select(F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("snapped_at"),
                    (F.col("o_totalprice") * 1e6).alias("market_cap"))


def market_yearly(spark, sf_dir):
    """M-07: yearly median market value in billions from epoch-ms rows."""
    return round_cols(TR.yearly_median(_market(spark, sf_dir), "snapped_at", "market_cap"), ["market_cap"])


def counts_before(spark, sf_dir):
    """A-12 + X-10: orders before 1998, within 1998..2000, after 2000 and
    with no date."""
    y = F.year("o_orderdate")
    c = T(spark, sf_dir, "orders").groupBy(y.alias("year")).agg(F.count("*").alias("cnt"))
    return c.agg(F.coalesce(F.sum(F.when(F.col("year") < 1998, F.col("cnt"))), F.lit(0)).cast("bigint").alias("before"),
                 F.coalesce(F.sum(F.when(F.col("year").between(1998, 2000), F.col("cnt"))), F.lit(0))
                 .cast("bigint").alias("within"),
                 F.coalesce(F.sum(F.when(F.col("year") > 2000, F.col("cnt"))), F.lit(0)).cast("bigint").alias("after"),
                 F.coalesce(F.sum(F.when(F.col("year").isNull(), F.col("cnt"))), F.lit(0)).cast("bigint")
                 .alias("undated"))


def _monthly(spark, sf_dir):
    li = T(spark, sf_dir, "lineitem")
    o = T(spark, sf_dir, "orders")
    ym = lambda c: (F.year(c) * 100 + F.month(c)).alias("period")
    a = li.groupBy(ym("l_shipdate")).agg(F.count("*").alias("activity"))
    b = exact_quantiles(o.withColumn("period", ym("o_orderdate")), "o_totalprice", {"price": 0.5}, ["period"])
    return a, b


def lag_correlation(spark, sf_dir):
    """M-06: Spearman correlation of monthly lineitem activity with the
    monthly median order price, positional lags -5..5."""
    a, b = _monthly(spark, sf_dir)
    return round_cols(TR.lagged_spearman(a, b, "period", "activity", "price", 5),
                      ["spearman_correlation"])


def lag_correlation_p(spark, sf_dir):
    """M-06 with Student-t p-values."""
    a, b = _monthly(spark, sf_dir)
    r = TR.lagged_spearman(a, b, "period", "activity", "price", 5)
    return round_cols(r.withColumn("p_value", TR.correlation_p_value("spearman_correlation", "n")), ["spearman_correlation", "p_value"])


def _some_months(spark, sf_dir):
    """The monthly series without every seventh month."""
    return [d.where(F.col("period") % 7 != 0) for d in _monthly(spark, sf_dir)]


def lag_correlation_calendar(spark, sf_dir):
    """M-06 by calendar months over series with missing ones."""
    a, b = _some_months(spark, sf_dir)
    return round_cols(TR.lagged_spearman(a, b, "period", "activity", "price", 5, TR.month_index("period")), ["spearman_correlation"])


def month_gaps(spark, sf_dir):
    """M-06 (trap T-25): the months missing from both series."""
    a, b = _some_months(spark, sf_dir)
    return TR.period_gaps(a.join(b, "period"), TR.month_index("period"))
