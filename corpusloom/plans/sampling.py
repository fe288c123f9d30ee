"""Named queries: sampling, splits, folds and small relational lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators.shape import order_columns
from corpusloom.operators.quantiles import exact_quantiles
from corpusloom.functions.arrays import argmax
from corpusloom.operators import evaluate as EV
from corpusloom.operators import joins as J
from corpusloom.operators import splits as SP
from corpusloom.plans.common import T, round_cols
from corpusloom.sources import derived


def _labelled_docs(spark, sf_dir):
    return T(spark, sf_dir, "documents").select("doc_id", "lang").join(
        T(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


def split_exact(spark, sf_dir):
    """O-08: 10% test split of labelled documents, exact size, seeded."""
    return SP.split_exact(_labelled_docs(spark, sf_dir), "doc_id", 0.1, 42)


def split_stratified(spark, sf_dir):
    """O-09: 10% test split stratified by the quality label."""
    return SP.split_stratified(_labelled_docs(spark, sf_dir), "doc_id", "quality", 0.1, 42)


def group_folds(spark, sf_dir):
    """O-10: 5 group folds of conversation turns (a conversation never
    spans two folds); every turn row carries its fold."""
    c = T(spark, sf_dir, "conversations").select("conv_id", "turn")
    folds = SP.group_folds(c, "conv_id", 5)
    return c.join(folds.select("conv_id", "fold"), "conv_id")


def sample_exact(spark, sf_dir):
    """O-06: exactly 500 events, repeatable for seed 42."""
    return SP.sample_exact(T(spark, sf_dir, "events").select("event_id", "user_id", "event_type"),
                           "event_id", 500, 42)


def seeded_shuffle(spark, sf_dir):
    """O-07: seeded permutation position of every event."""
    return SP.seeded_shuffle(T(spark, sf_dir, "events").select("event_id"), "event_id", 42)


def bounded_scan(spark, sf_dir):
    """R-03 + O-05: the first 100 documents in doc_id order (take(n))."""
    return SP.head(T(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id", 100)


def value_extremes(spark, sf_dir):
    """A-09: min/max of event values and times (time as text) per type."""
    e = T(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(
        F.min("value").alias("min_value"), F.max("value").alias("max_value"),
        F.min(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("first_ts"),
        F.max(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("last_ts"))


def distinct_keys(spark, sf_dir):
    """U-05 + O-01: distinct customer keys of orders, sorted."""
    return T(spark, sf_dir, "orders").select("o_custkey").distinct().orderBy("o_custkey")


def text_join(spark, sf_dir):
    """J-04: every document joined on exact text with the first document of
    that text (canonical id)."""
    d = T(spark, sf_dir, "documents").select("doc_id", J.text_digest("text").alias("digest"))
    first = d.groupBy("digest").agg(F.min("doc_id").alias("first_doc_id"))
    return d.join(first, "digest").select("doc_id", "first_doc_id")


def year_lookup(spark, sf_dir):
    """J-09: monthly order price looked up for every month with lineitem
    activity; months with no price are reported, not dropped."""
    li = T(spark, sf_dir, "lineitem")
    o = T(spark, sf_dir, "orders")
    ym = lambda c: (F.year(c) * 100 + F.month(c)).alias("period")
    a = li.groupBy(ym("l_shipdate")).agg(F.count("*").alias("activity"))
    b = exact_quantiles(o.withColumn("period", ym("o_orderdate")), "o_totalprice", {"price": 0.5}, ["period"])
    r = a.join(b, "period", "left").withColumn("missing", F.col("price").isNull())
    return round_cols(r, ["price"])


def per_fold_report(spark, sf_dir):
    """M-25 + P-02 + P-13: classification report per fold (fold = vec_id
    mod 5) in one grouped pass, macro columns selected by suffix, columns ordered base-then-metrics."""
    lg = derived.logits(T(spark, sf_dir, "embeddings")).withColumn("fold", (F.col("row_id") % 5).cast("int"))
    lg = lg.withColumn("pred", argmax("logits"))
    out = EV.classification_report(lg, "label", "pred", ("fold",))
    out = out.select("fold", "accuracy", *[c for c in out.columns if c.endswith("_macro")])
    out = out.withColumnsRenamed({"accuracy": "eval_accuracy"})
    metrics = sorted(c for c in out.columns if c != "fold")
    return round_cols(order_columns(out, ["fold"], metrics), metrics)
