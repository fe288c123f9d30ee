"""Named queries: joins, dedup, set operations and the review round trip."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.text import valid_year, year_int, year_part
from corpusloom.operators import joins as J
from corpusloom.plans.common import T
from corpusloom.sources import derived


def _meta(spark, sf_dir):
    return derived.metadata(T(spark, sf_dir, "labels"))


def _docs_keyed(spark, sf_dir):
    return T(spark, sf_dir, "documents").withColumn("key", F.col("doc_id").cast("string"))


def dedup_text_first(spark, sf_dir):
    """W-06: first document (lowest doc_id) of every distinct text."""
    d = T(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    return J.dedup_text(d, "text", "doc_id").select("doc_id", "lang", "n_chars")


def dedup_key_last(spark, sf_dir):
    """W-07: last metadata row per key in (ord, doc_id) order."""
    return J.keep_last(_meta(spark, sf_dir), "key", ["ord", "doc_id"])


def dedup_key_first(spark, sf_dir):
    """W-05: first metadata row per key in (ord, doc_id) order."""
    return J.keep_first(_meta(spark, sf_dir), "key", ["ord", "doc_id"])


def semi_both(spark, sf_dir):
    """J-01 (+U-03): documents with labels and labels with documents."""
    docs = T(spark, sf_dir, "documents").select("doc_id", "lang")
    labs = T(spark, sf_dir, "labels").select("doc_id", "quality")
    a, b = J.semi_both(docs, labs, "doc_id")
    return (a.select(F.lit("documents").alias("side"), "doc_id")
            .unionByName(b.select(F.lit("labels").alias("side"), "doc_id")))


def anti_removals(spark, sf_dir):
    """J-05 + X-13 (+U-04): metadata rows whose key was not flagged for
    removal."""
    m = _meta(spark, sf_dir)
    removals = m.where(F.col("remove") == 1).select("key")
    return J.anti_by_keys(m, removals, "key").select("key", "doc_id", "ord", "quality")


def inner_join_metadata(spark, sf_dir):
    """J-02 + P-14: documents joined with last-wins metadata, NULL -> ''."""
    docs = _docs_keyed(spark, sf_dir).select("key", "lang", "source")
    meta = _meta(spark, sf_dir).select("key", "doc_id", "quality", "toxic", "ord", "remove")
    return J.inner_join_last(docs, meta, "key", ["ord", "doc_id"])


def left_join_suffix(spark, sf_dir):
    """J-06 + P-15: metadata left-joined with labels on doc_id; clashing
    label columns get ``_pos``; missing label values filled with 0."""
    meta = _meta(spark, sf_dir).select("key", "doc_id", "quality", "toxic", "ord")
    labs = T(spark, sf_dir, "labels")
    j = J.left_join_suffix(meta, labs, "doc_id", "_pos")
    return j.na.fill(0, ["quality_pos", "toxic_pos"])


def merge_precedence(spark, sf_dir):
    """J-03 + P-12: first-per-text documents inner-joined with first-per-key
    metadata; the left value wins on a name clash (``doc_id``)."""
    docs = J.dedup_text(T(spark, sf_dir, "documents"), "text", "doc_id") \
        .select(F.col("doc_id").cast("string").alias("key"), "doc_id", "lang", "source", "n_chars")
    meta = J.keep_first(_meta(spark, sf_dir), "key", ["ord", "doc_id"])
    return J.merge_precedence(docs, meta, "key")


def join_reconciliation(spark, sf_dir):
    """M-19: one-row reconciliation of documents vs metadata keys."""
    return J.join_reconciliation(_docs_keyed(spark, sf_dir).select("key"),
                                 _meta(spark, sf_dir).select("key"), "key")


def review_roundtrip(spark, sf_dir):
    """M-21: split dated papers at 2008 for review (X-10), union the two
    reviewed lists (U-01), take the flagged keys (X-13) and anti-join them
    away (J-05).  Papers without a valid year are not reviewed and kept."""
    papers = derived.dated_documents(T(spark, sf_dir, "documents")) \
        .withColumn("ys", year_part("date_text")) \
        .withColumn("year", F.when(valid_year("ys", "len4"), year_int("ys"))) \
        .select(F.col("doc_id").cast("string").alias("key"), "doc_id", "corpus", "year")
    flags = J.keep_first(_meta(spark, sf_dir), "key", ["ord", "doc_id"]).select("key", "remove")
    old = papers.where(F.col("year") <= 2008).join(flags, "key", "left")
    new = papers.where(F.col("year") > 2008).join(flags, "key", "left")
    decisions = old.unionByName(new)
    removed = decisions.where(F.col("remove") == 1).select("key")
    return J.anti_by_keys(papers, removed, "key")
