"""Derived inputs built from the supplied tables (FIXTURES.md part C).

Each builder is a lazy DataFrame over the whole source table, so the work
grows with the data.  The DuckDB oracle re-states each definition in SQL
(``corpusloom.plans.oracle``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import alnum_only, split_words
from corpusloom.sources.schemas import IGNORE_INDEX


def votes(events: DataFrame) -> DataFrame:
    """IN-1: crowd votes per (user_id, week) from ``events``.

    bullish = purchases, bearish = errors, liked = clicks, disliked = views,
    important = signups, lol = events with value > 100.
    """
    week = F.floor((F.dayofmonth("ts") - 1) / 7).cast("int")

    def n(cond):
        return F.count_if(cond).cast("int")

    et = F.col("event_type")
    return (events.select("user_id", week.alias("week"), "event_type", "value")
            .groupBy("user_id", "week")
            .agg(n(et == "purchase").alias("bullish"),
                 n(et == "error").alias("bearish"),
                 n(et == "click").alias("liked"),
                 n(et == "view").alias("disliked"),
                 n(et == "signup").alias("important"),
                 n(F.col("value") > 100).alias("lol")))


CORPORA = ["social", "patents", "literature"]


def dated_documents(documents: DataFrame) -> DataFrame:
    """IN-2: documents with a ``corpus`` (doc_id % 3) and a ``date_text`` that
    holds junk, an out-of-range year and NULLs in fixed places."""
    d = F.col("doc_id")
    corpus = F.element_at(F.array(*[F.lit(c) for c in CORPORA]), (d % 3).cast("int") + 1)
    good = F.concat((F.lit(2013) + F.floor(d / 3) % 12).cast("string"), F.lit("-0"),
                    (F.lit(1) + d % 9).cast("string"), F.lit("-01"))
    date_text = (F.when(d % 97 == 0, F.concat(F.lit("bad"), d.cast("string")))
                 .when(d % 89 == 0, F.lit("1999-01-01"))
                 .when((d % 50 == 0) & ((d % 3) == 2), F.lit(None).cast("string"))
                 .otherwise(good))
    return documents.select("doc_id", "text", "lang", "source",
                            corpus.alias("corpus"), date_text.alias("date_text"))


def planted_terms() -> list[str]:
    """Terms added to IN-3 that can never match a cleaned single word
    (trap T-23): a phrase, an upper-case word and a hyphenated word."""
    return ["two words", "UPPER", "hy-phen"]


def vocabulary(benchmark: DataFrame) -> DataFrame:
    """IN-3: keyword vocabulary = distinct lower-case alphanumeric words of
    length >= 6 from the whole ``benchmark`` table, plus planted terms."""
    words = (benchmark.select(F.explode(split_words(F.lower("text"))).alias("w"))
             .select(alnum_only("w").alias("term"))
             .where(F.length("term") >= 6)
             .distinct())
    # made by the JVM: local rows would start a Python worker per core in each job that reads them
    planted = benchmark.sparkSession.range(0, 1, 1, 1).select(F.explode(F.array(*map(F.lit, planted_terms()))).alias("term"))
    return words.unionByName(planted).distinct()


def metadata(labels: DataFrame) -> DataFrame:
    """IN-4: metadata rows keyed by a STRING key with duplicates (ord 1,
    quality flipped), unmatched keys (+1,000,000) and a review flag."""
    d = F.col("doc_id")
    base = labels.select(
        d.cast("string").alias("key"), d.alias("doc_id"), "quality",
        F.when(d % 7 == 0, F.lit(None).cast("int")).otherwise(F.col("toxic")).alias("toxic"),
        F.lit(0).alias("ord"),
        F.when(d % 17 == 0, F.lit(1)).otherwise(F.lit(None)).cast("int").alias("remove"))
    dup = (base.where(d % 10 == 0)
           .withColumn("ord", F.lit(1))
           .withColumn("quality", (F.lit(1) - F.col("quality")).cast("int")))
    extra = (base.where(d % 13 == 0)
             .withColumn("key", (d + F.lit(1_000_000)).cast("string")))
    return base.unionByName(dup).unionByName(extra)


ENTITY_GROUPS = ["ESG", "Consensus", "Identifiers"]


def predictions(documents: DataFrame) -> DataFrame:
    """IN-5: per document an array of ``doc_id % 5`` entity predictions."""
    d = F.col("doc_id")
    groups = F.array(*[F.lit(g) for g in ENTITY_GROUPS])

    def one(_x, i):
        return F.struct(
            F.element_at(groups, ((d + i) % 3).cast("int") + 1).alias("entity_group"),
            (F.lit(0.98) + ((d * 37 + i * 101) % 2000) / F.lit(100000)).alias("score"))

    preds = F.transform(F.array_repeat(F.lit(0), (d % 5).cast("int")), one)
    return documents.select("doc_id", "text", preds.alias("predictions"))


def logits(embeddings: DataFrame) -> DataFrame:
    """IN-6: ten class logits from all embedding elements (the sum over the
    positions ``i % 10 = c``), ``label`` as the true class."""
    part = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: F.aggregate(
        F.filter("embedding", lambda _x, i: i % 10 == c), F.lit(0.0), lambda a, x: a + x))
    return embeddings.select(F.col("vec_id").alias("row_id"), part.alias("logits"), F.col("label"))


def word_tag_rows(documents: DataFrame) -> DataFrame:
    """IN-7 as one row per word: (doc_id, pos, word, tag_id, gold_id, pred_id).

    gold at a word: ``B-T`` (1) when its length >= 7; ``I-T`` (2) when length
    >= 5 and the previous gold tag is not ``O``; else ``O`` (0).  The
    recurrence is equivalent to: a 5..6-letter word is ``I-T`` exactly when
    the last earlier word outside 5..6 letters had >= 7 letters, which is a
    per-document running "last non-null" window (O(n log n), no quadratic
    array fold).  Predicted = gold with ``O`` where (doc_id + pos) % 11 = 0;
    gold ids are the ignore index where pos % 13 = 0.  Whole documents.
    """
    w = documents.select("doc_id", F.posexplode(split_words("text")).alias("pos", "word"))
    ln = F.length("word")
    win = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last_break = F.last(F.when((ln < 5) | (ln >= 7), ln), ignorenulls=True).over(win)
    gold = (F.when(ln >= 7, F.lit(1))
            .when((ln >= 5) & F.coalesce(last_break >= 7, F.lit(False)), F.lit(2))
            .otherwise(F.lit(0)))
    t = w.withColumn("_g", gold)
    return t.select("doc_id", "pos", "word", F.col("_g").alias("tag_id"),
                    F.when(F.col("pos") % 13 == 0, F.lit(IGNORE_INDEX)).otherwise(F.col("_g")).alias("gold_id"),
                    F.when((F.col("doc_id") + F.col("pos")) % 11 == 0, F.lit(0)).otherwise(F.col("_g"))
                    .alias("pred_id"))


def word_tags(documents: DataFrame) -> DataFrame:
    """IN-7 in the sequence-label dataset shape (A8): per document the word
    array and aligned gold / predicted id arrays (positions in order)."""
    rows = word_tag_rows(documents)
    packed = F.sort_array(F.collect_list(F.struct("pos", "word", "gold_id", "pred_id")))
    g = rows.groupBy("doc_id").agg(packed.alias("_r"))
    return g.select("doc_id", F.col("_r.word").alias("tokens"), F.col("_r.gold_id").alias("gold_ids"),
                    F.col("_r.pred_id").alias("pred_ids"))


def mixed_header_sources(conversations: DataFrame, carry: tuple[str, ...] = ()) -> list[DataFrame]:
    """IN-9: three views of ``conversations`` with different raw headers:
    (created_at, user_name, tweet), (Date, time, content), (datetime,
    full_text).  Rows are split by ``turn % 3`` so every row appears once.
    ``carry`` names extra columns passed through unchanged (order keys)."""
    c = conversations
    date = F.concat(F.lit("2020-"), F.lpad(((F.col("conv_id") % 12) + 1).cast("string"), 2, "0"),
                    F.lit("-01"))
    clock = F.concat(F.lpad((F.col("turn") % 24).cast("string"), 2, "0"), F.lit(":00:00"))
    t = F.col("turn") % 3
    extra = list(carry)
    v1 = c.where(t == 0).select(date.alias("created_at"), F.col("role").alias("user_name"),
                                F.col("text").alias("tweet"), *extra)
    v2 = c.where(t == 1).select(date.alias("Date"), clock.alias("time"),
                                F.col("text").alias("content"), *extra)
    v3 = c.where(t == 2).select(F.concat(date, F.lit(" "), clock).alias("datetime"),
                                F.col("text").alias("full_text"), *extra)
    return [v1, v2, v3]
