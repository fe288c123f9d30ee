"""Vocabulary statistics kept up to date by signed deltas (M-10..M-13).

The counts that the statistics need are additive: tokens per corpus, cleaned
words per corpus, and how many documents there are and hold a keyword.  A lot of
documents that arrives, or goes, is one delta with a sign, a version of the
table (see ``manifests``).  The table at a version is the sum of its deltas; the
statistics read it and never the texts again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import alnum_only, clean_word_list, split_words
from corpusloom.functions.tokens import tokens
from corpusloom.operators import vocabulary as V
from corpusloom.operators.joins import broadcast_if_small
from corpusloom.streaming.manifests import Manifests

SCHEMA = "kind string, corpus string, token string, cnt long"


class VocabularyTable:
    """Counts of the corpora below ``folder``, for the keywords of ``vocab`` (``term``)."""

    def __init__(self, spark: SparkSession, folder: str, vocab: DataFrame):
        self.spark, self.manifests = spark, Manifests(spark, folder)
        self.vocab = vocab.select("term").distinct()

    # --- deltas -------------------------------------------------------------------
    def _counts(self, docs: DataFrame) -> DataFrame:
        """``SCHEMA`` of ``docs`` (``corpus``, ``doc_id``, ``text``)."""
        # three plain passes: arrays that are exploded under a name get a filter on their size, which repeats their
        # expressions, and columns that several branches read are computed in each
        token = docs.select(F.lit("token").alias("kind"), "corpus", F.explode(tokens("text")).alias("token"), F.lit(1).cast("long").alias("cnt"))
        known = broadcast_if_small(self.vocab.select(F.col("term").alias("token")).where(F.length("term") > 0))
        word = docs.select("corpus", F.monotonically_increasing_id().alias("row"), clean_word_list("text").alias("words"))
        word = word.select("corpus", "row", F.explode("words").alias("token")).join(known, "token")
        # each keyword counts for itself and marks its document
        none = F.lit(None)
        both = word.select("corpus", F.explode(F.array(F.struct("token", none.cast("long").alias("row")), F.struct(none.cast("string").alias("token"), "row"))).alias("e"))
        both = both.groupBy("corpus", "e.token", "e.row").agg(F.count("*").alias("cnt"))
        one = F.col("row").isNull()
        hits = both.select(F.when(one, "keyword").otherwise("hit document").alias("kind"), "corpus", F.coalesce("token", F.lit("")).alias("token"),
                           F.when(one, F.col("cnt")).otherwise(1).alias("cnt"))
        whole = docs.select("corpus", F.size(split_words("text")).alias("n_words")).groupBy("corpus").agg(
            F.count("*").alias("document"), F.sum(F.greatest("n_words", F.lit(0))).alias("words"))
        whole = whole.select("corpus", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("cnt")) for k in ("document", "words")]))
                             .alias("e")).select("e.kind", "corpus", F.lit("").alias("token"), "e.cnt")
        return token.unionByName(hits).groupBy("kind", "corpus", "token").agg(F.sum("cnt").alias("cnt")).unionByName(whole)

    def _apply(self, docs: DataFrame, sign: int) -> int:
        name, path = self.manifests.new()
        self._counts(docs).select("kind", "corpus", "token", (F.col("cnt") * sign).alias("cnt")).write.parquet(path)
        self.manifests.commit(name)
        return self.version

    def add(self, docs: DataFrame) -> int:
        """Count in ``docs`` (``corpus``, ``doc_id``, ``text``); returns the version."""
        return self._apply(docs, 1)

    def remove(self, docs: DataFrame) -> int:
        """Take out ``docs``, whose texts are those that were added; returns the version."""
        return self._apply(docs, -1)

    @property
    def version(self) -> int:
        return self.manifests.next_number()

    def compact(self) -> None:
        """One delta in place of all: later reads sum nothing but what comes after it."""
        name, path = self.manifests.new("all")
        self.counts().write.parquet(path)
        self.manifests.commit(name)

    # --- statistics ------------------------------------------------------------------
    def counts(self, version: int | None = None) -> DataFrame:
        """``SCHEMA`` at a version (the last one): the sums that are not zero."""
        paths = self.manifests.paths(version)
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        deltas = self.spark.read.schema(SCHEMA).parquet(*paths)
        return deltas.groupBy("kind", "corpus", "token").agg(F.sum("cnt").alias("cnt")).where("cnt <> 0")

    def token_table(self, version: int | None = None) -> DataFrame:
        return self.counts(version).where("kind = 'token'").select("corpus", "token", "cnt")

    def vocab_stats(self, version: int | None = None) -> DataFrame:
        """M-10 at a version."""
        return V.with_ttr(V.corpus_totals(self.token_table(version)))

    def js_distance(self, pairs: DataFrame, version: int | None = None) -> DataFrame:
        """M-11 at a version."""
        return V.js_distance(self.token_table(version), pairs)

    def keyword_density(self, version: int | None = None) -> DataFrame:
        """M-13 at a version."""
        c, kind = self.counts(version), F.col("kind")

        def total(name: str):
            return F.coalesce(F.sum(F.when(kind == name, F.col("cnt"))), F.lit(0)).cast("bigint")

        per = c.where(kind != "token").groupBy("corpus").agg(
            total("words").alias("total_words"), total("document").alias("n_docs"), total("keyword").alias("total_occurrences"),
            F.count_if(kind == "keyword").alias("unique_found"), total("hit document").alias("docs_with_keywords")).where("n_docs > 0")
        own = F.lower(alnum_only("term"))
        sizes = self.vocab.agg(F.count("*").alias("n"), F.count_if((F.col("term") == own) & (F.length("term") > 0)).alias("m"))
        out = per.withColumn("_v", sizes.select(F.struct("n", "m")).scalar())
        return out.select(
            "corpus", "total_words", "n_docs", "total_occurrences", "unique_found", "docs_with_keywords",
            F.col("_v.n").alias("vocab_size"), F.col("_v.m").alias("matchable_terms"),
            F.when(F.col("total_words") > 0, F.col("total_occurrences") / F.col("total_words") * 1000).otherwise(F.lit(0.0)).alias("density_per_1k"),
            (F.col("unique_found") / F.col("_v.n") * 100).alias("coverage"),
            (F.col("docs_with_keywords") / F.col("n_docs") * 100).alias("doc_coverage"))
