"""Named queries: token counts and corpus vocabulary statistics.

Corpora: the ``documents`` table split by ``lang`` plus the ``benchmark``
table as the general-language baseline corpus ``benchmark``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.functions.numbers import round_half_even
from corpusloom.functions.tokens import tokens
from corpusloom.operators import sketches as SK
from corpusloom.operators import vocabulary as V
from corpusloom.plans.common import T, round_cols
from corpusloom.session import cut_lineage, ensure_checkpoint_dir
from corpusloom.sources import derived
from corpusloom.streaming.vocabulary import VocabularyTable

BASELINE = "benchmark"
SPECIAL_TOKENS = 2  # [CLS] + [SEP] added by the reference's default tokenizer call


def _token_table(spark, sf_dir):
    """The central (corpus, token, cnt) table, checkpointed once: every
    pairwise measure, total and scalar statistic reads this vocabulary-sized
    table instead of re-tokenising the text."""
    return cut_lineage(V.token_table(_corpora(spark, sf_dir)))


def _corpora(spark, sf_dir):
    docs = T(spark, sf_dir, "documents").select(F.col("lang").alias("corpus"), "doc_id", "text")
    bench = T(spark, sf_dir, "benchmark").select(F.lit(BASELINE).alias("corpus"),
                                                 F.col("item_id").alias("doc_id"), "text")
    return docs.unionByName(bench)


def _vocab(spark, sf_dir):
    return derived.vocabulary(T(spark, sf_dir, "benchmark"))


def _all_pairs(tt):
    """Every unordered pair of corpora, generated from ONE row holding the
    sorted corpus list (no join): element i pairs with the elements after
    it."""
    cs = tt.agg(F.array_sort(F.collect_set("corpus")).alias("cs"))
    a = cs.select("cs", F.posexplode("cs").alias("i", "corpus_a"))
    return a.select("corpus_a", F.explode(F.slice("cs", F.col("i") + 2, F.size("cs"))).alias("corpus_b"))


def _baseline_pairs(tt):
    c = tt.select(F.col("corpus").alias("domain")).distinct().where(F.col("domain") != BASELINE)
    return c.withColumn("baseline", F.lit(BASELINE))


def token_counts(spark, sf_dir):
    """K-01 (+K-02): tokens per document, special tokens included (T-19)."""
    d = T(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return V.ensure_token_counts(d, "text", "total_tokens", SPECIAL_TOKENS).drop("text")


def corpus_size(spark, sf_dir):
    """M-15 + A-10 + A-07: documents, tokens, average and shares per corpus
    (social / patents / literature of IN-2)."""
    d = derived.dated_documents(T(spark, sf_dir, "documents"))
    d = V.ensure_token_counts(d, "text", "total_tokens", SPECIAL_TOKENS)
    return round_cols(V.corpus_size(d, "corpus"), ["avg_tokens", "doc_share", "token_share"])


def vocab_stats(spark, sf_dir):
    """M-10 + A-14 + A-15: totals, distinct tokens, average frequency, TTR
    per corpus."""
    r = V.vocab_stats(_corpora(spark, sf_dir), "corpus", "text")
    return round_cols(r, ["avg_freq", "ttr"])


def js_distance(spark, sf_dir):
    """M-11 + J-10 + J-13: JS distance for every pair of corpora."""
    tt = _token_table(spark, sf_dir)
    return round_cols(V.js_distance(tt, _all_pairs(tt)), ["js_distance"])


def js_divergence(spark, sf_dir):
    """M-11 (trap T-21): distance and divergence for every pair of corpora."""
    tt = _token_table(spark, sf_dir)
    return round_cols(V.js_distance(tt, _all_pairs(tt), divergence=True), ["js_distance", "js_divergence"])


def _versions(spark, sf_dir) -> VocabularyTable:
    """The vocabulary after three lots of documents and the benchmark came in
    and every tenth document went."""
    table = VocabularyTable(spark, f"{ensure_checkpoint_dir(spark)}/vocabulary-{uuid.uuid4().hex}", cut_lineage(_vocab(spark, sf_dir)))
    docs = T(spark, sf_dir, "documents").select(F.col("lang").alias("corpus"), "doc_id", "text")
    for k in range(3):
        table.add(docs.where(F.col("doc_id") % 3 == k))
    table.add(_corpora(spark, sf_dir).where(F.col("corpus") == BASELINE))
    table.remove(docs.where("doc_id % 10 = 0"))
    return table


def vocab_stats_versions(spark, sf_dir):
    """M-10 from deltas: the last version, and the one after the second lot."""
    table = _versions(spark, sf_dir)
    parts = [table.vocab_stats(v).withColumn("version", F.lit(v)) for v in (2, table.version)]
    return round_cols(parts[0].unionByName(parts[1]), ["avg_freq", "ttr"])


def js_distance_versions(spark, sf_dir):
    """M-11 from deltas, after they are made one."""
    table = _versions(spark, sf_dir)
    table.compact()
    return round_cols(table.js_distance(_all_pairs(table.token_table())), ["js_distance"])


def keyword_density_versions(spark, sf_dir):
    """M-13 from deltas."""
    return round_cols(_versions(spark, sf_dir).keyword_density(), ["density_per_1k", "coverage", "doc_coverage"])


def distinct_sketch(spark, sf_dir):
    """A-15 by sketches: distinct tokens of every corpus from sketches of its
    documents' tenths, merged; whether the estimate is within four standard errors."""
    tokens_ = _corpora(spark, sf_dir).select("corpus", (F.col("doc_id") % 10).alias("part"), F.explode(tokens("text")).alias("token"))
    parts = SK.part_sketches(tokens_, "token", ["corpus"], "part")
    exact = V.corpus_totals(_token_table(spark, sf_dir)).select("corpus", "unique_tokens")
    r = SK.estimated(SK.merged(parts, ["corpus"])).join(exact, "corpus").join(parts.groupBy("corpus").agg(F.count("*").alias("n_parts")), "corpus")
    off = F.abs(F.col("approx_distinct") - F.col("unique_tokens")) / F.col("unique_tokens")
    return r.select("corpus", "n_parts", "unique_tokens", (off <= 4 * SK.relative_error()).alias("within"))


def domain_concentration(spark, sf_dir):
    """M-12 + J-11 + O-03: share of each language corpus covered by its 1,000
    tokens most enriched against the benchmark corpus."""
    tt = _token_table(spark, sf_dir)
    s, _top = V.domain_concentration(tt, [BASELINE], 1000)
    return round_cols(s, ["concentration"])


def enriched_tokens(spark, sf_dir):
    """O-03: the 25 most enriched tokens per (corpus, baseline) pair."""
    tt = _token_table(spark, sf_dir)
    _s, top = V.domain_concentration(tt, [BASELINE], 25)
    return round_cols(top, ["enrichment"])


def keyword_density(spark, sf_dir):
    """M-13 + F-04 + F-05 + J-12 + A-16: keyword density and coverage."""
    r = V.keyword_density(_corpora(spark, sf_dir), _vocab(spark, sf_dir))
    return round_cols(r, ["density_per_1k", "coverage", "doc_coverage"])


def top_keywords(spark, sf_dir):
    """O-04: 20 most frequent keywords per corpus."""
    return V.top_keywords(_corpora(spark, sf_dir), _vocab(spark, sf_dir), 20)


def corpus_keyword_profile(spark, sf_dir):
    """Flagship: keyword density joined with vocabulary statistics per
    corpus."""
    c = _corpora(spark, sf_dir)
    kd = V.keyword_density(c, _vocab(spark, sf_dir)).select(
        "corpus", "n_docs", "total_words", "density_per_1k", "coverage", "doc_coverage")
    vs = V.vocab_stats(c, "corpus", "text")
    r = kd.join(vs, "corpus", "inner")
    return round_cols(r, ["density_per_1k", "coverage", "doc_coverage", "avg_freq", "ttr"])


def corpus_summary(spark, sf_dir):
    """M-14 + F-24: one wide row per corpus - vocabulary statistics, keyword
    density, JS distance and concentration against the baseline (NULL for
    the baseline itself), rounded half-even to 3 digits."""
    c = _corpora(spark, sf_dir)
    tt = _token_table(spark, sf_dir)
    vs = V.with_ttr(V.corpus_totals(tt))
    kd = V.keyword_density(c, _vocab(spark, sf_dir)).select("corpus", "density_per_1k", "doc_coverage")
    bp = _baseline_pairs(tt)
    js = V.js_distance(tt, bp.select(F.col("domain").alias("corpus_a"), F.col("baseline").alias("corpus_b")))
    js_w = js.groupBy(F.col("corpus_a").alias("corpus")).pivot("corpus_b", [BASELINE]) \
        .agg(F.first("js_distance")).withColumnRenamed(BASELINE, f"js_vs_{BASELINE}")
    conc, _t = V.domain_concentration(tt, [BASELINE], 1000)
    conc_w = conc.groupBy(F.col("domain").alias("corpus")).pivot("baseline", [BASELINE]) \
        .agg(F.first("concentration")).withColumnRenamed(BASELINE, f"concentration_vs_{BASELINE}")
    out = vs.join(kd, "corpus", "left").join(js_w, "corpus", "left").join(conc_w, "corpus", "left")
    dbl = ["avg_freq", "ttr", "density_per_1k", "doc_coverage", f"js_vs_{BASELINE}",
           f"concentration_vs_{BASELINE}"]
    return out.withColumns({c: round_half_even(c, 3) for c in dbl})


def corpus_class_means(spark, sf_dir):
    """A-23: mean TTR and keyword density of domain corpora vs the general
    baseline, and their ratio."""
    c = _corpora(spark, sf_dir)
    tt = _token_table(spark, sf_dir)
    st = V.with_ttr(V.corpus_totals(tt)) \
        .join(V.keyword_density(c, _vocab(spark, sf_dir)).select("corpus", "density_per_1k"), "corpus")
    cls = F.when(F.col("corpus") == BASELINE, F.lit("general")).otherwise(F.lit("domain"))
    g = st.groupBy(cls.alias("corpus_class")).agg(F.avg("ttr").alias("mean_ttr"),
                                                  F.avg("density_per_1k").alias("mean_density"))
    gen = g.where(F.col("corpus_class") == "general").select(
        F.struct(F.col("mean_ttr").alias("t"), F.col("mean_density").alias("d")).alias("s")).scalar()
    r = g.withColumn("_g", gen).select(
        "corpus_class", "mean_ttr", "mean_density",
        F.try_divide(F.col("mean_ttr"), F.col("_g.t")).alias("ttr_ratio"),
        F.try_divide(F.col("mean_density"), F.col("_g.d")).alias("density_ratio"))
    return round_cols(r, ["mean_ttr", "mean_density", "ttr_ratio", "density_ratio"])
