"""Corpus vocabulary statistics (A-14..A-16, A-23, J-10..J-13, K-01, K-02,
O-03, O-04, M-10..M-15).

Everything hangs off one long token-frequency table ``(corpus, token, cnt)``
built by ``explode`` + ``groupBy`` in the same stage, so the exploded tokens
are never materialised: map-side partial aggregation collapses frequent
tokens before the shuffle.  Pairwise measures (JS distance, enrichment) join
that table with itself for an explicit, caller-given list of corpus pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import alnum_only, clean_word_list, split_words
from corpusloom.functions.tokens import token_count, tokens
from corpusloom.operators.joins import broadcast_if_small
from corpusloom.operators.prefix import ordered_prefix


def ensure_token_counts(df: DataFrame, text_col: str = "text", out: str = "total_tokens",
                        special_tokens: int = 0) -> DataFrame:
    """K-01 + K-02: add a per-row token count unless the column exists."""
    if out in df.columns:
        return df
    return df.withColumn(out, token_count(text_col, special_tokens))


def token_table(df: DataFrame, corpus_col: str = "corpus", text_col: str = "text") -> DataFrame:
    """A-14: ``(corpus, token, cnt)`` frequency table."""
    return (df.select(F.col(corpus_col).alias("corpus"), F.explode(tokens(text_col)).alias("token"))
            .groupBy("corpus", "token").agg(F.count("*").alias("cnt")))


def corpus_totals(tt: DataFrame) -> DataFrame:
    """Per corpus: total tokens, distinct tokens, average frequency."""
    return tt.groupBy("corpus").agg(F.sum("cnt").cast("bigint").alias("total_tokens"),
                                    F.count("*").alias("unique_tokens")) \
        .withColumn("avg_freq", F.col("total_tokens") / F.col("unique_tokens"))


def ttr_prefix(df: DataFrame, corpus_col: str = "corpus", text_col: str = "text",
               order_col: str = "doc_id", sample_tokens: int = 100_000) -> DataFrame:
    """M-10 (TTR part): type-token ratio of the first ``sample_tokens``
    tokens of each corpus in ``order_col`` order (the reference's sample
    definition).  Token offsets come from :func:`ordered_prefix` over a
    narrow (corpus, order, n) table; only documents that start inside the
    sample are re-tokenised."""
    counts = df.select(F.col(corpus_col).alias("corpus"), F.col(order_col).alias("_ord"),
                       F.size(tokens(text_col)).alias("_n")).where(F.col("_n") > 0)
    starts = ordered_prefix(counts, ["_ord"], "_n", out="_start", partition_cols=["corpus"],
                            inclusive=False, materialize=True).where(F.col("_start") < sample_tokens)
    docs = df.select(F.col(corpus_col).alias("corpus"), F.col(order_col).alias("_ord"),
                     F.col(text_col).alias("_t"))
    starts = starts.select(F.col("corpus").alias("_c"), F.col("_ord").alias("_o"), "_start")
    head = docs.join(starts, F.col("corpus").eqNullSafe(F.col("_c")) & (F.col("_ord") == F.col("_o")))
    toks = head.select("corpus", "_start", F.posexplode(tokens("_t")).alias("_p", "token")) \
        .where(F.col("_start") + F.col("_p") < sample_tokens)
    return toks.groupBy("corpus").agg(
        (F.count_distinct("token") / F.count("*")).alias("ttr"))


def with_ttr(totals: DataFrame) -> DataFrame:
    """Type-token ratio of the whole corpus, from its totals."""
    return totals.withColumn("ttr", F.col("unique_tokens") / F.col("total_tokens"))


def vocab_stats(df: DataFrame, corpus_col: str = "corpus", text_col: str = "text",
                order_col: str = "doc_id", sample_tokens: int | None = None) -> DataFrame:
    """M-10: total, unique, average frequency and TTR per corpus, the ratio
    over the whole corpus or, on request, over its first ``sample_tokens``."""
    tot = corpus_totals(token_table(df, corpus_col, text_col))
    if sample_tokens is None:
        return with_ttr(tot)
    ttr = ttr_prefix(df, corpus_col, text_col, order_col, sample_tokens).withColumnRenamed("corpus", "_c")
    return tot.join(ttr, F.col("corpus").eqNullSafe(F.col("_c")), "left").drop("_c").withColumn("ttr", F.coalesce("ttr", F.lit(0.0)))


def js_distance(tt: DataFrame, pairs: DataFrame, divergence: bool = False) -> DataFrame:
    """M-11: Jensen-Shannon *distance* (natural log) between the token
    distributions of each ``(corpus_a, corpus_b)`` pair, renormalised on the
    shared vocabulary; no shared token -> 1.0 (trap T-21).  ``divergence`` adds
    the divergence itself, of which the distance is the square root."""
    a = tt.select(F.col("corpus").alias("corpus_a"), "token", F.col("cnt").alias("ca"))
    b = tt.select(F.col("corpus").alias("corpus_b"), "token", F.col("cnt").alias("cb"))
    shared = (pairs.join(a, "corpus_a").join(b, ["corpus_b", "token"]))
    sums = shared.groupBy("corpus_a", "corpus_b").agg(F.sum("ca").alias("sa"), F.sum("cb").alias("sb"))
    # one row per requested pair: bounded by the caller's pair list
    t = shared.join(F.broadcast(sums), ["corpus_a", "corpus_b"])
    p, q = F.col("ca") / F.col("sa"), F.col("cb") / F.col("sb")
    m = (p + q) / 2
    terms = t.select("corpus_a", "corpus_b", (p * F.log(p / m)).alias("l"), (q * F.log(q / m)).alias("r"))
    js = terms.groupBy("corpus_a", "corpus_b").agg(
        F.sqrt(F.greatest(F.lit(0.0), (F.sum("l") + F.sum("r")) / 2)).alias("js_distance"),
        F.count("*").alias("shared_tokens"))
    return (pairs.join(js, ["corpus_a", "corpus_b"], "left")
            .select("corpus_a", "corpus_b",
                    F.coalesce("js_distance", F.lit(1.0)).alias("js_distance"),
                    *([F.coalesce(F.col("js_distance") * F.col("js_distance"), F.lit(1.0)).alias("js_divergence")] if divergence else []),
                    F.coalesce("shared_tokens", F.lit(0)).cast("bigint").alias("shared_tokens")))


def domain_concentration(tt: DataFrame, baselines: list[str], top_k: int = 1000) -> tuple[DataFrame, DataFrame]:
    """M-12: for every corpus against each baseline in ``baselines`` (a
    caller-given list), the enrichment of each domain token = domain
    frequency / baseline frequency (a token missing from the baseline counts
    1, J-11), and the share of the domain's tokens covered by its ``top_k``
    most enriched tokens (ties by token, trap T-14).  Returns (summary, top
    tokens).

    Per baseline: the domain token table is left-joined with that baseline's
    tokens on ``token`` (an equi-join), the baseline total is a scalar
    subquery, and the per-pair top-k is ``row_number() <= k`` (planned as a
    group limit before the shuffle)."""
    tot = tt.groupBy("corpus").agg(F.sum("cnt").alias("td"))
    summaries, tops = [], []
    for base in baselines:
        bl = tt.where(F.col("corpus") == base).select("token", F.col("cnt").alias("cb"))
        tb = bl.select(F.sum("cb").alias("tb")).scalar()
        d = (tt.where(F.col("corpus") != base).select(F.col("corpus").alias("domain"), "token",
                                                      F.col("cnt").alias("cd"))
             .join(tot.withColumnRenamed("corpus", "domain"), "domain"))
        enr = d.join(bl, "token", "left").withColumn("baseline", F.lit(base)).withColumn(
            "enrichment", (F.col("cd") / F.col("td")) / (F.coalesce(F.col("cb"), F.lit(1)) / tb))
        w = Window.partitionBy("domain").orderBy(F.col("enrichment").desc(), F.col("token"))
        top = enr.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)
        summaries.append(top.groupBy("domain", "baseline", "td")
                         .agg(F.sum("cd").alias("top_mass"), F.count("*").alias("top_n"))
                         .select("domain", "baseline", "top_n",
                                 (F.col("top_mass") / F.col("td") * 100).alias("concentration")))
        tops.append(top.select("domain", "baseline", "rank", "token", "enrichment", F.col("cd").alias("cnt")))
    out_s, out_t = summaries[0], tops[0]
    for a, b in zip(summaries[1:], tops[1:]):
        out_s, out_t = out_s.unionByName(a), out_t.unionByName(b)
    return out_s, out_t


def keyword_hits(df: DataFrame, vocab: DataFrame, corpus_col: str = "corpus",
                 doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """J-12 + A-14: ``(corpus, doc, term, n)`` keyword hits - lower-cased
    whitespace words with non-alphanumerics removed, semi-joined with the
    vocabulary (broadcast after a size check)."""
    w = df.select(F.col(corpus_col).alias("corpus"), F.col(doc_col).alias("doc"),
                  F.explode(clean_word_list(text_col)).alias("term"))
    v = broadcast_if_small(vocab.select("term").distinct().where(F.length("term") > 0))
    return w.join(v, "term", "inner").groupBy("corpus", "doc", "term").agg(F.count("*").alias("n"))


def keyword_density(df: DataFrame, vocab: DataFrame, corpus_col: str = "corpus",
                    doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """M-13: per corpus - words, documents, keyword occurrences, distinct
    keywords found, documents with a keyword, density per 1,000 words,
    vocabulary coverage % (over the FULL term list, trap T-23), matchable
    terms and document coverage %.

    One pass over the text: cleaned words are exploded once
    (``explode_outer`` keeps documents without words), left-joined with the
    broadcast vocabulary, and aggregated per (corpus, doc, matched term);
    every total comes from that small table."""
    v = broadcast_if_small(vocab.select(F.col("term").alias("_mt")).distinct().where(F.length("_mt") > 0))
    # word totals: a plain whitespace split, carried on the first exploded
    # row of each document; matching uses the cleaned non-empty words
    # per-row values are computed in a projection BELOW the generator:
    # expressions placed next to an explode are evaluated once per
    # generated row, which would re-split the whole text for every word
    pre = df.select(F.col(corpus_col).alias("corpus"), F.col(doc_col).alias("doc"),
                    F.size(split_words(text_col)).alias("_nw"), clean_word_list(text_col).alias("_cw"))
    w = pre.select("corpus", "doc", "_nw", F.posexplode_outer("_cw").alias("_p", "w"))
    j = w.join(v, F.col("w") == F.col("_mt"), "left")
    first = F.col("_p").isNull() | (F.col("_p") == 0)
    per = j.groupBy("corpus", "doc", "_mt").agg(F.count("w").alias("n"),
                                                F.sum(F.when(first, F.col("_nw"))).alias("nw"))
    hit = F.col("_mt").isNotNull()
    agg = per.groupBy("corpus").agg(
        F.coalesce(F.sum("nw"), F.lit(0)).cast("bigint").alias("total_words"),
        F.count_distinct("doc").alias("n_docs"),
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).cast("bigint").alias("total_occurrences"),
        F.count_distinct("_mt").cast("bigint").alias("unique_found"),
        F.count_distinct(F.when(hit, F.col("doc"))).cast("bigint").alias("docs_with_keywords"))
    vs = vocab.select("term").distinct()
    # a term can match only if it equals its own cleaned, lower-cased form
    cleaned = F.lower(alnum_only("term"))
    sizes = vs.agg(F.count("*").alias("n"),
                   F.count_if((F.col("term") == cleaned) & (F.length("term") > 0)).alias("m"))
    st = sizes.select(F.struct("n", "m").alias("s")).scalar()
    out = agg.withColumn("_v", st)
    return out.select(
        "corpus", "total_words", "n_docs", "total_occurrences", "unique_found", "docs_with_keywords",
        F.col("_v.n").alias("vocab_size"), F.col("_v.m").alias("matchable_terms"),
        F.when(F.col("total_words") > 0, F.col("total_occurrences") / F.col("total_words") * 1000)
        .otherwise(F.lit(0.0)).alias("density_per_1k"),
        (F.col("unique_found") / F.col("_v.n") * 100).alias("coverage"),
        F.when(F.col("n_docs") > 0, F.col("docs_with_keywords") / F.col("n_docs") * 100)
        .otherwise(F.lit(0.0)).alias("doc_coverage"))


def top_keywords(df: DataFrame, vocab: DataFrame, k: int = 20, corpus_col: str = "corpus",
                 doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """O-04: the ``k`` most frequent keywords per corpus (ties by term)."""
    hits = keyword_hits(df, vocab, corpus_col, doc_col, text_col)
    c = hits.groupBy("corpus", "term").agg(F.sum("n").cast("bigint").alias("cnt"))
    w = Window.partitionBy("corpus").orderBy(F.col("cnt").desc(), F.col("term"))
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def corpus_size(df: DataFrame, corpus_col: str = "corpus", count_col: str = "total_tokens") -> DataFrame:
    """M-15 (+A-07, A-10): documents, tokens, average tokens per document and
    each corpus' share of all documents and tokens."""
    g = df.groupBy(F.col(corpus_col).alias("corpus")).agg(
        F.count("*").alias("documents"), F.sum(count_col).cast("bigint").alias("tokens"),
        F.avg(count_col).alias("avg_tokens"))
    tots = df.select(F.struct(F.count("*").alias("d"), F.sum(count_col).alias("t")).alias("s")).scalar()
    return (g.withColumn("_s", tots)
            .withColumn("doc_share", F.col("documents") / F.col("_s.d") * 100)
            .withColumn("token_share", F.col("tokens") / F.col("_s.t") * 100).drop("_s"))
