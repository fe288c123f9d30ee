"""Language identification as a Spark job (K-10, X-11), re-aimed from a
per-row library call to a character n-gram model trained and applied with
joins and aggregates.

Training: character n-grams of lower-cased text, counted per (language,
gram); each language keeps its ``top_k`` most frequent grams with
add-one-smoothed log probabilities (a bounded profile: languages x top_k
rows, broadcast after a size check).  Scoring: the n-grams of a document
meet the profile; grams outside a language's profile score that
language's smoothing floor; the best-scoring language wins (ties by name).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import collapse_ws
from corpusloom.operators.joins import broadcast_if_small


def gram_text(text):
    """Whitespace-normalised, lower-cased text padded with one space at both
    ends (materialise it as a column before :func:`char_ngrams`)."""
    return F.concat(F.lit(" "), F.lower(collapse_ws(text)), F.lit(" "))


def char_ngrams(prepared_col: str, n: int = 3):
    """Overlapping character n-grams of an already prepared text column, in
    one linear regex pass: a zero-width lookahead captures the ``n``
    characters at every position, and one character (code point) is taken (per-position ``substring`` would
    rescan UTF-8 text from the start each time)."""
    return F.regexp_extract_all(F.col(prepared_col), F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))


def word_units(prepared_col: str, n: int = 3):
    """The words of a prepared text, each with the space before it and the
    ``n - 1`` characters after it: from ``n`` = 3 on, the n-grams of a text are
    those of its units, and a unit comes again where a text does not."""
    return F.regexp_extract_all(F.col(prepared_col), F.lit(f"(?s)(?=( [^ ]+.{{0,{n - 1}}})) [^ ]+"), F.lit(1))


def train_profiles(df: DataFrame, text_col: str = "text", lang_col: str = "lang", n: int = 3) -> DataFrame:
    """(lang, gram, logp, floor) profile rows: all of each language's
    grams with add-one smoothed log probabilities and its floor."""
    text = df.select(F.col(lang_col).alias("lang"), gram_text(text_col).alias("_gt"))
    # n-grams of each distinct unit, not of each text
    unit = text.select("lang", F.explode(word_units("_gt", n)).alias("_u")) if n >= 3 else text.withColumnRenamed("_gt", "_u")
    units = unit.groupBy("lang", "_u").agg(F.count("*").alias("_c"))
    counts = units.select("lang", "_c", F.explode(char_ngrams("_u", n)).alias("gram")).groupBy("lang", "gram").agg(F.sum("_c").alias("cnt"))
    return _profiles(counts)


def _profiles(counts: DataFrame) -> DataFrame:
    tot = counts.groupBy("lang").agg(F.sum("cnt").alias("total"), F.count("*").alias("v"))
    prof = counts.join(tot, "lang").select(
        "lang", "gram", F.log((F.col("cnt") + 1) / (F.col("total") + F.col("v"))).alias("logp"),
        F.log(F.lit(1.0) / (F.col("total") + F.col("v"))).alias("floor"))
    return prof


def identify(df: DataFrame, profiles: DataFrame, key_col: str, text_col: str = "text", n: int = 3,
             out: str = "language") -> DataFrame:
    """Best language per row; NULL or blank text -> NULL, as is all without a
    profile.  Ties go to the language that sorts first.

    score(doc, lang) = grams of the text x the language's floor + sum over its
    grams of what their log probability is above that floor.

    Plan: the profile is turned to one row per gram with a column per language
    (their list, one row a language, is collected), so each gram of a text meets
    one row - map-side while the profile is small, by gram beyond - and
    the sums of a text are one row; only these are shuffled."""
    floors = {r["lang"]: r["floor"] for r in profiles.groupBy("lang").agg(F.first("floor").alias("floor")).collect()}
    langs = sorted(floors)
    keys = df.select(key_col)
    if not langs:
        return keys.withColumn(out, F.lit(None).cast("string"))
    above = F.col("logp") - F.col("floor")
    wide = profiles.groupBy("gram").agg(*[F.max(F.when(F.col("lang") == x, above)).alias(f"_d{i}") for i, x in enumerate(langs)])
    pre = df.select(key_col, gram_text(text_col).alias("_gt"))
    pre = pre.select(key_col, "_gt", F.greatest(F.length("_gt") - n + 1, F.lit(0)).cast("bigint").alias("_tot"))
    grams = pre.select(key_col, "_tot", F.explode(char_ngrams("_gt", n)).alias("gram"))
    sums = grams.join(broadcast_if_small(wide), "gram", "left").groupBy(key_col, "_tot").agg(
        *[F.coalesce(F.sum(f"_d{i}"), F.lit(0.0)).alias(f"_s{i}") for i in range(len(langs))])
    scores = [F.struct((-(F.col(f"_s{i}") + F.col("_tot") * F.lit(floors[x]))).alias("ns"), F.lit(x).alias("lang")) for i, x in enumerate(langs)]
    best = sums.select(key_col, F.array_min(F.array(*scores))["lang"].alias(out))
    return keys.join(best, key_col, "left")
