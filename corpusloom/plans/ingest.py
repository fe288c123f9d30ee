"""Named queries: source standardisation, unions and the composed ingest /
join jobs (M-22, M-23, M-24)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.functions.text import collapse_ws, non_blank, year_int
from corpusloom.operators import joins as J
from corpusloom.operators import shape as SH
from corpusloom.operators.encoding import repair_encoding
from corpusloom.plans.common import T, round_cols
from corpusloom.sources import derived
from corpusloom.session import ensure_checkpoint_dir
from corpusloom.sources.files import file_key
from corpusloom.sources.smallfiles import read_small_files

VIEWS = ["view_created_at", "view_date_time", "view_datetime"]


def _views(spark, sf_dir, with_order: bool = False):
    c = T(spark, sf_dir, "conversations")
    if with_order:
        c = c.withColumn("_ord", F.struct("conv_id", "turn"))
        return dict(zip(VIEWS, derived.mixed_header_sources(c, carry=("_ord",))))
    return dict(zip(VIEWS, derived.mixed_header_sources(c)))


def standardise_columns(spark, sf_dir):
    """P-01 + P-02 + P-03 + U-01: three differently headed sources mapped to
    (timestamp, username, tweet) and unioned with their source name."""
    parts = [SH.standardise_columns(v).withColumn("source", F.lit(n)) for n, v in _views(spark, sf_dir).items()]
    return SH.union_all(parts)


def standardise_merge_date_time(spark, sf_dir):
    """P-04 opt-in: ``Date`` + ``time`` merged into one timestamp."""
    parts = [SH.standardise_columns(v, merge_date_time=True).withColumn("source", F.lit(n))
             for n, v in _views(spark, sf_dir).items()]
    return SH.union_all(parts)


def union_sources(spark, sf_dir):
    """U-02 + A-07: rows per source and percent of all rows."""
    u = standardise_columns(spark, sf_dir)
    c = u.groupBy("source").agg(F.count("*").alias("rows"))
    n = u.select(F.count("*").alias("n")).scalar()
    return round_cols(c.withColumn("percent", F.col("rows") / n * 100), ["percent"])


def posts_ingest(spark, sf_dir):
    """M-22: standardise three sources, union, clean the post text
    (whitespace, then encoding repair on suspect rows only), drop blank
    posts, keep the first post of every distinct text in source order."""
    parts = [SH.standardise_columns(v, keep=["_ord"]).withColumn("src_rank", F.lit(i))
             for i, v in enumerate(_views(spark, sf_dir, with_order=True).values())]
    u = SH.union_all(parts).withColumn("tweet", F.when(F.col("tweet").isNotNull(), collapse_ws("tweet")))
    u = repair_encoding(u, "tweet").where(non_blank("tweet"))
    first = J.dedup_text(u, "tweet", ["src_rank", "_ord"])
    return first.select("timestamp", "username", "tweet")


def combine_text_sources(spark, sf_dir):
    """U-02 + P-06 + P-07 (+K-02): text columns of several tables combined
    with a source column (a table without a text column is skipped), and
    each source's share."""
    srcs = {"documents": T(spark, sf_dir, "documents"), "conversations": T(spark, sf_dir, "conversations"),
            "posts": SH.union_all([SH.standardise_columns(v) for v in _views(spark, sf_dir).values()]), "benchmark": T(spark, sf_dir, "benchmark"),
            "labels": T(spark, sf_dir, "labels")}
    u = SH.combine_text_sources(srcs)
    c = u.groupBy("source").agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars"))
    n = u.select(F.count("*").alias("n")).scalar()
    return round_cols(c.withColumn("percent", F.col("rows") / n * 100), ["percent"])


def text_alias_roundtrip(spark, sf_dir):
    """P-06 + P-07: tables with two aliases are cleaned as ``text`` and get
    their columns' old names back."""
    out = []
    for name, df, alias in (("documents", T(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("tweet")), "tweet"),
                            ("benchmark", T(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("sentence")), "sentence")):
        work, old = SH.with_text_column(df)
        back = SH.restore_text_column(work.withColumn("text", collapse_ws("text")), old)
        assert old == alias and back.columns == df.columns
        out.append(back.select(F.lit(name).alias("source"), "doc_id", F.lit(old).alias("alias"), F.md5(alias).alias("text_md5")))
    return SH.union_all(out)


def _records(spark, sf_dir):
    """IN-10-like metadata records from IN-4: NULL structs and lists in
    fixed places (doc_id % 3, % 4), year as text."""
    m = derived.metadata(T(spark, sf_dir, "labels"))
    d = F.col("doc_id")
    venue = F.when(d % 3 == 0, F.lit(None)).otherwise(F.struct(
        F.concat(F.lit("v"), F.col("key")).alias("id"), F.concat(F.lit("Venue "), (d % 11).cast("string")).alias("name"),
        F.lit("journal").alias("type"), F.array(F.lit("alt")).alias("alternate_names"),
        F.lit(None).cast("string").alias("issn"), F.lit(None).cast("string").alias("url"),
        F.array().cast("array<string>").alias("alternate_urls")))
    fields = F.when(d % 4 == 0, F.lit(None).cast("array<string>")).otherwise(
        F.array(F.lit("Computer Science"), F.concat(F.lit("F"), (d % 5).cast("string"))))
    year = F.when(d % 9 == 0, F.lit(None)).otherwise((F.lit(2000) + d % 25).cast("string"))
    key = F.when(d % 23 == 0, F.lit("")).otherwise(F.col("key"))
    return m.select(key.alias("paperId"), "doc_id", "ord", "quality", "toxic", venue.alias("publicationVenue"),
                    fields.alias("fieldsOfStudy"), year.alias("year_text"))


def standardise_records(spark, sf_dir):
    """P-05 + P-08 + P-11 + P-16 + X-02 + X-09: NULL struct/list
    normalisation, empty keys dropped, integer year required, extended
    typed columns, a flat projection."""
    r = SH.normalise_records(_records(spark, sf_dir))
    r = r.where(F.col("paperId").isNotNull() & (F.col("paperId") != ""))
    r = r.withColumn("year", year_int("year_text")).where(F.col("year").isNotNull())
    r = SH.extend_schema(r, {"n_fields": F.size("fieldsOfStudy"), "has_venue": F.col("publicationVenue.id").isNotNull()},
                         {"n_fields": "int", "has_venue": "boolean"})
    return r.select("paperId", "doc_id", "ord", "year", "n_fields", "has_venue",
                    F.col("publicationVenue.name").alias("venue_name"))


def literature_join(spark, sf_dir):
    """M-23 (join part): normalised records deduplicated keep-first per
    paperId, documents deduplicated per text, inner join, left (document)
    values win on clashes."""
    recs = SH.normalise_records(_records(spark, sf_dir)).where(F.col("paperId") != "")
    recs = J.keep_first(recs.select("paperId", "doc_id", "ord", "quality", F.col("publicationVenue.name")
                                    .alias("venue"), F.size("fieldsOfStudy").alias("n_fields")),
                        "paperId", ["ord", "doc_id"])
    docs = J.dedup_text(T(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "text", "doc_id") \
        .select(F.col("doc_id").cast("string").alias("paperId"), "doc_id", "lang",
                F.length("text").alias("text_chars"))
    return J.merge_precedence(docs, recs, "paperId")


def patent_join(spark, sf_dir):
    """M-24 (S-10, X-02, J-02, P-14): patent texts keyed by their file name
    (``<source>/<doc_id>.md`` paths), empty keys dropped, metadata
    deduplicated last-wins and joined, NULL metadata -> ''."""
    d = T(spark, sf_dir, "documents").select(
        F.concat(F.lit("/data/patents/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"),
                 F.lit(".md")).alias("path"), "text")
    d = d.withColumn("key", file_key("path", ".md")).where(F.col("key").isNotNull() & (F.col("key") != ""))
    meta = derived.metadata(T(spark, sf_dir, "labels")).select("key", "doc_id", "quality", "toxic", "ord")
    j = J.inner_join_last(d.select("key", F.length("text").alias("text_chars")), meta, "key", ["ord", "doc_id"])
    return j


def _turn_files(spark, sf_dir) -> str:
    """Conversation turns written as many small files below the shared folder:
    one file for each of ``turn % 3`` header styles and 211 ranges of
    conversations, with planted bad lines.  Returns the folder."""
    c = T(spark, sf_dir, "conversations").withColumn("style", F.pmod("turn", F.lit(3))).withColumn(
        "part", F.concat(F.col("style").cast("string"), F.lit("-"), F.pmod("conv_id", F.lit(211)).cast("string")))
    date = F.concat(F.lit("2020-"), F.lpad((F.col("conv_id") % 12 + 1).cast("string"), 2, "0"), F.lit("-01"))
    cell = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    line = (F.when(F.col("style") == 0, F.concat_ws(",", date, "role", cell, "conv_id", "turn"))
            .when(F.col("style") == 1, F.concat_ws(",", date, F.concat(F.lpad((F.col("turn") % 24).cast("string"), 2, "0"), F.lit(":00")), cell, "conv_id"))
            .otherwise(F.to_json(F.struct(date.alias("datetime"), F.col("text").alias("full_text"), F.col("role").alias("user")))))
    header = (F.when(F.col("style") == 0, "created_at,user_name,tweet,a,b").when(F.col("style") == 1, "Date,time,Content,c"))
    # a field too many, a broken quote, a cut object
    bad = F.when(F.col("style") == 0, "x,y,z,1,2,3").when(F.col("style") == 1, 'x,"y').otherwise('{"datetime": "x", ')
    rows = c.select("part", "style", F.concat(F.lit("1"), F.lpad("conv_id", 12, "0"), F.lpad("turn", 12, "0")).alias("ord"), line.alias("value"))
    planted = c.where("conv_id % 11 = 0").select("part", "style", F.concat(F.lit("1"), F.lpad("conv_id", 12, "0"), F.lpad("turn", 12, "0"), F.lit("x")).alias("ord"),
                                                 bad.alias("value"))
    heads = c.select("part", "style").distinct().select("part", "style", F.lit("0").alias("ord"), header.alias("value")).where("value is not null")
    folder = f"{ensure_checkpoint_dir(spark)}/turn-files-{uuid.uuid4().hex}"
    lines = rows.unionAll(planted).unionAll(heads)
    for kind, which in (("csv", "style < 2"), ("json", "style = 2")):
        (lines.where(which).repartition("part").sortWithinPartitions("part", "ord").select("part", "value")
         .write.partitionBy("part").option("compression", "none").text(f"{folder}/{kind}"))
    return folder


def small_files_scan(spark, sf_dir):
    """S-01..S-08 + S-17: turns written as hundreds of small CSV and JSON files
    of three headers and read back as one table; bad lines are rows with a reason."""
    folder = _turn_files(spark, sf_dir)
    out = []
    for kind in ("csv", "json"):
        good, bad = read_small_files(spark, f"{folder}/{kind}", "*.txt", merge_date_time=True, kind=kind)
        out.append(good.select(F.lit(kind).alias("kind"), F.lit("good").alias("status"), "timestamp", "username", F.md5("tweet").alias("tweet_md5"))
                   .unionByName(bad.select(F.lit(kind).alias("kind"), F.split("reason", r" \(").getItem(0).alias("status"),
                                           F.lit(None).cast("string").alias("timestamp"), F.lit(None).cast("string").alias("username"),
                                           F.md5("raw").alias("tweet_md5"))))
    return SH.union_all(out)
