"""Declared schemas, label lists and column-synonym lists (fixed values)."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: label lists (id = list position) -------------------------
MARKET_LABELS = ["neutral", "bearish", "bullish"]
ENGAGEMENT_LABELS = ["neutral", "liked", "disliked"]
CONTENT_LABELS = ["neutral", "important", "lol"]
VOTE_COLUMNS = ["bearish", "bullish", "liked", "disliked", "important", "lol"]
# label pairs: (output column, negative/low label, positive/high label)
VOTE_PAIRS = [
    ("market_direction", "bearish", "bullish"),
    ("engagement_quality", "disliked", "liked"),
    ("content_characteristics", "lol", "important"),
]
SEQUENCE_TAGS = ["O", "B-T", "I-T"]
IGNORE_INDEX = -100

# --- fixed values: header synonyms, in priority order ------------------------
DATE_VARIANTS = ["created_at", "date", "time", "timestamp", "datetime", "date_time"]
USER_VARIANTS = ["username", "user_name", "user", "screen_name", "author"]
TWEET_VARIANTS = ["tweet", "text", "content", "full_text", "message", "tweet_text"]
STANDARD_POST_COLUMNS = {"timestamp": DATE_VARIANTS, "username": USER_VARIANTS,
                         "tweet": TWEET_VARIANTS}
# text-column aliases accepted by inference/counting (renamed to ``text``)
TEXT_ALIASES = ["text", "tweet", "review", "comment", "sentence", "document", "code"]

# --- fixed values: yearly mention terms and their synonym merges ------------
COIN_TERMS = ["bitcoin", "ethereum", "hedera", "xrp", "stablecoin",
              "automated market maker", " amm ", "decentralized exchange",
              "decentralised exchange"]
COIN_MERGES = {
    "contains_automated_market_maker": ["contains_automated market maker", "contains_ amm "],
    "contains_decentralized_exchange": ["contains_decentralised exchange",
                                        "contains_decentralized exchange"],
}

# --- declared record schemas -------------------------------------------------
PREDICTION = T.StructType([
    T.StructField("entity_group", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("word", T.StringType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
])

VOTE_COUNTS = T.StructType([T.StructField(c, T.IntegerType()) for c in VOTE_COLUMNS])

POST = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("username", T.StringType()),
    T.StructField("tweet", T.StringType()),
])

VENUE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("alternate_names", T.ArrayType(T.StringType())),
    T.StructField("issn", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("alternate_urls", T.ArrayType(T.StringType())),
])
OPEN_ACCESS_PDF = T.StructType([T.StructField(c, T.StringType())
                                for c in ("url", "status", "license", "disclaimer")])
PAPER_METADATA = T.StructType([
    T.StructField("paperId", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("isOpenAccess", T.BooleanType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("title", T.StringType()),
    T.StructField("abstract", T.StringType()),
    T.StructField("venue", T.StringType()),
    T.StructField("publicationDate", T.StringType()),
    T.StructField("publicationVenue", VENUE),
    T.StructField("openAccessPdf", OPEN_ACCESS_PDF),
    T.StructField("publicationTypes", T.ArrayType(T.StringType())),
    T.StructField("fieldsOfStudy", T.ArrayType(T.StringType())),
    T.StructField("s2FieldsOfStudy", T.ArrayType(T.StructType([
        T.StructField("category", T.StringType()), T.StructField("source", T.StringType())]))),
    T.StructField("authors", T.ArrayType(T.StructType([
        T.StructField("authorId", T.StringType()), T.StructField("name", T.StringType())]))),
    T.StructField("references", T.ArrayType(T.StructType([
        T.StructField("paperId", T.StringType()), T.StructField("title", T.StringType())]))),
])

# --- fixed values: record fields normalised when null ------------------------
LIST_FIELDS = ["publicationTypes", "references", "fieldsOfStudy", "s2FieldsOfStudy", "authors"]
NULL_STRUCT_FIELDS = ["publicationVenue", "openAccessPdf"]
