"""Named queries: batch inference with pluggable predictors.  The bundled
predictors follow fixed rules, so SQL can check what they give."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import infer as INF
from corpusloom.plans.common import T, round_cols

# fixed values: the demo lexicon (frequent function words of the four
# languages in the supplied prose), standing in for a sentiment model
POSITIVE = ["the", "and", "le", "la", "der", "und", "el"]
NEGATIVE = ["of", "de", "des", "die", "los", "en"]


def batch_sentiment(spark, sf_dir):
    """D-06 + M-26 + F-28 + F-29: sentiment predictions for every
    conversation turn (blank turns get NULL outputs)."""
    c = T(spark, sf_dir, "conversations").withColumn("key", F.struct("conv_id", "turn"))
    r = INF.sentiment_inference(c, "key", "text", INF.lexicon_sentiment(POSITIVE, NEGATIVE))
    return round_cols(r.select("key.conv_id", "key.turn", "sentiment_label", "sentiment_score", "confidence_level",
                               F.coalesce(F.size("sentiment_class"), F.lit(0)).alias("n_classes")), ["sentiment_score"])


def batch_entities(spark, sf_dir):
    """D-06 + K-03 + M-27: entity predictions over 512-token windows of
    every document, regrouped per document in chunk order."""
    d = T(spark, sf_dir, "documents").select("doc_id", "text")
    return INF.entity_inference(d, "doc_id", "text", INF.capitalised_entities(7), 512)


def document_entities(spark, sf_dir):
    """D-06 + M-27 (trap T-22): entities of every document from batches of
    bounded tokens, with places in the document, where the text must hold them."""
    d = T(spark, sf_dir, "documents").select("doc_id", "text")
    r = INF.document_entities(d, "doc_id", "text", INF.capitalised_entities(7), 512, 8192).join(d, "doc_id")
    found = F.transform("predictions", lambda p: F.concat_ws(":", p["start"], p["end"], p["word"]))
    held = F.forall("predictions", lambda p: F.substring(F.col("text"), p["start"] + 1, p["end"] - p["start"]) == p["word"])
    return r.select("doc_id", "num_preds", F.md5(F.array_join(found, "|")).alias("entities_md5"), held.alias("text_holds_them"))
