"""Named queries: entity filtering, threshold sweeps and model evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.arrays import argmax, array_max_or, decode_label, scores_excluding, softmax
from corpusloom.functions.literal import parse_literal_list
from corpusloom.functions.numbers import confidence_band
from corpusloom.operators import evaluate as EV
from corpusloom.operators import labels as L
from corpusloom.operators import splits as SP
from corpusloom.plans.common import T, round_cols, votes
from corpusloom.sources import derived
from corpusloom.sources.schemas import SEQUENCE_TAGS


def _preds(spark, sf_dir):
    return derived.predictions(T(spark, sf_dir, "documents"))


def _with_class(spark, sf_dir, df):
    """Gold class from ``labels.quality``; unlabeled documents count as 0
    (left join + fill, P-15)."""
    lab = T(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("class"))
    return df.join(lab, "doc_id", "left").na.fill(0, ["class"])


def entity_filter(spark, sf_dir):
    """M-09: keep documents whose best non-ESG entity score exceeds 0.995."""
    r = EV.entity_filter(_preds(spark, sf_dir).drop("text"))
    r = r.select("doc_id", "num_preds", F.size("prediction_scores").alias("n_scores"),
                 "prediction_max", "prediction_median", "max_pred")
    return round_cols(r, ["prediction_max", "prediction_median"])


def confusion(spark, sf_dir):
    """A-20: confusion counts of the 0.995 entity flag against the gold class."""
    r = EV.entity_filter(_preds(spark, sf_dir).drop("text"), keep_only=False)
    return EV.confusion_counts(_with_class(spark, sf_dir, r), "class", "max_pred")


def _pmax0(spark, sf_dir):
    p = _preds(spark, sf_dir).select(
        "doc_id", array_max_or(scores_excluding("predictions"), 0.0).alias("prediction_max"),
        F.size("predictions").alias("num_preds"))
    return _with_class(spark, sf_dir, p)


def threshold_sweep(spark, sf_dir):
    """M-08: accuracy at thresholds 0.9900, 0.9901, ..., 1.0000 (empty
    prediction lists score 0, notebook variant of T-02)."""
    r = EV.threshold_sweep(_pmax0(spark, sf_dir), "class", "prediction_max")
    return round_cols(r, ["threshold", "accuracy"])


def class_describe(spark, sf_dir):
    """A-13: describe() of the best entity score per gold class."""
    r = EV.group_describe(_pmax0(spark, sf_dir), "class", "prediction_max")
    return round_cols(r, ["mean", "std", "min", "p25", "p50", "p75", "max"])


def class_box_stats(spark, sf_dir):
    """A-22: box-plot statistics of the prediction count per gold class."""
    r = EV.box_stats(_pmax0(spark, sf_dir), "class", "num_preds")
    return round_cols(r, ["p25", "p50", "p75", "iqr"])


def pct_histogram(spark, sf_dir):
    """A-21: 10-bin histogram of the bullish vote share (IN-1)."""
    from corpusloom.functions.numbers import pct_of, row_sum
    v = votes(spark, sf_dir).select(pct_of("bullish", row_sum(["bearish", "bullish"])).alias("bullish_pct"))
    return round_cols(EV.histogram(v, "bullish_pct", 10), ["bin_start", "bin_end", "density"])


def _logits(spark, sf_dir):
    return derived.logits(T(spark, sf_dir, "embeddings"))


def classification_report(spark, sf_dir):
    """M-16 + F-27: arg-max predictions of IN-6 logits against the label."""
    r = EV.classification_report(EV.with_argmax(_logits(spark, sf_dir)), "label", "pred")
    return round_cols(r, r.columns)


def roc_points(spark, sf_dir):
    """M-18 + F-26 + W-09: one-vs-rest ROC points per class."""
    return round_cols(EV.roc_points(_logits(spark, sf_dir), "logits", "label"), ["threshold", "tpr", "fpr"])


CLASS_NAMES = [f"class_{i}" for i in range(10)]


def prediction_summary(spark, sf_dir):
    """M-20 + F-28: distribution of top label and confidence band
    over all rows (NULL labels stay in the denominator)."""
    lg = _logits(spark, sf_dir)
    pr = lg.select(softmax("logits").alias("p"))
    top = pr.select(decode_label(argmax("p"), CLASS_NAMES).alias("sentiment_label"),
                    F.round(F.array_max("p"), 9).alias("sentiment_score"))
    top = top.withColumn("confidence_level", confidence_band("sentiment_score"))
    c = top.groupBy("sentiment_label", "confidence_level").agg(F.count("*").alias("count"))
    n = top.select(F.count("*").alias("n")).scalar()
    return round_cols(c.withColumn("percent", F.col("count") / n * 100), ["percent"])


def span_report(spark, sf_dir):
    """M-17 + F-30: entity-level strict/lenient P/R/F1 and token accuracy
    on IN-7 tags."""
    t = derived.word_tag_rows(T(spark, sf_dir, "documents")).where(F.col("gold_id") != -100)
    tok = t.select(F.col("doc_id").alias("doc"), "pos",
                   decode_label("pred_id", SEQUENCE_TAGS).alias("pred"),
                   decode_label("gold_id", SEQUENCE_TAGS).alias("gold"))
    r = EV.span_report_rows(tok)
    return round_cols(r, ["token_accuracy", "strict_precision", "strict_recall", "strict_f1",
                          "lenient_precision", "lenient_recall", "lenient_f1"])


def span_report_folds(spark, sf_dir):
    """M-25: entity metrics on each of the 5 group folds of the documents'
    sources, a source never in two folds."""
    d = T(spark, sf_dir, "documents")
    folds = SP.group_folds(d.select("source", "doc_id"), "source", 5).select("source", "fold")
    tags = derived.word_tags(d).join(d.select("doc_id", "source"), "doc_id").join(folds, "source")
    r = EV.span_report(tags, "doc_id", "pred_ids", "gold_ids", SEQUENCE_TAGS, group_cols=["fold"])
    return round_cols(r, [c for c in r.columns if c.startswith(("token_acc", "strict_", "lenient_")) and not c.endswith("_spans")])


def parse_printed_list(spark, sf_dir):
    """F-17 + F-08: IN-5 predictions printed as a Python list literal, then
    parsed back (quotes normalised, JSON parse, error -> empty list)."""
    p = _preds(spark, sf_dir)
    item = lambda x: F.concat(F.lit("{'entity_group': '"), x["entity_group"],
                              F.lit("', 'score': "), x["score"].cast("string"), F.lit("}"))
    printed = F.concat(F.lit("["), F.array_join(F.transform("predictions", item), ",\n "), F.lit("]"))
    parsed = F.from_json(F.regexp_replace(printed, "'", '"'), "array<struct<entity_group:string,score:double>>")
    parsed = F.coalesce(parsed, F.array().cast("array<struct<entity_group:string,score:double>>"))
    r = p.select("doc_id", parsed.alias("parsed")).select(
        "doc_id", F.size("parsed").alias("n_parsed"),
        F.array_max(F.transform("parsed", lambda x: x["score"])).alias("max_score"),
        F.size(F.filter("parsed", lambda x: x["entity_group"] == "ESG")).alias("n_esg"))
    return round_cols(r, ["max_score"])


def parse_literal_cells(spark, sf_dir):
    """F-17: predictions with words of the text, printed as Python literals with
    both kinds of quotes, escapes, constants and line breaks in place of commas,
    parsed back; every seventh cell is cut short and gives no element."""
    p = _preds(spark, sf_dir)

    def quoted(word, q):
        w = F.replace(word, F.lit("\\"), F.lit("\\\\"))
        w = F.replace(F.replace(w, F.lit(q), F.lit("\\" + q)), F.lit("\n"), F.lit("\\n"))
        return F.concat(F.lit(q), w, F.lit(q))

    def item(x, i):
        word = F.concat(F.substring(F.col("text"), i * 9 + 1, F.lit(30)), F.lit("it's \"so\""))
        return F.concat(F.lit("{'word': "), F.when(i % 2 == 0, quoted(word, "'")).otherwise(quoted(word, '"')),
                        F.lit(", 'ok': "), F.when(x["score"] > 0.99, "True").otherwise("None"),
                        F.lit(", 'span': ("), i.cast("string"), F.lit(", "), (i + 30).cast("string"), F.lit(",), 'score': "),
                        x["score"].cast("string"), F.lit("}"))

    printed = F.transform("predictions", item)
    items = F.when(F.col("doc_id") % 2 == 0, F.array_join(printed, ",\n ")).otherwise(F.array_join(printed, "\n "))
    cell = F.concat(F.lit("["), items, F.when(F.col("doc_id") % 7 == 3, "").otherwise("]"))
    parsed = parse_literal_list(cell, "struct<word:string,ok:boolean,span:array<int>,score:double>")
    r = p.select("doc_id", parsed.alias("p")).select(
        "doc_id", F.size("p").alias("n_parsed"), F.array_join("p.word", "|").alias("words"),
        F.size(F.filter("p", lambda x: x["ok"])).alias("n_ok"), F.size(F.filter("p", lambda x: x["ok"].isNull())).alias("n_none"),
        F.aggregate("p", F.lit(0), lambda a, x: a + x["span"][1]).alias("span_ends"),
        F.array_max(F.transform("p", lambda x: x["score"])).alias("max_score"))
    return round_cols(r, ["max_score"])


def label_id_roundtrip(spark, sf_dir):
    """F-16: quantile labels encoded to ids and decoded back."""
    from corpusloom.functions.arrays import encode_label
    from corpusloom.sources.schemas import MARKET_LABELS
    r = L.quantile_labels(votes(spark, sf_dir), with_ids=False)
    r = r.select("user_id", "week", "market_direction",
                 encode_label("market_direction", MARKET_LABELS).alias("market_direction_id"))
    return r.withColumn("decoded", decode_label("market_direction_id", MARKET_LABELS))
