"""Evaluation operators (A-13, A-20..A-22, F-17, F-26..F-30, M-08, M-09,
M-16..M-18, M-20, M-25).

All metrics are aggregates over (label, prediction) count tables, so the
row-level data is scanned once and everything after the first aggregate is
small.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.arrays import (argmax, array_max_or, array_median, drop_ignored, list_sizes,
                                         row_slices, scores_excluding, softmax)
from corpusloom.operators.prefix import ordered_prefix
from corpusloom.operators.quantiles import exact_quantiles


def entity_filter(df: DataFrame, pred_col: str = "predictions", threshold: float = 0.995,
                  exclude_group: str = "ESG", keep_only: bool = True) -> DataFrame:
    """M-09 (F-08, F-11, F-12, F-13, X-12, P-11): number of predictions,
    non-``exclude_group`` scores, their max (NULL when none) and median, and
    the flag ``max_pred = prediction_max > threshold`` (NULL -> false).
    ``keep_only`` keeps flagged rows only."""
    out = (df.withColumn("num_preds", F.size(pred_col).cast("int"))
             .withColumn("prediction_scores", scores_excluding(pred_col, exclude_group))
             .withColumn("prediction_max", array_max_or("prediction_scores"))
             .withColumn("prediction_median", array_median("prediction_scores"))
             .withColumn("max_pred", F.coalesce(F.col("prediction_max") > threshold, F.lit(False))))
    return out.where(F.col("max_pred")) if keep_only else out


def confusion_counts(df: DataFrame, gold_col: str, pred_col: str) -> DataFrame:
    """A-20: TN, FP, FN, TP of a binary gold column against a boolean/0-1
    prediction (trap T-03: evaluates the column that exists)."""
    g = F.col(gold_col).cast("int") == 1
    p = F.col(pred_col).cast("int") == 1
    return df.agg(F.count_if(~g & ~p).alias("tn"), F.count_if(~g & p).alias("fp"),
                  F.count_if(g & ~p).alias("fn"), F.count_if(g & p).alias("tp"))


def threshold_sweep(df: DataFrame, gold_col: str, score_col: str, lo: int = 9900, hi: int = 10000,
                    scale: int = 10000) -> DataFrame:
    """M-08: accuracy of ``score > t`` against the 0/1 gold column for every
    grid threshold t = i/scale, i in [lo, hi].

    Each row is bucketed once (how many grid points its score exceeds); the
    (gold, bucket) count table has at most 2 x (grid + 1) rows and is
    expanded to per-threshold correct counts without touching row data
    again."""
    grid = [i / scale for i in range(lo, hi + 1)]
    n_grid = len(grid)
    g = F.array(*[F.lit(t) for t in grid])
    b = df.select(F.col(gold_col).cast("int").alias("gold"),
                  F.size(F.filter(g, lambda t: F.col(score_col) > t)).alias("c"))
    counts = b.groupBy("gold", "c").agg(F.count("*").alias("n"))
    # gold=1 rows are correct for thresholds k < c; gold=0 rows for k >= c
    ks = F.when(F.col("gold") == 1, F.sequence(F.lit(0), F.col("c") - 1)) \
        .otherwise(F.sequence(F.col("c"), F.lit(n_grid - 1)))
    ks = F.when((F.col("gold") == 1) & (F.col("c") == 0), F.array().cast("array<int>")) \
        .when((F.col("gold") != 1) & (F.col("c") >= n_grid), F.array().cast("array<int>")).otherwise(ks)
    correct = counts.select(F.explode(ks).alias("k"), "n")
    zero = counts.agg(F.count("*").alias("_z")).select(
        F.explode(F.sequence(F.lit(0), F.lit(n_grid - 1))).alias("k"), F.lit(0).cast("bigint").alias("n"))
    total = counts.select(F.sum("n").alias("t")).scalar()
    acc = correct.unionByName(zero).groupBy("k").agg(F.sum("n").alias("correct"))
    return acc.select(F.element_at(g, F.col("k") + 1).alias("threshold"),
                      (F.col("correct") / total).alias("accuracy"))


def classification_report(df: DataFrame, label_col: str, pred_col: str, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """M-16: accuracy plus weighted and macro precision / recall / F1 over
    the classes present in either column (undefined ratios count as 0), one
    row per group when ``group_cols`` are given."""
    g = list(group_cols)
    pairs = df.groupBy(*g, F.col(label_col).alias("y"), F.col(pred_col).alias("p")).agg(F.count("*").alias("n"))
    by_true = pairs.groupBy(*g, F.col("y").alias("cls")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n"))).alias("tp"))
    by_pred = pairs.groupBy(*g, F.col("p").alias("cls")).agg(F.sum("n").alias("predicted"))
    per = by_true.join(by_pred, [*g, "cls"], "full_outer").na.fill(0, ["support", "tp", "predicted"])
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    per = per.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))) \
        .otherwise(F.lit(0.0))
    per = per.withColumn("f1", f1)
    tot = F.sum("support")
    return per.groupBy(*g).agg(
        (F.sum("tp") / tot).alias("accuracy"),
        (F.sum(F.col("precision") * F.col("support")) / tot).alias("precision_weighted"),
        (F.sum(F.col("recall") * F.col("support")) / tot).alias("recall_weighted"),
        (F.sum(F.col("f1") * F.col("support")) / tot).alias("f1_weighted"),
        F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"))


def with_argmax(df: DataFrame, logits_col: str = "logits", out: str = "pred") -> DataFrame:
    """F-27: predicted class = first arg-max of the logits."""
    return df.withColumn(out, argmax(logits_col))


def roc_points(df: DataFrame, logits_col: str, label_col: str, digits: int = 9) -> DataFrame:
    """M-18 (F-26 + W-09): one-vs-rest ROC points per class.  Softmax
    probabilities are
    aggregated to distinct scores; cumulative positives/negatives in
    descending score order come from :func:`ordered_prefix` partitioned by
    class (no class-sized single window)."""
    probs = df.select(F.col(label_col).alias("y"), softmax(logits_col).alias("pr"))
    # the outer form: a plain explode pushes size(pr) > 0 to the scan, and with it the logits and their softmax a second time
    ex = probs.select("y", F.posexplode_outer("pr").alias("cls", "score")).where(F.col("score").isNotNull())
    agg = ex.groupBy("cls", "score").agg(F.count_if(F.col("y") == F.col("cls")).alias("pos"),
                                         F.count_if(F.col("y") != F.col("cls")).alias("neg"))
    tot = agg.groupBy("cls").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    cum = ordered_prefix(agg, ["score"], ["pos", "neg"], out=["cum_pos", "cum_neg"],
                         partition_cols=["cls"], descending=True, materialize=True)
    return cum.join(tot, "cls").select(
        F.col("cls").cast("int").alias("cls"), F.round("score", digits).alias("threshold"),
        F.try_divide(F.col("cum_pos"), F.col("P")).alias("tpr"),
        F.try_divide(F.col("cum_neg"), F.col("N")).alias("fpr"))


MODES, SIDES = ("strict", "lenient"), ("gold", "pred")
COUNTS = ["n_tokens", "n_correct"] + [f"{m}_{k}" for m in MODES for k in ("gold", "pred", "both")]
#: Tags counted at once in a task, but for those of a single row.
AT_ONCE = 1 << 17


def _tag_table(tags: pa.Array, numbers: dict[str, int]) -> dict[str, np.ndarray]:
    """What the metrics ask of each tag: its number and its type's, whether it is NULL, O, B or I."""
    coded = tags.dictionary_encode()
    names = [*coded.dictionary.to_pylist(), None]
    codes = coded.indices.fill_null(len(names) - 1).to_numpy(zero_copy_only=False)
    rows = [(-1, -1, 1, 0, 0, 0) if x is None else
            (numbers.setdefault(x, len(numbers)), numbers.setdefault("-" + x.rsplit("-", 1)[-1], len(numbers)), 0, x == "O", x[:2] == "B-", x[:2] == "I-")
            for x in names]
    columns = np.array(rows, np.int32).T
    out = {"tag": columns[0][codes], "kind": columns[1][codes]}
    return out | {k: columns[i].astype(bool)[codes] for i, k in enumerate(("null", "o", "b", "i"), 2)}


def _count_spans(lists: pa.Array) -> pa.Array:
    sizes = list_sizes(lists)
    flat, n = lists.flatten(), len(sizes)
    parts, numbers = dict(zip([f.name for f in flat.type], flat.flatten())), {}
    row, place = np.repeat(np.arange(n), sizes), np.arange(len(flat))
    first = place == (np.cumsum(sizes) - sizes)[row]
    tags = {side: _tag_table(parts[side], numbers) for side in SIDES}

    def per_row(marks: np.ndarray) -> np.ndarray:
        return np.bincount(row[marks], minlength=n)

    begins, last = {}, {}
    for side, t in tags.items():
        # the last tag that is no I, if the document has one before
        base = np.maximum.accumulate(np.where(first | ~t["i"], place, 0)) if len(place) else place
        in_b = t["b"][base] & (t["kind"][base] == t["kind"])
        new = first | np.roll(t["o"], 1) | (np.roll(t["kind"], 1) != t["kind"])
        begins["strict", side], begins["lenient", side] = t["b"], t["b"] | t["i"] & new
        for mode, inside in (("strict", t["b"] | t["i"] & in_b), ("lenient", t["b"] | t["i"])):
            # from a tag that starts something to the next; the last token inside is where a span that starts there ends
            start = np.flatnonzero(first | begins[mode, side] | ~t["i"])
            ends = np.maximum.reduceat(np.where(inside, place, -1), start) if len(place) else place
            last[mode, side] = ends[np.searchsorted(start, place, "right") - 1]
    null = {side: per_row(t["null"]) > 0 for side, t in tags.items()}
    either = null["gold"] | null["pred"]
    got = {"n_tokens": (sizes, None), "n_correct": (per_row(tags["gold"]["tag"] == tags["pred"]["tag"]), either)}
    for mode in MODES:
        g, p = begins[mode, "gold"], begins[mode, "pred"]
        both = g & p & (tags["gold"]["kind"] == tags["pred"]["kind"]) & (last[mode, "gold"] == last[mode, "pred"])
        got |= {f"{mode}_gold": (per_row(g), null["gold"]), f"{mode}_pred": (per_row(p), null["pred"]), f"{mode}_both": (per_row(both), either)}
    arrays = [pa.array(got[k][0].astype(np.int32), mask=got[k][1]) for k in COUNTS]
    return pa.StructArray.from_arrays(arrays, COUNTS, mask=lists.is_null())


def span_counts(tags: Column) -> Column:
    """What one document's ``tags`` (an array of structs ``pred``, ``gold``)
    adds to the entity metrics: a struct of ``n_tokens``, ``n_correct`` and, for
    each mode, the numbers of gold spans, predicted spans and spans that are
    both.  A NULL tag makes NULL of what depends on its side.

    Lenient (the default of entity metrics): B starts a span, and an I after O,
    after another type, or at the beginning does.  Strict (IOB2): only B starts
    one; an I is inside only when the last tag that is no I is a B of its type.

    A span is in both readings when both start at one token with one type and
    have the same last token.  The tags of some rows at a time are arrays of
    numbers, so a token costs a few vector steps and no object."""
    def run(lists: pa.Array) -> pa.Array:
        done = [_count_spans(lists.slice(a, b - a)) for a, b in row_slices(list_sizes(lists), AT_ONCE)]
        return pa.concat_arrays(done) if done else pa.array([], pa.struct([(k, pa.int32()) for k in COUNTS]))

    return F.arrow_udf(run, "struct<" + ",".join(f"{k}:int" for k in COUNTS) + ">")(tags)


def span_metrics(counts: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """M-17 from a column ``c`` of ``span_counts``: entity-level strict and
    lenient P/R/F1 and token accuracy (trap T-27 names), over all documents or
    per group.  Documents add up on the map side."""
    groups = list(group_cols or [])
    r = counts.groupBy(*groups).agg(*[F.coalesce(F.sum(f"c.{n}"), F.lit(0)).cast("bigint").alias(n) for n in COUNTS])
    out = [*groups, "n_tokens", F.try_divide(F.col("n_correct").cast("double"), F.col("n_tokens")).alias("token_accuracy")]
    for mode in MODES:
        g, p, tp = (F.col(f"{mode}_{k}") for k in ("gold", "pred", "both"))
        prec = F.when(p > 0, tp / p).otherwise(F.lit(0.0))
        rec = F.when(g > 0, tp / g).otherwise(F.lit(0.0))
        f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
        out += [prec.alias(f"{mode}_precision"), rec.alias(f"{mode}_recall"), f1.alias(f"{mode}_f1"), g.alias(f"{mode}_gold_spans"),
                p.alias(f"{mode}_pred_spans")]
    return r.select(*out)


def span_report(df: DataFrame, doc_col: str, pred_ids: str, gold_ids: str, labels: list[str],
                ignore: int = -100, group_cols: list[str] | None = None) -> DataFrame:
    """M-17 + F-30 on array-shaped data: drop ignored positions, map ids to
    names, count each document's spans in its row."""
    pairs = drop_ignored(pred_ids, gold_ids, labels, ignore)
    return span_metrics(df.select(*(group_cols or []), span_counts(pairs).alias("c")), group_cols)


def span_report_rows(tok: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """M-17 on a (doc, pos, pred, gold) tag-name table (ignored positions
    already removed): the tags of a document come together once."""
    groups = list(group_cols or [])
    docs = tok.groupBy(*groups, "doc").agg(F.sort_array(F.collect_list(F.struct("pos", "pred", "gold"))).alias("t"))
    return span_metrics(docs.select(*groups, span_counts(F.col("t")).alias("c")), groups)


def group_describe(df: DataFrame, group_col: str, value_col: str) -> DataFrame:
    """A-13: pandas ``describe`` per group: count, mean, std (sample), min,
    quartiles (linear interpolation), max."""
    v = F.col(value_col)
    q = exact_quantiles(df, value_col, {"p25": 0.25, "p50": 0.5, "p75": 0.75}, [group_col]).withColumnRenamed(group_col, "_g")
    plain = df.groupBy(group_col).agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                                      F.min(v).alias("min"), F.max(v).alias("max"))
    return plain.join(q, F.col(group_col).eqNullSafe(F.col("_g")), "left").select(
        group_col, "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def box_stats(df: DataFrame, group_col: str, value_col: str) -> DataFrame:
    """A-22: box-plot statistics per group: quartiles, IQR, whiskers at the
    most extreme values within 1.5 IQR of the box, outlier count."""
    d = group_describe(df, group_col, value_col).select(group_col, "p25", "p50", "p75")
    d = d.withColumn("iqr", F.col("p75") - F.col("p25"))
    j = df.select(group_col, value_col).join(d, group_col)
    v = F.col(value_col)
    lo_fence = F.col("p25") - 1.5 * F.col("iqr")
    hi_fence = F.col("p75") + 1.5 * F.col("iqr")
    return j.groupBy(group_col, "p25", "p50", "p75", "iqr").agg(
        F.min(F.when(v >= lo_fence, v)).alias("whisker_low"),
        F.max(F.when(v <= hi_fence, v)).alias("whisker_high"),
        F.count_if((v < lo_fence) | (v > hi_fence)).alias("outliers"))


def histogram(df: DataFrame, value_col: str, bins: int = 10, group_col: str | None = None) -> DataFrame:
    """A-21: equal-width histogram between the global min and max (the max
    falls in the last bin, like numpy); count and density per bin."""
    st = df.select(F.struct(F.min(value_col).alias("lo"), F.max(value_col).alias("hi"),
                            F.count(value_col).alias("n")).alias("s")).scalar()
    d = df.where(F.col(value_col).isNotNull()).withColumn("_s", st)
    lo, hi = F.col("_s.lo"), F.col("_s.hi")
    width = (hi - lo) / bins
    raw = F.when(hi == lo, F.lit(0)).otherwise(F.floor((F.col(value_col) - lo) / width).cast("int"))
    d = d.withColumn("bin", F.least(raw, F.lit(bins - 1)))
    keys = ([group_col] if group_col else []) + ["bin"]
    g = d.groupBy(*keys).agg(F.count("*").alias("count"), F.first(lo).alias("_lo"),
                             F.first(width).alias("_w"), F.first("_s.n").alias("_n"))
    return g.select(*keys, (F.col("_lo") + F.col("bin") * F.col("_w")).alias("bin_start"),
                    (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("bin_end"), "count",
                    F.try_divide(F.col("count"), F.col("_n") * F.col("_w")).alias("density"))
