"""Batch model inference (D-06, M-26, M-27, F-28, F-29).

A predictor factory is called once per task (not per row or batch) inside
``mapInPandas``; the "device" is ``partitionId % n_devices``, mirroring the
reference's one-model-per-worker placement.  Arrow batches are predicted in
chunks.  Long texts are split into token windows JVM-side (K-03) before
they reach Python, and chunk predictions are regrouped in chunk order.

The bundled predictors are small lexicon/regex models so the machinery runs
offline; any callable ``factory(device) -> predict(list[str]) -> list[list[dict]]``
can be plugged in.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.functions.arrays import first_prediction
from corpusloom.functions.numbers import confidence_band
from corpusloom.functions.text import non_blank, py_strip
from corpusloom.functions.tokens import token_spans
from corpusloom.operators.textprep import fixed_windows

SENTIMENT = T.ArrayType(T.StructType([T.StructField("label", T.StringType()),
                                      T.StructField("score", T.DoubleType())]))
ENTITIES = T.ArrayType(T.StructType([T.StructField("entity_group", T.StringType()),
                                     T.StructField("score", T.DoubleType()),
                                     T.StructField("word", T.StringType()),
                                     T.StructField("start", T.IntegerType()),
                                     T.StructField("end", T.IntegerType())]))


def lexicon_sentiment(positive: list[str], negative: list[str]) -> Callable:
    """Factory of a word-count sentiment model: bullish when positive words
    outnumber negative ones, bearish for the reverse, else neutral; score =
    (winner + 1) / (both + 2).  Returns one prediction per text."""
    pos, neg = frozenset(positive), frozenset(negative)

    def factory(_device: int):
        def predict(texts: list[str]) -> list[list[dict]]:
            out = []
            for t in texts:
                words = (t or "").lower().split()
                p = sum(w in pos for w in words)
                n = sum(w in neg for w in words)
                label = "bullish" if p > n else "bearish" if n > p else "neutral"
                out.append([{"label": label, "score": (max(p, n) + 1) / (p + n + 2)}])
            return out
        return predict
    return factory


def capitalised_entities(min_len: int = 7) -> Callable:
    """Factory of a regex entity model: capitalised words of at least
    ``min_len`` letters; group by length parity; offsets are relative to
    the chunk (trap T-22)."""
    pat = re.compile(r"\b[^\W\d_][^\W_]{%d,}" % (min_len - 1))

    def factory(_device: int):
        def predict(texts: list[str]) -> list[list[dict]]:
            out = []
            for t in texts:
                ents = []
                for m in pat.finditer(t or ""):
                    w = m.group(0)
                    if not w[0].isupper():
                        continue
                    ents.append({"entity_group": "Consensus" if len(w) % 2 else "Identifiers",
                                 "score": min(0.999, 0.98 + len(w) / 1000), "word": w,
                                 "start": m.start(), "end": m.end()})
                out.append(ents)
            return out
        return predict
    return factory


def batch_predict(df: DataFrame, text_col: str, keep_cols: list[str], factory: Callable,
                  pred_type: T.DataType, n_devices: int = 1, chunk: int = 64) -> DataFrame:
    """D-06: ``predictions`` column from ``factory`` via ``mapInPandas``;
    one model per task, device by partition id."""
    schema = T.StructType([df.schema[c] for c in keep_cols] + [T.StructField("predictions", pred_type)])

    def run(batches):
        from pyspark import TaskContext
        ctx = TaskContext.get()
        device = (ctx.partitionId() % n_devices) if ctx is not None else 0
        predict = factory(device)
        for pdf in batches:
            texts = pdf[text_col].tolist()
            preds = []
            for i in range(0, len(texts), chunk):
                preds.extend(predict(texts[i:i + chunk]))
            out = pdf[keep_cols].copy()
            out["predictions"] = pd.Series(preds, index=pdf.index, dtype="object")
            yield out

    return df.select(*keep_cols, text_col).mapInPandas(run, schema)


class Batches:
    """Texts in batches of at most ``budget`` padded tokens: the longest text of
    a batch times its number of texts.  Calls ``predict`` batch by batch."""

    def __init__(self, predict: Callable, budget: int):
        self.predict, self.budget, self.rows, self.longest, self.seen = predict, budget, [], 0, []

    def _flush(self) -> list[tuple]:
        if not self.rows:
            return []
        self.seen.append(self.longest * len(self.rows))
        got = list(zip((k for k, _ in self.rows), self.predict([t for _, t in self.rows])))
        self.rows, self.longest = [], 0
        return got

    def add(self, key, text: str, n_tokens: int) -> list[tuple]:
        """Take one text; returns (key, prediction) of a batch that was full."""
        if n_tokens > self.budget:
            raise ValueError(f"{n_tokens} tokens in one text: more than the budget of {self.budget}")
        longest = max(self.longest, n_tokens)
        done = self._flush() if longest * (len(self.rows) + 1) > self.budget else []
        self.rows.append((key, text))
        self.longest = max(self.longest, n_tokens)
        return done

    def end(self) -> list[tuple]:
        return self._flush()


def budget_predict(df: DataFrame, key_col: str, text_col: str, tokens_col: str, factory: Callable, pred_type: T.DataType,
                   budget: int = 16_384, n_devices: int = 1) -> DataFrame:
    """D-06 with bounded batches: ``key_col`` and ``predictions``.  Rows of a
    partition go by length, so texts of a batch are about as long and little is
    padded; no batch passes ``budget``, and predictions do not depend on the
    batches.  No text is shuffled, or computed once more to find ranges of lengths."""
    schema = T.StructType([df.schema[key_col], T.StructField("predictions", pred_type)])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        ctx = TaskContext.get()
        work = Batches(factory((ctx.partitionId() % n_devices) if ctx is not None else 0), budget)

        def rows(pairs: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{key_col: k, "predictions": p} for k, p in pairs], target)

        for batch in batches:
            done: list[tuple] = []
            for k, t, c in zip(*(x.to_pylist() for x in batch.columns)):
                done += work.add(k, t, c)
            yield rows(done)
        yield rows(work.end())

    return df.select(key_col, text_col, tokens_col).sortWithinPartitions(tokens_col, key_col).mapInArrow(run, schema)


def placed_windows(df: DataFrame, key_col: str, text_col: str = "text", window: int = 512) -> DataFrame:
    """K-03 with places: (key, chunk_id, chunk_text, n_tokens, start), where
    ``start`` is the chunk's first character in the text."""
    # NULL chunks instead of a filter, which would sink below the tokenizer and run it once more
    base = df.select(key_col, F.length(text_col).alias("_len"), token_spans(text_col).alias("_sp"))
    starts = F.when(F.size("_sp") > 0, F.sequence(F.lit(1), F.size("_sp"), F.lit(window)))
    chunks = F.transform(starts, lambda s: F.struct(F.array_join(F.slice("_sp", s, window), "").alias("t"),
                                                    F.least(F.size("_sp") - s + 1, F.lit(window)).alias("n")))
    base = base.select(key_col, "_len", chunks.alias("_ch"))
    # each chunk starts where the ones before it end; the first one after the white space at the text's start
    whole = F.aggregate("_ch", F.lit(0), lambda a, c: a + F.length(c["t"]))
    place = F.aggregate("_ch", F.array(F.col("_len") - whole), lambda a, c: F.concat(a, F.array(F.element_at(a, -1) + F.length(c["t"]))))
    out = base.select(key_col, F.posexplode(F.arrays_zip(F.col("_ch").alias("c"), F.slice(place, F.lit(1), F.size("_ch")).alias("s")))
                      .alias("chunk_id", "_z"))
    return out.select(key_col, "chunk_id", py_strip("_z.c.t").alias("chunk_text"), F.col("_z.c.n").alias("n_tokens"), F.col("_z.s").alias("start"))


def document_entities(df: DataFrame, key_col: str, text_col: str, factory: Callable, window: int = 512, budget: int = 16_384,
                      n_devices: int = 1) -> DataFrame:
    """M-27 with places in the document (trap T-22): ``predictions`` of each text
    in order, ``start`` and ``end`` counted in its characters, each with its
    ``chunk_id``.  Texts without a token have no row."""
    chunks = placed_windows(df, key_col, text_col, window).withColumn("_ck", F.struct(key_col, "chunk_id", "start"))
    pred = budget_predict(chunks.select("_ck", "chunk_text", "n_tokens"), "_ck", "chunk_text", "n_tokens", factory, ENTITIES, budget, n_devices)

    def moved(p):
        return (p.withField("start", p["start"] + F.col("_ck.start")).withField("end", p["end"] + F.col("_ck.start"))
                .withField("chunk_id", F.col("_ck.chunk_id")))

    tagged = pred.select(F.col("_ck").getField(key_col).alias(key_col),
                         F.struct(F.col("_ck.chunk_id").alias("chunk_id"), F.transform("predictions", moved).alias("p")).alias("c"))
    g = tagged.groupBy(key_col).agg(F.sort_array(F.collect_list("c")).alias("_cs"))
    return g.select(key_col, F.flatten(F.col("_cs.p")).alias("predictions")).withColumn("num_preds", F.size("predictions"))


def sentiment_inference(df: DataFrame, key_col: str, text_col: str, factory: Callable,
                        n_devices: int = 1) -> DataFrame:
    """M-26: predictions for non-blank texts; top label / score (F-29) and
    confidence band (F-28); blank texts get NULL outputs in the same schema
    (trap T-26).  Blank rows never reach Python."""
    ok = non_blank(text_col)
    good = batch_predict(df.where(ok), text_col, [key_col], factory, SENTIMENT, n_devices)
    blank = df.where(~ok).select(key_col, F.lit(None).cast(SENTIMENT).alias("predictions"))
    allp = good.unionByName(blank)
    top = first_prediction("predictions")
    return allp.select(key_col, F.col("predictions").alias("sentiment_class"),
                       top["label"].alias("sentiment_label"), top["score"].alias("sentiment_score"),
                       confidence_band(top["score"]).alias("confidence_level"))


def entity_inference(df: DataFrame, key_col: str, text_col: str, factory: Callable, window: int = 512,
                     n_devices: int = 1) -> DataFrame:
    """M-27: texts longer than ``window`` tokens are split into windows
    (K-03) before inference; chunk predictions are collected back per row
    in chunk order, each tagged with its ``chunk_id``."""
    chunks = fixed_windows(df, key_col, text_col, window).withColumn("_ck", F.struct(key_col, "chunk_id"))
    pred = batch_predict(chunks.select("_ck", "chunk_text"), "chunk_text", ["_ck"], factory, ENTITIES, n_devices)
    tagged = pred.select(F.col("_ck").getField(key_col).alias(key_col),
                         F.struct(F.col("_ck.chunk_id").alias("chunk_id"),
                                  F.transform("predictions", lambda p: p.withField("chunk_id", F.col("_ck.chunk_id")))
                                  .alias("p")).alias("c"))
    g = tagged.groupBy(key_col).agg(F.sort_array(F.collect_list("c")).alias("_cs"))
    return g.select(key_col, F.flatten(F.col("_cs.p")).alias("predictions")) \
        .withColumn("num_preds", F.size("predictions"))
