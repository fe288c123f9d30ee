"""Approximate nearest neighbours by multi-index hashing.

A rotation learned on a bounded sample (principal axes, then alternating code
and rotation steps) turns vectors into binary codes.  The codes are split
into substrings of eight bits, each with an index of its own.  A query's
radius follows from the score that it must beat: the k-th best among the
sample.  By the pigeonhole principle a code within radius r agrees with the
query's code up to floor(r / m) bits in one of m substrings, so probing all
substring values that near finds every code within r.  What is found is
checked by its full Hamming distance and reranked on the original vectors.

The index is dealt into blocks and the queries too; every block of the index
answers every block of queries, and the answers, at most k a query and block,
are merged.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import save, shared_dir

#: Documented bound of the sample that the codes and radii are fitted on.
SAMPLE = 8_192
BITS = 128
INDEX_BLOCK = 8_192
QUERY_BLOCK = 4_096
#: Standard deviations of the Hamming distance that the radius allows above its mean.
MARGIN = 1.3
ROUNDS = 12
FOUND = "query_id long, vec_id long, score double"

_COUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id`` and ``v`` (double array) of the rows that take part: a non-null
    id, no null or non-finite component, not all zero, and the most frequent
    length (the smallest of equally frequent ones)."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where("id is not null and size(v) > 0")
    fine = (F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (sizes["n"] if sizes else 0))


class Codes:
    """Learned rotations: vectors to codes of ``bits`` bits (whole bytes)."""

    def __init__(self, sample: np.ndarray, top: float, bits: int = BITS, seed: int = 5):
        self.top = top
        x = self.lift(sample)
        self.mean = x.mean(axis=0)
        x = x - self.mean
        self.rotations, rng, n = [], np.random.default_rng(seed), 0
        values, axes = np.linalg.eigh(x.T @ x)
        axes = axes[:, np.argsort(values)[::-1]]
        while n < bits:
            width = min(x.shape[1], bits - n)
            r = np.linalg.qr(rng.standard_normal((width, width)))[0]
            base = axes[:, :width]
            for _ in range(ROUNDS):
                p = x @ base
                u, _, w = np.linalg.svd(np.where(p @ r >= 0, 1.0, -1.0).T @ p)
                r = w.T @ u.T
            self.rotations.append(base @ r)
            n += width
        self.bits = bits

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Largest inner product as largest cosine: a further component makes
        all indexed vectors as long as the longest."""
        rest = np.sqrt(np.maximum(self.top ** 2 - (x * x).sum(axis=1), 0))
        return np.hstack([x, rest[:, None]])

    def __call__(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Codes as rows of bytes."""
        x = np.hstack([x * (self.top / np.linalg.norm(x, axis=1))[:, None], np.zeros((len(x), 1))]) if query else self.lift(x)
        # the sample's mean is no direction of an angle: signs are taken around the origin
        return np.packbits(np.hstack([x @ r for r in self.rotations]) >= 0, axis=1)


def _hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between the codes of ``a`` and ``b``."""
    out = np.zeros((len(a), len(b)), np.uint16)
    for j in range(a.shape[1]):
        out += _COUNT[a[:, j][:, None] ^ b[:, j][None, :]]
    return out


class BlockIndex:
    """The substring indexes of one block: per substring the rows by value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = np.argsort(codes, axis=0, kind="stable")
        self.start = np.stack([np.searchsorted(codes[self.order[:, j], j], np.arange(257)) for j in range(codes.shape[1])])

    def probe(self, queries: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Matrix of (query, row) pairs that agree in a substring up to
        ``radius // substrings`` bits."""
        m = self.codes.shape[1]
        near = _COUNT[np.arange(256)[:, None] ^ np.arange(256)[None, :]]
        found = np.zeros((len(queries), len(self.codes)), bool)
        for j in range(m):
            reach = near[queries[:, j]] <= (radius // m)[:, None]  # query, value
            for v in np.flatnonzero(np.diff(self.start[j])):
                q = np.flatnonzero(reach[:, v])
                if len(q):
                    rows = self.order[self.start[j, v]:self.start[j, v + 1], j]
                    found[q[:, None], rows[None, :]] = True
        return found


def _search(codes: Codes, sample_ids: np.ndarray, sample: np.ndarray, k: int, margin: float):
    def run(key, index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(queries):
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        ids, x = index["id"].to_numpy(np.int64), np.stack(index["v"].to_numpy()).astype(np.float64)
        block, out = BlockIndex(codes(x)), []
        for at in range(0, len(queries), 256):
            part = queries.iloc[at:at + 256]
            qid, q = part["query"].to_numpy(np.int64), np.stack(part["qv"].to_numpy()).astype(np.float64)
            floor, radius = radii(codes, q, qid, sample_ids, sample, k, margin)
            qc = codes(q, True)
            found = block.probe(qc, radius)
            found &= _hamming(qc, block.codes) <= radius[:, None]
            found &= qid[:, None] != ids[None, :]
            rough = np.where(found, q @ x.T, -np.inf)
            rough[rough < (floor - 1e-9 * (1 + np.abs(floor)))[:, None]] = -np.inf
            for r in range(len(part)):
                hit = np.flatnonzero(rough[r] > -np.inf)
                if len(hit) > k:  # all that can still be among the k best after rounding
                    kth = np.partition(rough[r][hit], len(hit) - k)[len(hit) - k]
                    hit = hit[rough[r][hit] >= kth - 1e-9 * (1 + abs(kth))]
                score = (x[hit] * q[r]).sum(axis=1)
                best = np.lexsort((ids[hit], -score))[:k]
                out.append(pd.DataFrame({"query_id": qid[r], "vec_id": ids[hit][best], "score": score[best]}))
        return pd.concat(out)

    return run


def radii(codes: Codes, q: np.ndarray, qid: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int,
          margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Per query the score of its k-th best sample row (a lower bound of the
    k-th best of all) and the Hamming radius that covers such a score."""
    against = q @ sample.T
    against[qid[:, None] == sample_ids[None, :]] = -np.inf
    if len(sample) < k + 1:
        return np.full(len(q), -np.inf), np.full(len(q), codes.bits)
    floor = np.partition(against, against.shape[1] - k, axis=1)[:, against.shape[1] - k]
    angle = np.arccos(np.clip(floor / (np.linalg.norm(q, axis=1) * codes.top), -1, 1)) / np.pi
    radius = codes.bits * angle + margin * np.sqrt(codes.bits * angle * (1 - angle))
    return floor, np.minimum(np.ceil(radius), codes.bits).astype(np.int64)


def nearest(vectors: DataFrame, is_query: Column | None = None, k: int = 20, id_col: str = "vec_id",
            vec_col: str = "embedding", margin: float = MARGIN) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` rows of
    largest inner product found for every query row (default: ids divisible
    by 20), the query's own id left out; ties go to the smaller id.  A query
    that finds fewer asks again with a wider radius.

    Rows that ``usable`` leaves out neither ask nor answer.  With fewer than
    ``k`` others all are returned.  Rows that repeat an id are candidates each
    (a query never finds its own id) and repeated queries are answered once.
    Empty input gives no rows; other columns are ignored."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    is_query = F.col("id") % 20 == 0 if is_query is None else is_query
    size = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("top"),
                    F.sum(F.when(is_query, 1).otherwise(0)).alias("q")).first()
    if not size["n"] or not size["q"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    share = int(min(1.0, SAMPLE / size["n"]) * (1 << 40))
    picked = rows.where(F.pmod(F.xxhash64(F.col("id"), F.lit(3)), F.lit(1 << 40)) < share).toPandas()  # about SAMPLE rows
    if not len(picked):
        picked = rows.limit(1).toPandas()
    sample_ids, sample = picked["id"].to_numpy(np.int64), np.stack(picked["v"].to_numpy()).astype(np.float64)
    codes = Codes(sample, float(np.sqrt(size["top"])))

    folder, lacking, parts = shared_dir(spark, "nearest"), None, []
    while True:
        found = save(_round(rows, is_query, lacking, size, _search(codes, sample_ids, sample, k, margin)), f"{folder}/{len(parts)}")
        parts.append(found)
        # a query short of results asks again with a wider radius, until it has all it can have
        asked = rows.where(is_query).select("id").distinct() if lacking is None else lacking
        enough = found.groupBy("query_id").count().where(F.col("count") >= min(k, size["n"] - 1)).select(F.col("query_id").alias("id"))
        short = save(asked.join(enough, "id", "left_anti"), f"{folder}/short-{len(parts)}")
        if margin > 4 * np.sqrt(BITS) or short.isEmpty():
            break
        lacking, margin = short, 2 * margin + 1
    found = functools.reduce(DataFrame.unionAll, parts).distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _round(rows: DataFrame, is_query: Column, only: DataFrame | None, size, search) -> DataFrame:
    """Every block of the index answers every block of the queries (those in
    ``only``, if given)."""
    blocks, asks = -(-size["n"] // INDEX_BLOCK), -(-size["q"] // QUERY_BLOCK)
    index = (rows.withColumn("ib", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
             .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(asks - 1)))))
    queries = rows.where(is_query).dropDuplicates(["id"])
    queries = queries if only is None else queries.join(only, "id", "left_semi")
    queries = (queries.select(F.col("id").alias("query"), F.col("v").alias("qv"))
               .withColumn("qb", F.pmod(F.xxhash64("query", F.lit(1)), F.lit(asks)).cast("int"))
               .withColumn("ib", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    return index.groupBy("ib", "qb").cogroup(queries.groupBy("ib", "qb")).applyInPandas(search, FOUND)
