"""Centroid clustering on integer vectors, filtered by n-simplex projection.

The distances of every vector to a few pivots are measured once and become
the coordinates of the apex of a simplex over the pivots: the first ones place
the vector in the pivots' span, the last one is its altitude above it.  For
two apexes the Euclidean distance is a lower bound of the true distance, and
the one with an altitude turned over an upper bound.  A round compares the
cached apexes with those of the centroids, keeps the centroids whose lower
bound does not pass the least upper bound, and decides between these by exact
integer distances.

Rounds read one saved table of vectors and apexes; a task sends one row per
centroid and component, so what reaches the driver does not grow with the
vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import save, shared_dir

SCALE = 1024
#: Integers of at most this size have squared distances within 64 bits (up to 64 components of double the size).
SMALL = 1 << 27
#: Sums travel as digits of this many bits, the last one signed, so that no sum of any size is rounded.
LIMB_BITS, LIMBS = 40, 5
#: Relative slack of the bounds, far above the rounding of the projection.
SLACK = 1e-6
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


# --- n-simplex projection ---------------------------------------------------------

class Simplex:
    """Apex coordinates over ``pivots`` (rows of float64).  Pivots that lie
    nearly in the span of the ones before them are left out, so the base is
    well conditioned; without two pivots nothing is bounded but by the first."""

    def __init__(self, pivots: np.ndarray, least_altitude: float = 0.05):
        self.base, kept = np.zeros((0, 0)), []
        for p in pivots:
            if not kept:
                kept = [p]
                continue
            row = self._project(self._squares(p[None], kept), self.base)[0]
            if row[-1] > least_altitude * max(np.sqrt(self._squares(p[None], kept).max()), 1e-300):
                k = len(row) - 1
                base = np.zeros((k + 1, k + 1))
                base[:k, :k], base[k] = self.base, row
                self.base = base
                kept.append(p)
        self.pivots = np.array(kept)
        self.width = float(np.sqrt((self.base ** 2).sum(1).max())) if len(self.base) else 0.0

    @staticmethod
    def _squares(x: np.ndarray, pivots) -> np.ndarray:
        return np.stack([((x - p) ** 2).sum(1) for p in pivots], 1)

    @staticmethod
    def _project(squares: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Squared distances (rows) to the pivots -> apexes.  The first pivot is
        the origin, row i of ``base`` is pivot i + 1."""
        out = np.zeros(squares.shape)
        rest = squares[:, 0].copy()
        for i, b in enumerate(base):
            rhs = (squares[:, 0] - squares[:, i + 1] + (b ** 2).sum()) / 2 - out[:, :i] @ b[:i]
            out[:, i] = rhs / b[i]
        if len(base):
            rest = rest - (out[:, :len(base)] ** 2).sum(1)
        out[:, -1] = np.sqrt(np.maximum(rest, 0))
        return out

    def apex(self, x: np.ndarray) -> np.ndarray:
        return self._project(self._squares(x, self.pivots), self.base)

    def candidates(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For apexes ``a`` (vectors) and ``b`` (centroids): which centroids can be nearest."""
        inner = ((a[:, None, :-1] - b[None, :, :-1]) ** 2).sum(2)
        low = np.sqrt(inner + (a[:, None, -1] - b[None, :, -1]) ** 2)
        high = np.sqrt(inner + (a[:, None, -1] + b[None, :, -1]) ** 2)
        size = np.sqrt((a ** 2).sum(1))[:, None] + np.sqrt((b ** 2).sum(1))[None] + self.width
        return low - SLACK * size <= (high + SLACK * size).min(1)[:, None]


# --- exact integers ---------------------------------------------------------------

def integers(column: pa.Array, dims: int) -> np.ndarray:
    """floor(SCALE * x) of a list column of ``dims`` finite numbers: int64 where
    all are small, otherwise Python integers."""
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)
    if not len(x) or np.abs(x).max() <= SMALL / SCALE:
        return np.floor(x * SCALE).astype(np.int64)
    exact = [[(n * SCALE) // d for n, d in map(float.as_integer_ratio, row)] for row in x.tolist()]
    return np.array(exact, object)


def as_float(q: np.ndarray) -> np.ndarray:
    return q.astype(np.float64)


def fits(q: np.ndarray) -> bool:
    return q.dtype != object or not q.size or max(abs(q.max()), abs(q.min())) <= SMALL


def assign(q: np.ndarray, apex: np.ndarray, centres: np.ndarray, simplex: Simplex) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, exact squared distance) of each row of ``q``; ties go
    to the smaller number."""
    could = simplex.candidates(apex, simplex.apex(as_float(centres)))
    small = fits(q) and fits(centres) and q.shape[1] <= 64
    kind = np.int64 if small else object
    q, centres = q.astype(kind), centres.astype(kind)
    best, dist = np.full(len(q), -1), np.zeros(len(q), kind)
    for c in range(len(centres)):
        rows = np.flatnonzero(could[:, c])
        if not len(rows):
            continue
        d = ((q[rows] - centres[c]) ** 2).sum(1)
        better = (best[rows] < 0) | (d < dist[rows])
        best[rows[better]], dist[rows[better]] = c, d[better]
    return best, dist


def limbs(value: int) -> list[int]:
    mask = (1 << LIMB_BITS) - 1
    return [(value >> (LIMB_BITS * k)) & mask for k in range(LIMBS - 1)] + [value >> (LIMB_BITS * (LIMBS - 1))]


def from_limbs(parts) -> int:
    return sum(int(p) << (LIMB_BITS * k) for k, p in enumerate(parts))


# --- clustering -------------------------------------------------------------------

def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, seed: str = "3:",
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Exact integer k-means of the rows of ``vectors`` whose vector has exactly
    ``dims`` components, none null or non-finite.

    Returns ``vec_id``, ``cluster``, ``distance`` (squared),
    ``cluster_inertia``, ``inertia``, ``centroid_sha256``, one row per kept
    row.  The first centroids are the rows with the smallest SHA-256 of
    ``seed`` and id; of rows with one id the smaller vector comes first, rows
    with a null id are clustered but never chosen.  Fewer such rows than ``k``
    give fewer centroids, none an empty result, as does an empty table.  A
    distance or sum beyond 64 bits is null, its cluster is still exact.  The pivots are
    the first centroids, whose bounds are tight in the first round and loosen as
    centroids move; any choice gives the same result.  Other columns are ignored."""
    spark, folder = vectors.sparkSession, shared_dir(vectors.sparkSession, "kmeans")
    v = F.col("embedding")
    kept = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("embedding")).where(
        (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    digest = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    first = (kept.where("vec_id is not null").withColumn("_h", digest).orderBy("_h", "embedding").limit(k)
             .select("embedding").toArrow())
    if not first.num_rows:
        return spark.createDataFrame([], RESULT)
    centres = integers(first.column(0).combine_chunks(), dims)
    simplex = Simplex(as_float(centres))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apex = simplex.apex(as_float(integers(batch.column("embedding"), dims))) if batch.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(np.arange(len(apex) + 1, dtype=np.int32) * apex.shape[1], apex.ravel())],
                ["vec_id", "embedding", "apex"])

    kind = kept.schema["embedding"].dataType.simpleString()
    table = save(kept.mapInArrow(measure, f"vec_id long, embedding {kind}, apex array<double>"), f"{folder}/apexes")

    def apexes(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("apex").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)

    def step(centres: np.ndarray) -> np.ndarray:
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros((len(centres), dims), object), [0] * len(centres)
            for batch in batches:
                if not batch.num_rows:
                    continue
                q = integers(batch.column("embedding"), dims)
                best, _ = assign(q, apexes(batch), centres, simplex)
                for c in np.unique(best):
                    rows = q[best == c]
                    total[c] += rows.sum(0).astype(object)
                    count[c] += len(rows)
            rows = [(c, j, count[c], *limbs(int(total[c, j]))) for c in range(len(centres)) if count[c] for j in range(dims)]
            names = ["c", "j", "n"] + [f"l{i}" for i in range(LIMBS)]
            cols = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names)

        schema = "c long, j long, n long, " + ", ".join(f"l{i} long" for i in range(LIMBS))
        got = table.select("embedding", "apex").mapInArrow(sums, schema).groupBy("c", "j").agg(
            F.sum("n").alias("n"), *[F.sum(f"l{i}").alias(f"l{i}") for i in range(LIMBS)])
        new = centres.astype(object)
        for r in got.collect():  # at most k * dims rows
            new[r["c"], r["j"]] = from_limbs(r[f"l{i}"] for i in range(LIMBS)) // r["n"]
        return new if not fits(new) else new.astype(np.int64)

    for _ in range(rounds):
        now = step(centres)
        if (now == centres).all():
            break
        centres = now

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            best, dist = assign(integers(batch.column("embedding"), dims), apexes(batch), centres, simplex)
            short = [d if d < 1 << 63 else None for d in dist.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(best, pa.int32()), pa.array(short, pa.int64())],
                                             ["vec_id", "cluster", "distance"])

    done = save(table.mapInArrow(last, "vec_id long, cluster int, distance long"), f"{folder}/assigned")
    whole = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = {r["cluster"]: r["s"] for r in done.groupBy("cluster").agg(whole.alias("s")).collect()}  # at most k rows
    inertia = None if None in sums.values() else sum(map(int, sums.values()))

    def long(n) -> int | None:
        return None if n is None or n >= 1 << 63 else int(n)

    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centres.tolist()]
    per = spark.createDataFrame([(c, long(sums.get(c)), long(inertia), digests[c]) for c in range(len(centres))],
                                "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
