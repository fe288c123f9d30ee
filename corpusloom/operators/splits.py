"""Sampling, shuffling, splits and folds (O-05..O-10).

Row order is defined by a seeded hash of a key (the leading 15 hexadecimal
digits of ``md5(seed|key)``, which any SQL engine can repeat) with the key as
tie-break, so results do not depend on physical partitioning.  Positions come from :func:`ordered_prefix` (range-bucketed),
never from a single-partition window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.joins import broadcast_if_small
from corpusloom.operators.prefix import ordered_prefix


def seeded_hash(key_cols, seed: int = 42) -> Column:
    """60 bits of the MD5 of the seed and the keys; a NULL key counts as no text."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ([key_cols] if isinstance(key_cols, str) else key_cols)]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *cols))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def head(df: DataFrame, order_cols, n: int) -> DataFrame:
    """O-05 / R-03: first ``n`` rows in an explicit order (top-k plan:
    per-partition limit, then a merge of at most n rows per partition)."""
    cols = [order_cols] if isinstance(order_cols, str) else order_cols
    return df.orderBy(*cols).limit(n)


def sample_exact(df: DataFrame, key_cols, n: int, seed: int = 42) -> DataFrame:
    """O-06: exactly ``n`` rows (or all if fewer), repeatable for a seed."""
    keys = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    return df.orderBy(seeded_hash(keys, seed), *keys).limit(n)


def seeded_shuffle(df: DataFrame, key_cols, seed: int = 42, out: str = "shuffle_pos") -> DataFrame:
    """O-07: a repeatable permutation: 1-based position in seeded-hash
    order."""
    keys = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    h = df.withColumn("_h", seeded_hash(keys, seed))
    return ordered_prefix(h, ["_h", *keys], None, out=out).drop("_h")


def split_exact(df: DataFrame, key_cols, test_fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """O-08: train/test split with exactly ceil(n * f) test rows (the first
    rows of the seeded permutation)."""
    s = seeded_shuffle(df, key_cols, seed, "_pos")
    n = df.select(F.count("*").alias("n")).scalar()
    n_test = F.ceil(n * F.lit(test_fraction))
    return s.withColumn("split", F.when(F.col("_pos") <= n_test, F.lit("test")).otherwise(F.lit("train"))) \
        .drop("_pos")


def split_stratified(df: DataFrame, key_cols, label_col: str, test_fraction: float = 0.1,
                     seed: int = 42) -> DataFrame:
    """O-09: stratified split.  Test rows total ceil(n * f); each label gets
    floor(n_l * n_test / n) plus one for the largest remainders (ties by
    label); within a label, the first rows of the seeded permutation are
    test.  The label-count table is one row per label."""
    keys = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    counts = df.groupBy(label_col).agg(F.count("*").alias("_nl"))
    n = counts.select(F.sum("_nl").alias("n")).scalar()
    n_test = F.ceil(n * F.lit(test_fraction))
    q = counts.withColumn("_exact", F.col("_nl") * n_test / n) \
        .withColumn("_floor", F.floor("_exact")).withColumn("_rem", F.col("_exact") - F.col("_floor"))
    short = q.select((n_test - F.sum("_floor")).alias("r")).scalar()
    # ranks over the label-count table (one row per label, not row data)
    w = Window.orderBy(F.col("_rem").desc(), F.col(label_col))
    q = q.withColumn("_quota", F.col("_floor") + F.when(F.row_number().over(w) <= short, 1).otherwise(0))
    h = df.withColumn("_h", seeded_hash(keys, seed))
    pos = ordered_prefix(h, ["_h", *keys], None, out="_pos", partition_cols=[label_col]).drop("_h")
    quota = broadcast_if_small(q.select(F.col(label_col).alias("_label"), "_quota"))
    j = pos.join(quota, F.col(label_col).eqNullSafe(F.col("_label")), "left").drop("_label")
    return j.withColumn("split", F.when(F.col("_pos") <= F.col("_quota"), F.lit("test"))
                        .otherwise(F.lit("train"))).drop("_pos", "_quota")


# ------------------------------------------------------------------ group folds
def _class_plan(loads: list[int], s: int, m: int, k: int):
    """Greedy assignment of ``m`` equal groups of size ``s`` to ``k`` folds
    with current ``loads`` (lightest fold first, ties by fold index).

    Assigning to the lightest fold and adding ``s`` merges the k arithmetic
    progressions L_f + j*s; writing L_f = q_f*s + r_f, the merged order is by
    level (q_f + j), then r_f, then f.  Level lambda holds the folds with
    q_f <= lambda, so the sequence is piecewise periodic with at most k
    segments.  Returns (segments, per-fold counts): each segment is
    (start_t, length, active folds ordered by (r_f, f))."""
    q = [L // s for L in loads]
    r = [L % s for L in loads]
    levels = sorted(set(q))
    segments, t = [], 0
    for i, lam in enumerate(levels):
        active = sorted((f for f in range(k) if q[f] <= lam), key=lambda f: (r[f], f))
        span = (levels[i + 1] - lam) * len(active) if i + 1 < len(levels) else None  # None = unbounded
        segments.append((t, span, active))
        if span is not None:
            t += span
    counts = [0] * k
    left = m
    for start, span, active in segments:
        take = left if span is None else min(left, span)
        full, extra = divmod(take, len(active))
        for i, f in enumerate(active):
            counts[f] += full + (1 if i < extra else 0)
        left -= take
        if left == 0:
            break
    return segments, counts


def group_folds(df: DataFrame, group_col: str, k: int = 5, seed: int = 0) -> DataFrame:
    """O-10: group k-fold.  Groups are taken in (size desc, seeded hash,
    group) order and each goes to the currently lightest fold (ties to the
    lower fold index), so no group is ever split (trap T-16).

    Exact sequential greedy without a sequential pass over groups: groups of
    equal size are placed in closed form (see ``_class_plan``).  Only the
    table of distinct group sizes - at most sqrt(2 * rows) entries - reaches
    the driver; each group's fold is a column expression of its rank inside
    its size class, and rows get their fold by joining on the group."""
    sizes = df.groupBy(group_col).agg(F.count("*").alias("_size"))
    classes = sizes.groupBy("_size").agg(F.count("*").alias("_m")).orderBy(F.col("_size").desc())
    loads = [0] * k
    plans = []
    for row in classes.collect():  # bounded: distinct group sizes only
        s, m = int(row["_size"]), int(row["_m"])
        segments, counts = _class_plan(loads, s, m, k)
        plans.append((s, segments))
        loads = [L + c * s for L, c in zip(loads, counts)]
    # plan table: <= k segments per size class, derived from the class table
    seg_rows = [(s_, st, (st + span) if span is not None else None, active)
                for s_, segments in plans for st, span, active in segments]
    plan = df.sparkSession.createDataFrame(
        seg_rows, "_size long, _start long, _end long, _active array<int>")
    g = sizes.withColumn("_h", seeded_hash(group_col, seed))
    ranked = ordered_prefix(g, ["_h", group_col], None, out="_t", partition_cols=["_size"]) \
        .withColumn("_t", F.col("_t") - 1)
    j = ranked.join(broadcast_if_small(plan), "_size") \
        .where((F.col("_t") >= F.col("_start")) & (F.col("_end").isNull() | (F.col("_t") < F.col("_end"))))
    fold = F.element_at("_active", (F.pmod(F.col("_t") - F.col("_start"), F.size("_active")) + 1).cast("int"))
    return j.select(group_col, F.col("_size").alias("group_size"), fold.cast("int").alias("fold"))
