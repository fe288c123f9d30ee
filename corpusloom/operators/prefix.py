"""Ordered prefix sums without a global single-partition window (W-08).

Spark has no global row order except through a window with no partition,
which funnels every row into one task.  ``ordered_prefix`` instead:

1. takes split points of the whole order key from a sample of bounded size
   (the rows with the least hash, a top-k without a shuffle),
2. finds each row's bucket by binary search, a deterministic, monotone
   expression, so rows with equal leading keys are split by the next key,
3. sums the values per bucket (a tiny table: ``n_buckets`` rows per
   partition group) and turns those into bucket offsets,
4. exchanges the rows once, by bucket, runs the sums inside each bucket and
   adds the offsets.

Only rows equal in all order columns always share a bucket, so the order
columns must identify a row for a repeatable result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sampled rows per bucket.
SAMPLE_PER_BUCKET = 32


def default_buckets(df: DataFrame) -> int:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(4, n * 2)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _order_key(df: DataFrame, order_cols: list, descending: bool) -> Column:
    """A struct that sorts rows like ``order_cols`` do."""
    lead = _col(order_cols[0])
    if descending:
        whole = isinstance(df.select(lead.alias("c")).schema["c"].dataType, T.IntegralType)
        lead = F.bitwise_not(lead) if whole else -lead
    return F.struct(lead.alias("k0"), *[_col(c).alias(f"k{i}") for i, c in enumerate(order_cols[1:], 1)])


def _splits(df: DataFrame, key: Column, n_buckets: int) -> Column:
    """A scalar: ``n_buckets - 1`` or fewer ascending split points of ``key``."""
    size = SAMPLE_PER_BUCKET * n_buckets
    sample = df.select(key.alias("k")).orderBy(F.xxhash64("k"), "k").limit(size)
    step = F.greatest(F.floor(F.size("s") / F.lit(n_buckets)), F.lit(1)).cast("int")
    every = F.filter("s", lambda _, i: (i > 0) & (i % step == 0))
    return sample.agg(F.array_sort(F.collect_list("k")).alias("s")).select(every.alias("p")).scalar()


def _bucket(splits: str, key: str, n_buckets: int) -> Column:
    """How many of the sorted ``splits`` are at most ``key``, by binary search.
    A sample of fewer rows than buckets has no more splits than rows."""
    steps = (SAMPLE_PER_BUCKET * n_buckets).bit_length()
    start = F.struct(F.lit(0).alias("lo"), F.size(splits).alias("hi"))

    def halve(a: Column, _: Column) -> Column:
        mid = F.shiftright(a["lo"] + a["hi"], 1)
        right = F.get(F.col(splits), mid) <= F.col(key)
        return F.when(a["lo"] >= a["hi"], a).when(right, F.struct((mid + 1).alias("lo"), a["hi"].alias("hi"))) \
            .otherwise(F.struct(a["lo"].alias("lo"), mid.alias("hi")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda a: a["lo"])


def ordered_prefix(df: DataFrame, order_cols: list, value_col=None, out="prefix",
                   partition_cols: list | None = None, n_buckets: int | None = None,
                   inclusive: bool = True, descending: bool = False,
                   materialize: bool = False) -> DataFrame:
    """Add ``out`` = running sum of ``value_col`` (1 per row when ``None``)
    in (partition_cols, order_cols) order; lists of both give several sums.

    ``inclusive`` includes the current row; ``descending`` orders the leading
    key, then a number, from high to low (used for score-ordered cumulative
    counts).

    The input is read three times (sample, bucket totals, running sums) and
    exchanged once.  ``materialize`` checkpoints it first (shared checkpoint
    folder), which is worth it when the input is an expensive aggregate - pass
    a narrow table, not text.
    """
    if materialize:
        from corpusloom.session import cut_lineage
        df = cut_lineage(df)
    parts = list(partition_cols or [])
    n_buckets = n_buckets or default_buckets(df)
    outs, values = ([out], [value_col]) if isinstance(out, str) else (list(out), list(value_col))
    held = [f"_pv{i}" for i in range(len(outs))]
    key = _order_key(df, order_cols, descending)
    base = (df.withColumns({h: F.lit(1).cast("bigint") if v is None else _col(v) for h, v in zip(held, values)})
            .withColumn("_pk", key).withColumn("_ps", _splits(df, key, n_buckets))
            .withColumn("_pb", _bucket("_ps", "_pk", n_buckets)).drop("_ps"))

    totals = base.groupBy(*parts, "_pb").agg(*[F.sum(h).alias(f"{h}t") for h in held])
    ow = Window.partitionBy(*parts).orderBy("_pb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*parts, "_pb", *[F.coalesce(F.sum(f"{h}t").over(ow), F.lit(0)).alias(f"{h}o") for h in held])
    if not parts:
        # bounded by the number of buckets: safe to broadcast
        offsets = F.broadcast(offsets)
    joined = _join_offsets(base, offsets, parts)

    w = Window.partitionBy(*parts, "_pb").orderBy("_pk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = {o: F.sum(h).over(w) + F.col(f"{h}o") - (0 if inclusive else F.col(h)) for h, o in zip(held, outs)}
    return joined.withColumns(sums).drop("_pb", "_pk", *held, *[f"{h}o" for h in held])


def _join_offsets(base: DataFrame, offsets: DataFrame, partition_cols: list[str]) -> DataFrame:
    """Rows with the offset of their bucket; a NULL partition key is a
    partition like any other."""
    keys = [*partition_cols, "_pb"]
    renamed = offsets.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return base.join(renamed, reduce(lambda a, b: a & b, same)).drop(*[f"_k{i}" for i in range(len(keys))])
