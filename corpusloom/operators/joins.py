"""Joins, keyed dedup and join reconciliation (J-01..J-12, W-05..W-07,
P-12, M-19, U-03..U-05).

Keyed dedup is an aggregate, not a window: ``min(struct(order..., row...))``
per key is deterministic (the whole struct breaks ties) and its partial
aggregation collapses a hot key on the map side, so a key that holds a third
of all rows never lands in one task as raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _cols(c) -> list[str]:
    return [c] if isinstance(c, str) else list(c)


def _pick(df: DataFrame, key, order, agg) -> DataFrame:
    key, order = _cols(key), _cols(order)
    payload = [c for c in df.columns if c not in key and c not in order]
    packed = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                      *[F.col(c) for c in payload])
    out = df.groupBy(*key).agg(agg(packed).alias("_r"))
    sel = [F.col(k) for k in key]
    sel += [F.col(f"_r._o{i}").alias(c) for i, c in enumerate(order)]
    sel += [F.col(f"_r.{c}").alias(c) for c in payload]
    return out.select(*sel).select(*df.columns)


def keep_first(df: DataFrame, key, order) -> DataFrame:
    """W-05/W-06: one row per key - the smallest ``order`` (explicit order
    columns, trap T-08).  Other columns come from that same row."""
    return _pick(df, key, order, F.min)


def keep_last(df: DataFrame, key, order) -> DataFrame:
    """W-07: one row per key - the largest ``order`` (dict-comprehension
    'last wins')."""
    return _pick(df, key, order, F.max)


def text_digest(text_col: str):
    """Stands for a text as a key of joins and groups."""
    return F.sha2(F.col(text_col).cast("string"), 256)


def dedup_text(df: DataFrame, text_col: str = "text", order="doc_id") -> DataFrame:
    """W-06: keep the first row of every distinct text (NULL texts form one
    group, like ``unique``).  Texts are told apart by their SHA-256, so only
    digests and order columns are grouped; the winning rows are picked by a
    semi join.  ``order`` must be unique among the rows of a text."""
    order = _cols(order)
    first = (df.select(text_digest(text_col).alias("_d"), *order).groupBy("_d").agg(F.min(F.struct(*order)).alias("_f"))
             .select(F.col("_d").alias("_first"), *[F.col(f"_f.{c}").alias(f"_o{i}") for i, c in enumerate(order)]))
    same = text_digest(text_col).eqNullSafe(F.col("_first"))
    for i, c in enumerate(order):
        same = same & F.col(c).eqNullSafe(F.col(f"_o{i}"))
    return df.join(first, same, "left_semi")


def semi_both(left: DataFrame, right: DataFrame, key) -> tuple[DataFrame, DataFrame]:
    """J-01: rows of each side whose key exists on the other side."""
    key = _cols(key)
    return (left.join(right.select(*key), key, "left_semi"),
            right.join(left.select(*key), key, "left_semi"))


def anti_by_keys(df: DataFrame, keys: DataFrame, key) -> DataFrame:
    """J-05/U-04: rows whose key is not in ``keys``.  An anti join (NOT
    ``NOT IN``) keeps rows with NULL keys like Python's ``not in`` (trap
    T-11)."""
    key = _cols(key)
    return df.join(keys.select(*key), key, "left_anti")


def inner_join_last(left: DataFrame, right: DataFrame, key, order,
                    null_as_empty: bool = True) -> DataFrame:
    """J-02 + P-14: right side deduplicated 'last wins', inner join, right
    columns overwrite left ones, NULL right values become ''."""
    key = _cols(key)
    r = keep_last(right, key, order)
    rcols = [c for c in r.columns if c not in key]
    if null_as_empty:
        r = r.select(*key, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
                             for c in rcols])
    lcols = [c for c in left.columns if c not in key and c not in rcols]
    return left.select(*key, *lcols).join(r, key, "inner")


def left_join_suffix(left: DataFrame, right: DataFrame, key: str,
                     suffix: str = "_pos", null_safe: bool = True) -> DataFrame:
    """J-06: left outer join keeping every left row (multiplicity = product
    of key counts); right columns that clash get ``suffix``.  ``null_safe``
    matches NULL keys with NULL keys, as pandas index joins do."""
    rmap = {c: (c + suffix if c in left.columns else c) for c in right.columns if c != key}
    r = right.select(F.col(key).alias("_rk"), *[F.col(c).alias(n) for c, n in rmap.items()])
    cond = left[key].eqNullSafe(r["_rk"]) if null_safe else left[key] == r["_rk"]
    return left.join(r, cond, "left").drop("_rk")


def merge_precedence(left: DataFrame, right: DataFrame, key) -> DataFrame:
    """J-03 + P-12: inner join on key; on a column-name clash the left value
    wins; columns sorted by name after the key (deterministic order)."""
    key = _cols(key)
    lc = [c for c in left.columns if c not in key]
    rc = [c for c in right.columns if c not in key and c not in lc]
    j = left.alias("l").join(right.alias("r"), key, "inner")
    cols = sorted(lc + rc)
    return j.select(*key, *[F.col(f"l.{c}") if c in lc else F.col(f"r.{c}") for c in cols])


def join_reconciliation(left: DataFrame, right: DataFrame, key) -> DataFrame:
    """M-19: one-row report on a key join - rows and distinct keys per side,
    common keys, keys only on one side, duplicate keys per side.  One full
    outer join of the two distinct-key sets (each side pre-aggregated)."""
    key = _cols(key)
    lk = left.groupBy(*key).agg(F.count("*").alias("_ln"))
    rk = right.groupBy(*key).agg(F.count("*").alias("_rn"))
    j = lk.join(rk, key, "full_outer")
    ln, rn = F.col("_ln"), F.col("_rn")
    return j.agg(
        F.coalesce(F.sum(ln), F.lit(0)).cast("bigint").alias("left_rows"),
        F.coalesce(F.sum(rn), F.lit(0)).cast("bigint").alias("right_rows"),
        F.count(ln).alias("left_keys"),
        F.count(rn).alias("right_keys"),
        F.count_if(ln.isNotNull() & rn.isNotNull()).alias("common_keys"),
        F.count_if(rn.isNull()).alias("left_only_keys"),
        F.count_if(ln.isNull()).alias("right_only_keys"),
        F.count_if(ln > 1).alias("left_dup_keys"),
        F.count_if(rn > 1).alias("right_dup_keys"))


def broadcast_if_small(df: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """Broadcast a lookup side only after adding up its bytes (one aggregate on
    the small side); beyond the bound the planner's shuffle join is kept."""
    size = F.lit(16 * len(df.columns))
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    n = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    return F.broadcast(df) if n <= max_bytes else df
