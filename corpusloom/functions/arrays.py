"""Array and label column expressions (F-11..F-13, F-16, F-26, F-27, F-29,
F-30), written with Spark higher-order functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def scores_excluding(pred, group: str = "ESG") -> Column:
    """F-11: scores of predictions whose entity_group differs from ``group``."""
    return F.transform(F.filter(_c(pred), lambda x: x["entity_group"] != F.lit(group)),
                       lambda x: x["score"])


def array_max_or(arr, empty_value=None) -> Column:
    """F-12: array maximum; an empty array gives ``empty_value`` (NULL in the
    filter script, 0 in the notebook: trap T-02)."""
    m = F.array_max(_c(arr))
    return m if empty_value is None else F.coalesce(m, F.lit(empty_value))


def array_median(arr) -> Column:
    """F-13: median of a numeric array (linear interpolation, NULL on empty)."""
    s = F.array_sort(F.filter(_c(arr), lambda x: x.isNotNull()))
    n = F.size(s)
    lo = F.element_at(s, F.floor((n - 1) / 2).cast("int") + 1)
    hi = F.element_at(s, F.ceil((n - 1) / 2).cast("int") + 1)
    return F.when(n > 0, (lo.cast("double") + hi.cast("double")) / 2)


def encode_label(value, labels: list[str]) -> Column:
    """F-16: label name -> id by list position (NULL when absent)."""
    arr = F.array(*[F.lit(x) for x in labels])
    pos = F.array_position(arr, _c(value))
    return F.when(pos > 0, (pos - 1).cast("int"))


def decode_label(idx, labels: list[str]) -> Column:
    """F-16: id -> label name (NULL when out of range)."""
    arr = F.array(*[F.lit(x) for x in labels])
    return F.try_element_at(arr, _c(idx).cast("int") + 1)


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` names it
    in lambdas (which compute a plain expression for every element)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def softmax(logits) -> Column:
    """F-26: numerically stable softmax of a numeric array."""
    def powers(a):
        return bound(F.array_max(a), lambda m: F.transform(a, lambda x: F.exp(x - m)))

    def shares(e):
        return bound(F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x), lambda total: F.transform(e, lambda x: x / total))

    return bound(F.transform(_c(logits), lambda x: x.cast("double")), lambda a: bound(powers(a), shares))


def argmax(arr) -> Column:
    """F-27: 0-based position of the first maximum; NULL on empty."""
    a = _c(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def first_prediction(pred) -> Column:
    """F-29: first element of a prediction array (NULL when empty/NULL)."""
    return F.try_element_at(_c(pred), F.lit(1))


def drop_ignored(pred_ids, gold_ids, labels: list[str], ignore: int = -100) -> Column:
    """F-30: pair predicted and gold ids, drop positions whose gold id is
    ``ignore``, map both to names -> ARRAY<STRUCT<pred, gold>>."""
    z = F.arrays_zip(_c(pred_ids).alias("p"), _c(gold_ids).alias("g"))
    kept = F.filter(z, lambda x: x["g"] != F.lit(ignore))
    return F.transform(kept, lambda x: F.struct(decode_label(x["p"], labels).alias("pred"),
                                                decode_label(x["g"], labels).alias("gold")))


def row_slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first, past the last) of runs of rows that hold at most ``most`` in all, or one row."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
        yield at, (at := max(at + 1, upto))


def list_sizes(lists: pa.Array) -> np.ndarray:
    """Elements of each list; NULL has none."""
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
