"""Numeric column expressions (F-18..F-25, F-28, A-01)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def row_sum(cols, null_as_zero: bool = True) -> Column:
    """A-01: row-wise sum over columns.  ``null_as_zero`` mirrors
    ``df[cols].sum(axis=1)``; ``False`` mirrors ``a + b`` (null propagates,
    trap T-17)."""
    parts = [F.coalesce(_c(c), F.lit(0)) if null_as_zero else _c(c) for c in cols]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def pct_of(part, total) -> Column:
    """F-18: ``part / total * 100`` with a zero total giving NULL (``/``
    raises in ANSI mode)."""
    return F.try_divide(_c(part), _c(total)) * F.lit(100.0)


def smoothed_ratio(a, b) -> Column:
    """F-19: ``a / (b + 1)``."""
    return F.try_divide(_c(a).cast("double"), _c(b) + F.lit(1))


def clip_lower(c, bound: float = 0.0) -> Column:
    """F-22: clip at a lower bound; NULL stays NULL."""
    c = _c(c)
    return F.when(c.isNull(), F.lit(None)).otherwise(F.greatest(c, F.lit(bound)))


def scale(c, factor: float = 1e9) -> Column:
    """F-23: divide by a constant (to billions by default)."""
    return _c(c) / F.lit(float(factor))


def round_half_even(c, digits: int = 3) -> Column:
    """F-24: pandas/numpy rounding - scale, round half to even, unscale
    (``np.round``), rather than rounding the exact binary value."""
    f = float(10 ** digits)
    return F.rint(_c(c).cast("double") * f) / f


def human_number(c, style: str = "short") -> Column:
    """F-25: human-readable counts.

    * ``short``  ``12B`` / ``3M`` / ``41K`` with half-even whole rounding,
      else the integer as text (parameter-count style)
    * ``docs``   ``1.23M`` / ``4.5K`` / ``987`` (document-count style)
    * ``tokens`` ``4.5K`` above 1000, else the whole number
    """
    x = _c(c).cast("double")
    if style == "short":
        return (F.when(x >= 1e9, F.concat(F.bround(x / 1e9, 0).cast("bigint").cast("string"), F.lit("B")))
                .when(x >= 1e6, F.concat(F.bround(x / 1e6, 0).cast("bigint").cast("string"), F.lit("M")))
                .when(x >= 1e3, F.concat(F.bround(x / 1e3, 0).cast("bigint").cast("string"), F.lit("K")))
                .otherwise(_c(c).cast("bigint").cast("string")))
    if style == "docs":
        return (F.when(x >= 1e6, F.format_string("%.2fM", x / 1e6))
                .when(x >= 1e3, F.format_string("%.1fK", x / 1e3))
                .otherwise(F.format_string("%.0f", x)))
    if style == "tokens":
        return (F.when(x > 1000, F.format_string("%.1fK", x / 1000))
                .otherwise(F.format_string("%.0f", x)))
    raise ValueError(f"unknown style {style!r}")


def confidence_band(score) -> Column:
    """F-28: > 0.9 high, > 0.7 medium, else low; NULL score -> NULL."""
    s = _c(score)
    return (F.when(s.isNull(), F.lit(None).cast("string"))
            .when(s > 0.9, F.lit("high"))
            .when(s > 0.7, F.lit("medium"))
            .otherwise(F.lit("low")))


def rounded(c, digits: int = 9) -> Column:
    """Round a derived double so results compare stably across engines."""
    return F.round(_c(c).cast("double"), digits)
