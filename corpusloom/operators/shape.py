"""Projection and schema shaping (P-01..P-16, U-01, U-02).

Name resolution works on ``df.columns`` (metadata on the driver, no data);
everything else is column expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.sources.schemas import LIST_FIELDS, NULL_STRUCT_FIELDS, STANDARD_POST_COLUMNS, TEXT_ALIASES


def resolve_synonyms(columns: list[str], variants: dict[str, list[str]] = STANDARD_POST_COLUMNS) -> dict:
    """P-01: map raw column names to standard names.  Matching is
    case-insensitive; for each target the first variant (priority order)
    present wins and only that one is kept (trap T-01)."""
    # of columns that differ only in case the first one counts
    raw_of = {c.lower(): c for c in reversed(columns)}
    found = {target: next((raw_of[v] for v in options if v in raw_of), None) for target, options in variants.items()}
    return {raw: target for target, raw in found.items() if raw is not None}


def standardise_columns(df: DataFrame, variants: dict[str, list[str]] = STANDARD_POST_COLUMNS,
                        keep: list[str] | None = None, merge_date_time: bool = False) -> DataFrame:
    """P-01 + P-02 + P-03 (+ P-04 opt-in): rename by synonym, add missing
    standard columns as NULL strings, fixed column order.  ``keep`` carries
    extra columns through (e.g. an explicit order key).  With
    ``merge_date_time`` a ``date`` column plus a ``time`` column become
    ``'<date> <time>'`` (the evident intent; unreachable in the reference)."""
    mapping = resolve_synonyms(df.columns, variants)
    sel = {}
    for raw, std in mapping.items():
        sel[std] = F.col(f"`{raw}`").cast("string")
    if merge_date_time:
        low = {c.lower(): c for c in df.columns}
        if "date" in low and "time" in low:
            sel["timestamp"] = F.concat_ws(" ", F.col(f"`{low['date']}`").cast("string"),
                                           F.col(f"`{low['time']}`").cast("string"))
        elif "datetime" in low:
            sel["timestamp"] = F.col(f"`{low['datetime']}`").cast("string")
    cols = [sel.get(t, F.lit(None).cast("string")).alias(t) for t in variants]
    return df.select(*cols, *(keep or []))


def union_all(dfs: list[DataFrame]) -> DataFrame:
    """U-01: union by name, missing columns filled with NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def text_column(df: DataFrame, aliases: list[str] = TEXT_ALIASES, keep: list[str] | None = None) -> DataFrame:
    """P-06 + P-07: reduce a dataset to one ``text`` column taken from the
    first known alias present (``tweet`` included: trap T-04); error if
    none."""
    for a in aliases:
        if a in df.columns:
            return df.select(F.col(a).alias("text"), *(keep or []))
    raise ValueError(f"no text column among {aliases}: {df.columns}")


def with_text_column(df: DataFrame, aliases: list[str] = TEXT_ALIASES) -> tuple[DataFrame, str]:
    """P-06: ``df`` with its first known text alias named ``text``, other columns
    as they are (one that clashes keeps its place under ``_text``), and the old
    name; error if there is none."""
    old = next((a for a in aliases if a in df.columns), None)
    if old is None:
        raise ValueError(f"no text column among {aliases}: {df.columns}")
    names = {"text": "_text"} if old != "text" and "text" in df.columns else {}
    return df.withColumnsRenamed(names).withColumnRenamed(old, "text"), old


def restore_text_column(df: DataFrame, old: str) -> DataFrame:
    """P-06: undo ``with_text_column``: give ``text`` its old name back."""
    df = df.withColumnRenamed("text", old)
    return df.withColumnRenamed("_text", "text") if old != "text" and "_text" in df.columns else df


def combine_text_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """U-02: union of the text columns of several sources with a ``source``
    column; sources without a text column are skipped."""
    parts = []
    for name, df in sources.items():
        try:
            parts.append(text_column(df).withColumn("source", F.lit(name)))
        except ValueError:
            continue
    return union_all(parts)


def _null_struct(dt: T.StructType):
    """A struct of typed NULLs matching ``dt`` (built lazily: Column objects
    need an active session)."""
    return F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in dt.fields])


def normalise_records(df: DataFrame) -> DataFrame:
    """P-08: NULL ``publicationVenue`` / ``openAccessPdf`` become structs of
    typed NULLs; NULL list fields become empty lists."""
    out = df
    for f in NULL_STRUCT_FIELDS:
        if f in df.columns and isinstance(df.schema[f].dataType, T.StructType):
            out = out.withColumn(f, F.coalesce(F.col(f), _null_struct(df.schema[f].dataType)))
    for f in LIST_FIELDS:
        if f in df.columns:
            dt = df.schema[f].dataType
            out = out.withColumn(f, F.coalesce(F.col(f), F.array().cast(dt)))
    return out


def extend_schema(df: DataFrame, new_cols: dict, types: dict[str, str]) -> DataFrame:
    """P-11: keep the old columns, append typed new ones."""
    return df.withColumns({c: (e if not isinstance(e, str) else F.expr(e)).cast(types[c])
                           for c, e in new_cols.items()})


def order_columns(df: DataFrame, base: list[str], metrics: list[str]) -> DataFrame:
    """P-13: base columns, then the metric columns present, then the rest."""
    present = [m for m in metrics if m in df.columns]
    rest = [c for c in df.columns if c not in base and c not in present]
    return df.select(*[c for c in base if c in df.columns], *present, *rest)
