"""Registry of named queries (``queries()``) and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("labeling", "joining", "vocabulary", "trends", "evaluation", "textprep", "subwords", "incremental", "files", "sampling", "ingest", "inference")
QueryFn = Callable[[SparkSession, str], DataFrame]


def _collect() -> dict[str, QueryFn]:
    mods = [import_module(f"corpusloom.plans.{name}") for name in MODULES]
    out: dict[str, QueryFn] = {}
    for m in mods:
        for key in getattr(m, "__all__", None) or [k for k in dir(m) if not k.startswith("_")]:
            fn = getattr(m, key)
            if callable(fn) and getattr(fn, "__module__", "") == m.__name__ \
                    and fn.__code__.co_varnames[:2] == ("spark", "sf_dir"):
                out[key] = fn
    return out


def queries() -> dict[str, QueryFn]:
    return _collect()


def oracle_sql() -> dict[str, str]:
    from corpusloom.plans.oracle import ORACLE
    q = queries()
    return {k: v for k, v in ORACLE.items() if k in q}
