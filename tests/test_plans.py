"""Structural checks on physical plans: no
Python evaluation in expression-only queries, no cartesian / nested-loop
joins, no single-partition exchange feeding a window over row data, and
column pruning at the Parquet scan."""

import re

import pytest

from corpusloom.plans import registry as E
from tests.conftest import SF_SMALL

PYTHON_OK = {"html_to_markdown", "document_entities", "small_files_scan", "encoding_search", "subword_counts", "subword_pad", "subword_alignment", "batch_sentiment", "batch_entities", "encoding_repair", "posts_ingest"}
# windows over a single partition are allowed only on tables bounded by the
# number of labels / buckets (never row data)
SINGLE_WINDOW_OK = {"split_stratified"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    out = {}
    for name, fn in E.queries().items():
        out[name] = _plan(fn(spark, SF_SMALL))
    return out


def test_no_python_in_expression_queries(plans):
    bad = [n for n, p in plans.items() if n not in PYTHON_OK and re.search(r"(BatchEvalPython|ArrowEvalPython|MapInPandas)", p)]
    assert bad == []


def test_no_cartesian_or_nested_loop_joins(plans):
    bad = [n for n, p in plans.items() if re.search(r"(CartesianProduct|BroadcastNestedLoopJoin)", p)]
    assert bad == []


def _single_windows(plan: str) -> bool:
    """Whether a window reads an exchange into one partition, whatever sorts
    or projections stand between them."""
    stack = []
    for line in plan.split("\n"):
        m = re.match(r"^([\s:|+\-*()\d]*)([A-Z].*)$", line)
        if not m:
            continue
        depth = len(m[1])
        stack = [x for x in stack if x[0] < depth]
        if m[2].startswith("Exchange SinglePartition"):
            for _, name in reversed(stack):
                # the bucket table of a prefix sum, the fixed bins of a quantile
                if name.startswith("Window") and re.search("_pb|_bin|_total", name):
                    break
                if name.startswith("Window"):
                    return True
                if not re.match(r"Sort|Project|InputAdapter|WholeStage|AQEShuffleRead|ShuffleQueryStage", name):
                    break
        stack.append((depth, m[2]))
    return False


def test_no_single_partition_window_on_rows(plans):
    assert sorted(n for n, p in plans.items() if _single_windows(p) and n not in SINGLE_WINDOW_OK) == []


def test_the_window_check_sees_through_a_sort(spark):
    from pyspark.sql import Window, functions as F
    bad = spark.range(10).withColumn("r", F.row_number().over(Window.orderBy("id")))
    assert _single_windows(_plan(bad))


def test_scan_reads_only_needed_columns(spark):
    df = E.queries()["market_yearly"](spark, SF_SMALL)
    p = df._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet [^\[]*\[([^\]]*)\]", p)
    assert scans and all("o_custkey" not in s and "o_orderpriority" not in s for s in scans)
