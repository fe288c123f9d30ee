"""Exact quantiles by selection and ordered prefix sums: brute force, ties,
hot keys, odd values, and their plans."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import prefix
from corpusloom.operators.prefix import ordered_prefix
from corpusloom.operators.quantiles import exact_quantiles, log_bin
from corpusloom.plans import registry
from tests.conftest import SF_SMALL

PROBS = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q90": 0.9, "q1": 1.0}


@pytest.fixture(params=[1, 4, 17])
def partitions(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


def _linear(values, p):
    values = sorted(values)
    at = (len(values) - 1) * p
    low, high = values[math.floor(at)], values[math.ceil(at)]
    return low if low == high else (1 - (at - math.floor(at))) * low + (at - math.floor(at)) * high


def test_quantiles_equal_sorting(spark, partitions):
    r = np.random.default_rng(3)
    groups = {"normal": r.normal(0, 1, 3000), "wide": np.exp(r.normal(0, 50, 2000)) * r.choice([-1, 1], 2000),
              "counts": r.integers(0, 6, 4000).astype(float), "near": 1e6 + np.arange(1500) * 1e-9, "one": np.array([7.0]),
              "two": np.array([-0.0, 5e-324]), None: r.integers(-3, 3, 100) / 7, "ends": np.array([-math.inf, -1e308, 0.0, 1e308, math.inf])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("normal", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {x["g"]: x for x in exact_quantiles(df, "v", PROBS, ["g"]).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        for name, p in PROBS.items():
            assert got[g][name] == _linear(vs.tolist(), p), (g, name)
    whole = exact_quantiles(df.where("g = 'wide'"), "v", PROBS).first()
    assert [whole[n] for n in PROBS] == [_linear(groups["wide"].tolist(), p) for p in PROBS.values()]


def test_quantiles_odd(spark):
    df = spark.createDataFrame([(1, None)], "g int, v double")
    assert exact_quantiles(df, "v", {"m": 0.5}).collect()[0]["m"] is None
    assert exact_quantiles(df, "v", {"m": 0.5}, ["g"]).count() == 0
    nan = spark.createDataFrame([(float("nan"),), (1.0,), (2.0,)], "v double")
    got = exact_quantiles(nan, "v", {"low": 0.0, "mid": 0.5, "high": 1.0}).first()
    assert (got["low"], got["mid"]) == (1.0, 2.0) and math.isnan(got["high"])
    whole = spark.range(1001).select((F.col("id") % 7).cast("int").alias("v"))
    assert exact_quantiles(whole, "v", {"m": 0.5}).first()["m"] == 3.0


def test_bins_never_fall(spark):
    values = sorted({s * m * 2.0 ** e for e in (-1074, -1030, -3, -1, 0, 1, 52, 1000) for m in (1, 1.001, 1.5, 1.999999) for s in (1, -1)}
                    | {0.0, math.inf, -math.inf})
    bins = [r["b"] for r in spark.createDataFrame([(v,) for v in values], "v double").select(log_bin(F.col("v")).alias("b")).collect()]
    assert bins == sorted(bins)


def test_labels_are_built_without_a_job(spark):
    sc = spark.sparkContext
    sc.setJobGroup("build", "build")
    registry.queries()["vote_quantile_labels"](spark, SF_SMALL)
    registry.queries()["market_yearly"](spark, SF_SMALL)
    status = sc.statusTracker()
    names = {status.getStageInfo(s).name for j in status.getJobIdsForGroup("build") for s in status.getJobInfo(j).stageIds}
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert all(n.startswith("parquet") for n in names), names  # reading the tables' schemas is all that may run


def _rows(spark, n=4000):
    """Half of the rows on one leading key; groups with a null one."""
    r = np.random.default_rng(1)
    data = [(int(r.integers(3)) or None, 5 if i % 2 else int(r.integers(-50, 50)), f"k{int(r.integers(10**9))}-{i}", int(r.integers(9)))
            for i in range(n)]
    return data, spark.createDataFrame(data, "g int, a int, b string, v int").repartition(6)


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("inclusive", [True, False])
def test_prefix_equals_a_loop(spark, partitions, descending, inclusive):
    data, df = _rows(spark)
    got = ordered_prefix(df, ["a", "b"], ["v", None], out=["s", "n"], partition_cols=["g"], inclusive=inclusive, descending=descending)
    want, total = {}, {}
    for g, a, b, v in sorted(data, key=lambda x: (-x[1] if descending else x[1], x[2])):
        s, n = total.get(g, (0, 0))
        total[g] = (s + v, n + 1)
        want[b] = total[g] if inclusive else (s, n)
    assert {x["b"]: (x["s"], x["n"]) for x in got.collect()} == want


def test_prefix_splits_a_hot_leading_key(spark):
    _, df = _rows(spark)
    key = prefix._order_key(df, ["a", "b"], False)
    split = df.withColumn("k", key).withColumn("s", prefix._splits(df, key, 16)).withColumn("pb", prefix._bucket("s", "k", 16))
    sizes = [r["count"] for r in split.groupBy("pb").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * 4000 / 16


def test_prefix_exchanges_rows_once(spark, tmp_path):
    _, df = _rows(spark, 100)
    df.write.parquet(f"{tmp_path}/rows")
    plan = ordered_prefix(spark.read.parquet(f"{tmp_path}/rows"), ["a", "b"], "v", out="s")._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("Subqueries")[0]
    # the column of the text key passes through one exchange: that of the rows, by bucket
    of_rows = [x for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan) if x.startswith("_pb")]
    assert len(of_rows) == 2  # one of the rows, one of the buckets' totals
    assert "percentile_approx" not in plan


def test_prefix_odd(spark):
    empty = spark.createDataFrame([], "a int, b int")
    assert ordered_prefix(empty, ["a", "b"], None, out="n").count() == 0
    equal = spark.createDataFrame([(1, 1)] * 5 + [(None, 2)], "a int, b int")
    assert sorted(r["n"] for r in ordered_prefix(equal, ["a", "b"], None, out="n").collect()) == [1, 2, 3, 4, 5, 6]
