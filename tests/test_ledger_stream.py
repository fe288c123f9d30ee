"""The ledger of attempts and keep-first over micro-batches."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators import joins as J
from corpusloom.streaming import dedup
from corpusloom.streaming.ledger import Ledger

SCHEMA = T.StructType([T.StructField("text", T.StringType())])


def _convert(df):
    """Keys ending in 3 always fail, in 5 at their first attempt, others never."""
    last = F.right("key", F.lit(1))
    fails = (last == "3") | ((last == "5") & (F.col("attempt") < 2))
    return df.withColumn("error", F.when(fails, F.concat(F.lit("bad "), "attempt"))).withColumn("text", F.when(~fails, F.upper("body")))


@pytest.fixture
def inputs(spark):
    return spark.range(60).select(F.concat(F.lit("k"), "id").alias("key"), F.concat(F.lit("b"), "id").alias("body"))


def test_each_input_appears_once_and_failures_end(spark, tmp_path, inputs):
    ledger = Ledger(spark, str(tmp_path), SCHEMA)
    assert [ledger.run(inputs, _convert) for _ in range(5)] == [60, 12, 6, 0, 0]
    done = ledger.outputs()
    assert done.count() == 54 == done.select("key").distinct().count()
    assert {(r["key"], r["attempt"]) for r in done.where("attempt > 1").collect()} == {(f"k{i}", 2) for i in range(5, 60, 10)}
    assert {(r["key"], r["failed"], r["last_error"]) for r in ledger.dead_letters().collect()} == {(f"k{i}", 3, "bad 3") for i in range(3, 60, 10)}
    before = sorted(map(tuple, ledger.entries().collect()))
    ledger.compact()
    assert len(ledger.manifests.runs()) == 1 and sorted(map(tuple, ledger.entries().collect())) == before
    more = inputs.unionAll(spark.createDataFrame([("k99", "b99")], inputs.schema))
    assert ledger.run(more, _convert) == 1 and len(ledger.manifests.runs()) == 2
    ledger.compact()
    assert len(ledger.manifests.runs()) == 1 and ledger.outputs().count() == 55


def test_a_run_that_dies_between_data_and_manifest(spark, tmp_path, inputs):
    class Killed(Exception):
        pass

    def kill():
        raise Killed

    ledger = Ledger(spark, str(tmp_path), SCHEMA)
    ledger.run(inputs.limit(20), _convert)
    with pytest.raises(Killed):
        ledger.run(inputs, _convert, before_commit=kill)
    assert len(list((tmp_path / "data").iterdir())) == 2 and len(ledger.manifests.runs()) == 1
    again = Ledger(spark, str(tmp_path), SCHEMA)  # a new driver
    while again.run(inputs, _convert):
        pass
    done = again.outputs()
    assert done.count() == 54 == done.select("key").distinct().count() and again.dead_letters().count() == 6


def test_empty_ledger(spark, tmp_path, inputs):
    ledger = Ledger(spark, f"{tmp_path}/none", SCHEMA)
    assert ledger.outputs().count() == ledger.dead_letters().count() == 0 and ledger.run(inputs.limit(0), _convert) == 0
    assert ledger.pending(inputs).count() == 60


def _stream(spark, df, parts, folder, seed):
    """``df`` dealt at random to ``parts`` files, one a batch."""
    rows = df.collect()
    random.Random(seed).shuffle(rows)
    for k in range(parts):
        part = rows[k::parts]
        if part:
            spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_any_split_into_batches(spark, tmp_path, parts):
    r = random.Random(parts)
    data = [(r.randrange(12) or None, o, r.choice(["x", "y", None, "z"])) for o in r.sample(range(1000), 120)]
    df = spark.createDataFrame(data, "k int, o int, text string")
    src = _stream(spark, df, parts, f"{tmp_path}/a", parts)
    dedup.log_changes(dedup.first_rows(src, "k", "o"), f"{tmp_path}/log", f"{tmp_path}/ck")
    got = dedup.table_of(spark, f"{tmp_path}/log", "k", "o").select(*df.columns).collect()
    assert sorted(map(str, got)) == sorted(map(str, J.keep_first(df, "k", "o").collect()))
    dedup.log_changes(dedup.first_texts(src, "text", "o"), f"{tmp_path}/log2", f"{tmp_path}/ck2")
    got = {(x["o"], x["k"]) for x in dedup.table_of(spark, f"{tmp_path}/log2", "digest", "o").collect()}
    assert got == {(x["o"], x["k"]) for x in J.dedup_text(df, "text", "o").collect()}


def test_a_late_smaller_order_replaces(spark, tmp_path):
    for k, row in enumerate([("a", 5, "late"), ("a", 2, "first"), ("a", 9, "no")]):
        spark.createDataFrame([row], "k string, o int, v string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        src = spark.readStream.schema("k string, o int, v string").parquet(f"{tmp_path}/in")
        dedup.log_changes(dedup.first_rows(src, "k", "o"), f"{tmp_path}/log", f"{tmp_path}/ck")  # goes on from the checkpoint
        want = [("a", 5, "late"), ("a", 2, "first"), ("a", 2, "first")][k]
        assert [tuple(x) for x in dedup.table_of(spark, f"{tmp_path}/log", "k", "o").collect()] == [want]
