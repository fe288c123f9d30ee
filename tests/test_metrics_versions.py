"""Entity metrics by one fold, vocabulary versions, sketches, calendar gaps and text aliases."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import evaluate as EV
from corpusloom.operators import shape as SH
from corpusloom.operators import sketches as SK
from corpusloom.operators import trends as TR
from corpusloom.operators import vocabulary as V
from corpusloom.streaming.vocabulary import VocabularyTable


def _spans(tags, strict):
    """(first, last, type) of the spans of a tag list, token by token."""
    spans, prev, base = [], None, None
    for i, t in enumerate(tags):
        kind = t.split("-")[-1]
        if not t.startswith("I-"):
            base = t
        if strict:
            begins, inside = t.startswith("B-"), t.startswith("B-") or (t.startswith("I-") and base is not None and base == "B-" + kind)
        else:
            begins = t.startswith("B-") or (t.startswith("I-") and (prev in (None, "O") or prev.split("-")[-1] != kind))
            inside = t != "O"
        if begins:
            spans.append([i, i, kind])
        elif inside:
            spans[-1][1] = i
        prev = t
    return {tuple(s) for s in spans}


def test_span_counts_equal_a_walk(spark):
    rng, rows = random.Random(4), []
    for d in range(400):
        n = rng.randrange(9)
        gold = rng.choices(["O", "B-A", "I-A", "B-B", "I-B"], k=n)
        pred = [g if rng.random() < 0.7 else rng.choice(["O", "B-A", "I-A", "I-B"]) for g in gold]
        rows.append((d, [{"pred": p, "gold": g} for p, g in zip(pred, gold)]))
    df = spark.createDataFrame(rows, "d int, t array<struct<pred:string,gold:string>>")
    for r in df.select("d", EV.span_counts(F.col("t")).alias("c")).collect():
        tags = rows[r["d"]][1]
        assert (r["c"]["n_tokens"], r["c"]["n_correct"]) == (len(tags), sum(t["pred"] == t["gold"] for t in tags))
        for mode in ("strict", "lenient"):
            g, p = (_spans([t[k] for t in tags], mode == "strict") for k in ("gold", "pred"))
            assert (r["c"][f"{mode}_gold"], r["c"][f"{mode}_pred"], r["c"][f"{mode}_both"]) == (len(g), len(p), len(g & p)), (mode, tags)
    whole = EV.span_metrics(df.select(EV.span_counts(F.col("t")).alias("c"))).first()
    rows_ = df.select(F.col("d").alias("doc"), F.posexplode("t").alias("pos", "x")).select("doc", "pos", "x.*")
    assert EV.span_report_rows(rows_).first() == whole
    assert EV.span_report_rows(rows_.limit(0)).first()["n_tokens"] == 0


def test_span_report_without_a_shuffle_by_document(spark):
    df = spark.createDataFrame([(1, [0, 1], [0, 1])], "doc int, p array<int>, g array<int>")
    plan = EV.span_report(df, "doc", "p", "g", ["O", "B-A"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Window" not in plan and "Generate" not in plan


@pytest.fixture(scope="module")
def corpora(spark):
    r = random.Random(2)
    words = ["alpha", "Beta", "gamma!", "delta7", "x", "längst", "beta"]
    rows = [(r.choice(["a", "b", None]), i, " ".join(r.choices(words, k=r.randrange(6)))) for i in range(90)] + [("b", 900, None), ("c", 901, "")]
    return spark.createDataFrame(rows, "corpus string, doc_id int, text string").cache()


def test_versions_equal_the_whole(spark, tmp_path, corpora):
    vocab = spark.createDataFrame([("alpha",), ("beta",), ("two words",), ("längst",)], "term string")
    table = VocabularyTable(spark, str(tmp_path), vocab)
    for k in range(3):
        assert table.add(corpora.where(F.col("doc_id") % 3 == k)) == k + 1
    table.remove(corpora.where("doc_id % 10 = 0"))
    left = corpora.where("doc_id % 10 <> 0")

    def same(got, want):
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))

    for _ in range(2):
        same(table.vocab_stats(), V.vocab_stats(left))
        same(table.keyword_density(), V.keyword_density(left, vocab))
        pairs = spark.createDataFrame([("a", "b")], "corpus_a string, corpus_b string")
        same(table.js_distance(pairs), V.js_distance(V.token_table(left), pairs))
        same(table.vocab_stats(3), V.vocab_stats(corpora))
        same(table.vocab_stats(1), V.vocab_stats(corpora.where("doc_id % 3 = 0")))
        table.compact()
    # what died before its manifest does not count
    name, path = table.manifests.new()
    table._counts(corpora).write.parquet(path)
    same(table.vocab_stats(), V.vocab_stats(left))
    table.remove(left)
    assert table.counts().count() == 0 and table.vocab_stats().count() == 0


def test_sketches_merge(spark):
    df = spark.range(60_000).select((F.col("id") % 2).alias("g"), (F.col("id") % 7).alias("part"), (F.col("id") % 20_011).alias("v"))
    parts = SK.part_sketches(df, "v", ["g"], "part")
    whole = SK.part_sketches(df.withColumn("part", F.lit(0)), "v", ["g"], "part")

    def counts(s):
        return {r["g"]: r["approx_distinct"] for r in SK.estimated(SK.merged(s, ["g"])).collect()}

    assert counts(parts) == counts(whole) == counts(parts.unionAll(parts))
    assert all(abs(n - 20_011) <= 4 * SK.relative_error() * 20_011 for n in counts(parts).values())


def test_period_gaps(spark):
    df = spark.createDataFrame([(201801,), (201802,), (201806,), (201901,), (201901,), (None,)], "period int")
    got = TR.period_gaps(df, TR.month_index("period")).orderBy("before").collect()
    assert [(r["after"] - r["before"], r["missing"]) for r in got] == [(4, 3), (7, 6)]
    assert TR.period_gaps(df.limit(0), TR.month_index("period")).count() == 0


def test_calendar_lags_skip_missing_periods(spark):
    a = spark.createDataFrame([(p, float(v)) for p, v in [(1, 1), (2, 5), (3, 2), (7, 9), (8, 4), (9, 7)]], "p int, x double")
    b = a.select("p", (F.col("x") * 2).alias("y"))
    got = {r["lag"]: r["n"] for r in TR.lagged_spearman(a, b, "p", "x", "y", 2, F.col("p")).collect()}
    assert got == {-2: 2, -1: 4, 0: 6, 1: 4, 2: 2}


def test_text_alias_goes_and_comes_back(spark):
    df = spark.createDataFrame([("a", "b", 1)], "sentence string, code string, n int")
    work, old = SH.with_text_column(df)
    assert old == "sentence" and work.columns == ["text", "code", "n"] and SH.restore_text_column(work, old).columns == df.columns
    clash = spark.createDataFrame([("a", "b")], "tweet string, text string")
    work, old = SH.with_text_column(clash, ["tweet", "text"])
    assert work.first().asDict() == {"text": "a", "_text": "b"} and SH.restore_text_column(work, old).first().asDict() == {"tweet": "a", "text": "b"}
    with pytest.raises(ValueError):
        SH.with_text_column(spark.range(1))
