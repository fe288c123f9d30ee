"""Batches of bounded tokens and entities with places in the document."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import infer as INF


def test_no_batch_passes_the_budget():
    rng, calls = random.Random(1), []

    def predict(texts):
        calls.append([len(t) for t in texts])
        return [[t] for t in texts]

    work, got = INF.Batches(predict, 50), []
    texts = ["x" * rng.randint(0, 50) for _ in range(300)]
    for i, t in enumerate(texts):
        got += work.add(i, t, len(t))
    got += work.end()
    assert got == [(i, [t]) for i, t in enumerate(texts)] and work.end() == []
    assert all(max(c) * len(c) <= 50 for c in calls) and work.seen == [max(c) * len(c) for c in calls]
    with pytest.raises(ValueError):
        work.add(1, "x" * 51, 51)


@pytest.fixture
def docs(spark):
    rng = random.Random(3)
    words = ["Consensus", "mechanism", "Ledgers", "a", "Überweisung", "(Identifier)", "x_Y", "42", "Protocol's"]
    rows = [(i, "  " * (i % 3) + " ".join(rng.choices(words, k=rng.randrange(40))) + "\n" * (i % 2)) for i in range(60)] + [(98, None), (99, " \n")]
    return spark.createDataFrame(rows, "id int, t string")


def test_entities_have_places_in_the_document(spark, docs):
    want = {r["id"]: INF.capitalised_entities(7)(0)([r["t"]])[0] for r in docs.where("trim(t) <> ''").collect()}
    seen = []
    for window, budget, parts in ((7, 30, 1), (7, 500, 4), (512, 8192, 17)):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        got = {r["id"]: r for r in INF.document_entities(docs, "id", "t", INF.capitalised_entities(7), window, budget).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        texts = {r["id"]: r["t"] for r in docs.collect()}
        assert set(got) == {i for i, t in texts.items() if (t or "").strip()}
        for i, r in got.items():
            assert all(texts[i][p["start"]:p["end"]] == p["word"] for p in r["predictions"])
            assert [(p["start"], p["end"], p["word"]) for p in r["predictions"]] == [(p["start"], p["end"], p["word"]) for p in want[i]]
        seen.append({i: r["num_preds"] for i, r in got.items()})
    assert seen[0] == seen[1] == seen[2]


def test_windows_give_back_the_text(spark, docs):
    w = INF.placed_windows(docs, "id", "t", 5).join(docs, "id")
    assert w.where(F.expr("substring(t, start + 1, length(chunk_text))") != F.col("chunk_text")).count() == 0 and w.count() > 100
    with pytest.raises(Exception, match="more than the budget"):
        INF.document_entities(docs, "id", "t", INF.capitalised_entities(7), 512, 3).collect()
