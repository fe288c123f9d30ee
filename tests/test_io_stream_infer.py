"""Files (IN-10), incremental streaming and batch inference."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from corpusloom.operators import infer as INF
from corpusloom.operators.shape import normalise_records
from corpusloom.sources import files as IO
from corpusloom.sources.schemas import PAPER_METADATA
from corpusloom.streaming.incremental import convert_pages
from tests.conftest import SF_SMALL


def _tmp():
    return tempfile.mkdtemp(prefix="corpusloom-test-")


def test_json_records_quarantine_and_normalise(spark):
    root = _tmp()
    recs = [{"paperId": f"p{i}", "title": f"T{i}", "year": 2000 + i,
             "publicationVenue": None if i % 2 else {"id": "v", "name": "Venue"},
             "fieldsOfStudy": None if i % 3 == 0 else ["CS"]} for i in range(6)]
    for r in recs:
        with open(os.path.join(root, r["paperId"] + ".json"), "w") as f:
            json.dump(r, f)
    open(os.path.join(root, "empty.json"), "w").close()
    with open(os.path.join(root, "broken.json"), "w") as f:
        f.write('{"paperId": "bad", "title": ')
    good, bad = IO.read_json_records(spark, root, PAPER_METADATA)
    assert good.count() == 6
    assert bad.count() == 1 and bad.first()._source_file.endswith("broken.json")
    n = normalise_records(good)
    rows = {r.paperId: r for r in n.collect()}
    assert rows["p1"].publicationVenue is not None and rows["p1"].publicationVenue.name is None
    assert rows["p0"].fieldsOfStudy == [] and rows["p2"].fieldsOfStudy == ["CS"]


def test_text_tree_and_pending(spark):
    root = _tmp()
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "source").limit(20).collect()
    for d in docs:
        sub = os.path.join(root, "a" if d.doc_id % 2 else "b")
        os.makedirs(sub, exist_ok=True)
        with open(os.path.join(sub, f"{d.doc_id}.md"), "w", encoding="utf-8") as f:
            f.write(d.text)
    t = IO.read_text_tree(spark, root)
    got = {int(r.key): (r.subdir, r.text) for r in t.collect()}
    assert got == {d.doc_id: ("a" if d.doc_id % 2 else "b", d.text) for d in docs}
    done = t.where(F.col("subdir") == "a").select("key")
    assert IO.pending_inputs(t, done, "key").count() == sum(1 for d in docs if d.doc_id % 2 == 0)


def test_csv_header_probe_and_tolerant_read(spark):
    root = _tmp()
    with open(os.path.join(root, "x.csv"), "w") as f:
        f.write('created_at,User_Name,tweet\n2020-01-01,ann,"hello\nworld"\n2020-01-02,bob,plain\n')
    assert IO.header_probe(spark, root) == ["created_at", "User_Name", "tweet"]
    good, bad = IO.read_csv(spark, root, multi_line=True)
    rows = sorted(r.tweet for r in good.collect())
    assert rows == ["hello\nworld", "plain"]


def test_incremental_conversion_is_resumable(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    src, out, quar, ck = _tmp(), _tmp(), _tmp(), _tmp()
    pages.where(F.col("page_id") < 10).write.mode("append").parquet(src)
    convert_pages(spark, src, out, quar, checkpoint=ck)
    first = spark.read.parquet(out).count()
    assert first == pages.where(F.col("page_id") < 10).count()
    pages.where(F.col("page_id") >= 10).write.mode("append").parquet(src)
    convert_pages(spark, src, out, quar, checkpoint=ck)  # only the new files
    total = spark.read.parquet(out)
    assert total.count() == pages.count()
    assert total.select("page_id").distinct().count() == pages.count()


def test_write_if_absent_is_idempotent(spark):
    p = os.path.join(_tmp(), "out")
    IO.write_if_absent(spark.range(3), p)
    IO.write_if_absent(spark.range(10), p)
    assert spark.read.parquet(p).count() == 3


def test_sentiment_inference_schema_and_blank(spark):
    df = spark.createDataFrame([(1, "the and the"), (2, "of de"), (3, "   "), (4, None)], "k int, text string")
    r = {x.k: x for x in INF.sentiment_inference(df, "k", "text", INF.lexicon_sentiment(["the", "and"], ["of", "de"]))
         .collect()}
    assert r[1].sentiment_label == "bullish" and r[1].confidence_level == "medium"
    assert r[2].sentiment_label == "bearish"
    assert r[3].sentiment_label is None and r[3].confidence_level is None and r[4].sentiment_class is None


def test_entity_inference_chunks_in_order(spark):
    text = " ".join(["Ethereum validators"] * 30)
    df = spark.createDataFrame([(1, text)], "k int, text string")
    r = INF.entity_inference(df, "k", "text", INF.capitalised_entities(7), window=8).first()
    chunk_ids = [p.chunk_id for p in r.predictions]
    assert chunk_ids == sorted(chunk_ids) and chunk_ids[-1] > 0
    assert r.num_preds == 30


def test_review_files_round_trip(spark):
    """M-21 through files: review lists split at 2008 written as CSV (S-15),
    read back (S-01) with column pruning (S-02), unioned, flagged keys
    anti-joined away (J-05)."""
    from corpusloom.operators.joins import anti_by_keys
    root = _tmp()
    papers = spark.createDataFrame([(f"p{i}", 1995 + i, f"T{i}", (1 if i % 4 == 0 else None)) for i in range(30)],
                                   "paperId string, year int, title string, remove int")
    IO.write_csv(papers.where("year <= 2008").orderBy("year"), os.path.join(root, "old"), single_file=True)
    IO.write_csv(papers.where("year > 2008").orderBy("year"), os.path.join(root, "new"), single_file=True)
    schema = papers.schema
    good, bad = IO.read_csv(spark, root, schema=schema)
    decisions = good.select("paperId", "remove")
    assert bad.count() == 0 and decisions.count() == 30
    kept = anti_by_keys(papers, decisions.where("remove = 1"), "paperId")
    assert sorted(r.paperId for r in kept.collect()) == sorted(f"p{i}" for i in range(30) if i % 4)


def test_json_directory_standardised(spark):
    """S-08 + P-01..P-03: JSON-lines files with different headers read as
    one directory, mapped to (timestamp, username, tweet), missing columns
    NULL, rows from every file kept."""
    from corpusloom.operators.shape import standardise_columns, union_all
    root = _tmp()
    with open(os.path.join(root, "a.json"), "w") as f:
        f.write('{"created_at": "2021-01-01", "username": "ann", "tweet": "hi"}\n'
                '{"created_at": "2021-01-02", "username": "bob", "tweet": "yo"}\n')
    with open(os.path.join(root, "b.json"), "w") as f:
        f.write('{"date": "2022-05-05", "full_text": "hello there"}\n')
    parts = []
    for name in ("a.json", "b.json"):
        raw = spark.read.json(os.path.join(root, name))
        parts.append(standardise_columns(raw))
    rows = sorted(tuple(r) for r in union_all(parts).collect())
    assert rows == [("2021-01-01", "ann", "hi"), ("2021-01-02", "bob", "yo"), ("2022-05-05", None, "hello there")]


def test_csv_without_schema_quarantines_ragged_rows(spark):
    root = _tmp()
    with open(os.path.join(root, "a.csv"), "w") as f:
        f.write("a,b\n1,2\n3\n4,5,6\n7,8\n")
    good, bad = IO.read_csv(spark, root)
    assert sorted((r.a, r.b) for r in good.collect()) == [(1, 2), (7, 8)]
    assert bad.count() == 2


def test_prefix_and_split_keep_null_keys(spark):
    from corpusloom.operators.prefix import ordered_prefix
    from corpusloom.operators.splits import split_stratified
    rows = [(i, None if i % 4 == 0 else "ab"[i % 2]) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, label string")
    got = ordered_prefix(df, ["id"], None, partition_cols=["label"]).collect()
    assert len(got) == 100 and max(r.prefix for r in got if r.label is None) == 25
    split = split_stratified(df, "id", "label", 0.2).collect()
    assert len(split) == 100 and sum(r.split == "test" for r in split if r.label is None) == 5


def test_exact_quantiles_equal_numpy(spark):
    import numpy as np
    from corpusloom.operators.quantiles import exact_quantiles
    rng = np.random.default_rng(3)
    rows = [(None if k % 5 == 0 else k % 3, None if k % 11 == 0 else float(v)) for k, v in enumerate(rng.integers(0, 40, 500))]
    df = spark.createDataFrame(rows, "g int, v double")
    probs = {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q9": 0.9}
    for r in exact_quantiles(df, "v", probs, ["g"]).collect():
        v = [x for g, x in rows if g == r.g and x is not None]
        assert np.allclose([r[n] for n in probs], np.quantile(v, list(probs.values())))
    assert exact_quantiles(df.limit(0), "v", probs).first().q2 is None
