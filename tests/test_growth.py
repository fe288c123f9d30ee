"""Steps whose time or memory must not grow faster than their input."""

import itertools
import os
import random

from pyspark.sql import functions as F

from corpusloom.functions.arrays import list_sizes
from corpusloom.operators import evaluate as EV
from corpusloom.operators import infer as INF
from corpusloom.operators import lang as LG
from corpusloom.plans import files as PF
from corpusloom.session import ensure_checkpoint_dir
from corpusloom.sources import derived
from corpusloom.sources import files as FS
from corpusloom.streaming.vocabulary import VocabularyTable


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_vocabulary_needs_no_python(spark):
    v = derived.vocabulary(spark.range(1).select(F.lit("Ledgers of a consensus").alias("text")))
    assert "RDD" not in optimized(v) and {r["term"] for r in v.collect()} == {"ledgers", "consensus", "two words", "UPPER", "hy-phen"}


def test_a_delta_tokenises_once(spark, tmp_path):
    docs = spark.createDataFrame([("a", 1, "The ledgers, ledgers consensus"), ("a", 2, "none here"), ("b", 3, None), (None, 4, "Ledgers! -")],
                                 "corpus string, doc_id int, text string")
    vocab = spark.createDataFrame([("ledgers",), ("consensus",), ("two words",)], "term string")
    counts = VocabularyTable(spark, str(tmp_path / "v"), vocab)._counts(docs)
    assert optimized(counts).count("regexp_extract_all(") == 1
    got = {(r["kind"], r["corpus"], r["token"]): r["cnt"] for r in counts.where("kind <> 'token'").collect()}
    assert got == {("keyword", "a", "ledgers"): 2, ("keyword", "a", "consensus"): 1, ("keyword", None, "ledgers"): 1, ("hit document", "a", ""): 1,
                   ("hit document", None, ""): 1, ("document", "a", ""): 2, ("document", "b", ""): 1, ("document", None, ""): 1,
                   ("words", "a", ""): 6, ("words", "b", ""): 0, ("words", None, ""): 2}


def spans(tags, mode):
    """Spans (start, last token, type) of one side by a walk over its tags."""
    out, start, prev, base = [], None, None, None
    for k, tag in enumerate(tags):
        kind = tag.rsplit("-", 1)[-1]
        i = tag.startswith("I-")
        base = base if i else tag
        begins = tag.startswith("B-") or mode == "lenient" and i and (prev in (None, "O") or prev.rsplit("-", 1)[-1] != kind)
        if begins or not i:
            start = None
        if begins:
            out.append([k, k, kind])
            start = out[-1]
        elif start and i and (mode == "lenient" or base and base.startswith("B-") and base.rsplit("-", 1)[-1] == kind):
            start[1] = k
        prev = tag
    return {tuple(x) for x in out}


def test_span_counts_without_a_fold(spark):
    rng, names = random.Random(4), ["O", "B-X", "I-X", "B-Y", "I-Y"]
    rows = [(d, [tuple(rng.choices(names, k=2)) if rng.random() < 0.4 else (x, x) for x in rng.choices(names, k=rng.randrange(30))]) for d in range(400)]
    df = spark.createDataFrame(rows + [(400, None), (401, [("B-X", None), ("I-X", "I-X")])], "d int, t array<struct<pred:string,gold:string>>")
    r = df.select("d", EV.span_counts(F.col("t")).alias("c"))
    assert "lambda" not in optimized(r)
    got = {x["d"]: x["c"] for x in r.collect()}
    for d, tags in rows:
        want = [len(tags), sum(p == g for p, g in tags)]
        for mode in ("strict", "lenient"):
            p, g = (spans([t[k] for t in tags], mode) for k in (0, 1))
            want += [len(g), len(p), len(g & p)]
        assert list(got[d]) == want, (tags, got[d], want)
    assert got[400] is None and got[401]["n_tokens"] == 2 and got[401]["strict_gold"] is None and got[401]["strict_pred"] == 1


def test_micro_batches_do_not_grow_with_the_table(spark, tmp_path):
    pages = spark.range(0, 160, 1, 80).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<p>page "), "id", F.lit("</p>")).alias("html"))
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    here = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(here))
    got = {r["page_id"]: r["text_md5"] for r in PF.converted_pages(spark, str(tmp_path)).collect()}
    assert len(got) == 160 and sum(v is None for v in got.values()) == 13
    (folder,) = [x for x in os.listdir(here) if x.startswith("pages-") and x not in before]
    assert len([x for x in os.listdir(f"{here}/{folder}/out") if x.startswith("batch=")]) <= 8


def test_profiles_come_from_distinct_words(spark):
    texts = ["Le chat  noir a\nmangé le chat", "a b c", "", None, " x ", "\U0001f600 ab \U0001f600", "word"]
    df = spark.createDataFrame([("fr" if i % 2 else "en", t) for i, t in enumerate(texts)], "lang string, text string")
    plain = df.select("lang", LG.gram_text("text").alias("g")).select("lang", F.explode(LG.char_ngrams("g")).alias("gram")).groupBy("lang", "gram").count()
    units = df.select("lang", LG.gram_text("text").alias("g")).select("lang", F.explode(LG.word_units("g")).alias("u"))
    got = units.select("lang", F.explode(LG.char_ngrams("u")).alias("gram")).groupBy("lang", "gram").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect())) and got.count() > 20
    assert units.count() == 15
    assert "_c" in optimized(LG.train_profiles(df))


def test_small_files_share_tasks(spark, tmp_path):
    for i in range(200):
        (tmp_path / f"k={i}").mkdir()
        (tmp_path / f"k={i}" / "part-x.txt").write_text(f"text {i}\nmore")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(4 << 20))
    try:
        t = FS.read_text_tree(spark, str(tmp_path), "*.txt", ".txt")
        assert t.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism < 200
        assert {(r["subdir"], r["text"]) for r in t.collect()} == {(f"k={i}", f"text {i}\nmore") for i in range(200)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_pages_share_folders_and_no_text_is_shuffled(spark, tmp_path):
    import glob
    import hashlib

    texts = [(i, f"page {i}\nßé" if i % 7 else None) for i in [*range(-1500, 1500), 10**15]]
    again = [(5, "second"), (5, "third"), (None, "nothing"), (1024, "page 1024\nßé")]
    here = ensure_checkpoint_dir(spark).removeprefix("file:")
    for k, rows in enumerate((texts, texts + again)):
        (tmp_path / str(k)).mkdir()
        spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / str(k) / "pages.parquet"))
        before = set(glob.glob(f"{here}/tree-*"))
        got = {r["page_id"]: r for r in PF.text_tree_scan(spark, str(tmp_path / str(k))).collect()}
        (folder,) = set(glob.glob(f"{here}/tree-*")) - before
        assert len(os.listdir(folder)) == 5 + k and len(glob.glob(f"{folder}/*/*")) == len(got) == 3001 + k
        assert not glob.glob(f"{folder}/**/.*", recursive=True)  # no checksum beside each file
        want = {}
        for i, t in rows:
            want.setdefault(i, []).append((t or "") + "\n")
        for i, parts in want.items():
            r = got[i]
            assert r["has_key"] and r["n_chars"] == sum(map(len, parts))
            assert r["text_md5"] in {hashlib.md5("".join(x).encode()).hexdigest() for x in itertools.permutations(parts)}


def test_windows_tokenise_once_and_move_no_text(spark):
    df = spark.createDataFrame([(1, "a b c")], "id int, t string")
    assert optimized(INF.placed_windows(df, "id", "t", 2)).count("regexp_extract_all(") == 1
    r = INF.document_entities(df, "id", "t", INF.capitalised_entities(7), 512, 8192)
    assert "RepartitionByExpression" not in optimized(r)


def test_list_sizes_of_null_lists():
    import pyarrow as pa

    assert list_sizes(pa.array([[1, 2], None, []], pa.list_(pa.int32()))).tolist() == [2, 0, 0]
