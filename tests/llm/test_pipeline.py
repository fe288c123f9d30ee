"""The pipeline against plain Python over a small table, and the registered
queries against their SQL."""

import os
import re

import duckdb
import pytest

import corpus_pipeline
from corpusloom.llm import bpe, queries, warc
from corpusloom.llm.common import save, shared_dir

SF = "/root/testdata/sf0.001"


LONG = "a line of more than sixty-four characters in which two of them may differ, no more than that"
NEAR = ["Subscribe to our newsletter!\nshort", "Subscribe to our newsletter\nShort", "  Subscribe to our newsletters!\nshort ", "Subscribe now to our newsletter",
        LONG, LONG.replace("two", "tow"), LONG.replace("sixty-four", "sixty-nine"), LONG.replace("line", "lime") + "\nown line here", LONG[::-1],
        "twelve chars\ntwelve Chars", "page 12 of 30 in all", "page 13 of 31 in all"]


@pytest.fixture(scope="module")
def stages(spark):
    folder, df = shared_dir(spark, "t"), spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(10**6, None, None, "src0", 0), (10**6 + 1, "12 %%", "en", "src1", 5)]
    extra += [(2 * 10**6 + i, t, "en", "src1", len(t)) for i, t in enumerate(NEAR)]
    df = df.unionAll(spark.createDataFrame(extra, df.schema))
    out = [df]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(df := save(stage(spark, df, SF), f"{folder}/{k}"))
    return out


def test_stages_keep_the_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(s.dtypes == stages[0].dtypes for s in stages[1:-1])


def test_language_stage_keeps_clean_documents(stages):
    gone = {r["doc_id"] for r in stages[0].collect()} - {r["doc_id"] for r in stages[1].collect()}
    assert gone == {10**6, 10**6 + 1}


def edits(a, b, most):
    """Whether two strings are within ``most`` edits, by the whole table."""
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        if min(row) > most:
            return False
    return row[-1] <= most


def test_line_stage(stages):
    """Every pair of distinct lines compared by the whole edit table; the first line of a class stays."""
    docs, white = sorted(stages[1].collect(), key=lambda r: r["doc_id"]), " \t\n\x0b\x0c\r"
    lines = sorted({x.strip(white) for r in docs for x in r["text"].split("\n")} - {""}, key=len)
    label = {x: x for x in lines}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(lines):
        if len(a) >= 8:
            most = 2 if len(a) >= 64 else 1
            for b in lines[i + 1:]:
                if len(b) - len(a) > most:
                    break
                # two strings within two edits share a third of themselves: a quick way past the table
                third = len(a) // 3
                if (a[:third] in b or a[third:2 * third] in b or a[2 * third:] in b) and edits(a, b, most):
                    label[root(b)] = root(a)
    seen, want = set(), {}
    for r in docs:
        left = []
        for x in r["text"].split("\n"):
            if (bare := x.strip(white)) == "" or root(bare) not in seen:
                left.append(x)
            if bare:
                seen.add(root(bare))
        if any(x.strip(white) for x in left):
            want[r["doc_id"]] = "\n".join(left)
    got = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    assert got == want
    near = {i: got.get(2 * 10**6 + i) for i in range(len(NEAR))}
    assert (near[1], near[5], near[7], near[9], near[11]) == ("Short", None, "own line here", "twelve chars", "page 13 of 31 in all") and near[6]


def test_ngram_stage(stages):
    rows = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    sets = {i: {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} for i, t in rows.items() if (w := re.findall(r"[^\x20\x09-\x0D]+", t.lower()))}
    label, ids = {i: i for i in rows}, sorted(sets)
    for _ in range(5):
        for a in ids:
            for b in ids:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[b] = min(label[a], label[b])
    assert {r["doc_id"] for r in stages[3].collect()} == {i for i in rows if label[i] == i}


def test_last_stages(spark, stages):
    assert sorted(r["doc_id"] for r in stages[4].collect()) == sorted(r["doc_id"] for r in stages[3].collect())
    encode = bpe.text_encoder(queries.tokenizer("word_bpe_49k.json"))
    counts = {r["doc_id"]: r["n_tokens"] for r in stages[5].collect()}
    assert counts == {r["doc_id"]: encode(r["text"])[0] for r in stages[4].collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    want = con.execute(queries.ORACLE_SQL[name])
    cols = sorted(c[0] for c in want.description)
    at = [[c[0] for c in want.description].index(c) for c in cols]
    rows = sorted((tuple(r[k] for k in at) for r in want.fetchall()), key=str)
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == cols
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=str) == rows


def test_pages_are_digested_once_a_scan(spark):
    records = warc.page_records(spark.read.parquet(f"{SF}/pages.parquet"))
    plan = warc.record_roles(records)._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("sha1(") <= plan.count("Relation [") and "sha1(" not in "".join(re.findall(r"Filter .*", plan))
