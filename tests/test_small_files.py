"""Many small files of mixed headers: every line becomes a row or a quarantined row."""

import json
import random

from corpusloom.sources.smallfiles import parse_csv, parse_json, read_small_files
from corpusloom.sources.schemas import STANDARD_POST_COLUMNS as POSTS


def test_ten_thousand_files_in_few_tasks(spark, tmp_path):
    rng, lines, bad = random.Random(1), 0, 0
    heads = ["created_at,user_name,tweet", "Date,Time,Content,extra", "datetime,FULL_TEXT", "id,size"]
    for k in range(10_000):
        folder = tmp_path / f"d{k % 7}"
        folder.mkdir(exist_ok=True)
        head = heads[k % 4] if k % 50 else heads[3]
        rows = []
        for j in range(rng.randint(0, 4)):
            n = head.count(",") + 1 + (rng.random() < 0.1)
            rows.append(",".join(f'"v{j} ""q"", x"' if i == 2 else f"v{k}-{j}" for i in range(n)))
            bad += (n != head.count(",") + 1) or head == heads[3]
        lines += len(rows)
        bad += head == heads[3]  # the header itself is a bad line then
        lines += head == heads[3]
        (folder / f"f{k}.csv").write_text("\n".join([head, *rows]) + "\n")
    good, quarantine = read_small_files(spark, str(tmp_path), "*.csv", merge_date_time=True)
    assert good.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    assert (good.count(), quarantine.count()) == (lines - bad, bad)
    assert good.columns == ["timestamp", "username", "tweet", "file", "line"]
    assert good.where("tweet not like '%\"q\", x'").where("username is not null").count() == 0
    assert {r["reason"].split(" ", 1)[-1] for r in quarantine.select("reason").distinct().collect()} == {
        "known column in the header", "fields instead of 3", "fields instead of 4", "fields instead of 2"}


def test_quotes_and_line_ends():
    text = 'tweet,user\r\n"two\r\nlines, one field",a\r\n"never closed,b\r\nplain,c\r\n"say ""hi""",d\r\n\r\nx"y,e\r\n"a"b,f\r\nlone\r\n'
    rows = list(parse_csv(text, POSTS))
    assert [(r["line"], r.get("tweet"), r.get("username"), r.get("reason", "").split(" (")[0]) for r in rows] == [
        (2, "two\r\nlines, one field", "a", ""), (4, None, None, "unclosed quote"), (5, "plain", "c", ""), (6, 'say "hi"', "d", ""),
        (8, None, None, "unclosed quote"), (9, None, None, "malformed quotes"), (10, None, None, "1 fields instead of 2")]


def test_json_documents_and_lines():
    assert [r["tweet"] for r in parse_json('[{"text": "a"}, {"content": 5}]', POSTS)] == ["a", "5"]
    assert list(parse_json('{"created_at": "d", "tweet": null, "x": [1]}', POSTS)) == [{"timestamp": "d", "tweet": None, "line": 1}]
    rows = list(parse_json('{"tweet": "a"}\n\n[1]\n{"tweet"\n{"z": 1}\n', POSTS))
    assert [(r["line"], r.get("tweet"), r.get("reason", "").split(" (")[0]) for r in rows] == [
        (1, "a", ""), (3, None, "no object"), (4, None, "no JSON"), (5, None, "no known field")]


def test_bad_files(spark, tmp_path):
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "blank.json").write_bytes(b" \n")
    (tmp_path / "latin.csv").write_bytes("tweet\nok\nété\n".encode("latin-1"))
    (tmp_path / "bom.csv").write_bytes("﻿tweet,time,date\na,t,d\n".encode())
    (tmp_path / "o.json").write_text(json.dumps({"date": "d", "time": "t", "message": "m"}))
    good, bad = read_small_files(spark, str(tmp_path), merge_date_time=True)
    assert sorted((r["timestamp"], r["tweet"], r["line"]) for r in good.collect()) == [("d t", "a", 2), ("d t", "m", 1)]
    assert sorted((r["file"].rsplit("/")[-1], r["line"], r["reason"]) for r in bad.collect()) == [
        ("blank.json", 0, "empty file"), ("latin.csv", 3, "no UTF-8")]  # Spark's file source lists no file of zero bytes
    none = tmp_path / "none"
    none.mkdir()
    assert [x.count() for x in read_small_files(spark, str(none))] == [0, 0]
