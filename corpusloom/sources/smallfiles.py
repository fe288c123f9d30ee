"""Very many small files as one table (S-01..S-08, S-17).

Spark's file source lists the tree, also on storage that only Spark reads, and
its partitions are put together until each task has enough bytes to read.  Each task parses its files whole
in Arrow batches: a CSV file with the header it has, JSON lines, or a JSON
document.  Columns are mapped to standard names file by file, so files with
different headers make one table without a union per header.

Nothing is dropped: what cannot be parsed is a row of the same table with the
file, the line, the raw text and a reason.  Files of zero bytes have no rows.
"""

from __future__ import annotations

import csv
import io
import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.shape import resolve_synonyms
from corpusloom.sources.schemas import STANDARD_POST_COLUMNS

#: What opening a file counts for, in bytes, when files are dealt to tasks.
OPEN_COST = 16 << 10
#: Physical lines that one quoted record may span.
SPAN = 1000
META = ["file", "line", "reason", "raw"]


def _lines(text: str) -> list[str]:
    """Lines that end at line feeds and carriage returns only."""
    return io.StringIO(text, newline="").readlines()


def _post(record: dict, mapping: dict[str, str], merge_date_time: bool) -> dict:
    out = {std: None if record.get(raw) is None else str(record[raw]) for raw, std in mapping.items()}
    if merge_date_time:
        low = {k.lower(): k for k in record}
        if "date" in low and "time" in low:
            out["timestamp"] = " ".join(str(record[low[k]]) for k in ("date", "time") if record[low[k]] is not None)
        elif "datetime" in low:
            out["timestamp"] = record[low["datetime"]]
    return out


def _record(lines: list[str], at: int) -> tuple[int, str, list[str] | None, str | None]:
    """(end, raw, fields, reason) of the CSV record that begins at line ``at``;
    it goes on over line ends inside quotes."""
    raw, end = lines[at], at + 1
    while raw.count('"') % 2 and end < len(lines) and end - at < SPAN:
        raw, end = raw + lines[end], end + 1
    raw = raw.rstrip("\r\n")
    if raw.count('"') % 2:
        return end, raw, None, "unclosed quote"
    try:
        return end, raw, next(csv.reader(io.StringIO(raw, newline=""), strict=True), []), None
    except csv.Error as e:
        return end, raw, None, f"malformed quotes ({e})"


def parse_csv(text: str, variants: dict, merge_date_time: bool = False) -> Iterator[dict]:
    """Rows of a CSV text by its header; blank lines are skipped.  Where a
    record of several lines makes no row its quote was never closed: only its
    first line is bad, and reading goes on with the next one."""
    lines, at, header, mapping = _lines(text), 0, None, {}
    while at < len(lines):
        end, raw, fields, reason = _record(lines, at)
        line, at = at + 1, end
        if not raw.strip():
            continue
        if reason is None and header is None:
            header, mapping = fields, resolve_synonyms(fields, variants)
            if mapping:
                continue
        if reason is None and mapping and len(fields) != len(header):
            reason = f"{len(fields)} fields instead of {len(header)}"
        if reason and end > line:
            raw, reason, at = lines[line - 1].rstrip("\r\n"), "unclosed quote", line
        elif not reason and not mapping:
            reason = "no known column in the header"
        if reason:
            yield {"line": line, "raw": raw, "reason": reason}
        else:
            yield _post({k: v if v != "" else None for k, v in zip(header, fields)}, mapping, merge_date_time) | {"line": line}


def parse_json(text: str, variants: dict, merge_date_time: bool = False) -> Iterator[dict]:
    """A JSON document (an object, or a list of them) or one object a line."""
    try:
        whole = json.loads(text)
        records = [(1, x, None) for x in (whole if isinstance(whole, list) else [whole])]
    except ValueError:
        records = []
        for k, line in enumerate(_lines(text), 1):
            if line.strip():
                try:
                    records.append((k, json.loads(line), None))
                except ValueError as e:
                    records.append((k, line.rstrip("\r\n"), f"no JSON ({e.args[0].split(':')[0]})"))
    for k, record, reason in records:
        if reason is None and not isinstance(record, dict):
            reason, record = "no object", json.dumps(record)
        if reason is None:
            mapping = resolve_synonyms(list(record), variants)
            if mapping:
                yield _post(record, mapping, merge_date_time) | {"line": k}
                continue
            reason, record = "no known field", json.dumps(record)
        yield {"line": k, "raw": record, "reason": reason}


def parse_file(name: str, data: bytes, variants: dict, merge_date_time: bool, kind: str | None = None) -> Iterator[dict]:
    if not data.strip():
        yield {"line": 0, "reason": "empty file"}
        return
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError as e:
        yield {"line": data[:e.start].count(b"\n") + 1, "raw": data.decode("utf-8", "replace"), "reason": "no UTF-8"}
        return
    kind = kind or ("json" if name.lower().endswith((".json", ".jsonl", ".ndjson")) else "csv")
    yield from (parse_json if kind == "json" else parse_csv)(text, variants, merge_date_time)


def read_small_files(spark: SparkSession, path: str, glob: str = "*", variants: dict[str, list[str]] = STANDARD_POST_COLUMNS,
                     merge_date_time: bool = False, kind: str | None = None,
                     partition_bytes: int = 64 << 20) -> tuple[DataFrame, DataFrame]:
    """S-01..S-08 + S-17: (good, quarantine) of all files below ``path``.

    Good rows have the standard columns of ``variants`` as text (missing ones
    NULL), ``file`` and ``line``; quarantined rows have ``file``, ``line`` (0 for
    a whole file), ``reason`` and ``raw``.  ``kind`` (csv or json) stands for the
    files' extensions.  Files go to tasks by size, about
    ``partition_bytes`` each.  For files that fit in memory; larger ones are for
    ``read_csv``, which splits them."""
    cols = list(variants)
    schema = pa.schema([(c, pa.string()) for c in cols] + [("file", pa.string()), ("line", pa.int64()), ("reason", pa.string()), ("raw", pa.string())])
    ddl = ", ".join(f"`{c}` string" for c in cols) + ", file string, line long, reason string, raw string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows += [r | {"file": name} for r in parse_file(name, data.as_py() or b"", variants, merge_date_time, kind)]
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema)

    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path))
    size = files.agg(F.count("*").alias("n"), F.sum("length").alias("bytes")).first()  # from the listing alone
    tasks = math.ceil(((size["bytes"] or 0) + size["n"] * OPEN_COST) / partition_bytes)
    files = files.select("path", "content").coalesce(max(tasks, min(size["n"], spark.sparkContext.defaultParallelism), 1))
    parsed = files.mapInArrow(run, ddl)
    return (parsed.where("reason is null").select(*cols, "file", "line"), parsed.where("reason is not null").select(*META))
