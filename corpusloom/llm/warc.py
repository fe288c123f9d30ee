"""Deterministic sharded WARC writer and reader.

Records are dealt to shards by ranges of their id (bounds from an exact
histogram, so equal input gives equal shards on any cluster), sorted inside a
shard, and written as one gzip member each into files that roll at a
compressed size.  Headers, record ids and digests are made anew from the
payload.  Files get their final name by a rename, and a manifest row per file
names what belongs to the archive; readers start from the manifest, so the
remains of lost tasks are never read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import AtomicFile, arrow_schema, filesystem, save, shared_dir, with_shards

#: Fixed, so that equal input gives equal bytes.
WARC_DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Pages by digest (hexadecimal), and per page and digest the record that a copy refers to.
RECORDS = "page_id long, digest string, url string, payload binary"
ROLES = "page_id long, digest string, payload_bytes long, refers_to long, refers_url string"
MANIFEST = "shard long, seq int, path string, n_records long, n_bytes long, sha256 string"
READ = ("page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, "
        "refers_to long, file string, offset long")


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def hex_to_32(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _uri(url, page_id) -> str:
    """``url`` without the control characters that would end a header line."""
    if url is None:
        return f"urn:page:{page_id}"
    return "".join(c if c > " " and c != "\x7f" else "%%%02X" % ord(c) for c in url)


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def response_record(page_id, url, payload: bytes, n_bytes: int, refers_to, refers_url, digest: str) -> bytes:
    """A response record, or a revisit one (without payload) when
    ``refers_to`` names the page that holds the same payload.  The HTTP head
    of a revisit keeps the length of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)),
               ("WARC-Date", WARC_DATE), ("WARC-Target-URI", _uri(url, page_id)),
               ("WARC-Payload-Digest", "sha1:" + digest), ("WARC-Block-Digest", "sha1:" + digest32(block))]
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)),
                    ("WARC-Refers-To-Target-URI", _uri(refers_url, refers_to)), ("WARC-Refers-To-Date", WARC_DATE),
                    ("X-Refers-To-Page", str(refers_to))]
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    headers.append(("Content-Type", "application/http; msgtype=response"))
    return _record(headers, block)


def _member(data: bytes) -> bytes:
    """One gzip member without time and name."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class ShardWriter:
    """Writes the records of one shard into files ``name-shard-seq.warc.gz``
    and rolls before a file would pass ``max_bytes`` (a single larger record
    gets a file of its own)."""

    def __init__(self, folder: str, shard: int, max_bytes: int):
        self.folder, self.shard, self.max_bytes, self.seq, self.out, self.done = folder, shard, max_bytes, 0, None, []

    def _open(self) -> None:
        name = f"part-{self.shard:08d}-{self.seq:05d}.warc.gz"
        self.out, self.sha, self.n = AtomicFile(f"{self.folder}/{name}"), hashlib.sha256(), 0
        info = b"software: corpusloom\r\nformat: WARC File Format 1.1\r\n"
        self._put(_member(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(f"file:{name}")),
                                   ("WARC-Date", WARC_DATE), ("WARC-Filename", name),
                                   ("Content-Type", "application/warc-fields")], info)))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)

    def add(self, record: bytes) -> None:
        data = _member(record)
        if self.out and self.n and self.out.size + len(data) > self.max_bytes:
            self.close()
        if not self.out:
            self._open()
        self._put(data)
        self.n += 1

    def close(self) -> None:
        if self.out:
            self.out.commit()
            self.done.append((self.shard, self.seq, self.out.path, self.n, self.out.size, self.sha.hexdigest()))
            self.out, self.seq = None, self.seq + 1


def write_archives(records: DataFrame, roles: DataFrame, folder: str, max_bytes: int = 64 << 20,
                   shard_bytes: int = 32 << 20) -> DataFrame:
    """Write ``records`` (``RECORDS``) as WARC files below ``folder``, copies
    as revisits according to ``roles`` (``ROLES``, one row per page and
    digest); returns the saved manifest, one row per file.

    Payloads are shuffled once: a role travels beside its record and sorts
    before it."""
    schema = arrow_schema(records.sparkSession.createDataFrame([], MANIFEST).schema)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, role = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["role"]:
                    role = row
                    continue
                if (row["page_id"], row["digest"]) != (role["page_id"], role["digest"]):
                    raise ValueError(f"page {row['page_id']} has no role")
                if writer is None or writer.shard != row["_shard"]:
                    if writer:
                        writer.close()
                        yield rows(writer.done)
                    writer = ShardWriter(folder, row["_shard"], max_bytes)
                writer.add(response_record(row["page_id"], row["url"], row["payload"], role["payload_bytes"], role["refers_to"],
                                           role["refers_url"], hex_to_32(row["digest"])))
        if writer:
            writer.close()
            yield rows(writer.done)

    def rows(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    none = F.lit(None)
    sent = records.select("page_id", "digest", F.lit(False).alias("role"), "url", "payload", none.cast("long").alias("payload_bytes"),
                          none.cast("long").alias("refers_to"), none.cast("string").alias("refers_url"))
    sent = sent.unionAll(roles.select("page_id", "digest", F.lit(True), none.cast("string"), none.cast("binary"), "payload_bytes",
                                      "refers_to", "refers_url"))
    dealt = with_shards(sent, "page_id", F.col("payload_bytes") + 1024, shard_bytes, roles)
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = dealt.repartition(n, "_shard").sortWithinPartitions("_shard", "page_id", "digest", F.desc("role"), "url")
    return save(placed.mapInArrow(write, MANIFEST), f"{folder}/manifest")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The page records of the files that ``manifest`` names (schema
    ``READ``).  Block digests are checked.  A revisit has no payload of its
    own: its ``payload`` is null, its length and digest are those of the full
    payload it refers to."""
    schema = arrow_schema(manifest.sparkSession.createDataFrame([], READ).schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                chunk, held = [], 0
                for row in parse_file(path):
                    chunk.append(row if payloads else row[:2] + (None,) + row[3:])
                    held += len(row[2] or b"") if payloads else 200
                    if held > 4 << 20:
                        yield pack(chunk)
                        chunk, held = [], 0
                if chunk:
                    yield pack(chunk)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(n, "path").mapInArrow(read, READ)


def parse_file(path: str) -> Iterator[tuple]:
    """Rows of ``READ`` from one archive."""
    store, p = filesystem(path)
    with store.open_input_file(p) as raw, gzip.GzipFile(fileobj=raw) as f:
        name, offset = os.path.basename(p), 0
        while version := f.readline():
            if version.strip() != b"WARC/1.1":
                raise ValueError(f"{path}: no WARC record at {offset}")
            head, taken = {}, len(version)
            while (line := f.readline()) not in (b"\r\n", b""):
                taken += len(line)
                k, _, v = line.decode().partition(":")
                head[k.lower()] = v.strip()
            block = f.read(size := int(head["content-length"]))
            if len(block) < size or f.read(4) != b"\r\n\r\n":
                raise ValueError(f"{path}: cut short at {offset}")
            here, offset = offset, offset + taken + 2 + size + 4
            if head["warc-type"] == "warcinfo":
                continue
            if head["warc-block-digest"] != "sha1:" + digest32(block):
                raise ValueError(f"{path}: wrong block digest at {here}")
            http, _, payload = block.partition(b"\r\n\r\n")
            length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
            revisit = head["warc-type"] == "revisit"
            digest = head["warc-payload-digest"].removeprefix("sha1:")
            if not revisit and (len(payload) != length or digest32(payload) != digest):
                raise ValueError(f"{path}: wrong payload at {here}")
            page = head.get("x-page-id")
            ref = head.get("x-refers-to-page")
            yield (None if page is None else int(page), head["warc-target-uri"], None if revisit else payload, length,
                   digest, head["warc-type"], None if ref is None else int(ref), name, here)


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``RECORDS`` of ``pages``; null html is an empty payload."""
    payload = F.encode(F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")), "UTF-8")
    base = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                        payload.alias("payload"))
    # a digest that cannot be null: joins on it push no null test, and with it no second digest, to the scan
    return base.withColumn("digest", F.coalesce(F.sha1("payload"), F.lit("")))


def record_roles(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``ROLES`` of ``records``: of equal payloads of at least ``min_bytes``
    bytes the one with the smallest id keeps its payload, the others name it
    in ``refers_to``.  Only ids and digests are shuffled; copies meet as one
    row per map task, and a digest of very many pages is spread by the
    skew-join rule."""
    narrow = (records.select("page_id", "digest", "url", F.octet_length("payload").cast("long").alias("payload_bytes"))
              .groupBy("page_id", "digest", "payload_bytes").agg(F.min("url").alias("url")))
    first = (narrow.where(F.col("page_id").isNotNull() & (F.col("payload_bytes") >= min_bytes)).groupBy("digest", "payload_bytes")
             .agg(F.min("page_id").alias("first_id"), F.min_by("url", "page_id").alias("first_url")))
    other = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return narrow.join(first, ["digest", "payload_bytes"], "left").select(
        "page_id", "digest", "payload_bytes", F.when(other, F.col("first_id")).alias("refers_to"),
        F.when(other, F.col("first_url")).alias("refers_url"))


def archive_pages(pages: DataFrame, folder: str | None = None, max_bytes: int = 64 << 20,
                  min_bytes: int = 0) -> DataFrame:
    """Write every row of ``pages`` (``page_id``, ``url``, ``html``) as a WARC
    record and return what the archives hold (``READ``).

    Null html is an empty payload.  A null id is written without page header
    and never is the response of a group that has an id; rows that repeat the
    smallest id of a group are all responses.  A null url becomes
    ``urn:page:<id>``; control characters in a url are percent-encoded.  An
    empty table gives no archives; other columns are ignored."""
    folder = folder or shared_dir(pages.sparkSession, "warc")
    records = page_records(pages)
    roles = save(record_roles(records, min_bytes), f"{folder}/roles")
    return read_archives(write_archives(records, roles, folder, max_bytes))
