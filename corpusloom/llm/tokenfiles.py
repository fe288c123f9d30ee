"""Token-id files: flat unsigned integers, 64-bit document offsets, prefix sums.

Documents are dealt to shards by ranges of their id.  Each shard is written
as ``.bin`` (token ids, two bytes each when the vocabulary fits, else four,
little-endian), ``.idx`` (int64 start of each document in the shard, and the
end) and ``.ids`` (int64 document ids).  A manifest row per shard counts its
tokens; the global base of a shard is the prefix sum over the manifest.
Readers map the files into memory.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import AtomicFile, TwoGenerations, arrow_schema, filesystem, local_path, save, shared_dir, with_shards

MANIFEST = "shard long, path string, n_docs long, n_tokens long, width int, has_ids boolean"
READ = "doc_id long, start long, n_tokens long, ids array<int>"
DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"
CACHE = 600_000
#: A space or line feed that does not stand alone.
ADJACENT = ("  ", " \n", "\n ", "\n\n")


class CachedEncoder:
    """Ids of whole texts as a byte-level tokenizer of the ``tokenizers``
    library gives them.

    Its pre-tokens are encoded independently.  None spans the border between
    a word and a single space or line feed after it, so a text in which these
    stand alone is cut before each, and each distinct part goes to the library
    once (a bounded store).  Other texts go to the library whole."""

    def __init__(self, path: str, dtype: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.library, self.code = Tokenizer.from_file(path), {"<u2": "H", "<u4": "I"}[dtype]
        spec = json.loads(self.library.to_str())
        if spec["normalizer"] or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError(f"{path}: not a plain byte-level tokenizer")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.known, self.stops = TwoGenerations(CACHE), {}

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special) or any(s in text for s in ADJACENT):
            return self._whole(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        if not first or first[-1].isspace():
            return self._whole(text)
        parts = self.known.lookup(rest, self._parts)
        return self._whole(first) + b"".join(parts) if all(parts) else self._whole(text)

    def _parts(self, new: list[str]) -> list[bytes]:
        """Ids of parts that follow a space or begin with a line feed; empty
        for those with white space at a border.  Letters and the stops after
        them are pre-tokens of their own, so their results are joined if
        known."""
        out, ask, stops = dict.fromkeys(new, b""), [], self.stops
        for p in new:
            word = p[1:] if p[:1] == "\n" else p
            if not word or word[0].isspace() or word[-1].isspace():
                continue
            letters = word.rstrip(".,")
            if letters != word and letters.isalpha() and max(letters) < "\u0250" and (head := self.known.new.get(p[:len(p) - len(word) + len(letters)])):
                tail = word[len(letters):]
                if tail not in stops:
                    if len(stops) > 1000:
                        stops.clear()
                    stops[tail] = self._whole(tail)
                out[p] = head + stops[tail]
            else:
                ask.append(p)
        given = [p if p[0] == "\n" else " " + p for p in ask]
        for p, e in zip(ask, self.library.encode_batch_fast(given, add_special_tokens=False)):
            out[p] = array(self.code, e.ids).tobytes()
        return list(out.values())

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()


_ENCODERS: dict[tuple, CachedEncoder] = {}


def cached_encoder(path: str, dtype: str) -> CachedEncoder:
    """The encoder of this Python worker; its store outlives a task."""
    if (path, dtype) not in _ENCODERS:
        _ENCODERS[path, dtype] = CachedEncoder(path, dtype)
    return _ENCODERS[path, dtype]


def write_tokens(docs: DataFrame, folder: str, encoder: Callable[[], Callable[[str], bytes]], end_id: int, width: int,
                 shard_bytes: int = 8 << 20) -> DataFrame:
    """Write ``docs`` (``doc_id`` long, ``text`` string) in ascending id order;
    ``encoder`` is called once per task and makes a text's ids as little-endian
    integers of ``width`` bytes.  Returns the saved manifest with the prefix
    sum ``base`` of each shard."""
    dtype = {2: "<u2", 4: "<u4"}[width]
    schema = arrow_schema(docs.sparkSession.createDataFrame([], MANIFEST).schema)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, shard, out = encoder(), np.array([end_id], dtype).tobytes(), None, None

        def close() -> pa.RecordBatch:
            out.commit()
            name = f"{folder}/shard-{shard:010d}"
            for suffix, data in ((".idx", starts), (".ids", ids)):
                f = AtomicFile(name + suffix)
                f.write(np.array(data, "<i8").tobytes())
                f.commit()
            row = (shard, name, len(ids), starts[-1], width, known)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            shards, docs_, texts = (batch.column(c) for c in ("_shard", "doc_id", "text"))
            for s, doc, text in zip(shards.to_pylist(), docs_.to_pylist(), texts):
                text = text.as_py()
                if s != shard or (doc is not None) != known:
                    if out:
                        yield close()
                    shard, known, starts, ids = s, doc is not None, [0], []
                    out = AtomicFile(f"{folder}/shard-{s:010d}.bin")
                data = encode(text or "") + end
                out.write(data)
                starts.append(starts[-1] + len(data) // width)
                ids.append(doc if known else -1)
        if out:
            yield close()

    # null ids come first, in a shard of their own
    sized = with_shards(docs.where("doc_id is not null"), "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)) + 8, shard_bytes)
    loose = docs.where("doc_id is null").withColumn("_shard", F.lit(-1).cast("long"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = ["_shard", "doc_id", "text"]
    placed = sized.select(cols).unionAll(loose.select(cols)).repartition(n, "_shard").sortWithinPartitions(*cols)
    manifest = save(placed.mapInArrow(write, MANIFEST), f"{folder}/manifest")
    # one row per file of shard_bytes: the prefix sum over the manifest is narrow
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def mapped(path: str, dtype: str) -> np.ndarray:
    """The integers of a file: memory-mapped on mounted storage, else read."""
    if (p := local_path(path)) is not None:
        with open(p, "rb") as f:
            empty = not f.read(1)
        return np.empty(0, dtype) if empty else np.memmap(p, dtype, "r")
    store, p = filesystem(path)
    with store.open_input_file(p) as f:
        return np.frombuffer(f.read(), dtype)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(doc_id, global start, ids) of every document of the listed shards."""
    for batch in batches:
        for row in batch.to_pylist():
            tokens = mapped(row["path"] + ".bin", f"<u{row['width']}")
            starts, ids = mapped(row["path"] + ".idx", "<i8"), mapped(row["path"] + ".ids", "<i8")
            for k in range(row["n_docs"]):
                yield int(ids[k]) if row["has_ids"] else None, row["base"] + int(starts[k]), tokens[starts[k]:starts[k + 1]]


def _read(manifest: DataFrame, schema: str, row: Callable) -> DataFrame:
    target = arrow_schema(manifest.sparkSession.createDataFrame([], schema).schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def pack() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), target)], schema=target)

        for doc, start, ids in _documents(batches):
            held.append(row(doc, start, ids))
            size += 64 + 4 * len(ids) * (schema is READ)
            if size > 4 << 20:
                yield pack()
                held, size = [], 0
        if held:
            yield pack()

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(n, "shard").mapInArrow(read, schema)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """``READ``: every document with its global start and its ids."""
    return _read(manifest, READ, lambda doc, start, ids: (doc, start, len(ids), ids.astype(np.int32)))


def read_digests(manifest: DataFrame) -> DataFrame:
    """``DIGEST``: like ``read_tokens`` with a checksum in place of the ids."""
    return _read(manifest, DIGEST, lambda doc, start, ids: (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2, folder: str | None = None,
                id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 8 << 20) -> DataFrame:
    """Encode every whole text with the tokenizer file, append ``end_id``,
    write the token files and return their manifest.

    Null and empty texts hold only the end id.  Rows with a null id are
    written first, in a shard of their own; repeated ids follow each other in
    text order.  Empty input writes no shard; other columns are ignored."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    top = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True) - 1, end_id)
    width = 2 if top < 1 << 16 else 4
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return write_tokens(base, folder or shared_dir(spark, "tokens"),
                        lambda: cached_encoder(tokenizer_path, f"<u{width}"), end_id, width, shard_bytes)
