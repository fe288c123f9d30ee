"""Removal of long repeated byte strings by merging shard Burrows-Wheeler
transforms.

*Where to look.*  Of every window of ``length`` bytes the gram with the least
hash is its anchor, so equal windows have equal anchors at equal places.  A
piece is the text of a run of windows with one anchor: its windows partition
those of the document.  An anchor that occurs once has no repeated window.
Equal pieces count as one with copies.

*What repeats.*  The different pieces of an anchor come to one task, which packs
them into shards and sorts the suffixes of each shard once.  The shards'
transforms are then merged: the interleave, which says whose suffix comes next,
is refined by reading the blocks of bytes before the suffixes in its order and
sorting stably by them, so each round orders the suffixes by one more block.  The
round in which two neighbours part gives their common prefix; intervals whose
common prefixes reach ``length`` repeat.  No suffix is sorted twice, and a
merge only moves shard numbers.

An anchor with more different pieces than a merge may hold is dealt out window by
window instead: equal windows meet by their digest, in any number of tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrays import Rolling, U64, random_values, row_chunks, runs
from corpusloom.llm.common import save, shared_dir

LENGTH, GRAM = 200, 64
#: Different pieces of one anchor that a merge may hold.
GROUP = 8192
#: Symbols of a shard and of a merge (passed only by the last group in it).
SHARD, MERGE = 1 << 15, 1 << 17
POSITION = 24
BLOCK_TEXT = 1 << 23
VALUES = random_values(256, 11)


# --- pieces -------------------------------------------------------------------

def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        x, span = np.minimum(x[:-span], x[span:]), 2 * span
    return np.minimum(x[:len(x) - (width - span)], x[width - span:]) if span < width else x


def anchored_runs(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, end, anchor hash) of the runs of window starts with one anchor,
    the leftmost gram with the least hash.  ``data`` has fewer than 2^24 bytes."""
    at = np.arange(len(data) - gram + 1)
    h = Rolling(data, VALUES)(at, at + gram)
    low = U64((1 << POSITION) - 1)
    anchor = (sliding_min((h & ~low) | at.astype(U64), length - gram + 1) & low).astype(np.int64)
    cut = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
    first = np.concatenate([[0], cut])
    return first, np.concatenate([cut, [len(anchor)]]), h[anchor[first]]


def _columns(parts: list[tuple]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 4


def occurrences(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """``anchor``, ``piece`` (digest), ``tid`` and ``at`` (start * 2^16 + windows) of every piece of ``tid``, ``body``."""
    for batch in batches:
        body = batch.column("body").cast(pa.large_binary())
        off = np.frombuffer(body.buffers()[1], np.int64)[body.offset:body.offset + len(body) + 1]
        data = np.frombuffer(body.buffers()[2] or b"", np.uint8)
        tids = batch.column("tid").to_numpy()
        for row, end in row_chunks(off):
            parts = []
            for begin in range(int(off[row]), int(off[end]), BLOCK_TEXT):
                stop = min(int(off[end]), begin + BLOCK_TEXT + length - 1)
                if stop - begin >= length:
                    parts.append(_block(data[begin:stop], off[row:end + 1] - begin, tids[row:end], length, gram))
            cols = _columns(parts)
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == U64 else c, pa.int64()) for c in cols],
                                             ["anchor", "piece", "tid", "at"])


def _block(data: np.ndarray, off: np.ndarray, tids: np.ndarray, length: int, gram: int) -> tuple:
    """The pieces of the rows at ``off`` (may reach beyond ``data``) that start in its first ``BLOCK_TEXT`` bytes."""
    first, end, h = anchored_runs(data, length, gram)
    # cut the runs at the ends of rows: a window lies in one row
    last = np.minimum(off[1:] - length + 1, len(data) - length + 1)  # end of each row's window starts
    row_a = np.searchsorted(off, first, "right") - 1
    row_b = np.searchsorted(off, end - 1, "right") - 1
    n = row_b - row_a + 1
    which = np.repeat(np.arange(len(first)), n)
    row = np.repeat(row_a, n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    a, b = np.maximum(first[which], off[row]), np.minimum(end[which], last[row])
    keep = b > a
    a, b, row, h = a[keep], b[keep], row[keep], h[which[keep]]
    view = memoryview(data)
    piece = np.fromiter((xxhash.xxh3_64_intdigest(view[i:j]) for i, j in zip(a.tolist(), (b + length - 1).tolist())), U64, len(a))
    return h, piece, tids[row], (a - off[row]) << 16 | (b - a)


# --- shard transforms and their merge -----------------------------------------

class Shard:
    """Sorted suffixes of some texts.  A text ends in a terminator below all
    bytes; equal suffixes are ordered by their text."""

    def __init__(self, texts: list[bytes]):
        lens = np.array([len(t) + 1 for t in texts])
        self.start = np.cumsum(lens) - lens
        n = int(lens.sum())
        self.symbols = np.zeros(n, U64)
        inside = np.ones(n, bool)
        inside[self.start + lens - 1] = False
        self.symbols[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(U64) + U64(1)
        #: Symbols that a refinement round adds: what fills a 64-bit key (the byte 255, foreign to UTF-8, needs a ninth bit).
        self.bits = 9 if n and self.symbols.max() > 255 else 8
        self.block_size = 64 // self.bits
        self.left = np.repeat(self.start + lens - 1, lens) - np.arange(n)  # symbols before the terminator
        self.offset = np.arange(n) - np.repeat(self.start, lens)
        self.order = self._sort()

    def block(self, size: int, bits: int) -> np.ndarray:
        """The next ``size`` symbols from each position as one number, zeros behind the terminator."""
        n, out = len(self.symbols), self.symbols
        for j in range(1, size):
            nxt = np.zeros(n, U64)
            if j < n:
                nxt[:n - j] = np.where(self.left[:n - j] >= j, self.symbols[j:], U64(0))
            out = out << U64(bits) | nxt
        return out

    def _sort(self) -> np.ndarray:
        n, depth = len(self.symbols), self.block_size
        half = max(1, n.bit_length())
        key = self.block(depth, self.bits)
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
        where, low = np.arange(n), (1 << half) - 1
        while depth <= self.left.max() and rank.max() < n - 1:
            more = np.zeros(n, np.int64)
            ok = self.left >= depth
            more[ok] = rank[where[ok] + depth] + 1
            # rank, rank of what follows, place: three numbers of at most 21 bits, or a plain sort
            if 3 * half + 1 <= 64:
                packed = (rank.astype(U64) << U64(2 * half + 1)) | (more.astype(U64) << U64(half)) | where.astype(U64)
                packed.sort()
                order = (packed & U64(low)).astype(np.int64)
            else:
                order = np.lexsort((where, more, rank))
            a, b = rank[order], more[order]
            rank[order] = np.cumsum(np.concatenate([[0], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            depth *= 2
        return order


def merge(shards: list[Shard], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interleave of the shards' suffixes by their first ``length`` symbols.

    Returns, in merged order, the shard of each suffix, its place in that
    shard's order, and the symbols (in whole rounds, ``length`` at most) that it
    shares with the suffix before it."""
    n, block = sum(len(s.order) for s in shards), min(s.block_size for s in shards)
    who = np.repeat(np.arange(len(shards), dtype=np.int32 if len(shards) > 255 else np.uint8), [len(s.order) for s in shards])
    common, edge, depth = np.full(n, length, np.int32), np.zeros(n, bool), 0
    common[:1], edge[:1] = 0, True
    sizes = ([length % block] if length % block else []) + [block] * (length // block)
    rules = {size: _rule(shards, size) for size in set(sizes)}
    read, rank, at = np.empty(n, np.int32), np.empty(n, U64), np.arange(n, dtype=U64)
    follow, low = np.empty(n, np.int32), U64(0xFFFFFFFF)
    for size in sizes:
        before, ends, ends_who = rules[size]
        read[np.argsort(who, kind="stable")] = before  # the block before each suffix, -1 if its text begins there
        has = read >= 0
        rank[:len(ends)], rank[len(ends):] = ends, read[has]
        follow[:len(ends)], follow[len(ends):] = -1, np.cumsum(edge, dtype=np.int32)[has]
        who = np.concatenate([ends_who, who[has]])
        packed = rank << U64(32) | at
        packed.sort()
        order = (packed & low).astype(np.int64)
        who, after, packed = who[order], follow[order], packed >> U64(32)
        part = (packed[1:] != packed[:-1]) | (after[1:] != after[:-1])
        new = np.flatnonzero(part & ~edge[1:]) + 1
        common[new], edge[new] = depth, True
        depth += size
    place = np.argsort(who, kind="stable")
    rank = np.empty(n, np.int64)
    rank[place] = np.concatenate([np.arange(len(s.order)) for s in shards])
    return who, rank, common


def _rule(shards: list[Shard], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a round of ``size`` symbols reads: per suffix in shard order the rank
    of the block before it (-1 for none), and ranks and shards of the suffixes
    that end within a block, in their order."""
    bits = max(s.bits for s in shards)
    keys = [s.block(size, bits) for s in shards]
    _, rank = np.unique(np.concatenate(keys), return_inverse=True)
    before, ends, at = [], [], 0
    for k, s in enumerate(shards):
        mine = rank[at:at + len(s.order)].astype(np.int32)
        at += len(s.order)
        whole = s.offset[s.order] >= size
        before.append(np.where(whole, mine[np.where(whole, s.order - size, 0)], np.int32(-1)))
        short = s.order[s.left[s.order] < size]
        ends.append(np.stack([mine[short], np.full(len(short), k, np.int32)]))
    ends = np.concatenate(ends, 1)
    ends = ends[:, np.argsort(ends[0], kind="stable")]
    return np.concatenate(before), ends[0], ends[1].astype(np.int32 if len(shards) > 255 else np.uint8)


def repeated_windows(texts: list[bytes], length: int, shard: int = SHARD) -> list[np.ndarray]:
    """For each text, which of its windows of ``length`` bytes occur anywhere else in ``texts``."""
    shards, held, size = [], [], 0
    for k, t in enumerate(texts):
        held.append(t)
        size += len(t) + 1
        if size >= shard or k == len(texts) - 1:
            shards.append(Shard(held))
            held, size = [], 0
    who, rank, common = merge(shards, length)
    again = common >= length
    again[:-1] |= common[1:] >= length
    out = []
    for k, s in enumerate(shards):
        flag = np.zeros(len(s.order), bool)
        mine = who == k
        flag[s.order[rank[mine]]] = again[mine]
        flag &= s.left >= length  # shorter suffixes are no windows
        out += np.split(flag, s.start[1:])
    return out


def solve(batches: Iterator[pa.RecordBatch], length: int, shard: int, size: int) -> Iterator[pa.RecordBatch]:
    """``anchor``, ``piece`` and the runs of repeated windows (``first``,
    ``end``) of pieces sorted by anchor."""
    names = ["anchor", "piece", "first", "end"]
    held, symbols = [], 0

    def flush() -> pa.RecordBatch:
        flags = repeated_windows([t for _, _, t in held], length, shard)
        lens = np.array([len(f) for f in flags])
        starts = np.cumsum(lens) - lens
        a, b = runs(np.concatenate(flags), starts)
        row = np.searchsorted(starts, a, "right") - 1
        ids = np.array([(g, p) for g, p, _ in held], np.int64)
        cols = [ids[row, 0], ids[row, 1], a - starts[row], b - starts[row]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    for batch in batches:
        for g, p, body in zip(*(batch.column(c).to_pylist() for c in ("anchor", "piece", "body"))):
            if symbols >= size and held[-1][0] != g:
                yield flush()
                held, symbols = [], 0
            held.append((g, p, body))
            symbols += len(body) + 1
    if held:
        yield flush()


def window_digests(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """``anchor``, ``piece``, window ``first`` and its 128-bit digest (``w1``, ``w2``)."""
    for batch in batches:
        for g, p, body in zip(*(batch.column(c).to_pylist() for c in ("anchor", "piece", "body"))):
            view, n = memoryview(body), len(body) - length + 1
            d = np.frombuffer(b"".join(xxhash.xxh3_128_digest(view[i:i + length]) for i in range(n)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, g)), pa.array(np.full(n, p)), pa.array(np.arange(n)), pa.array(d[:, 0]),
                                              pa.array(d[:, 1])], ["anchor", "piece", "first", "w1", "w2"])


# --- documents ------------------------------------------------------------------

def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, shard: int = SHARD,
                   merge_size: int = MERGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``body`` (its text in UTF-8) and
    ``found``, the spans (``start``, ``end``; they may overlap, null for none) of
    bytes in strings of ``length`` bytes that occur again anywhere.

    Null texts are empty.  Texts below ``length`` bytes have no spans.  Ids
    may be null or repeat: every row is a document of its own, and equal rows
    repeat each other.  An empty table gives no rows; other columns are ignored."""
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession, "suffixes")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = docs.select(F.monotonically_increasing_id().alias("tid"), F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.encode(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), "UTF-8").alias("body"))
    name = f"corpusloom_bodies_{uuid.uuid4().hex}"
    (held.repartition(n, "tid").write.bucketBy(n, "tid").sortBy("tid").option("path", f"{folder}/bodies")
     .option("compression", "zstd").saveAsTable(name))
    bodies = spark.table(name)

    seen = "anchor long, piece long, tid long, at long"
    found = save(bodies.select("tid", "body").mapInArrow(partial(occurrences, length=length, gram=gram), seen), f"{folder}/occurrences")
    # saved, as are the runs below: a join with a saved table can split a hot key
    often = save(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), f"{folder}/often")
    found = save(found.join(often, "anchor"), f"{folder}/again")
    pieces = save(found.groupBy("anchor", "piece").agg(F.count("*").alias("copies"), F.min(F.struct("tid", "at")).alias("one"))
                  .select("anchor", "piece", "copies", "one.*"), f"{folder}/pieces")
    groups = pieces.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    wanted = pieces.join(groups, "anchor").groupBy("tid").agg(F.collect_list(F.struct("anchor", "piece", "kinds", "at")).alias("asked"))
    # a document's pieces hold at most about five times its text
    cut = F.transform("asked", lambda x: F.struct(
        x["anchor"].alias("anchor"), x["piece"].alias("piece"), x["kinds"].alias("kinds"),
        F.substring(F.col("body"), (F.shiftright(x["at"], 16) + 1).cast("int"),
                    (x["at"].bitwiseAND(F.lit(0xFFFF)) + (length - 1)).cast("int")).alias("body")))
    texts = save(bodies.select("tid", "body").join(wanted, "tid").select(F.explode(cut).alias("e")).select("e.*"), f"{folder}/texts")

    runs_of = "anchor long, piece long, first long, end long"
    merged = (texts.where(F.col("kinds") <= group).select("anchor", "piece", "body").repartition(n, "anchor")
              .sortWithinPartitions("anchor", "piece").mapInArrow(partial(solve, length=length, shard=shard, size=merge_size), runs_of))
    windows = texts.where(F.col("kinds") > group).select("anchor", "piece", "body").mapInArrow(
        partial(window_digests, length=length), "anchor long, piece long, first long, w1 long, w2 long")
    twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    single = windows.join(twice, ["w1", "w2"]).select("anchor", "piece", "first", (F.col("first") + 1).alias("end"))
    spots = save(merged.unionAll(single), f"{folder}/runs").join(
        pieces.where("copies = 1").select("anchor", "piece"), ["anchor", "piece"], "left_semi")
    # pieces with copies repeat as a whole
    windows_of = F.col("at").bitwiseAND(F.lit(0xFFFF))
    whole = pieces.where("copies > 1").select("anchor", "piece", F.lit(0).cast("long").alias("first"), windows_of.alias("end"))
    start = F.shiftright("at", 16)
    spans = (found.join(save(whole.unionAll(spots), f"{folder}/windows"), ["anchor", "piece"])
             .select("tid", F.struct((start + F.col("first")).alias("start"), (start + F.col("end") + (length - 1)).alias("end")).alias("span")))
    spans = save(spans.groupBy("tid").agg(F.collect_list("span").alias("found")), f"{folder}/spans")
    out = bodies.join(spans, "tid", "left").select("doc_id", "body", "found")
    spark.sql(f"DROP TABLE {name}")  # its files stay
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``spans`` (maximal removed runs,
    ``start`` and ``end`` in bytes) and ``kept`` (the other bytes joined) of every
    row of ``docs``; see ``repeated_spans``."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(span)),
                        ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, found = batch.column("body").to_pylist(), batch.column("found")
            off = found.offsets.to_numpy()
            start, end = (found.values.field(k).to_numpy() for k in (0, 1))
            row = np.repeat(np.arange(len(bodies)), np.diff(off))
            start, end = start[off[0]:off[-1]], end[off[0]:off[-1]]
            order = np.lexsort((start, row))
            row, start, end = row[order], start[order], end[order]
            # found spans come from runs of windows apart from each other: their ends rise with their starts
            head = np.ones(len(row), bool)
            head[1:] = (row[1:] != row[:-1]) | (start[1:] > end[:-1])
            tail = np.append(head[1:], True)[:len(head)]
            row, start, end = row[head], start[head], end[tail]
            first = np.searchsorted(row, np.arange(len(bodies) + 1))
            kept, pairs = list(bodies), np.stack([start, end], 1)
            for k in np.unique(row).tolist():
                edges = [0, *pairs[first[k]:first[k + 1]].ravel().tolist(), len(bodies[k])]
                kept[k] = b"".join([bodies[k][i:j] for i, j in zip(edges[::2], edges[1::2])])
            spans = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays([start, end], ["start", "end"]))
            size, left = (np.array([len(b) for b in x], np.int64) for x in (bodies, kept))
            cols = [batch.column("doc_id"), pa.array(size), pa.array(size - left), spans, pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)

    return repeated_spans(docs, length, **options).mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")
