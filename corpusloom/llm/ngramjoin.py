"""Jaccard join of word n-gram sets by vertical partitioning.

All n-grams stand in one global order: rare ones first (a bounded histogram
of the corpus tells the heavy ones), equal ones by hash.  Documents of equal
sets form classes.  A set that links with another lacks fewer than ``p`` of
its n-grams there, so the k-th common n-gram is among its first ``p + k - 1``:
two classes can only link if their heads, the first ``p + extra(p)`` n-grams,
share ``extra + 1``.  Classes whose head shares fewer with all others are out;
n-grams shared by the other heads give the candidate pairs, and the heads of a
pair are compared first.  To verify what is left the order is cut into
fragments: each fragment holds its slice of the candidates' sets, counts the
partial overlaps of the pairs by itself, and the counts are summed per pair.

Large groups never become all pairs.  Each class is first compared with one
other.  Then each shared n-gram compares the classes outside the component of
its pivot class with that one, then with a second pivot; afterwards only pairs
whose classes are in different components are left.  Of these, sizes and the n-grams that a class has to itself rule out
what cannot link, and the rest is compared.  Classes in one component already
need no comparison, so no link between components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.arrays import U64, Rolling, mix, random_values, row_chunks, runs, text_bytes
from corpusloom.llm.common import arrow_schema, components, free_names, maybe_broadcast, save, save_counted, shared_dir

#: Buckets of the histogram behind the order: its size does not grow.
BUCKETS = 1 << 20
#: Bytes of text that a task hashes at a time.
CHUNK = 1 << 18
#: Counters by which sets are told apart before they are fetched.
COUNTERS = 128
#: Pairs that one task verifies at a time, per fragment.
BLOCK = 20_000
SPLIT = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUES = random_values(256, 7)
_VALUES[ord("A"):ord("Z") + 1] = _VALUES[ord("a"):ord("z") + 1]  # A-Z count as lower case


def _words(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end = runs(~_SPACE[data], breaks)
    return Rolling(data, _VALUES)(start, end), start


def set_keys(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """63-bit hashes of all n-grams of the rows, and the row of each.  A row
    of fewer than ``n`` words has its whole sequence as one."""
    if len(offsets) == 2 and len(data) > SPLIT:  # one very long text: in pieces that end at white space
        words, at = [], 0
        while at < len(data):
            cut = min(at + SPLIT, len(data))
            cut += int(np.argmax(np.append(_SPACE[data[cut:]], True)))
            words.append(_words(data[at:cut], np.zeros(1, np.int64))[0])
            at = cut
        hashes, row = np.concatenate(words), None
        row = np.zeros(len(hashes), np.int64)
    else:
        hashes, start = _words(data, offsets[:-1])
        row = np.searchsorted(offsets, start, "right") - 1
    count = np.bincount(row, minlength=len(offsets) - 1)
    keys, rows = [], []
    if len(hashes) >= n:
        full = row[n - 1:] == row[:len(row) - n + 1]
        h = hashes[:len(hashes) - n + 1]
        for k in range(1, n):
            h = mix(h * U64(0xA0761D6478BD642F) ^ hashes[k:len(hashes) - n + 1 + k])
        keys.append(h[full])
        rows.append(row[:len(row) - n + 1][full])
    first = np.concatenate([[0], np.cumsum(count)])
    for r in np.flatnonzero((count > 0) & (count < n)):
        h = hashes[first[r]:first[r] + 1]
        for k in range(1, count[r]):
            h = mix(h * U64(0xA0761D6478BD642F) ^ hashes[first[r] + k:first[r] + k + 1])
        keys.append(mix(h + U64(int(count[r]))))
        rows.append(np.array([r]))
    if not keys:
        return np.empty(0, U64), np.empty(0, np.int64)
    return np.concatenate(keys) >> U64(1), np.concatenate(rows)


def ordered_sets(column: pa.Array, n: int, heavy: np.ndarray) -> Iterator[np.ndarray]:
    """The n-gram set of each row as ascending positions in the global order
    (int64): the weight class of the n-gram's bucket, then its hash."""
    data, offsets = text_bytes(column)
    for a, b in row_chunks(offsets, CHUNK):
        keys, rows = set_keys(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], n)
        place = ((heavy[(keys % U64(BUCKETS)).astype(np.int64)].astype(U64) << U64(60)) | (keys >> U64(3))).astype(np.int64)
        by = np.argsort(rows, kind="stable")
        place, ends = place[by], np.cumsum(np.bincount(rows, minlength=b - a))
        for e, s in zip(ends, np.concatenate([[0], ends[:-1]])):
            yield np.unique(place[s:e])


def heavy_classes(docs: DataFrame, n: int) -> np.ndarray:
    """Weight class 0 to 7 of every bucket of n-grams.

    Each task counts all n-grams of its documents per bucket and reports the
    buckets that stand out from its mean; the reports are summed.  The table
    is fixed in size and only decides the order, which any table keeps right."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for a, b in row_chunks(offsets, CHUNK):
                keys, _ = set_keys(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], n)
                np.add.at(total, (keys % U64(BUCKETS)).astype(np.int64), 1)
        mean = total.mean()
        out = np.flatnonzero(total > mean + 4 * np.sqrt(mean) + 4)
        yield pa.RecordBatch.from_arrays([pa.array(out.astype(np.int32)), pa.array(total[out])], names=["bucket", "count"])

    rows = (docs.select("text").mapInArrow(count, "bucket int, count long").groupBy("bucket").agg(F.sum("count").alias("count"))
            .toArrow())  # at most BUCKETS rows
    heavy = np.zeros(BUCKETS, np.uint8)
    bucket, times = (rows.column(c).to_numpy() for c in ("bucket", "count"))
    heavy[bucket] = np.minimum(7, 1 + np.log2(times / 8 + 1) / 2).astype(np.uint8)
    return heavy


def pivots(fragments: int) -> np.ndarray:
    """Borders that cut the order into ``fragments`` slices: two for the heavy
    classes, the others of equal width below them."""
    light = max(1, fragments - 2)
    return np.array([(1 << 60) // light * k for k in range(1, light)] + [1 << 60, 4 << 60], np.int64)


def _signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    u = s.astype(U64)
    return (int(mix(u).sum(dtype=U64).astype(np.int64)),
            int(np.bitwise_xor.reduce(mix(u + U64(0x1F83D9ABFB41BD6B)), initial=U64(0)).astype(np.int64)))


def prefix_size(n, percent: int):
    """How many of ``n`` n-grams must be looked at to meet one of any partner."""
    return n - (percent * n + 99) // 100 + 1


def extra(p):
    """By how many n-grams a head is longer than its prefix."""
    return p * 3 // 4 + 4


#: Bits of an n-gram's place that heads keep: fewer bits only add candidates.
HEAD_BITS = 44


def _head_table(docs: DataFrame, n: int, percent: int, heavy) -> DataFrame:
    """Per document: size, 128-bit signature and head of its set, how many of
    its n-grams fall to each of ``COUNTERS`` (255 at most), and a number ``rid``
    of the row."""
    schema = "doc_id long, n int, s1 long, s2 long, head array<long>, spread array<smallint>"
    target = arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_, s1, s2, head, spread = [], [], [], [], []
            for s in ordered_sets(batch.column(1), n, heavy.value):
                n_.append(len(s))
                for out, v in zip((s1, s2), _signature(s)):
                    out.append(v)
                p = prefix_size(len(s), percent)
                head.append(np.unique(s[:p + extra(p)] >> (63 - HEAD_BITS)) if len(s) else s)
                spread.append(np.minimum(np.bincount(s & (COUNTERS - 1), minlength=COUNTERS), 255).astype(np.int16))
            cols = (n_, s1, s2, head, spread)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(cols, list(target)[1:]))], schema=target)

    return docs.select("doc_id", "text").mapInArrow(build, schema).withColumn("rid", F.monotonically_increasing_id())


def _fragments(docs: DataFrame, n: int, heavy, borders: np.ndarray) -> DataFrame:
    """``(doc_id, frag, keys)``: the slice of each document's set in each
    fragment.  ``own`` tells the set that stands for a repeated id."""
    schema = "doc_id long, frag int, keys array<long>"
    target = arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            docs_, owns = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for doc, own, s in zip(docs_, owns, ordered_sets(batch.column(1), n, heavy.value)):
                if _signature(s)[0] == own:
                    rows += [(doc, f, part) for f, part in enumerate(np.split(s, np.searchsorted(s, borders)))]
                if len(rows) > 4000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*rows), target)], schema=target)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*rows), target)], schema=target)

    return docs.select("doc_id", "text", "own").mapInArrow(build, schema)


def _overlap(sets: pa.Table, pairs: pa.Table) -> pa.Table:
    """Partial overlaps of the pairs of one block in one fragment."""
    keys = sets.column("keys").combine_chunks()
    ends, values = keys.offsets.to_numpy(), keys.values.to_numpy()
    of = {d: values[i:j] for d, i, j in zip(sets.column("doc_id").to_pylist(), ends[:-1], ends[1:])}
    got = np.array([len(np.intersect1d(of[a], of[b], assume_unique=True))
                    for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist())], np.int64)
    out = pairs.select(["a", "b", "na", "nb"]).append_column("part", pa.array(got))
    return out.filter(pa.array(got > 0))


def _least(n: Column, percent: int) -> Column:
    """Shared head n-grams that a set of ``n`` needs at least, whatever the
    size of its partner (never under ``percent`` of its own)."""
    m = F.ceil(n * percent / 100)
    p = m - F.ceil(m * percent / 100) + 1
    # equal leading bits may merge two n-grams of a head: one is left out of account
    return F.greatest(F.least(F.floor(p * 3 / 4) + 4 + 1, m) - 1, F.lit(1))


class _Verifier:
    """Links among candidate pairs, by fragments."""

    def __init__(self, sets: DataFrame, heads: DataFrame, fragments: int, percent: int, folder: str):
        self.sets, self.heads, self.fragments = sets, heads, fragments
        self.percent, self.folder, self.round = percent, folder, 0

    def links(self, pairs: DataFrame) -> tuple[DataFrame, int]:
        """``(a, b, overlap)`` of the pairs (``a``, ``b``, ``na``, ``nb``) that reach the threshold, and their number."""
        self.round += 1
        need = F.least(_least(F.col("na"), self.percent), _least(F.col("nb"), self.percent))
        alike = self._overlaps(pairs.distinct(), self.heads, 1, "heads").where(F.col("overlap") >= need)
        whole = self._overlaps(alike.drop("overlap"), self.sets, self.fragments, "sets")
        linked = whole.where(F.lit(100) * F.col("overlap") >= F.lit(self.percent) * (F.col("na") + F.col("nb") - F.col("overlap")))
        return save_counted(linked.select("a", "b", "overlap"), f"{self.folder}/links-{self.round}")

    def _overlaps(self, pairs: DataFrame, sets: DataFrame, fragments: int, name: str) -> DataFrame:
        """``pairs`` with their ``overlap`` in ``sets``, where it is not 0.

        Pairs are dealt to tiles by both of their documents, so that a
        document goes to few of them; the pairs of a document of very many are
        spread further.  A tile holds about ``BLOCK`` pairs and their sets."""
        path = f"{self.folder}/{name}-{self.round}"
        pairs, rows = save_counted(pairs, f"{path}-pairs")
        if not rows:
            return pairs.withColumn("overlap", F.lit(0).cast("long"))
        tiles = f"{path}-pairs"
        if rows > BLOCK:  # else all pairs are one tile as they are
            side = math.ceil(math.sqrt(rows / BLOCK))
            degree = pairs.groupBy("a").agg(F.count("*").alias("deg"))
            spread = F.pmod(F.xxhash64("b"), F.ceil(F.col("deg") / F.lit(BLOCK)).cast("long"))
            tile = F.xxhash64(F.pmod(F.xxhash64("a"), F.lit(side)), F.pmod(F.xxhash64("b", F.lit(1)), F.lit(side)), spread)
            tiles = f"{path}-tiles"
            pairs = save(pairs.join(degree, "a").select(tile.alias("block"), "a", "b", "na", "nb"), tiles)

        def dealt(rows: DataFrame) -> DataFrame:
            return rows if "block" in rows.columns else rows.withColumn("block", F.lit(0).cast("long"))

        placed = dealt(pairs)
        members = placed.select("block", F.col("a").alias("doc_id")).unionAll(placed.select("block", F.col("b").alias("doc_id"))).distinct()
        left = sets.join(members, "doc_id").groupBy("block", "frag")
        # read anew: both sides of a cogroup may not come from one plan
        again = dealt(pairs.sparkSession.read.schema(pairs.schema).parquet(tiles))
        right = again.withColumn("frag", F.explode(F.sequence(F.lit(0), F.lit(fragments - 1)))).groupBy("block", "frag")
        parts = left.cogroup(right).applyInArrow(_overlap, "a long, b long, na int, nb int, part long")
        return parts.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("overlap"))


def _band(n: str, percent: int) -> Column:
    """Bands of sizes such that two sizes that can link are in one or in neighbours (the ratio has a margin for rounding)."""
    return F.floor(F.log(F.col(n).cast("double")) / math.log(100 / percent * (1 + 1e-6))).cast("int")


def _unlinked(left: DataFrame, percent: int, possible) -> DataFrame:
    """Pairs (``a``, ``b``, ``na``, ``nb``) of rows with one ``key`` in different components that can still link.

    The smaller set of a link has few n-grams to itself, and the sizes lie in
    one band or in neighbours.  Two sets differ by as many n-grams at least as
    their ``spread`` does, which leaves few pairs of a group that is alike but
    not enough."""
    if percent >= 100:
        return left.select(*(F.col("doc_id").alias(x) for x in "ab"), *(F.col("n").alias("n" + x) for x in "ab")).limit(0)
    small, large = (left.select("key", F.col("doc_id").alias(x), F.col("n").alias("n" + x), F.col("alone").alias("alone" + x),
                                F.col("comp").alias("c" + x), F.col("spread").alias("spread" + x)) for x in "ab")
    small = small.where(F.lit(100) * (F.col("na") - F.col("alonea")) >= F.lit(percent) * (F.col("na") + F.col("alonea"))).withColumn(
        "band", _band("na", percent))
    large = large.withColumn("band", F.explode(F.array(_band("nb", percent), _band("nb", percent) - 1)))
    order = (F.col("na") < F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))
    apart = F.aggregate(F.zip_with("spreada", "spreadb", lambda x, y: F.abs(x - y).cast("int")), F.lit(0), lambda s, x: s + x)
    most = (F.col("na") + F.col("nb") - apart) / 2
    alike = F.lit(100) * most >= F.lit(percent) * (F.col("na") + F.col("nb") - most)
    # part of the join, so that pairs beyond it are never rows
    met = small.alias("s").join(large.alias("l"), (F.col("s.key") == F.col("l.key")) & (F.col("s.band") == F.col("l.band")) & order
                                & (F.col("ca") != F.col("cb")) & possible("a", "b") & alike)
    turned = F.col("a") > F.col("b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(turned, F.col("nb")).otherwise(F.col("na")).alias("na"),
                      F.when(turned, F.col("na")).otherwise(F.col("nb")).alias("nb"))


def jaccard_links(docs: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text",
                  fragments: int = 8) -> tuple[DataFrame, DataFrame]:
    """``(sets, links)``: per row of ``docs`` its ``doc_id``, set size ``n``
    and class (``rep``, the smallest id with an equal set); and the verified
    ``(a, b, overlap)`` between classes, enough to connect every component."""
    return _joined(docs, n, percent, id_col, text_col, fragments)[:2]


def _joined(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str, fragments: int = 8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``jaccard_links`` and the ``components`` of the links."""
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession, "ngram")
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    heavy = spark.sparkContext.broadcast(heavy_classes(base, n))
    table = save(_head_table(base, n, percent, heavy), f"{folder}/heads")
    narrow = table.select("doc_id", "n", "s1", "s2", "rid").where("n > 0 and doc_id is not null")
    # of rows that repeat an id the one with the smallest set stands for it
    own = narrow.groupBy("doc_id").agg(F.min(F.struct("n", "s1", "s2", "rid")).alias("s")).select("doc_id", "s.*")
    classes, n_classes = save_counted(own.groupBy("n", "s1", "s2").agg(F.min(F.struct("doc_id", "rid")).alias("one"))
                   .select("n", "s1", "s2", F.col("one.doc_id").alias("rep"), F.col("one.rid").alias("rid")), f"{folder}/classes")

    # one head per class
    heads = table.select("rid", "doc_id", "n", "head").join(maybe_broadcast(classes.select("rid"), 16, rows=n_classes), "rid", "left_semi")
    rows = heads.select(F.explode("head").alias("key"), "doc_id")
    # an n-gram goes with its number of heads as one long, the rarer ones first
    rank = F.shiftleft(F.least("df", F.lit((1 << (63 - HEAD_BITS)) - 1)), HEAD_BITS).bitwiseOR(F.col("key"))
    met = rows.groupBy("key").agg(F.count("*").alias("df")).where("df > 1").select("key", rank.alias("rank"))
    needed = _least(F.col("n"), percent)
    sizes = heads.select("doc_id", "n", F.size("head").alias("held"))

    def by_class(hits: DataFrame, sizes: DataFrame) -> DataFrame:
        """Classes with enough n-grams that stand in another head (at most a head each)."""
        return (hits.groupBy("doc_id").agg(F.array_distinct(F.collect_list("rank")).alias("keys")).join(sizes, "doc_id")
                .where(F.size("keys") >= needed))

    some = save(by_class(rows.join(met, "key"), sizes), f"{folder}/some")
    # again among the classes that are left, of sizes that can link: these stand in the same band of sizes or in the next
    banded = (some.select("doc_id", "n", F.explode("keys").alias("rank"))
              .select("doc_id", "rank", F.explode(F.array(_band("n", percent), _band("n", percent) + 1)).alias("band")))
    near = banded.groupBy("rank", "band").agg(F.count("*").alias("c")).where("c > 1").select("rank", "band")
    some = by_class(banded.join(near, ["rank", "band"]), some.select("doc_id", "n", "held"))
    # of two linked heads the rarest n-grams, but for one less than they must share, have one in common
    rarest = F.slice(F.array_sort("keys"), F.lit(1), (F.size("keys") - needed + 1).cast("int"))
    rare = some.select("doc_id", "n", (F.col("held") - F.size("keys")).alias("alone"), F.explode(rarest).alias("key"))
    rare = save(rare.select("key", "doc_id", "n", "alone"), f"{folder}/rare")
    shared = rare.groupBy("key").agg(F.min("doc_id").alias("p1"), F.max("doc_id").alias("hi")).where("p1 <> hi").select("key", "p1")
    active = save(rare.join(shared.select("key"), "key"), f"{folder}/active")

    wanted, n_wanted = save_counted(classes.select(F.col("rep").alias("doc_id"), F.col("s1").alias("own"), "rid")
                  .join(active.select("doc_id").distinct(), "doc_id", "left_semi"), f"{folder}/wanted")
    heads = save(table.select("rid", "doc_id", "head").join(maybe_broadcast(wanted.select("rid"), 16, rows=n_wanted), "rid", "left_semi")
                 .select("doc_id", F.lit(0).alias("frag"), F.col("head").alias("keys")), f"{folder}/compared")
    found = _fragments(base.join(maybe_broadcast(wanted.select("doc_id", "own"), 24, rows=n_wanted), "doc_id"), n, heavy, pivots(fragments))
    sets = save(found, f"{folder}/fragments")
    heavy.destroy()  # all that needs it is saved
    verify = _Verifier(sets, heads, fragments, percent, folder)

    def possible(a: str, b: str) -> Column:
        """Whether sizes ``n`` and numbers ``alone`` of n-grams in no other head leave room for the overlap of a link."""
        most = F.least(F.col(f"n{a}") - F.col(f"alone{a}"), F.col(f"n{b}") - F.col(f"alone{b}"))
        return F.lit(100) * most >= F.lit(percent) * (F.col(f"n{a}") + F.col(f"n{b}") - most)

    def against(rows: DataFrame, pivot: DataFrame) -> DataFrame:
        """Pairs of each of ``rows`` with the pivot (``key``, ``p``) of its n-gram, unless both are in one component."""
        turned = F.col("p") < F.col("doc_id")
        of = rows.select("key", F.col("doc_id").alias("p"), F.col("n").alias("np"), F.col("alone").alias("alonep"), F.col("comp").alias("compp"))
        return (rows.join(pivot.join(of, ["key", "p"]), "key").where(F.col("comp") != F.col("compp")).where(possible("", "p"))
                .select(F.least("p", "doc_id").alias("a"), F.greatest("p", "doc_id").alias("b"),
                        F.when(turned, F.col("np")).otherwise(F.col("n")).alias("na"), F.when(turned, F.col("n")).otherwise(F.col("np")).alias("nb")))

    # each class is compared with one other first, the least that stands first under any of its n-grams
    single = active.withColumn("comp", F.col("doc_id")).join(shared, "key")
    first = single.groupBy("doc_id").agg(F.min(F.struct("p1", "key")).alias("m")).select("doc_id", "m.key")
    chosen = active.join(first, ["doc_id", "key"]).unionAll(
        active.join(shared, "key").where("doc_id = p1").select(*active.columns)).withColumn("comp", F.col("doc_id")).distinct()
    links, new = verify.links(against(chosen, shared.withColumnRenamed("p1", "p")))
    labels = components(links)
    for k in range(3):
        if new or k == 0:  # else the components are those of the last round
            marked = (active.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
                      .withColumn("comp", F.coalesce("component", "doc_id")).drop("component"))
            mixed = (marked.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi"))
            left, rest = save_counted(marked.join(mixed, "key"), f"{folder}/left-{k}")
        if not rest:
            break
        if k < 2:
            side = left if k == 0 else left.where("comp = hi")
            pairs = against(left, side.groupBy("key").agg(F.min("doc_id").alias("p")))
        else:
            spreads = table.select("rid", "spread").join(maybe_broadcast(wanted.select("rid", "doc_id"), 16, rows=n_wanted), "rid")
            pairs = _unlinked(left.join(spreads.drop("rid"), "doc_id"), percent, possible)
        found, new = verify.links(pairs)
        if new:  # between components so far, so none of them is known
            links = links.unionAll(found)
            labels = components(links)
    members = table.select("doc_id", "n", "s1", "s2").join(classes, ["n", "s1", "s2"], "left")
    return members.select("doc_id", "n", "rep"), links, labels


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` for every row of ``docs``.

    Words are runs of non-space bytes with A-Z lower-cased; a text of fewer
    than ``n`` words has its whole sequence as its one n-gram; a text without
    words or null has an empty set and is its own component.  Sets link when
    ``100 * intersection >= percent * union``.  A null id gets a null
    component unless its set equals another row's.  Of rows that repeat an id
    with different sets the smallest set stands for the id; the others join
    only the class of an equal set, if there is one.  Empty input gives no
    rows; other columns are ignored."""
    members, _, labels = _joined(docs, n, percent, id_col, text_col)
    return (members.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
            .select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                    F.coalesce("component", "rep", "doc_id").alias("component_id")))


def keep_one(docs: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document, that of the smallest id, of each component;
    rows without words stay."""
    found = jaccard_components(docs, n, percent, id_col, text_col)
    id_, = free_names(docs, "_id")
    lost, rows = save_counted(found.where("n_shingles > 0 and component_id <> doc_id").select(F.col("doc_id").alias(id_)).distinct(),
                              shared_dir(docs.sparkSession, "ngram-lost"))
    return docs.join(maybe_broadcast(lost, 16, rows=rows), F.col(f"`{id_col}`").cast("long") == F.col(id_), "left_anti")
