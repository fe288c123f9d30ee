"""Near-duplicate line removal by a segment-partition edit join (native).

Lines within an edit distance of ``threshold`` are one class, as are lines
linked through others; of each class the first line in (document, position)
order stays.

Every distinct line is indexed under its length and ``threshold + 1`` equal
segments: at most ``threshold`` edits leave one segment whole.  A line probes
the lengths up to ``threshold`` below its own, with the substrings at which
that segment can still stand (multi-match-aware positions).  An index entry
that many lines share is refined: the longest part not yet compared is cut
into ``threshold + 1`` pieces, of which again one must be whole, and so on
until few lines share a key; lines of a large group never meet as all pairs.
Candidates are verified by a bit-parallel automaton over the band of
``2 * threshold + 1`` diagonals.

Distinct lines are stored in buckets of their hash, so only candidate pairs
move to fetch the texts to compare.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import components, free_names, save, save_counted, shared_dir, shuffles_removed

#: Lines shorter than this are equal or different, never near.
MIN_CHARS = 32
#: Lines that may share an index key before it is refined.
SHARE = 16
#: Edits by length, for jobs not tied to one distance: (edits, from so many characters).
EDITS = ((1, 8), (2, 64))
#: White space of Unicode besides the line feed.
WHITE = " \t\r\v\f\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def row_key(text_col: str) -> Column:
    """Tells rows that repeat an id apart by their text."""
    return F.xxhash64(F.col(f"`{text_col}`").cast("string"))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", white: str = " ") -> DataFrame:
    """``doc_id``, ``row``, ``pos`` and trimmed ``line`` of every line that is not blank."""
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), row_key(text_col).alias("row"),
                       lines_of(F.col(f"`{text_col}`").cast("string")).alias("lines"))
    cut = base.select("doc_id", "row", F.posexplode("lines").alias("pos", "raw"))
    return cut.select("doc_id", "row", "pos", F.trim(F.col("raw"), F.lit(white)).alias("line")).where("line <> ''")


def store_lines(lines: DataFrame, path: str) -> DataFrame:
    """Distinct ``line`` with its hash ``h``, in buckets of ``h``."""
    spark = lines.sparkSession
    name = f"corpusloom_lines_{uuid.uuid4().hex}"
    distinct = (lines.select(F.xxhash64("line").alias("h"), "line").groupBy("h").agg(F.collect_set("line").alias("line"))
                .select("h", F.explode("line").alias("line")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with shuffles_removed(spark):
        distinct.write.bucketBy(n, "h").sortBy("h").option("path", path).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


# --- keys -------------------------------------------------------------------

def _piece(length, k: int, parts: int):
    """Start and length of piece ``k`` of a string cut into ``parts``."""
    start = F.floor(length * k / parts).cast("int")
    return start, F.floor(length * (k + 1) / parts).cast("int") - start


def _slice(start, length) -> Column:
    return F.substring(F.col("line"), start + 1, length)


def _interval(start, length) -> Column:
    return F.struct(start.cast("int").alias("at"), length.cast("int").alias("len"))


def _rest(total_at, total_len, start, length) -> Column:
    """What is left of an interval on both sides of a piece."""
    return F.filter(F.array(_interval(total_at, start - total_at), _interval(start + length, total_at + total_len - start - length)),
                    lambda r: r["len"] > 0)


def index_keys(lines: DataFrame, threshold: int) -> DataFrame:
    """``key``, ``h`` and the parts ``rest`` outside the segment."""
    size = F.char_length("line")
    entries = []
    for i in range(threshold + 1):
        at, n = _piece(size, i, threshold + 1)
        entries.append(F.struct(F.xxhash64(size, F.lit(i), _slice(at, n)).alias("key"), F.lit(i).alias("i")))
    return lines.select("h", size.alias("size"), F.explode(F.array(*entries)).alias("e")).select("e.key", "h", "size", "e.i")


def probe_keys(lines: DataFrame, threshold: int, min_chars: int) -> DataFrame:
    """``key``, ``h``, ``size`` (of the lines looked for), segment ``i`` and ``same`` (equal lengths)."""
    entries = []
    for less in range(threshold + 1):
        size = F.char_length("line") - less
        for i in range(threshold + 1):
            at, n = _piece(size, i, threshold + 1)
            for off in range(max(-i, less - (threshold - i)), min(i, less + threshold - i) + 1):
                fits = (size >= min_chars) & (at + off >= 0) & (at + off + n <= F.char_length("line"))
                entries.append(F.when(fits, F.struct(F.xxhash64(size, F.lit(i), _slice(at + off, n)).alias("key"), size.alias("size"),
                                                     F.lit(i).alias("i"), F.lit(less == 0).alias("same"))))
    return lines.select("h", F.explode(F.array(*entries)).alias("e")).where("e is not null").select("e.key", "h", "e.size", "e.i", "e.same")


def _refined(rows: DataFrame, threshold: int, probe: bool) -> DataFrame:
    """The rows of shared keys under longer keys: the longest part of ``rest``
    in ``threshold + 1`` pieces, at every shift that ``threshold`` edits allow
    for a probe.  Rows without a part long enough keep their key (``done``)."""
    rows = rows.withColumn("top", F.array_max(F.transform("rest", lambda r: F.struct(r["len"].alias("len"), (-r["at"]).alias("neg")))))
    at, size = -F.col("top.neg"), F.coalesce(F.col("top.len"), F.lit(0))
    entries = []
    for p in range(threshold + 1):
        start, n = _piece(size, p, threshold + 1)
        start = start + at
        others = F.filter("rest", lambda r: ~((r["at"] == at) & (r["len"] == size)))
        rest = F.concat(others, _rest(at, size, start, n))
        for off in range(-threshold, threshold + 1) if probe else (0,):
            fits = (size > threshold) & (start + off >= 0) & (start + off + n <= F.char_length("line"))
            entries.append(F.when(fits, F.struct(F.xxhash64("key", F.lit(p), _slice(start + off, n)).alias("key"), rest.alias("rest"),
                                                 F.lit(False).alias("done"))))
    entries.append(F.when(size <= threshold, F.struct(F.col("key"), F.col("rest"), F.lit(True).alias("done"))))
    keep = [c for c in ("h", "line", "same") if c in rows.columns]
    return (rows.select(*keep, F.explode(F.array(*entries)).alias("e")).where("e is not null").select(*keep, "e.*")
            .dropDuplicates(["key", "h"] + (["same"] if probe else [])))


# --- verification -----------------------------------------------------------

def within(x: str, y: str, threshold: int) -> Column:
    """Whether columns ``x`` and ``y`` (arrays of characters, ``y`` at least
    as long) are within ``threshold`` edits.

    Bit ``d`` of word ``e`` says that after the first i characters of ``x``,
    i + d - threshold characters of ``y`` can be reached with e edits; a step
    takes one character of ``x`` and moves all diagonals at once."""
    t, band = threshold, (1 << (2 * threshold + 1)) - 1
    first = [1 << t]
    for _ in range(t):
        first.append((first[-1] | first[-1] << 1) & band)
    match = " | ".join(f"IF({x}[i] = get({y}, i + {d - t}), {1 << d}L, 0L)" for d in range(2 * t + 1))
    # the words of a step refer to those before them, so each is written out in full
    words = ["(s.w0 & m)"]
    for e in range(1, t + 1):
        words.append(f"(((s.w{e} & m) | s.w{e - 1} | shiftright(s.w{e - 1}, 1) | shiftleft({words[-1]}, 1)) & {band}L)")
    step = ", ".join(f"'w{e}', {w}" for e, w in enumerate(words))
    start = ", ".join(f"'w{e}', {w}L" for e, w in enumerate(first))
    goal = f"shiftright(s.w{t}, int(size({y}) - size({x}) + {t})) & 1L = 1L"
    return F.expr(f"""size({y}) - size({x}) <= {t} AND aggregate(sequence(0, size({x}) - 1), named_struct({start}),
        (s, i) -> transform(array({match}), m -> named_struct({step}))[0], s -> {goal})""")


def verified(pairs: DataFrame, lines: DataFrame, threshold: int) -> DataFrame:
    """The pairs (``a``, ``b`` hashes, ``b`` not shorter) within ``threshold`` edits."""
    left, right = (lines.select(F.col("h").alias(k), F.col("line").alias(c)) for k, c in (("a", "x"), ("b", "y")))
    met = pairs.join(left, "a").join(right, "b")
    chars = (F.filter(F.split(c, "", -1), lambda z: z != "").alias(c) for c in ("x", "y"))
    # a generator's output is computed once; other columns would be computed again for every step of a lambda
    met = met.select("a", "b", F.explode(F.array(F.struct(*chars))).alias("c")).select("a", "b", "c.x", "c.y")
    return met.where(within("x", "y", threshold)).select("a", "b").distinct()


# --- the join ---------------------------------------------------------------

def line_links(lines: DataFrame, folder: str, threshold: int, min_chars: int = MIN_CHARS, share: int = SHARE) -> DataFrame:
    """Pairs ``a``, ``b`` of hashes of ``lines`` (``store_lines``) within
    ``threshold`` edits; complete at any ``share``."""
    if threshold < 1:
        return lines.select(F.col("h").alias("a"), F.col("h").alias("b")).limit(0)
    index, probe = index_keys(lines, threshold), probe_keys(lines, threshold, min_chars)
    hot, some = save_counted(index.groupBy("key").count().where(F.col("count") > share).select("key"), f"{folder}/shared-0")
    found = [_pairs(index.join(hot, "key", "left_anti"), probe)]
    if some:
        def first(rows: DataFrame, *extra: str) -> DataFrame:
            rest = F.lit(None)
            for i in range(threshold + 1):
                at, n = _piece(F.col("size"), i, threshold + 1)
                rest = F.when(F.col("i") == i, _rest(F.lit(0), F.col("size"), at, n)).otherwise(rest)
            return rows.join(hot, "key", "left_semi").join(lines, "h").select("h", "line", "key", rest.alias("rest"), *extra)

        a, b, level = save(first(index), f"{folder}/index-0"), save(first(probe, "same"), f"{folder}/probe-0"), 0
        while True:
            level += 1
            a = save(_refined(a, threshold, False), f"{folder}/index-{level}")
            b = save(_refined(b, threshold, True), f"{folder}/probe-{level}")
            hot, some = save_counted(a.where("not done").groupBy("key").count().where(F.col("count") > share).select("key"), f"{folder}/shared-{level}")
            found.append(_pairs(a.join(hot, "key", "left_anti"), b.join(hot, "key", "left_anti")))
            if not some:
                break
            a, b = a.where("not done").join(hot, "key", "left_semi"), b.where("not done").join(hot, "key", "left_semi")
    pairs = save(functools.reduce(DataFrame.unionAll, found).distinct(), f"{folder}/pairs")
    return verified(pairs, lines, threshold)


def _pairs(index: DataFrame, probe: DataFrame) -> DataFrame:
    """Index and probe lines of equal keys; of two lines of equal length the
    one with the smaller hash is the first."""
    met = index.select("key", F.col("h").alias("a")).join(probe.select("key", F.col("h").alias("b"), "same"), "key")
    return met.where("a < b or not same and a <> b").select("a", "b").distinct()


def line_classes(docs: DataFrame, threshold: int = 1, min_chars: int = MIN_CHARS, id_col: str = "doc_id",
                 text_col: str = "text", share: int = SHARE, edits=None, white: str = " ") -> DataFrame:
    """``doc_id``, ``row``, ``pos``, ``keep`` of every line that is not blank:
    whether it is the first of its class.

    ``edits`` lists (edits, least length of the shorter line) and stands for
    ``threshold`` and ``min_chars``; lines are compared without the characters
    of ``white`` around them.
    A null id comes after all others.  Repeated rows (equal id and text) are
    one document here."""
    folder = shared_dir(docs.sparkSession, "lines")
    lines, edits = occurrences(docs, id_col, text_col, white), edits or [(threshold, min_chars)]
    stored = store_lines(lines.where(F.char_length("line") >= min(least for _, least in edits)), f"{folder}/lines")
    links = [line_links(stored.where(F.char_length("line") >= least), f"{folder}/{t}-{least}", t, least, share) for t, least in edits]
    labels = components(functools.reduce(DataFrame.unionAll, links))
    narrow = lines.select("doc_id", "row", "pos", F.xxhash64("line").alias("h"), F.xxhash64("line", F.lit(1)).alias("h2"))
    # an unlinked line is told by 128 bits, a linked one by its component
    linked = labels.unionAll(labels.select(F.col("component").alias("node"), "component")).distinct().withColumnRenamed("node", "h")
    classed = narrow.join(linked, "h", "left").select(
        "doc_id", "row", "pos", F.coalesce("component", "h").alias("c1"), F.when(F.col("component").isNull(), F.col("h2")).otherwise(0).alias("c2"))
    classed = save(classed, f"{folder}/classes")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "pos")
    first = classed.groupBy("c1", "c2").agg(F.min(place).alias("first"))
    return classed.join(first, ["c1", "c2"]).select("doc_id", "row", "pos", (place == F.col("first")).alias("keep"))


def removed_lines(docs: DataFrame, threshold: int = 1, min_chars: int = MIN_CHARS, id_col: str = "doc_id",
                  text_col: str = "text", share: int = SHARE, edits=None, white: str = " ") -> DataFrame:
    """``doc_id``, ``row`` and the positions ``removed`` of the lines that go,
    for the documents that lose any."""
    gone = line_classes(docs, threshold, min_chars, id_col, text_col, share, edits, white).where("not keep")
    return gone.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("pos")).alias("removed"))


def report(docs: DataFrame, threshold: int = 1, min_chars: int = MIN_CHARS, id_col: str = "doc_id",
           text_col: str = "text", share: int = SHARE) -> DataFrame:
    """``doc_id``, ``n_lines`` (not blank), ``n_removed`` and ``removed`` (the
    positions, joined by commas) for every row of ``docs``.

    Lines end at a line feed and are compared without surrounding spaces;
    blank lines always stay.  Null and empty texts have no lines.  A null id
    comes after all others; rows that repeat an id are told apart by their
    text, and equal ones lose the same lines.  Empty input gives no rows;
    other columns are ignored."""
    removed = removed_lines(docs, threshold, min_chars, id_col, text_col, share)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), row_key(text_col).alias("row"),
                       F.size(F.filter(lines_of(F.col(f"`{text_col}`").cast("string")), lambda x: F.trim(x) != "")).cast("long").alias("n_lines"))
    joined = rows.alias("r").join(removed.alias("x"), F.col("r.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("r.row") == F.col("x.row")), "left")
    lost = F.coalesce("x.removed", F.array().cast("array<int>"))
    return joined.select("r.doc_id", "n_lines", F.size(lost).cast("long").alias("n_removed"), F.array_join(lost, ",").alias("removed"))


def remove_lines(docs: DataFrame, threshold: int = 1, min_chars: int = MIN_CHARS, id_col: str = "doc_id",
                 text_col: str = "text", share: int = SHARE, edits=None, white: str = " ") -> DataFrame:
    """``docs`` without the lines that ``line_classes`` rejects, and without
    the documents of which only blank lines are left; texts that had no line
    before stay as they are.  An ``n_chars`` column follows the new text."""
    id_, row, gone, lines = free_names(docs, "_id", "_row", "_removed", "_lines")
    removed = removed_lines(docs, threshold, min_chars, id_col, text_col, share, edits, white).select(
        F.col("doc_id").alias(id_), F.col("row").alias(row), F.col("removed").alias(gone))
    joined = docs.join(removed, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(id_)) & (row_key(text_col) == F.col(row)), "left")
    kept = F.filter(F.transform(lines_of(F.col(f"`{text_col}`")), lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
                    lambda z: ~F.array_contains(F.col(gone), z["i"]))
    joined = joined.withColumn(lines, F.when(F.col(gone).isNotNull(), F.transform(kept, lambda z: z["x"])))
    joined = joined.where(F.col(lines).isNull() | F.exists(lines, lambda x: F.trim(x, F.lit(white)) != ""))
    text = F.coalesce(F.array_join(lines, "\n"), F.col(f"`{text_col}`"))
    size = F.when(F.col(lines).isNotNull(), F.char_length(text).cast("long"))
    cols = []
    for c in docs.columns:
        value = text if c == text_col else F.coalesce(size, F.col(c)) if c == "n_chars" else F.col(f"`{c}`")
        cols.append(value.alias(c))
    return joined.select(*cols)
