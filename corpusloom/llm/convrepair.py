"""Conversation structure repair by integer-minimum dynamic programming.

A conversation must read ``(s?(ua)+)?`` by the first letters of its roles.
Every edit has a weight that is one big integer: the cost in its high digits,
and one base-8 digit for the edit's letter at the place of the audit string
where it stands, the digits behind it zero.  The weight of a way is the sum of
its edits, so the least integer is the cheapest way and, of equally cheap ones,
the one whose audit string is least (a shorter string sorts as if padded
with zeros).  Nodes are the places between rows and the four states of the
pattern.  Of two ways to one node that cost the same none is the beginning of
the other (the rest could only be insertions, which cost), so the minimum of a
stretch of rows stays the minimum whatever follows.

That makes stretches independent: rows are dealt by ranges of (conversation,
turn), every task turns stretches of bounded length into a table of least
weights by first and last state, and the tables of one conversation are put
together in pairs.  Only then are texts read, in a stream beside the finished
audit string, so no conversation is held as a whole.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import arrow_schema, save, shared_dir

WHITE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
LETTERS = {"D": 1, "I": 2, "K": 3, "R": 4}
COST = {"D": 4, "I": 3, "K": 0, "R": 3}
CUT_COST = 3
#: States: nothing yet, after system, after user, after assistant.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The only role that can be put in at a state.
PUT = {0: "user", 1: "user", 2: "assistant", 3: "user"}
ACCEPT = (0, 3)
LEGAL = {"su", "ua", "au"}
#: Rows of a stretch: bounds the width of its integers.
STRETCH = 1024

Weight = tuple[int, int, int]  # cost, audit digits, number of digits


# --- least weights ------------------------------------------------------------

def stretch_table(items: list[str], starts: Iterable[int]) -> dict[tuple[int, int], Weight]:
    """Least weight between states over ``items``: "" for a row that must be
    deleted, otherwise the first letter of its role (or "-") and "!" if truncated."""
    width = 3 * (3 * len(items) + 2)  # at most two insertions before every row and at the end
    unit = {k: c << width for k, c in COST.items()}
    cut = CUT_COST << width
    table = {}
    for start in starts:
        ways: dict[int, tuple[int, int]] = {start: (0, 0)}

        def add(to: dict, state: int, way: tuple[int, int], edit: str, more: int = 0) -> None:
            at = way[1] + 1
            new = (way[0] + unit[edit] + more + (LETTERS[edit] << (width - 3 * at)), at)
            if state not in to or new[0] < to[state][0]:
                to[state] = new

        def insertions(to: dict) -> None:
            for state in (0, 1, 3, 2):  # an "a" can only follow the "u" put in before
                if state in to:
                    add(to, NEXT[state, PUT[state][0]], to[state], "I")

        for item in items:
            insertions(ways)
            new: dict[int, tuple[int, int]] = {}
            for state, way in ways.items():
                add(new, state, way, "D")
                if item:
                    more = cut if item[1:] else 0
                    if (kept := NEXT.get((state, item[0]))) is not None:
                        add(new, kept, way, "K", more)
                    add(new, NEXT[state, PUT[state][0]], way, "R", more)
            ways = new
        insertions(ways)
        low = (1 << width) - 1
        for state, (value, n) in ways.items():
            table[start, state] = (value >> width, (value & low) >> (width - 3 * n), n)
    return table


def joined(a: dict, b: dict) -> dict:
    """The table of two stretches in a row."""
    out: dict[tuple[int, int], tuple[int, Weight]] = {}
    width = 3 * (max(w[2] for w in a.values()) + max(w[2] for w in b.values()))
    for (s, m), (c1, d1, n1) in a.items():
        for (m2, e), (c2, d2, n2) in b.items():
            if m == m2:
                way = (c1 + c2, d1 << 3 * n2 | d2, n1 + n2)
                value = way[0] << width | way[1] << width - 3 * way[2]
                if (s, e) not in out or value < out[s, e][0]:
                    out[s, e] = (value, way)
    return {k: way for k, (_, way) in out.items()}


def cheapest(tables: list[dict]) -> tuple[int, str]:
    """(cost, audit) of a conversation from the tables of its stretches."""
    while len(tables) > 1:
        tables = [joined(*tables[i:i + 2]) if i + 1 < len(tables) else tables[i] for i in range(0, len(tables), 2)]
    if not tables:
        return 0, ""
    ends = [tables[0][0, e] for e in ACCEPT if (0, e) in tables[0]]
    width = 3 * max(n for _, _, n in ends)
    cost, digits, n = min(ends, key=lambda w: w[0] << width | w[1] << width - 3 * w[2])
    return cost, _letters(digits) if n else ""


def _letters(digits: int) -> str:
    return format(digits, "o").translate(str.maketrans({str(v): k for k, v in LETTERS.items()}))


def _pack(table: dict) -> str:
    return json.dumps([[s, e, c, format(d, "o"), n] for (s, e), (c, d, n) in table.items()])


def _unpack(text: str) -> dict:
    return {(s, e): (c, int(d, 8), n) for s, e, c, d, n in json.loads(text)}


# --- rows ---------------------------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv, turn, role, text, copies)``: the rows of ``conversations`` after
    the damage that the CRC of ``conv_id:turn`` decides; a null is one space in
    that key, in a role and in a text.  Dropped rows have no copies."""
    def text(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    key = F.concat(text("conv_id"), F.lit(":"), text("turn"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
                                text("role").alias("role"), text("text").alias("text"), (F.crc32(key) % 20).alias("kind"))
    kind, body = F.col("kind"), F.col("text")
    return rows.select(
        "conv", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind.isin(0, 1), "").when(kind == 2, F.translate(body, "".join(ENDS), "")).otherwise(body).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


ITEMS = "conv long, turn long, role string, h string, n long, blank boolean, cut boolean, seen boolean"
STRETCHES = ("conv long, part int, seq int, rows long, blank long, duplicate long, truncated long, illegal long, first_turn long, "
             "last_turn long, turns long, first_role string, last_role string, forced string, weights string")
REPAIRED = ("conv_id long, position long, turn long, edit string, role string, text string, gaps long, blank long, duplicate long, "
            "truncated long, illegal long, cost long, audit string")


def _items(rows: DataFrame) -> DataFrame:
    """``ITEMS`` of aggregated ``rows``: digests in place of texts, and whether
    role and text were seen at an earlier turn."""
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    narrow = rows.select("conv", "turn", "role", F.sha2("text", 256).alias("h"), "n", (bare == "").alias("blank"),
                         ((bare != "") & ~F.right(bare, F.lit(1)).isin(*ENDS)).alias("cut"))
    again = (narrow.where("n > 0 and not blank").groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("h").alias("g"))
             .agg(F.min(F.struct("turn")).alias("t"), F.count("*").alias("k")).where("k > 1"))
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h") == F.col("g"))
    seen = F.coalesce(F.col("k") > 1, F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("t.turn"))
    return narrow.join(again, same, "left").select("conv", "turn", "role", "h", "n", "blank", "cut", seen.alias("seen"))


def _stretches(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """``STRETCHES`` of at most ``limit`` rows of sorted ``ITEMS``.  Only a conversation that begins a
    partition can go on from another one."""
    schema, part = _arrow(STRETCHES), TaskContext.get().partitionId()
    out, seq, now, known = [], 0, None, False

    def fresh(conv) -> dict:
        return dict(conv=conv, rows=0, blank=0, duplicate=0, truncated=0, illegal=0, first_turn=None, last_turn=None, turns=0,
                    first_role=None, last_role=None, items=[])

    def close() -> None:
        nonlocal seq
        items = now.pop("items")
        now.update(part=part, seq=seq, forced="".join("." if i else "x" for i in items),
                   weights=_pack(stretch_table(items, (0,) if known else range(4))))
        out.append(now)
        seq += 1

    def take(row: dict) -> None:
        """One row of the conversation: its faults, and what it is to the repair."""
        now["rows"] += 1
        first = row["role"][:1]
        if now["last_role"] is not None and now["last_role"] + first not in LEGAL:
            now["illegal"] += 1
        if now["first_role"] is None:
            now["first_role"] = first
        now["last_role"] = first
        if (turn := row["turn"]) is not None and turn != now["last_turn"]:
            now["turns"] += 1
            now["last_turn"] = turn
            if now["first_turn"] is None:
                now["first_turn"] = turn
        if row["blank"] or row["seen"]:
            now["blank" if row["blank"] else "duplicate"] += 1
            now["items"].append("")
        else:
            now["truncated"] += row["cut"]
            now["items"].append((first or "-") + "!" * row["cut"])

    for batch in batches:
        for row in batch.to_pylist():
            if now is None or row["conv"] != now["conv"]:
                if now:
                    close()
                known = now is not None
                now = fresh(row["conv"])
            for _ in range(row["n"]):
                if len(now["items"]) == limit:
                    close()
                    known, now = False, fresh(row["conv"])
                take(row)
                row["seen"] = True  # further copies
        if len(out) > 5000:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if now:
        close()
    yield pa.RecordBatch.from_pylist(out, schema)


def _summary(stretches: list[dict]) -> dict:
    """What the stretches of one conversation, in order, say together."""
    total = {k: sum(s[k] for s in stretches) for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
    role = turn = low = None
    for s in stretches:
        if role is not None and s["first_role"] is not None:
            total["illegal"] += role + s["first_role"] not in LEGAL
        role = s["last_role"] if s["last_role"] is not None else role
        if s["first_turn"] is not None:
            total["turns"] -= s["first_turn"] == turn
            turn, low = s["last_turn"], s["first_turn"] if low is None else low
    gaps = 0 if turn is None else turn - low + 1 - total.pop("turns")
    total.pop("turns", None)
    cost, audit = cheapest([_unpack(s["weights"]) for s in stretches if s["rows"]])
    return total | dict(gaps=gaps if gaps < 1 << 63 else None, cost=cost, audit=audit, forced="".join(s["forced"] for s in stretches))


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[t]) for n, t in (f.split() for f in ddl.split(","))])


def _edits(audit: str, forced: str, rows: Iterator[dict]) -> Iterator[tuple]:
    """(letter, turn, role, text) of the rows that ``audit`` leaves."""
    state, at = 0, 0
    for letter in audit:
        if letter == "I":
            role, turn, text = PUT[state], None, ""
        else:
            at += 1
            if forced[at - 1] == "x":
                continue
            row = next(rows)
            if letter == "D":
                continue
            role, turn, text = PUT[state] if letter == "R" else row["role"], row["turn"], row["text"]
        state = NEXT[state, role[0]]
        yield letter, turn, role, text


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``REPAIRED`` rows from stretches and texts sorted by conversation,
    stretches first."""
    schema, out, size = _arrow(REPAIRED), [], 0
    stream = (row for batch in batches for row in batch.to_pylist())
    ahead = next(stream, None)

    def texts(conv) -> Iterator[dict]:
        nonlocal ahead
        last = None
        while ahead is not None and ahead["conv"] == conv and ahead["text"] is not None:
            row, ahead = ahead, next(stream, None)
            if (key := (row["turn"], row["role"], row["h"])) != last:
                yield row
            last = key

    while ahead is not None:
        conv, parts = ahead["conv"], []
        while ahead is not None and ahead["conv"] == conv and ahead["text"] is None:
            parts.append(ahead)
            ahead = next(stream, None)
        told = _summary(parts)
        forced, rows = told.pop("forced"), texts(conv)
        out.append(dict(conv_id=conv, position=0, **told))
        for k, (edit, turn, role, text) in enumerate(_edits(told["audit"], forced, rows)):
            out.append(dict(conv_id=conv, position=k + 1, edit=edit, turn=turn, role=role, text=text))
            size += len(text) + 100
            if size > 4 << 20:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, size = [], 0
        if next(rows, None) is not None:
            raise ValueError(f"conversation {conv}: more texts than rows")
        if len(out) > 5000:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, size = [], 0
    yield pa.RecordBatch.from_pylist(out, schema)


def repair(rows: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """``REPAIRED`` of ``rows`` (``conv``, ``turn``, ``role``, ``text``,
    ``copies``), for each conversation one row at position 0 with its faults,
    cost and audit, then the rows of the repaired conversation from position 1
    on, with the edit that made each.  A conversation stands in one partition, in
    order.

    Rows are taken by turn, null turns first, then by role and digest of the
    text.  A null ``conv`` is a conversation; equal rows are copies of each other.
    Blank and repeated rows are always deleted.  Conversations without rows left
    (``copies`` 0) have zeros and an empty audit; an empty table gives no rows; a
    span of turns beyond 64 bits gives null ``gaps``."""
    spark, folder = rows.sparkSession, shared_dir(rows.sparkSession, "repair")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = save(rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("n")), f"{folder}/rows")
    items = save(_items(held), f"{folder}/items")
    order = ["conv", "turn", "role", "h"]
    stretches = items.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(partial(_stretches, limit=stretch), STRETCHES)
    stretches = save(stretches, f"{folder}/stretches")
    # only rows that may stay: not blank, the first of their kind
    stay = items.where("n > 0 and not blank and not seen").select("conv", "turn", "role", "h")
    texts = held.where("n > 0").withColumn("h", F.sha2("text", 256)).withColumn("key", F.xxhash64("conv", "turn", "role", "h"))
    stay = stay.select(F.xxhash64(*order).alias("key"), *[F.col(c).alias(f"s_{c}") for c in order])
    same = (F.col("key") == F.col("s_key")) & F.col("conv").eqNullSafe(F.col("s_conv")) & F.col("turn").eqNullSafe(
        F.col("s_turn")) & (F.col("role") == F.col("s_role")) & (F.col("h") == F.col("s_h"))
    texts = texts.join(stay.withColumnRenamed("key", "s_key"), same, "left_semi").select("conv", "turn", "role", "h", "text")
    placed = (stretches.unionByName(texts, allowMissingColumns=True).repartition(n, "conv")
              .sortWithinPartitions("conv", F.col("text").isNotNull(), "part", "seq", "turn", "role", "h"))
    return placed.mapInArrow(_apply, REPAIRED)


def digests(repaired: DataFrame) -> DataFrame:
    """One row per conversation of ``repaired``: its row at position 0 with the
    SHA-256 of the repaired rows ``role:text`` joined by line feeds."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    schema = repaired.select(*names, F.lit("").alias("repaired_sha256")).schema
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, sha, out = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["position"] == 0:
                    if head:
                        out.append(head | {"repaired_sha256": sha.hexdigest()})
                    head, sha = {k: row[k] for k in names}, hashlib.sha256()
                else:
                    sha.update(("\n" * (row["position"] > 1) + f"{row['role']}:{row['text']}").encode())
            yield pa.RecordBatch.from_pylist(out, arrow)
            out = []
        if head:
            yield pa.RecordBatch.from_pylist([head | {"repaired_sha256": sha.hexdigest()}], arrow)

    return repaired.mapInArrow(run, schema)
