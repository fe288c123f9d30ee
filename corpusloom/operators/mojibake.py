"""Text repair as a search over codecs (K-09).

UTF-8 read with a single-byte codec turns every character beyond ASCII into
two to four characters beyond ASCII.  Damage therefore lies in runs of such
characters.  One layer of a run is undone by dynamic programming: at each place
either one character stays, or the two to four characters there, written in a
codec, are the UTF-8 form of one character; so a run may be part damaged and
part whole, and parts may have other codecs.  Every character has a cost by how
unlikely it is in text, every decoding one for the step.  Damage of several
layers is a chain of such readings, and the chain whose end is cheapest wins.

Only rows that a JVM pattern suspects reach Python, in Arrow batches; a run is
searched once per task.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Layers of a chain, at most.
LAYERS = 4
#: Runs remembered in a task, at most.
MEMORY = 1 << 16
STEP = 0.5


def _codec(name: str) -> list[str]:
    """The character of each byte; a byte without one stands for its own number."""
    return [bytes([b]).decode(name, "ignore") or chr(b) for b in range(256)]


CODECS = {"cp1252": _codec("cp1252"), "latin-1": [chr(b) for b in range(256)], "mac-roman": _codec("mac_roman")}
_BYTES = {name: {c: b for b, c in enumerate(table) if b >= 0x80} for name, table in CODECS.items()}


def _class(low: int, high: int, codecs: tuple[str, ...]) -> str:
    return "".join(sorted({re.escape(CODECS[c][b]) for c in codecs for b in range(low, high + 1)}))


def detector() -> str:
    """Pattern of the first character of a damaged one and what follows it: a
    lead byte and its continuation bytes in cp1252 or latin-1, or those of the
    Latin letters, signs and dashes in mac-roman."""
    win = ("cp1252", "latin-1")
    mac = CODECS["mac-roman"]
    more, mac_more = f"[{_class(0x80, 0xBF, win)}]", f"[{_class(0x80, 0xBF, ('mac-roman',))}]"
    return (f"[{_class(0xC2, 0xDF, win)}]{more}|[{_class(0xE0, 0xEF, win)}]{more}{{2}}|[{_class(0xF0, 0xF4, win)}]{more}{{3}}"
            f"|[{mac[0xC2]}{mac[0xC3]}]{mac_more}|{mac[0xE2]}{mac_more}{{2}}")


@functools.lru_cache(1 << 16)
def cost(c: str) -> float:
    """How unlikely a character is in prose."""
    code = ord(c)
    if 0x80 <= code < 0xA0 or unicodedata.category(c) in ("Cn", "Co", "Cs"):
        return 4.0
    if 0xC0 <= code < 0x180 and unicodedata.category(c)[0] == "L":
        return 1.0
    if 0x2010 <= code < 0x2030 or code in (0x20AC, 0x2122):  # dashes, quotes, the euro and trade mark signs
        return 1.25
    if code < 0xC0:
        return 1.5
    if 0x370 <= code < 0x530 or 0x5D0 <= code < 0x700 or 0x900 <= code < 0xE80 or 0x3040 <= code < 0xA000 or 0xAC00 <= code < 0xD7A4:
        return 1.5
    if code >= 0x1F300:
        return 2.0
    return 3.0  # phonetic and rare letters, mathematical and other signs


def _decoded(run: str, at: int) -> list[tuple[str, int, str, float]]:
    """(codec, length, character, cost) of the readings of the characters from ``at`` as one of UTF-8."""
    out = []
    for name, table in _BYTES.items():
        lead = table.get(run[at], 0)
        size = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
        if not size or at + size > len(run):
            continue
        raw = bytes([lead, *(table.get(c, 0) for c in run[at + 1:at + size])])
        try:
            c = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        # beyond Latin letters, dashes and what another layer shows, the signs of mac-roman say too little
        far = name == "mac-roman" and not (ord(c) < 0x100 or 0x2010 <= ord(c) < 0x2030 or c in _BYTES["cp1252"] or c in _BYTES[name])
        out.append((name, size, c, cost(c) + STEP + 3 * far))
    return out


def _read(run: str, codec: str) -> str:
    """``run`` with everything that ``codec`` is likely to have damaged read anew, whatever the characters cost."""
    out, at = [], 0
    while at < len(run):
        found = [(size, c) for name, size, c, price in _decoded(run, at) if name == codec and price <= cost(c) + STEP]
        size, c = found[0] if found else (1, run[at])
        out.append(c)
        at += size
    return "".join(out)


def _cheapest(run: str) -> str:
    """The cheapest reading of ``run`` by one layer, in parts of any codecs."""
    best: list[tuple[float, str]] = [(0.0, "")] * (len(run) + 1)
    for at in range(len(run) - 1, -1, -1):
        rest = best[at + 1]
        best[at] = (cost(run[at]) + rest[0], run[at] + rest[1])
        for _, size, c, price in _decoded(run, at):
            total = price + best[at + size][0]
            if total < best[at][0]:
                best[at] = (total, c + best[at + size][1])
    return best[0][1]


def repaired_run(run: str) -> tuple[str, int]:
    """(text, layers) of a run of characters beyond ASCII: of all chains of
    readings the one whose end is cheapest.  A layer in between may look worse
    than what it undoes, so a chain also goes on through whole readings by one
    codec."""
    best, layers, least = run, 0, sum(map(cost, run))
    seen, front = {run}, [run]
    for layer in range(1, LAYERS + 1):
        found = {x for r in front for x in (_cheapest(r), *(_read(r, name) for name in CODECS))} - seen
        for x in sorted(found):
            price = sum(map(cost, x)) + STEP * layer
            if price < least:
                best, layers, least = x, layer, price
        seen |= found
        front = sorted(found)
    return best, layers


_RUN = re.compile(r"[^\x00-\x7f]{2,}")
#: A run longer than this is searched in parts that end before a character which can begin a damaged one.
LONG = 256


def _parts(run: str) -> list[str]:
    parts, start = [], 0
    while len(run) - start > LONG:
        cut = start + LONG
        while cut < len(run) and not any(0xC2 <= t.get(run[cut], 0) <= 0xF4 for t in _BYTES.values()):
            cut += 1
        parts.append(run[start:cut])
        start = cut
    return [*parts, run[start:]]


def repaired(text: str | None, known: dict[str, tuple[str, int]]) -> tuple[str | None, int]:
    """(text, layers undone) of a text; ``known`` remembers its runs."""
    if text is None:
        return None, 0
    layers = 0

    def fix(m: re.Match) -> str:
        nonlocal layers
        out = []
        for part in _parts(m[0]):
            if (found := known.get(part)) is None:
                if len(known) >= MEMORY:
                    known.clear()
                found = known[part] = repaired_run(part)
            layers = max(layers, found[1])
            out.append(found[0])
        return "".join(out)

    return _RUN.sub(fix, text), layers


def repair(df: DataFrame, col: str, layers_col: str | None = None) -> DataFrame:
    """K-09: ``df`` with the damage in ``col`` undone; ``layers_col`` says by how
    many layers.  Rows that the detector does not suspect stay as they are and
    on the JVM.  NULL stays NULL."""
    def run(texts: pa.Array) -> pa.Array:
        known: dict = {}
        pairs = [repaired(t, known) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([t for t, _ in pairs], pa.string()), pa.array([n for _, n in pairs], pa.int32())],
                                          ["text", "layers"])

    suspect = F.coalesce(F.col(col).rlike(detector()), F.lit(False))
    fixed = F.arrow_udf(run, "text string, layers int")(F.col(col))
    bad = df.where(suspect).withColumn("_fixed", fixed)
    layers = [F.col("_fixed.layers").alias(layers_col)] if layers_col else []
    bad = bad.select(*[F.col("_fixed.text").alias(c) if c == col else F.col(f"`{c}`") for c in df.columns], *layers)
    good = df.where(~suspect)
    return (good.withColumn(layers_col, F.lit(0)) if layers_col else good).unionByName(bad)


def damaged(c, codec: str) -> Column:
    """UTF-8 bytes of a text read with ``codec``, as a JVM expression: how the
    damage comes about (fixtures)."""
    col = F.encode(F.col(c) if isinstance(c, str) else c, "UTF-8")
    if codec == "latin-1":
        return F.decode(col, "ISO-8859-1")
    table = CODECS[codec]
    high = [b for b in range(0x80, 0x100) if table[b] != chr(b)]
    return F.translate(F.decode(col, "ISO-8859-1"), "".join(chr(b) for b in high), "".join(table[b] for b in high))
