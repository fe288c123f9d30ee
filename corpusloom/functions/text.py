"""Text column expressions (F-01..F-10, K-08 whitespace part).

All functions return ``Column`` expressions evaluated JVM-side (whole-stage
codegen), never Python UDFs.  Regular expressions use only constructs that
Java regex and RE2 interpret identically, so the same pattern text can be
used by an independent SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Python's str.isspace() characters (what str.split()/str.strip() treat as
# whitespace): U+0009..U+000D, U+001C..U+001F, U+0020, U+0085, U+00A0,
# U+1680, U+2000..U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
            "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
            "\u2028\u2029\u202f\u205f\u3000")
# The same set as a regex character-class body (Java regex and RE2 syntax).
WS_CLASS = (r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
# JVM form of the same set: with the (?U) flag, Java's \s is Unicode
# White_Space, which equals Python's set minus U+001C..U+001F.  About 2.5x
# faster than the explicit class.  Use inside a pattern that starts with
# (?U) (see ``jvm_re``); the explicit class above is kept for RE2.
WS_CLASS_JVM = r"\s\x1C-\x1F"
# Letters and digits (Python str.isalnum, per code point).
ALNUM_CLASS = r"\p{L}\p{N}"
# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def jvm_re(pattern: str) -> str:
    """Prefix a JVM regex with the Unicode-classes flag (for WS_CLASS_JVM)."""
    return "(?U)" + pattern


def py_strip(c) -> Column:
    """F-02: strip Python whitespace at both ends (Spark ``trim`` strips
    spaces only)."""
    return F.btrim(_c(c), F.lit(WS_CHARS))


def collapse_ws(c) -> Column:
    """F-03: ``' '.join(s.split())`` - runs of whitespace become one space,
    ends stripped."""
    return py_strip(F.regexp_replace(_c(c), F.lit(jvm_re(f"[{WS_CLASS_JVM}]+")), F.lit(" ")))


def split_words(c) -> Column:
    """F-04: ``s.split()`` - whitespace split with no empty tokens."""
    return F.filter(F.split(_c(c), jvm_re(f"[{WS_CLASS_JVM}]+")), lambda x: x != F.lit(""))


def alnum_only(c) -> Column:
    """F-05: keep letters and digits only (``''.join(ch for ch in w if
    ch.isalnum())``)."""
    return F.regexp_replace(_c(c), F.lit(f"[^{ALNUM_CLASS}]"), F.lit(""))


def clean_word_list(c) -> Column:
    """The non-empty words of :func:`clean_words`, computed on the whole text:
    removing every character that is neither a letter/digit nor whitespace
    and then splitting gives the same non-empty cleaned words as splitting
    first and cleaning each word, without a per-word (interpreted) lambda.
    Words made only of punctuation - which clean to '' - are not returned."""
    kept = F.regexp_replace(F.lower(_c(c)), F.lit(jvm_re(f"[^{ALNUM_CLASS}{WS_CLASS_JVM}]")), F.lit(""))
    return split_words(kept)


def contains_term(text_lower, term: str) -> Column:
    """F-06: substring test on already lower-cased text.  ``term`` is used
    verbatim (edge spaces are significant)."""
    return F.contains(_c(text_lower), F.lit(term))


def year_part(c) -> Column:
    """F-07: first ``-``-separated part of a date string."""
    return F.split_part(_c(c), F.lit("-"), F.lit(1))


def valid_year(y, mode: str = "len4_2") -> Column:
    """X-08/X-09 (trap T-10): three validity rules used by the reference.

    * ``len4``    string of length 4
    * ``len4_2``  string of length 4 starting with ``2``
    * ``notnull`` any non-null value
    """
    y = _c(y)
    if mode == "len4":
        return F.coalesce(F.length(y) == 4, F.lit(False))
    if mode == "len4_2":
        return F.coalesce((F.length(y) == 4) & y.startswith("2"), F.lit(False))
    if mode == "notnull":
        return y.isNotNull()
    raise ValueError(f"unknown year mode {mode!r}")


def year_int(y) -> Column:
    """P-16: year string/float to INT (``'2013'`` and ``'2013.0'`` both);
    unparsable values become NULL instead of failing under ANSI mode."""
    return _c(y).try_cast("double").try_cast("int")


def non_blank(c, min_length: int = 1) -> Column:
    """X-01: non-null text whose stripped length is at least ``min_length``."""
    return F.coalesce(F.length(py_strip(c)) >= min_length, F.lit(False))


def title_body(title, body) -> Column:
    """F-10: ``f"{title.strip()}\\n\\n{body.strip()}".strip()``."""
    return py_strip(F.concat(py_strip(title), F.lit("\n\n"), py_strip(body)))


def remove_literals(c, literals: list[str]) -> Column:
    """F-09: remove literal substrings, longest first so that a banner which
    contains a shorter one is removed whole."""
    out = _c(c)
    for lit in sorted(literals, key=len, reverse=True):
        out = F.replace(out, F.lit(lit), F.lit(""))
    return out
