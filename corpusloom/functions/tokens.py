"""Tokenizer contract (K-01) as a JVM-side expression.

No pretrained sub-word tokenizer files are available offline, so the default
tokenizer is a regular expression: runs of letters/digits, or any single
other non-whitespace character.  The same pattern runs in RE2, so counts can
be checked by an independent SQL engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import ALNUM_CLASS, WS_CLASS, WS_CLASS_JVM, jvm_re

# fixed value: the default token pattern (RE2 / explicit form, used by the
# SQL oracle) and its JVM form (same character sets, faster on the JVM)
TOKEN_PATTERN = f"[{ALNUM_CLASS}]+|[^{ALNUM_CLASS}{WS_CLASS}]"
TOKEN_PATTERN_JVM = jvm_re(f"[{ALNUM_CLASS}]+|[^{ALNUM_CLASS}{WS_CLASS_JVM}]")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text, lowercase: bool = False) -> Column:
    """Token array of a text column (NULL text -> NULL)."""
    t = F.lower(_c(text)) if lowercase else _c(text)
    return F.regexp_extract_all(t, F.lit(TOKEN_PATTERN_JVM), F.lit(0))


def token_spans(text) -> Column:
    """Each token with the white space after it: joined by nothing they are
    the text again, but for white space at its start."""
    return F.regexp_extract_all(_c(text), F.lit(f"(?:{TOKEN_PATTERN_JVM})[{WS_CLASS_JVM}]*"), F.lit(0))


def token_count(text, special_tokens: int = 0) -> Column:
    """K-01: number of tokens plus ``special_tokens`` per document (trap T-19:
    the reference counts tokenizer special tokens in totals).  NULL text
    counts 0 tokens."""
    return (F.coalesce(F.size(tokens(text)), F.lit(0)) + F.lit(special_tokens)).cast("bigint")
