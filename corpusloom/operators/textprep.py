"""Text preparation for models (K-03..K-08, K-11, A-19, F-09, X-01..X-04).

Token sequences come from the default tokenizer expression; "decoding" a
token window joins its tokens with single spaces (no sub-word merges are
available offline).  Whole documents are processed; windows and blocks are
array slices computed per row, and packing moves array slices - never single
tokens - through the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import WS_CLASS_JVM, collapse_ws, jvm_re, py_strip, remove_literals
from corpusloom.functions.tokens import token_spans, tokens
from corpusloom.operators.prefix import ordered_prefix


def clean_posts(df: DataFrame, text_col: str = "text", min_length: int = 1) -> DataFrame:
    """K-08 (whitespace part) + X-01 + X-03 + X-04: collapse whitespace,
    then drop blank texts, the sentinel strings ``'null'`` and ``'-'``, and
    reposts starting with ``'RT @'``.  NULL text is dropped first (a bare
    ``<> 'null'`` test would also drop it, trap in X-03)."""
    # The predicates are evaluated on the raw text with cheap equivalents of
    # the tests on the collapsed text, so that pushing the filter below the
    # projection does not repeat the whitespace regex once per predicate:
    #   collapsed is blank        <=> no non-whitespace character
    #   collapsed == 'null' / '-' <=> stripped raw text == 'null' / '-'
    #   collapsed starts 'RT @'   <=> stripped raw text matches ^RT<ws>+@
    raw = F.col(text_col)
    stripped = py_strip(raw)
    keep = (F.coalesce(raw.rlike(jvm_re(f"[^{WS_CLASS_JVM}]")), F.lit(False))
            & (stripped != "null") & (stripped != "-") & ~stripped.rlike(jvm_re(f"^RT[{WS_CLASS_JVM}]+@")))
    if min_length > 1:
        keep = keep & (F.length(py_strip(collapse_ws(raw))) >= min_length)
    return df.where(keep).withColumn(text_col, collapse_ws(text_col))


def fixed_windows(df: DataFrame, key_col: str, text_col: str = "text", window: int = 512) -> DataFrame:
    """K-03: consecutive non-overlapping windows of ``window`` tokens, cut
    verbatim from the text (surrounding white space stripped) whatever its
    length.  Texts without a token have no window.  One output row per window:
    (key, chunk_id, chunk_text, n_tokens)."""
    # the spans are materialised first: lambdas must reference a column,
    # or the tokenizer would run once per window
    base = df.select(key_col, token_spans(text_col).alias("_sp")).where(F.size("_sp") > 0)
    sp = F.col("_sp")
    starts = F.sequence(F.lit(1), F.size(sp), F.lit(window))
    chunks = F.transform(starts, lambda s: F.slice(sp, s, window))
    out = base.select(key_col, F.posexplode(chunks).alias("chunk_id", "_c"))
    return out.select(key_col, "chunk_id", py_strip(F.array_join("_c", "")).alias("chunk_text"), F.size("_c").alias("n_tokens"))


def overlap_windows(df: DataFrame, key_col: str, label_col: str, text_col: str = "text",
                    max_length: int = 512, overlap: int = 50) -> DataFrame:
    """K-04: overlapping windows of ``max_length - 2`` tokens with step
    ``size - overlap``, each carrying the row label, cut verbatim from the
    text; the last window is the first that reaches the end of the text.  A
    text without tokens keeps one (empty or NULL) window."""
    size = max_length - 2
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than max_length - 2")
    base = df.select(key_col, label_col, text_col, token_spans(text_col).alias("_sp"))
    sp = F.col("_sp")
    n = F.size(sp)
    k = F.greatest(F.ceil((n - size) / F.lit(step)).cast("int"), F.lit(0)) + 1
    starts = F.sequence(F.lit(0), (k - 1) * step, F.lit(step))
    chunks = F.when(n > 0, F.transform(starts, lambda s: F.array_join(F.slice(sp, s + 1, size), ""))) \
        .otherwise(F.array(F.col(text_col)))
    out = base.select(key_col, label_col, F.posexplode(chunks).alias("chunk_id", "_c"))
    return out.select(key_col, label_col, "chunk_id", py_strip("_c").alias("chunk_text"))


def pad_truncate(df: DataFrame, key_col: str, text_col: str = "text", max_length: int = 512,
                 pad: str = "[PAD]") -> DataFrame:
    """K-06: truncate/pad the token sequence to ``max_length`` with an
    attention mask (1 for real tokens, 0 for padding)."""
    tk = F.coalesce(tokens(text_col), F.array().cast("array<string>"))
    base = df.select(key_col, F.slice(tk, 1, max_length).alias("_kept"))
    kept = F.col("_kept")
    n_pad = F.lit(max_length) - F.size(kept)
    padded = F.concat(kept, F.array_repeat(F.lit(pad), n_pad))
    mask = F.concat(F.array_repeat(F.lit(1), F.size(kept)), F.array_repeat(F.lit(0), n_pad))
    return base.select(key_col, padded.alias("input_tokens"), mask.alias("attention_mask"))


def pack_blocks(df: DataFrame, order_col: str, text_col: str = "text", block_size: int = 512,
                scope_col: str | None = None) -> DataFrame:
    """K-05 + W-08 (trap T-20): concatenate token sequences in ``order_col``
    order and cut them into ``block_size`` blocks, over the whole input or per
    value of ``scope_col`` (NULL is a scope of its own).  The last block of a
    scope may be short: tokens out = tokens in.

    Plan: token offsets come from :func:`ordered_prefix` (no global window)
    over a narrow (scope, order, n) table; every row emits one token slice per
    block it overlaps; blocks are assembled by grouping those slices (at most
    ``block_size`` tokens per group).  Texts are joined to their offsets
    before they are tokenised, so no token array is shuffled whole.
    ``order_col`` must identify a row within its scope."""
    scope = F.lit(0) if scope_col is None else F.col(scope_col)
    b = F.lit(block_size)
    base = df.select(scope.alias("_scope"), F.col(order_col).alias("_ord"), F.col(text_col).alias("_text"))
    narrow = base.select("_scope", "_ord", F.size(tokens("_text")).alias("_n")).where(F.col("_n") > 0)
    start = ordered_prefix(narrow, ["_ord"], "_n", out="_start", partition_cols=["_scope"], inclusive=False, materialize=True)
    start = start.select(F.col("_scope").alias("_s2"), F.col("_ord").alias("_o2"), "_start", "_n")
    j = base.join(start, base["_scope"].eqNullSafe(start["_s2"]) & (base["_ord"] == start["_o2"])) \
        .select("_scope", "_start", "_n", tokens("_text").alias("_tk"))
    j = j.withColumn("block_id", F.explode(F.sequence(F.floor(F.col("_start") / b).cast("bigint"),
                                                      F.floor((F.col("_start") + F.col("_n") - 1) / b).cast("bigint"))))
    lo = F.greatest(F.col("block_id") * b - F.col("_start"), F.lit(0))
    hi = F.least((F.col("block_id") + 1) * b - F.col("_start"), F.col("_n"))
    piece = F.slice("_tk", (lo + 1).cast("int"), (hi - lo).cast("int"))
    pieces = j.select("_scope", "block_id", F.struct(F.col("_start").alias("s"), piece.alias("p")).alias("pc"))
    blocks = pieces.groupBy("_scope", "block_id").agg(F.sort_array(F.collect_list("pc")).alias("_pcs"))
    out = blocks.select("_scope", "block_id", F.flatten(F.col("_pcs.p")).alias("block_tokens")) \
        .withColumn("n_tokens", F.size("block_tokens"))
    return out.drop("_scope") if scope_col is None else out.withColumnRenamed("_scope", scope_col)


def align_labels(words_df: DataFrame, doc_col: str, pos_col: str, word_col: str, tag_col: str,
                 max_length: int = 512, ignore: int = -100) -> DataFrame:
    """K-07: sub-word label alignment.  Each word is split into pieces by the
    tokenizer; its first piece carries the word's tag, the other pieces get
    ``ignore``; [CLS]/[SEP] positions get ``ignore``.  A document longer than
    ``max_length`` (with the two special positions) goes on in further
    sequences, numbered by ``part``: every word keeps its label."""
    pieces = tokens(word_col)
    lab = F.transform(pieces, lambda _p, i: F.when(i == 0, F.col(tag_col)).otherwise(F.lit(ignore)))
    per_word = words_df.select(doc_col, F.struct(F.col(pos_col).alias("pos"), lab.alias("l")).alias("w"))
    g = per_word.groupBy(doc_col).agg(F.sort_array(F.collect_list("w")).alias("_ws"))
    g = g.select(doc_col, F.flatten(F.col("_ws.l")).alias("_l")).where(F.size("_l") > 0)
    size = max_length - 2
    parts = F.transform(F.sequence(F.lit(1), F.size("_l"), F.lit(size)), lambda s: F.slice("_l", s, size))
    g = g.select(doc_col, F.posexplode(parts).alias("part", "_b"))
    return g.select(doc_col, "part", F.concat(F.array(F.lit(ignore)), "_b", F.array(F.lit(ignore))).alias("labels"))


def row_label_mode(df: DataFrame, key_col: str, labels_col: str, ignore: int = -100,
                   default: int = 0) -> DataFrame:
    """A-19: most frequent label of each row's label array, ignoring
    ``ignore``; ties go to the label seen first (trap T-15); rows with no
    valid label get ``default``.  Counting is an aggregate per (row, label);
    the pick is ``max(struct(count, -first_pos, label))`` per row."""
    ex = df.select(key_col, F.posexplode(labels_col).alias("pos", "lab")).where(F.col("lab") != ignore)
    c = ex.groupBy(key_col, "lab").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    best = c.groupBy(key_col).agg(F.max(F.struct("n", (-F.col("first")).alias("nf"), "lab")).alias("b"))
    out = df.select(key_col).join(best, key_col, "left")
    return out.select(key_col, F.coalesce(F.col("b.lab"), F.lit(default)).alias("label_mode"))


# --- fixed values: literal banner removed after conversion (F-09) -----------
PATENT_BANNER = ["# US Patent & Trademark Office Patent Public Search | Text View\n\n",
                 "# US Patent & Trademark Office Patent Public Search | Text View"]
# HTML entities decoded by html_to_text, in application order (&amp; last)
HTML_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                 ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def _re(c: Column, pattern: str, repl: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(repl))


def html_to_text(c, banner: list[str] | None = None) -> Column:
    """K-11 + F-09: HTML to Markdown-like text with a chain of JVM regular
    expressions: scripts, styles and comments dropped; ``h1..h6`` become
    ``#`` headings; list items ``*``; links ``[text](url)``; ``br`` and
    paragraphs line breaks; other tags removed; entities decoded; blank
    space normalised; a banner literal removed."""
    x = F.col(c) if isinstance(c, str) else c
    x = _re(x, r"(?is)<head\b[^>]*>.*?</head>", "")
    x = _re(x, r"(?is)<script\b[^>]*>.*?</script>", "")
    x = _re(x, r"(?is)<style\b[^>]*>.*?</style>", "")
    x = _re(x, r"(?s)<!--.*?-->", "")
    for n in range(1, 7):
        x = _re(x, rf"(?is)<h{n}\b[^>]*>(.*?)</h{n}>", "\n" + "#" * n + " $1\n")
    x = _re(x, r"(?is)<li\b[^>]*>(.*?)</li>", "\n* $1")
    x = _re(x, r'(?is)<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>', "[$2]($1)")
    x = _re(x, r"(?i)<br\s*/?>", "\n")
    x = _re(x, r"(?i)</?p\b[^>]*>", "\n\n")
    # block tags part the words of their neighbours
    x = _re(x, r"(?i)</?(?:div|section|article|header|footer|nav|main|aside|table|tr|ul|ol|form|body)\b[^>]*>", "\n")
    x = _re(x, r"(?i)</?(?:td|th)\b[^>]*>", " ")
    x = _re(x, r"<[^>]+>", "")
    for ent, ch in HTML_ENTITIES:
        x = F.replace(x, F.lit(ent), F.lit(ch))
    x = _re(x, r"[ \t]+", " ")
    x = _re(x, r" ?\n ?", "\n")
    x = _re(x, r"\n{3,}", "\n\n")
    x = py_strip(x)
    return remove_literals(x, banner if banner is not None else PATENT_BANNER)
