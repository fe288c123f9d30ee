"""Sub-word tokens with ids and character offsets (K-01, K-06, K-07).

A vocabulary becomes a trie, and every word is cut greedily into the longest
pieces that the vocabulary has.  Words come from the default tokenizer
expression on the JVM; Arrow batches of them are cut in Python, some rows at a
time and each distinct word of these once, and leave as Arrow arrays of integers:
no token or piece of a batch is a Python object.  Pieces carry the place of
their characters, so windows, padding and labels follow from columns.

Vocabularies mark either the pieces inside a word (``##ing``) or those that
end one (``ing</w>``); with ``byte_level`` they are written in the printable
characters that stand for the 256 bytes.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.arrays import list_sizes, row_slices
from corpusloom.functions.tokens import token_spans, tokens

PIECE = "array<struct<id:int,start:int,end:int,word:int>>"
_PIECE = pa.list_(pa.struct([("id", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("word", pa.int32())]))
#: Words cut in a task that are remembered, at most.
MEMORY = 1 << 17
#: Tokens cut at once, but for those of a single row.
AT_ONCE = 1 << 16


@functools.cache
def byte_letters() -> list[str]:
    """The character that stands for each byte: itself where it is printable,
    the others in their order from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def lowered(word: str) -> str:
    """Lower case that keeps the number of characters."""
    low = word.lower()
    return low if len(low) == len(word) else "".join(c.lower() if len(c.lower()) == 1 else c for c in word)


class PieceTrie:
    """The pieces of a vocabulary by their characters.  A node maps the next
    character to a node; ``MID`` and ``END`` hold the id of the piece that ends
    there inside a word and at its end."""

    MID, END = 0, 1

    def __init__(self, vocab: dict[str, int], unknown: int, continuation: str = "##", word_end: str = "", lowercase: bool = True,
                 byte_level: bool = False):
        self.unknown, self.lowercase, self.byte_level = unknown, lowercase, byte_level
        self.first: dict = {}
        self.inner = self.first if word_end else {}
        for piece, number in vocab.items():
            if word_end:
                ends = piece.endswith(word_end) and len(piece) > len(word_end)
                self._add(self.first, piece[:-len(word_end)] if ends else piece, number, ends, not ends)
            elif continuation and piece.startswith(continuation) and len(piece) > len(continuation):
                self._add(self.inner, piece[len(continuation):], number, True, True)
            else:
                self._add(self.first, piece, number, True, True)
        self.known: dict[str, list[tuple[int, int, int]]] = {}

    def _add(self, node: dict, letters: str, number: int, end: bool, mid: bool) -> None:
        for c in letters:
            node = node.setdefault(c, {})
        if end:
            node[self.END] = number
        if mid:
            node[self.MID] = number

    def cut(self, word: str) -> list[tuple[int, int, int]]:
        """(id, start, end) of the pieces of ``word``; a word with a part that
        the vocabulary lacks is one unknown piece."""
        if (found := self.known.get(word)) is None:
            if len(self.known) >= MEMORY:
                self.known.clear()
            found = self.known[word] = self._cut(word)
        return found

    def _cut(self, word: str) -> list[tuple[int, int, int]]:
        text = lowered(word) if self.lowercase else word
        if self.byte_level:
            letters = byte_letters()
            place = [i for i, c in enumerate(text) for _ in c.encode("utf-8", "surrogatepass")]
            text = "".join(letters[b] for b in text.encode("utf-8", "surrogatepass"))
        at, out, node = 0, [], self.first
        while at < len(text):
            best, k = None, at
            while k < len(text) and (node := node.get(text[k])) is not None:
                k += 1
                number = node.get(self.END if k == len(text) else self.MID)
                if number is not None:
                    best = (number, at, k)
            if best is None:
                return [(self.unknown, 0, len(word))]
            out.append(best)
            at, node = best[2], self.inner
        if self.byte_level:
            out = [(n, place[a], place[b - 1] + 1) for n, a, b in out]
        return out


def _before(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _cut_tokens(trie: PieceTrie, tokens_: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token of each piece, the pieces' (id, start, end) and the tokens' lengths."""
    coded = tokens_.dictionary_encode()
    words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    cut = [trie.cut(w.rstrip()) for w in words]
    n = np.fromiter(map(len, cut), np.int64, len(cut))
    parts = np.array([x for c in cut for x in c], np.int32).reshape(-1, 3)
    k = n[codes]
    owner = np.repeat(np.arange(len(codes)), k)
    at = np.arange(len(owner)) + np.repeat(_before(n)[codes] - _before(k), k)
    return owner, parts[at], np.fromiter(map(len, words), np.int64, len(words))[codes]


def _piece_lists(rows: np.ndarray, n_rows: int, *fields: np.ndarray) -> pa.Array:
    """Pieces in the order of their ``rows`` as one list a row."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n_rows))]).astype(np.int32)
    arrays = [pa.array(f.astype(np.int32)) for f in fields]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(arrays, fields=list(_PIECE.value_type)))


class _Vocabulary:
    """What a worker needs to cut words; it builds the trie once."""

    def __init__(self, vocab: dict[str, int], unknown: int, options: dict):
        self.vocab, self.unknown, self.options = vocab, unknown, options

    @functools.cached_property
    def trie(self) -> PieceTrie:
        return PieceTrie(self.vocab, self.unknown, **self.options)


class Subwords:
    """Column functions over one vocabulary, which is sent to the executors
    once: its size is that of the vocabulary file, not of the data."""

    def __init__(self, spark: SparkSession, vocab: dict[str, int], unknown: str | int = "[UNK]", **options):
        number = vocab[unknown] if isinstance(unknown, str) else unknown
        self.spec = spark.sparkContext.broadcast(_Vocabulary(vocab, number, options))

    @classmethod
    def from_json(cls, spark: SparkSession, path: str, unknown: str | int, **options) -> "Subwords":
        """The vocabulary of a tokenizer file (``model.vocab``); ``path`` is read on the driver."""
        with open(path, encoding="utf-8") as f:
            return cls(spark, json.load(f)["model"]["vocab"], unknown, **options)

    @classmethod
    def from_lines(cls, spark: SparkSession, path: str, unknown: str = "[UNK]", **options) -> "Subwords":
        """A vocabulary file of one piece a line; the id is the line's number from 0."""
        with open(path, encoding="utf-8") as f:
            return cls(spark, {p.rstrip("\n"): i for i, p in enumerate(f)}, unknown, **options)

    def _udf(self, run: Callable) -> Callable:
        spec = self.spec

        def cut(lists: pa.Array, *others: pa.Array) -> pa.Array:
            done = [run(spec.value.trie, *(c.slice(a, b - a) for c in (lists, *others))) for a, b in row_slices(list_sizes(lists), AT_ONCE)]
            return pa.concat_arrays(done) if done else pa.array([], _PIECE)

        return F.arrow_udf(cut, PIECE)

    def pieces(self, text) -> Column:
        """The pieces of a text: ``id``, ``start`` and ``end`` in its characters,
        ``word`` (its number).  NULL text has none."""
        text = F.col(text) if isinstance(text, str) else text

        def run(trie: PieceTrie, spans: pa.Array, lengths: pa.Array) -> pa.Array:
            n = list_sizes(spans)
            row, first = np.repeat(np.arange(len(n)), n), _before(n)
            owner, parts, size = _cut_tokens(trie, spans.flatten())
            ends = np.concatenate([[0], np.cumsum(size)])
            # the spans end where the text does; white space may come before them
            at = (lengths.fill_null(0).to_numpy(zero_copy_only=False) - ends[first + n])[row] + ends[:-1]
            word = np.arange(len(row)) - first[row]
            return _piece_lists(row[owner], len(n), parts[:, 0], parts[:, 1] + at[owner], parts[:, 2] + at[owner], word[owner])

        return self._udf(run)(token_spans(text), F.length(text))

    def word_pieces(self, words) -> Column:
        """The pieces of an array of words; ``start`` and ``end`` are places in
        the word."""
        def run(trie: PieceTrie, rows: pa.Array) -> pa.Array:
            n, by_word = list_sizes(rows), rows.flatten()
            m = list_sizes(by_word)
            row, word = np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)
            owner, parts, size = _cut_tokens(trie, by_word.flatten())
            before = _before(size)
            at = before - before[np.minimum(_before(m), max(len(before) - 1, 0))][word] if len(before) else before
            of = word[owner]
            return _piece_lists(row[of], len(n), parts[:, 0], parts[:, 1] + at[owner], parts[:, 2] + at[owner], (np.arange(len(row)) - _before(n)[row])[of])

        return self._udf(run)(F.transform(words, lambda w: tokens(w)))


def subword_count(sub: Subwords, text, special_tokens: int = 0) -> Column:
    """K-01: number of pieces plus ``special_tokens`` (trap T-19)."""
    return (F.size(sub.pieces(text)) + F.lit(special_tokens)).cast("bigint")


def pad_truncate_subwords(df: DataFrame, sub: Subwords, key_col: str, text_col: str = "text", max_length: int = 512, pad: int = 0,
                          first: int | None = None, last: int | None = None) -> DataFrame:
    """K-06: ids cut and padded to ``max_length`` with an attention mask, between
    the ids ``first`` and ``last`` if given, and the number of characters of the
    text that the ids cover."""
    head, tail = (F.array(*([] if x is None else [F.lit(x)])).cast("array<int>") for x in (first, last))
    room = max_length - (first is not None) - (last is not None)
    base = df.select(key_col, F.slice(sub.pieces(text_col), 1, room).alias("_p"))
    kept = F.concat(head, F.col("_p.id"), tail)
    n_pad = F.lit(max_length) - F.size(kept)
    return base.select(key_col, F.concat(kept, F.array_repeat(F.lit(pad), n_pad)).alias("input_ids"),
                       F.concat(F.array_repeat(F.lit(1), F.size(kept)), F.array_repeat(F.lit(0), n_pad)).alias("attention_mask"),
                       F.coalesce(F.array_max("_p.end"), F.lit(0)).alias("n_chars_covered"))


def align_labels_subwords(words_df: DataFrame, sub: Subwords, doc_col: str, pos_col: str, word_col: str, tag_col: str,
                          max_length: int = 512, ignore: int = -100) -> DataFrame:
    """K-07: labels of the pieces of each word.  The first piece of a word (two
    pieces may share a character of several bytes) carries its tag, the others ``ignore``, as do the two special
    positions around a sequence.  Longer documents go on in further sequences,
    numbered by ``part``; ``input_ids`` holds the pieces of the sequence."""
    per = words_df.groupBy(doc_col).agg(F.sort_array(F.collect_list(F.struct(F.col(pos_col).alias("pos"), F.col(word_col).alias("w"),
                                                                             F.col(tag_col).alias("t")))).alias("_ws"))
    cut = per.select(doc_col, F.col("_ws.t").alias("_t"), sub.word_pieces(F.col("_ws.w")).alias("_p"))
    first = lambda p, i: (i == 0) | (F.get(F.col("_p"), i - 1)["word"] != p["word"])
    labels = F.transform("_p", lambda p, i: F.struct(p["id"].alias("id"), F.when(first(p, i), F.get(F.col("_t"), p["word"]))
                                                     .otherwise(F.lit(ignore)).alias("label")))
    size = max_length - 2
    cut = cut.select(doc_col, labels.alias("_l"))
    # no filter on the pieces: it would sink below the cutting, and every word be cut for it once more
    parts = F.when(F.size("_l") > 0, F.transform(F.sequence(F.lit(1), F.size("_l"), F.lit(size)), lambda s: F.slice("_l", s, size)))
    out = cut.select(doc_col, F.posexplode(parts).alias("part", "_b"))
    edge = F.array(F.lit(ignore))
    return out.select(doc_col, "part", F.col("_b.id").alias("input_ids"), F.concat(edge, F.col("_b.label"), edge).alias("labels"))
