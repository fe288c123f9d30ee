"""Language identification, words first, then shorter and shorter n-grams.

The model holds the frequency of every word and of the character n-grams of
one to five letters per language, learned from a bounded sample of labelled
rows.  A word of the model is scored by its log frequencies; any other word
by those of its longest n-grams of which the model knows one.  The sums over
all words of a text decide.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.arrays import U64, Rolling, mix, runs
from corpusloom.llm.common import arrow_schema, free_names

MAX_GRAM = 5
#: Expected number of labelled rows that the classifier is fitted on, at most.
SAMPLE_ROWS = 4_000
#: Expected rows of a language in the sample, at least (or all it has).
LEAST_ROWS = 50
SMOOTH = 0.5
CHUNK = 1 << 18
#: A text is in a known language if the model knows at least this share of its
#: words' n-grams, of four letters, or of two where a text of fewer than
#: ``FEW_LETTERS`` says little (a shorter word is one n-gram, a known word is all known).
KNOWN_SHARE = 0.5
KNOWN_GRAMS = (4, 2)
FEW_LETTERS = 100
PREDICTED = "doc_id long, lang_pred string, score double"


@functools.cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


@functools.cache
def _values() -> np.ndarray:
    return mix(np.arange(1, sys.maxunicode + 2, dtype=U64) * U64(0x2545F4914F6CDD1D))


def _pieces(text: str) -> Iterator[str]:
    """A text in pieces of at least ``CHUNK`` characters that end before a non-letter."""
    at = 0
    while at < len(text):
        cut = min(at + CHUNK, len(text))
        while cut < len(text) and text[cut].isalpha():
            cut += 1
        yield text[at:cut]
        at = cut


def _batches(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Row numbers and texts, together about ``CHUNK`` characters at a time; a
    long text comes in pieces."""
    rows, held, size = [], [], 0
    for r, t in enumerate(texts):
        for p in _pieces(t) if len(t) > 2 * CHUNK else (t,):
            rows.append(r)
            held.append(p)
            size += len(p)
            if size >= CHUNK:
                yield rows, held
                rows, held, size = [], [], 0
    if held:
        yield rows, held


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, Rolling]:
    """Text number, start and end of each word, and the rolling hash."""
    lower = [t.lower() for t in texts]
    symbols = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in lower])])
    start, end = runs(_letters()[symbols], offsets[:-1])
    return np.searchsorted(offsets, start, "right") - 1, start, end, Rolling(symbols, _values())


def _grams(start: np.ndarray, end: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Word number and start of each n-gram of the words."""
    count = np.maximum(end - start - n + 1, 0)
    word = np.repeat(np.arange(len(start)), count)
    return word, np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count) + start[word]


def train(docs: DataFrame, labelled: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
          sample_rows: int = SAMPLE_ROWS) -> "Model":
    """Fit on the rows where ``labelled`` holds and the language is not null:
    all of them, or a sample of ``sample_rows`` (expected) chosen by a hash of
    the id, but at least ``LEAST_ROWS`` of each language.  N-gram counts are summed in Spark; the model's size is bounded by
    the sample."""
    rows = docs.where(labelled & F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull())
    lang = F.col(f"`{lang_col}`").cast("string")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy(lang.alias("lang")).count().collect()}  # one row per language
    langs, total = sorted(sizes), sum(sizes.values())
    # 40 bits of a hash against the share of the language
    share = F.coalesce(*[F.when(lang == x, F.lit(int(min(1.0, max(sample_rows / total, LEAST_ROWS / sizes[x])) * (1 << 40)))) for x in langs],
                       F.lit(0))
    rows = rows.where(F.pmod(F.xxhash64(F.col(f"`{id_col}`").cast("string")), F.lit(1 << 40)) < share).select(
        lang.alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = (c.to_pylist() for c in batch.columns)
            for lang in sorted(set(langs)):
                for _, held in _batches([t for t, x in zip(texts, langs) if x == lang]):
                    _, start, end, rolling = _words(held)
                    for n in range(MAX_GRAM + 1):
                        s = start if n == 0 else _grams(start, end, n)[1]
                        h, c = np.unique(rolling(s, end if n == 0 else s + n), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(np.full(len(h), n, np.int32)), pa.array(h.astype(np.int64)), pa.array(c.astype(np.int64))], names=["lang", "size", "hash", "count"])

    counts = (rows.mapInArrow(count, "lang string, size int, hash long, count long")
              .groupBy("lang", "size", "hash").agg(F.sum("count").alias("count")))
    number = F.coalesce(*[F.when(F.col("lang") == x, F.lit(k)) for k, x in enumerate(langs)], F.lit(-1)).cast("int")
    return Model(langs, counts.select(number.alias("lang"), F.col("size").cast("tinyint"), "hash", F.col("count").cast("int")).toArrow())


class Model:
    """Log frequencies: for words (size 0) and n-grams, sorted hashes and one
    column per language."""

    def __init__(self, langs: list[str], counts):
        self.langs = langs
        lang, size, hashes, count = (counts.column(c).to_numpy() for c in ("lang", "size", "hash", "count"))
        words = np.bincount(lang[size == 0], weights=count[size == 0], minlength=len(self.langs))
        self.keys, self.logs = [], []
        for n in range(MAX_GRAM + 1):
            at = size == n
            keys, place = np.unique(hashes[at].view(U64), return_inverse=True)
            table = np.full((len(keys), len(self.langs)), SMOOTH)
            np.add.at(table, (place, lang[at]), count[at])
            # per word of the language, also for n-grams that a language hardly has
            self.keys.append(keys)
            self.logs.append(np.log(table / (words + SMOOTH * max(len(keys), 1))).astype(np.float32))
        #: For texts whose words say nothing.
        self.usual = int(np.argmax(words)) if self.langs else -1

    def _known(self, n: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.keys[n]
        if not len(keys):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return keys[at] == hashes, at

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sum of the words' scores per text and language, per text the number
        of words, of letters, and of n-grams and known ones of each of ``KNOWN_GRAMS``)"""
        text, start, end, rolling = _words(texts)
        distinct, first, back = np.unique(rolling(start, end), return_index=True, return_inverse=True)
        known, at = self._known(0, distinct)
        of = np.zeros((len(distinct), len(self.langs)), np.float32)
        of[known] = self.logs[0][at[known]]
        rest = np.flatnonzero(~known)
        size = (end - start)[first]
        counts = [np.ones(len(distinct)), size]
        for n in KNOWN_GRAMS:
            counts += self._shares(n, start[first], end[first], rolling, rest)
        for n in range(MAX_GRAM, 0, -1):
            if not len(rest):
                break
            word, s = _grams(start[first[rest]], end[first[rest]], n)
            hit, at = self._known(n, rolling(s, s + n))
            word, at = word[hit], at[hit]
            times = np.bincount(word, minlength=len(rest))
            done = times > 0
            for k in range(len(self.langs)):
                total = np.bincount(word, weights=self.logs[n][at, k], minlength=len(rest))
                of[rest[done], k] = (total[done] / times[done])
            rest = rest[~done]
        sums = np.stack([np.bincount(text, weights=of[back, k], minlength=len(texts)) for k in range(len(self.langs))], 1)
        return sums, np.stack([np.bincount(text, weights=c[back], minlength=len(texts)) for c in counts], 1)

    def _shares(self, n: int, start: np.ndarray, end: np.ndarray, rolling: Rolling, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of n-grams of each word, and of those known; ``rest`` are the unknown words."""
        number = np.maximum(end - start - n + 1, 1)
        hits = number.copy()
        hits[rest] = 0
        word, s = _grams(start[rest], end[rest], n)
        hits[rest] += np.bincount(word[self._known(n, rolling(s, s + n))[0]], minlength=len(rest))
        for m in range(1, n):
            short = rest[(end - start)[rest] == m]
            hits[short] = self._known(m, rolling(start[short], end[short]))[0]
        return number, hits

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, posterior under equal priors, whether the text is in a
        known language) per text; ``und`` and 0 for null, texts without a letter,
        or a model of no language."""
        sums, counts = np.zeros((len(texts), len(self.langs))), np.zeros((len(texts), 2 + 2 * len(KNOWN_GRAMS)))
        if self.langs:
            for rows, held in _batches([t or "" for t in texts]):
                s, c = self.scores(held)
                np.add.at(sums, rows, s)
                np.add.at(counts, rows, c)
        out = []
        for s, (words, letters, *grams) in zip(sums, counts):
            number, hits = grams[2:] if letters < FEW_LETTERS else grams[:2]
            known = bool(words and hits >= KNOWN_SHARE * number)
            if not words:
                out.append(("und", 0.0, known))
            elif np.ptp(s) == 0:
                out.append((self.langs[self.usual], 1 / len(self.langs), known))
            else:
                best = int(np.argmax(s))
                out.append((self.langs[best], float(1 / np.exp(s - s[best]).sum()), known))
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, posterior) per text, as ``judge`` has them."""
        return [(lang, score) for lang, score, _ in self.judge(texts)]


def predict(docs: DataFrame, model: Model, columns: dict[str, Column], text_col: str = "text",
            names: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """``columns`` of ``docs``, then the language of the whole text and its
    score under ``names``, and whether it is in a known language if there is a
    third name.  Ties go to the language that sorts first."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    whole, = free_names(docs, "_text")
    picked = docs.select(F.col(f"`{text_col}`").cast("string").alias(whole), *(c.alias(n) for n, c in columns.items()))
    schema = T.StructType([*picked.schema.fields[1:], *(T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType())))])
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = zip(*held.value.judge(batch.column(0).to_pylist())) if batch.num_rows else ((), (), ())
            cols = [*batch.columns[1:], *(pa.array(x, t) for x, t, _ in zip(found, (pa.string(), pa.float64(), pa.bool_()), names))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, target)], schema=target)

    return picked.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that never train: a quarter by the checksum of the id."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` for every row of
    ``docs``, learned from its labelled rows that are not held out.

    Null texts and those without a letter are ``und`` with score 0, as is all
    when no row is labelled.  A null id is not held out.  Repeated rows are
    predicted each; empty input gives no rows; other columns are ignored."""
    model = train(docs, ~held_out() & F.col("doc_id").isNotNull(), sample_rows=sample_rows)
    return predict(docs, model, {"doc_id": F.col("doc_id").cast("long"), "held_out": held_out()})


def accept(docs: DataFrame, min_score: float = 0.0, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` in a known language (and at least ``min_score``, if given:
    short texts of shared words can score low); same columns.  Texts without a
    letter go, and those of whose n-grams the model knows less than
    ``KNOWN_SHARE``: another language or script, or no language.  All stay when
    no row has a label to learn from."""
    model = train(docs, ~held_out() & F.col("doc_id").isNotNull(), sample_rows=sample_rows)
    if not model.langs:
        return docs
    names = tuple(free_names(docs, "lang_pred", "score", "known"))
    found = predict(docs, model, {c: F.col(f"`{c}`") for c in docs.columns}, names=names)
    return found.where((F.col(names[0]) != "und") & F.col(names[2]) & (F.col(names[1]) >= min_score)).drop(*names)
