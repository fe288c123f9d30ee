"""BPE encoding by dynamic programming over prefixes, and decoding.

For a pre-token, an automaton over the vocabulary reports every token that
ends at each position.  The last token of a prefix's encoding is the one
whose pair with the last token of the prefix before it is compatible: no
merge across their border would have come before the merges that built the
two.  There is exactly one such token per prefix, so one pass stores it and
back-pointers give the exact ids, in time linear in the pre-token.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import TwoGenerations, arrow_schema

#: Stands for the end-of-word suffix inside the automaton; no byte-level symbol.
END = "\U0010fffd"
#: Entries of a generation of distinct words and of pre-tokens, words of a text
#: looked up at a time, and pairs of tokens: bounds of a Python worker's memory.
CACHE = 100_000
WORDS = 4_096
PAIRS = 250_000
#: Text in letters and signs up to U+017F, composed and of settled classes in every Unicode
#: table; without the white space beyond ASCII and the letter with two code points in lower case.
LATIN = re.compile(r"[\x00-\x7f\xa1-\u012f\u0131-\u017f]*").fullmatch
ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class BpeModel:
    """Vocabulary, merges and text rules of a ``tokenizers`` JSON file.

    Read are: the NFC, white-space and lower-case normalizers; a pre-tokenizer
    that keeps the matches of a pattern and maps bytes to symbols; a BPE model
    with an optional end-of-word suffix; and added special tokens.  Any other
    part is refused instead of being ignored."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")):
            raise ValueError(f"{path}: not a plain BPE model")
        if spec.get("post_processor") or spec.get("decoder"):
            raise ValueError(f"{path}: a post-processor or decoder is not supported")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.token_of = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens must be matched as they are")
        self.token_of |= {i: t for t, i in self.special.items()}
        self._normalizers(path, spec)
        self._pre_tokenizer(path, spec["pre_tokenizer"], regex)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

        # rank of the merge that makes a token, its two parts, and the token a pair merges to
        self.rank, self.parts, self.merged = {}, {}, {}
        vocab = model["vocab"]
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            if c in self.rank:
                raise ValueError(f"{path}: two merges make one token")
            self.rank[c], self.parts[c] = rank, (parts := (a, b))
            self.merged[parts] = rank
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            if i in self.rank or len(token.removesuffix(self.suffix) if self.suffix else token) == 1:
                word = token[:-len(self.suffix)] + END if self.suffix and token.endswith(self.suffix) else token
                self.automaton.add_word(word, (i, len(word)))
        self.automaton.make_automaton()
        self.n_ids, self.pairs = max(self.token_of) + 1, {}  # by left * n_ids + right: whether they are compatible

    def _normalizers(self, path: str, spec: dict) -> None:
        from tokenizers import Tokenizer

        rules = spec.get("normalizer") or {"type": "Sequence", "normalizers": []}
        kinds = [(n["type"], n.get("pattern"), n.get("content")) for n in rules.get("normalizers", [rules])]
        known = [("NFC", None, None), ("Replace", {"Regex": "\\s+"}, " "), ("Lowercase", None, None)]
        if any(k not in known for k in kinds):
            raise ValueError(f"{path}: unknown normalizer")
        self.lower = known[2] in kinds
        # for text beyond LATIN the library's Unicode tables hold; it needs no second copy of the vocabulary
        library = Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}}))
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer

    def _pre_tokenizer(self, path: str, spec: dict, regex) -> None:
        split, level = spec["pretokenizers"]
        if (split["type"], split["behavior"], split["invert"], level["type"], level["add_prefix_space"], level["use_regex"]) != ("Split", "Removed", True, "ByteLevel", False, False):
            raise ValueError(f"{path}: unknown pre-tokenizer")
        self.find = regex.compile(split["pattern"]["Regex"]).findall
        self.symbol = byte_symbols()

    # --- encoding ---

    def normalize(self, text: str) -> str:
        if text.isascii() or LATIN(text):
            return text.lower() if self.lower else text
        return self.normalizer.normalize_str(text) if self.normalizer else text

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a normalized text, as symbols of their bytes."""
        if (plain := text.isascii()) or LATIN(text):
            found = self.find(text)
            if plain and text.isprintable() and " " not in text:  # these bytes stand for themselves
                return found
            return ["".join(map(self.symbol.__getitem__, p.encode())) for p in found]
        return [p for p, _ in self.pre_tokenizer.pre_tokenize_str(text)]

    def encode_piece(self, symbols: str) -> list[int]:
        """Ids of one pre-token."""
        if self.suffix:
            symbols += END
        n = len(symbols)
        last, start, known, n_ids = [-1] * (n + 1), [0] * (n + 1), self.pairs, self.n_ids
        for end, (token, length) in self.automaton.iter(symbols):
            end += 1
            if last[end] >= 0:
                continue
            before = end - length
            if before:
                prev = last[before]
                if prev < 0:
                    continue
                fits = known.get(prev * n_ids + token)
                if fits is None:
                    fits = self.compatible(prev, token)
                    if len(known) >= PAIRS:
                        known.clear()
                    known[prev * n_ids + token] = fits
                if not fits:
                    continue
            last[end], start[end] = token, before
        if last[n] < 0:
            raise ValueError(f"no encoding of {symbols!r}")
        ids = []
        while n:
            ids.append(last[n])
            n = start[n]
        return ids[::-1]

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE over the two tokens' symbols gives just these two.

        The merges that built them are undone, latest first (by rank, and at
        equal rank the right one, as merges run from the left).  At each step
        the tokens at the border stood side by side until the undone merge; a
        merge of the two that comes earlier would have joined them."""
        bound, strict = len(self.parts), False  # a border merge before this rank (or at it, if not strict) is too early
        while True:
            across = self.merged.get((left, right))
            if across is not None and (across < bound or across == bound and not strict):
                return False
            rl, rr = self.rank.get(left, -1), self.rank.get(right, -1)
            if rl < 0 and rr < 0:
                return True
            if rl > rr:
                # a merge to the left of the border goes first at equal rank
                bound, strict, left = rl, True, self.parts[left][1]
            else:
                bound, strict, right = rr, False, self.parts[right][0]

    def decode(self, ids: list[int]) -> str:
        """Without a decoder the library joins the tokens by one space."""
        return " ".join([self.token_of[i] for i in ids])


def byte_symbols() -> list[str]:
    """Printable symbol of every byte: Latin-1 characters that print stand for
    themselves, the others follow from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class TextEncoder:
    """Encodes whole texts.  No pre-token spans white space, so the ids of
    distinct words between white space are kept (a bounded store), as one
    string each; the tokens follow from the ids."""

    def __init__(self, model: BpeModel):
        self.model, self.known, self.pieces = model, TwoGenerations(CACHE), TwoGenerations(CACHE)
        self.token_at = {str(i): t for i, t in model.token_of.items()}

    def __call__(self, text: str) -> tuple[int, str, str]:
        """(number of ids, ids joined by a space, decoded text)"""
        m = self.model
        if m.special_split and any(s in text for s in m.special):
            words = [x for p in m.special_split.split(text) for x in ([p] if p in m.special else split_words(p))]
        else:
            words = split_words(text)
        count, ids, tokens = 0, [], []
        for at in range(0, len(words), WORDS):
            found = " ".join(filter(None, self.known.lookup(words[at:at + WORDS], self._words)))
            if found:
                each = found.split(" ")
                count += len(each)
                ids.append(found)
                tokens.append(" ".join(map(self.token_at.__getitem__, each)))
        return count, " ".join(ids), " ".join(tokens)

    def _words(self, new: list[str]) -> list[str]:
        """Ids of each word, joined by a space."""
        m = self.model
        split = [() if w in m.special else m.pieces(m.normalize(w)) for w in new]
        ids = iter(self.pieces.lookup(list(itertools.chain.from_iterable(split)), self._pieces))
        return [str(m.special[w]) if w in m.special else " ".join(itertools.islice(ids, len(s))) for w, s in zip(new, split)]

    def _pieces(self, new: list[str]) -> list[str]:
        return [" ".join(map(str, self.model.encode_piece(p))) for p in new]


def split_words(text: str) -> list[str]:
    """Split at Unicode white space, which the four separators U+001C to
    U+001F are not (``str.split`` takes them for it)."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return re.split("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", text)
    return text.split()


_ENCODERS: dict[str, TextEncoder] = {}


def text_encoder(path: str) -> TextEncoder:
    """The encoder of this Python worker; its store outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(BpeModel(path))
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the ``ids`` of its whole text and the ``decoded`` text.

    Null and empty texts have no ids and decode to the empty text.  Rows are
    independent (null or repeated ids are kept as they are); other columns are
    ignored."""
    def rows(encoder: TextEncoder, doc, text: str) -> tuple:
        n, ids, decoded = encoder(text)
        return doc, [int(i) for i in ids.split()], decoded

    return _per_text(docs, tokenizer_path, id_col, text_col, "doc_id long, ids array<int>, decoded string", rows)


def encode_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``ENCODED``: like ``encode_documents`` with the number of ids and the
    digests of the ids and the decoded text in their place."""
    def rows(encoder: TextEncoder, doc, text: str) -> tuple:
        n, ids, decoded = encoder(text)
        return doc, n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    return _per_text(docs, tokenizer_path, id_col, text_col, ENCODED, rows)


def _per_text(docs, path, id_col, text_col, schema, row) -> DataFrame:
    target = arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(path)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 256):
                out = [row(encoder, d, t.as_py() or "") for d, t in zip(ids[at:at + 256], texts[at:at + 256])]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), target)], schema=target)

    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return base.mapInArrow(encode, schema)
