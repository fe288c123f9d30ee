"""Sub-word pieces against a brute-force longest match, their offsets, and labels."""

import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import subwords as SW

VOCAB = {p: i for i, p in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "un", "##aff", "##able", "##a", "a", "aff", "##b", "b", "ab", "##ab", "!",
                                     "é", "##é", "straß", "##e", "un!"])}


def longest(word, vocab, continuation="##"):
    """Pieces by trying every length from the longest down."""
    at, out = 0, []
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = (continuation if at else "") + word[at:end]
            if piece in vocab:
                out.append((vocab[piece], at, end))
                at = end
                break
        else:
            return [(vocab["[UNK]"], 0, len(word))]
    return out


def test_trie_equals_longest_match():
    rng, trie = random.Random(2), SW.PieceTrie(VOCAB, 1)
    for _ in range(4000):
        word = "".join(rng.choices(["un", "aff", "able", "a", "b", "é", "z", "!"], k=rng.randint(1, 6)))
        assert trie.cut(word) == longest(word, VOCAB), word


def test_word_ends_and_bytes():
    letters = SW.byte_letters()
    assert len(set(letters)) == 256 and letters[ord("a")] == "a" and letters[32] == "Ġ"
    mapped = "".join(letters[b] for b in "é".encode())
    vocab = {"a": 0, "a</w>": 1, "ab": 2, "b</w>": 3, mapped[0]: 4, mapped[1] + "</w>": 5, "?": 6}
    trie = SW.PieceTrie(vocab, 6, word_end="</w>", byte_level=True)
    assert trie.cut("aba") == [(2, 0, 2), (1, 2, 3)]
    assert trie.cut("ab") == [(0, 0, 1), (3, 1, 2)]  # "ab" does not end a word
    assert trie.cut("AÉ") == [(0, 0, 1), (4, 1, 2), (5, 1, 2)]
    assert trie.cut("c") == [(6, 0, 1)]


@pytest.fixture(scope="module")
def sub(spark):
    return SW.Subwords(spark, VOCAB)


def test_offsets_are_places_in_the_text(spark, sub):
    texts = [" Unaffable  unab\n!xyz é", None, "", " \t ", "a" * 3000, "İa ab", "un!"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", "t", sub.pieces("t").alias("p")).collect()
    for r in rows:
        for p in r["p"]:
            text = SW.lowered(r["t"][p["start"]:p["end"]])
            assert p["id"] == 1 or text in (k.removeprefix("##") for k, v in VOCAB.items() if v == p["id"])
    by = {r["i"]: [(p["id"], p["start"], p["end"], p["word"]) for p in r["p"]] for r in rows}
    assert by[0] == [(4, 1, 3, 0), (5, 3, 6, 0), (6, 6, 10, 0), (4, 12, 14, 1), (13, 14, 16, 1), (14, 17, 18, 2), (1, 18, 21, 3), (15, 22, 23, 4)]
    assert by[1] == by[2] == by[3] == [] and len(by[4]) == 3000
    assert by[6] == [(4, 0, 2, 0), (14, 2, 3, 1)]  # the words come first: "un!" is two


def test_counts_and_padding(spark, sub):
    df = spark.createDataFrame([(1, "unaffable ab"), (2, None), (3, "a a a a a a")], "k int, text string")
    assert [r["n"] for r in df.select(SW.subword_count(sub, "text", 2).alias("n"), "k").orderBy("k").collect()] == [6, 2, 8]
    got = SW.pad_truncate_subwords(df, sub, "k", "text", 6, 0, 2, 3).orderBy("k").collect()
    assert got[0]["input_ids"] == [2, 4, 5, 6, 12, 3] and got[0]["n_chars_covered"] == 12
    assert got[1]["input_ids"] == [2, 3, 0, 0, 0, 0] and got[1]["attention_mask"] == [1, 1, 0, 0, 0, 0] and got[1]["n_chars_covered"] == 0
    assert got[2]["input_ids"] == [2, 8, 8, 8, 8, 3] and got[2]["n_chars_covered"] == 7
    bare = SW.pad_truncate_subwords(df, sub, "k", "text", 3).orderBy("k").first()
    assert bare["input_ids"] == [4, 5, 6] and bare["attention_mask"] == [1, 1, 1]


def test_a_word_in_pieces_has_one_label(spark, sub):
    words = spark.createDataFrame([(1, 0, "unaffable!", 7), (1, 1, "zzz", 8), (1, 2, "ab", 9), (2, 0, "a", 5), (3, 0, None, 4)],
                                  "d int, p int, w string, tag int")
    got = SW.align_labels_subwords(words, sub, "d", "p", "w", "tag", 5).orderBy("d", "part").collect()
    assert [(r["d"], r["part"], r["input_ids"], r["labels"]) for r in got] == [
        (1, 0, [4, 5, 6], [-100, 7, -100, -100, -100]), (1, 1, [14, 1, 12], [-100, -100, 8, 9, -100]), (2, 0, [8], [-100, 5, -100])]


def test_vocabulary_files(spark, tmp_path):
    path = tmp_path / "vocab.txt"
    path.write_text("\n".join(VOCAB) + "\n", encoding="utf-8")
    one = spark.createDataFrame([("unaffable",)], "t string")
    assert [p["id"] for p in one.select(SW.Subwords.from_lines(spark, str(path)).pieces("t").alias("p")).first()["p"]] == [4, 5, 6]
    assert one.select(F.size(SW.Subwords.from_lines(spark, str(path), lowercase=False).pieces("t")).alias("n")).first()["n"] == 3


def test_a_batch_is_cut_in_little_memory(spark, sub, monkeypatch):
    monkeypatch.setattr(SW.F, "arrow_udf", lambda run, _type: lambda *_columns: run)
    cut, cut_words = sub.pieces("t"), sub.word_pieces(F.col("w"))
    words = ["ab", "unaffable", "zzz"] * 130
    spans, lengths = pa.array([[w + " " for w in words]] * 3000), pa.array([2 + sum(len(w) + 1 for w in words)] * 3000, pa.int32())
    by_word = pa.array([[[w] for w in words]] * 3000)
    cut(spans.slice(0, 1), lengths.slice(0, 1))
    tracemalloc.start()
    got, got_words = cut(spans, lengths), cut_words(by_word)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
    at, want = 2, []
    for k, w in enumerate(words):
        want += [{"id": n, "start": at + a, "end": at + b, "word": k} for n, a, b in longest(w, VOCAB)]
        at += len(w) + 1
    assert len(got) == 3000 and got[0].as_py() == got[2999].as_py() == want
    assert [(p["id"], p["word"]) for p in got_words[1700].as_py()] == [(p["id"], p["word"]) for p in want]
    assert got_words[2999].as_py()[1:4] == [{"id": n, "start": a, "end": b, "word": 1} for n, a, b in longest("unaffable", VOCAB)]


def test_labels_cut_each_word_once(spark, sub):
    words = spark.createDataFrame([(1, 0, "unaffable!", 7)], "d int, p int, w string, tag int")
    plan = SW.align_labels_subwords(words, sub, "d", "p", "w", "tag", 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
