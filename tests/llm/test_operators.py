"""Small tests of every operator against brute force, and of their odd inputs."""

import collections
import glob
import gzip
import hashlib
import html
import random
import re
import sys
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import ann, bpe, exactdedup, htmltext, langid, linededup, mixing, ngramjoin, tokenfiles, warc
from corpusloom.llm.common import components, save_counted, shared_dir

WORD, BYTE = (str(public_tokenizers.path(f)) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=()):
    """Documents from (id, text[, lang[, source]]), with columns that clash with inner names."""
    full = [(r + (None,) * 4)[:4] for r in rows]
    df = spark.createDataFrame([(i, t, la, s, len(t or "")) for i, t, la, s in full], DOCS)
    for c in extra:
        df = df.withColumn(c, F.lit("x"))
    return df


CLASH = ("_id", "_row", "key", "h", "line", "score", "lang_pred", "_position", "_removed", "sha", "_shard", "rank")
ODD = [(1, None), (2, ""), (3, "  \n "), (4, "One line of text"), (4, "One line of text"), (None, "One line of text"), (5, "é" * 50_000),
       (None, None), (6, "word " * 30_000)]


# --- exact dedup --------------------------------------------------------------

@pytest.mark.parametrize("bits,capacity", [(64, 100_000), (64, 2), (3, 4)])
def test_exact_groups(spark, bits, capacity):
    random.seed(1)
    rows = [(i, random.choice(["a", "b", "", None, "c" * 9999, f"t{i % 40}"])) for i in range(200)]
    got = exactdedup.exact_groups(docs(spark, rows, CLASH), capacity=capacity, hash_bits=bits).collect()
    of = collections.defaultdict(list)
    for i, t in rows:
        of[t or ""].append(i)
    want = {(i, max(of[t or ""]), len(of[t or ""]), i == max(of[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows}
    assert {tuple(r)[:5] for r in got} == want and len(got) == 200
    if bits == 3:
        assert max(r["chain"] for r in got) > 1


def test_exact_odd(spark):
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exactdedup.exact_groups(docs(spark, ODD)).collect()}
    assert (None, 4, 3, False) in got and (4, 4, 3, True) in got and (1, 2, 3, False) in got
    assert exactdedup.exact_groups(docs(spark, [])).count() == 0
    left = exactdedup.drop_copies(docs(spark, ODD, CLASH))
    assert left.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and left.count() == len(ODD) - 3


def test_directory_splits_only_full_buckets(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("h")).unionAll(spark.range(500).select((F.col("id") + (1 << 62)).alias("h")))
    leaves = exactdedup.directory(keys, 100)
    held = (keys.withColumn("leaf", F.shiftrightunsigned("h", 48)).join(leaves, "leaf").groupBy("bucket", "depth").count().collect())
    assert all(r["count"] <= 100 or r["depth"] == 16 for r in held)
    assert sum(r["count"] for r in held) == 3500
    assert len({r["bucket"] for r in held}) == len(held)


# --- WARC ----------------------------------------------------------------------

def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))


def test_warc_round_trip_and_determinism(spark):
    random.seed(2)
    rows = [(i, f"http://h/{i}\r\nX: y" if i % 7 else None, random.choice([None, "", "é<p>same</p>", f"<p>{i}</p>" * 500])) for i in range(120)]
    digests = []
    for parts in (1, 5):
        folder = shared_dir(spark, "t")
        records = warc.page_records(pages(spark, rows).repartition(parts))
        manifest = warc.write_archives(records, warc.record_roles(records), folder, max_bytes=6_000, shard_bytes=80_000)
        assert manifest.count() > 3 and manifest.agg(F.max("n_bytes")).first()[0] <= 6_000
        got = {r["page_id"]: r for r in warc.read_archives(manifest).collect()}
        digests.append(sorted((r["shard"], r["seq"], r["sha256"]) for r in manifest.collect()))
    assert digests[0] == digests[1] and len(got) == 120
    first = {}
    for i, _, t in rows:
        first.setdefault(t or "", i)
    for i, _, t in rows:
        data, r = (t or "").encode(), got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), warc.digest32(data))
        assert r["refers_to"] == (None if first[t or ""] == i else first[t or ""])
        assert r["record_type"] == ("response" if first[t or ""] == i else "revisit")
        if r["record_type"] == "response":
            assert bytes(r["payload"]) == data
    local = folder.removeprefix("file:")
    assert not glob.glob(f"{local}/*.tmp-*")
    with gzip.open(sorted(glob.glob(f"{local}/*.warc.gz"))[0]) as f:
        assert f.read().startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")


def test_warc_odd(spark):
    got = [(r["page_id"], r["record_type"], r["refers_to"]) for r in
           warc.archive_pages(pages(spark, [(None, None, "a"), (3, "u", "a"), (3, "u", "a"), (None, "u", None)])).collect()]
    assert sorted(got, key=str) == sorted([(None, "revisit", 3), (3, "response", None), (3, "response", None), (None, "response", None)], key=str)
    assert warc.archive_pages(pages(spark, [])).count() == 0
    small = warc.archive_pages(pages(spark, [(1, "u", "a"), (2, "u", "a")]), min_bytes=2)
    assert {r["record_type"] for r in small.collect()} == {"response"}


# --- tokens ---------------------------------------------------------------------

PARTS = ["a", "b", "th", "e", " ", "'s", "'", "!!", "1", "É", "ß", "İ", "ΑΣ", "́", "<|endoftext|>", "\n", "中", "😀", "\x1c", "aaaa", "  ", "\t",
         "\xa0", "the", "The,", "word.", "...", "Ᲊ", "Ɤ"]


@pytest.fixture(scope="module")
def texts():
    random.seed(3)
    return ["".join(random.choice(PARTS) for _ in range(random.randint(0, 40))) for _ in range(3000)] + ["a" * 3000, "abc def " * 2000]


def test_bpe_equals_the_library(texts):
    library, encode = Tokenizer.from_file(WORD), bpe.text_encoder(WORD)
    for t in texts:
        n, ids, decoded = encode(t)
        want = library.encode(t, add_special_tokens=False)
        assert [int(i) for i in ids.split()] == want.ids and n == len(want.ids)
        assert decoded == library.decode(want.ids, skip_special_tokens=False)


def test_bpe_prefixes_have_one_last_token():
    model = bpe.BpeModel(WORD)
    for word in ("theththe", "aaaaaaaaa", "internationalization"):
        ids = model.encode_piece(word)
        assert "".join(model.token_of[i] for i in ids) == word + "</w>"
        assert all(model.compatible(a, b) for a, b in zip(ids, ids[1:]))


def test_bpe_settled_letters_equal_the_library():
    library, model = Tokenizer.from_file(WORD), bpe.BpeModel(WORD)
    for c in (c for c in map(chr, range(0x250)) if bpe.split_words(c) == [c]):
        for t in (f"a{c}1{c}!{c}{c}B'{c}s", f"{c}x{c}"):
            want = library.normalizer.normalize_str(t)
            assert model.normalize(t) == want
            assert model.pieces(want) == [p for p, _ in library.pre_tokenizer.pre_tokenize_str(want)]


def test_bpe_store_stays_small(monkeypatch):
    """Bytes that a worker holds after 300,000 distinct words; a text longer than a look-up is encoded whole."""
    encode, library, r = bpe.TextEncoder(bpe.BpeModel(WORD)), Tokenizer.from_file(WORD), random.Random(5)
    monkeypatch.setattr(encode.model, "encode_piece", lambda p: [len(p), 300, 3000])  # any ids
    for _ in range(60):
        encode(" ".join("".join(r.choices("abcdefghijkl", k=10)) for _ in range(5000)))
    held = {}
    for part in (x for s in (encode.known, encode.pieces) for x in (s.new, s.old)):
        held[id(part)] = sys.getsizeof(part)
        for x in (y for kv in part.items() for y in kv):
            held[id(x)] = sys.getsizeof(x)
            if isinstance(x, tuple):
                held |= {id(y): sys.getsizeof(y) for y in x}
    assert sum(held.values()) < 80 << 20
    monkeypatch.undo()
    encode.known, encode.pieces = (type(encode.known)(50) for _ in range(2))
    text = "".join(r.choice(("of the ", "Été\xa0", "x1, ", "<|endoftext|>", "\x00 ")) for _ in range(3 * 4096))
    want = library.encode(text, add_special_tokens=False).ids
    assert encode(text) == (len(want), " ".join(map(str, want)), library.decode(want, skip_special_tokens=False))


def test_bpe_odd(spark):
    got = bpe.encode_documents(docs(spark, ODD, CLASH), WORD).collect()
    assert len(got) == len(ODD) and [r["ids"] for r in got if r["doc_id"] in (1, 2, 3)] == [[], [], []]
    assert bpe.encode_digests(docs(spark, []), WORD).count() == 0


def test_token_files_equal_the_library(spark, texts):
    library = Tokenizer.from_file(BYTE)
    rows = [(7 * i % 997, t) for i, t in enumerate(texts[:900])] + [(2000, None)]
    manifest = tokenfiles.token_files(docs(spark, rows, CLASH), BYTE, shard_bytes=5_000)
    assert manifest.count() > 5
    got, at = {r["doc_id"]: r for r in tokenfiles.read_tokens(manifest).collect()}, 0
    crc = {r["doc_id"]: r for r in tokenfiles.read_digests(manifest).collect()}
    for i, t in sorted(rows):
        want = library.encode(t or "", add_special_tokens=False).ids + [2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids"]) == (at, len(want), want)
        assert crc[i]["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes()) and crc[i]["start"] == at
        at += len(want)


def test_token_files_odd(spark):
    got = tokenfiles.read_tokens(tokenfiles.token_files(docs(spark, ODD), BYTE)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, 1, 2, 3, 4, 4, 5, 6] and got[2]["ids"] == [2]
    assert tokenfiles.read_digests(tokenfiles.token_files(docs(spark, []), BYTE)).count() == 0


# --- nearest neighbours ----------------------------------------------------------

def vectors(spark, x, ids=None):
    rows = [(int(i), None if v is None else [None if c is None else float(c) for c in v], 0) for i, v in zip(ids if ids is not None else range(len(x)), x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit("x")).withColumn("v", F.lit(1))


def test_nearest_recall_and_scores(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 24)) * rng.uniform(0.5, 2, (3000, 1))
    x[100:400] = x[100] + 0.01 * rng.standard_normal((300, 24))
    x[500:800] = x[500]
    x = x.astype(np.float32)
    monkeypatch.setattr(ann, "SAMPLE", 500)
    monkeypatch.setattr(ann, "INDEX_BLOCK", 1000)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 100)
    got = ann.nearest(vectors(spark, x)).toPandas()
    y, hits = x.astype(np.float64), 0
    for q in range(0, 3000, 20):
        s = (y * y[q]).sum(1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(3000), -s))[:20]
        mine = got[got["query_id"] == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 21))
        assert np.allclose(mine["score"], s[mine["vec_id"]], rtol=0, atol=1e-12)
        assert list(zip(-mine["score"], mine["vec_id"])) == sorted(zip(-mine["score"], mine["vec_id"]))
        hits += len({*best} & {*mine["vec_id"]})
    assert hits / (150 * 20) >= 0.9


def test_nearest_odd(spark):
    x = [[1, 0], None, [0, 0], [float("nan"), 1], [1, None], [float("inf"), 0], [0.5, 0.5], [1, 0], [1, 2, 3], []]
    got = {(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(vectors(spark, x), F.col("id") < 5).collect()}
    assert got == {(0, 1, 7), (0, 2, 6)}
    assert ann.nearest(vectors(spark, [])).count() == 0
    assert ann.nearest(vectors(spark, [[1, 1]], [3])).count() == 0


# --- lines -----------------------------------------------------------------------

def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("threshold,share", [(1, 1000), (1, 2), (2, 3)])
def test_line_links_are_complete(spark, threshold, share):
    random.seed(threshold)
    base = ["".join(random.choice("abé ") for _ in range(random.randint(6, 14))).strip() + "x" for _ in range(5)]
    lines = set()
    for _ in range(150):
        s = list(random.choice(base))
        for _ in range(random.randint(0, 3)):
            k = random.randrange(len(s))
            s[k:k + random.randint(0, 1)] = random.choice(["", "a", "b", "é"])
        lines.add("".join(s).strip())
    lines = sorted(x for x in lines if len(x) >= 4)
    folder = shared_dir(spark, "t")
    stored = linededup.store_lines(spark.createDataFrame([(x,) for x in lines], "line string"), folder + "/l")
    of = {r["h"]: r["line"] for r in stored.collect()}
    got = {tuple(sorted((of[r["a"]], of[r["b"]]))) for r in linededup.line_links(stored, folder, threshold, 4, share).collect()}
    assert got == {(a, b) for i, a in enumerate(lines) for b in lines[i + 1:] if distance(a, b) <= threshold}


def test_lines_removed_and_odd(spark):
    long = "this is a line that is long enough to be near another"
    rows = [(11, f"{long}\n\nshort"), (12, f"{long[:-1]}\nown line of the second document\nshort"), (13, f" {long} "), *ODD[:3]]
    kept = {r["doc_id"]: r["text"] for r in linededup.remove_lines(docs(spark, rows, CLASH)).collect()}
    assert kept == {11: f"{long}\n\nshort", 12: "own line of the second document", 1: None, 2: "", 3: "  \n "}
    got = linededup.report(docs(spark, ODD, CLASH)).collect()
    assert len(got) == len(ODD) and {(r["doc_id"], r["n_lines"], r["n_removed"]) for r in got} >= {(1, 0, 0), (3, 0, 0), (4, 1, 0), (None, 1, 1)}
    assert linededup.report(docs(spark, [])).count() == 0 and linededup.remove_lines(docs(spark, [])).count() == 0


def test_pipeline_lines_by_length(spark):
    page = "The annual report of the society, page {} of {}, all rights reserved by it"
    lines = ["Subscribe to our newsletter!", "Subscribe to our newsletter", "Read more", "Read more\r", "\tRead more\xa0", page.format(12, 30), page.format(13, 31),
             "Item 1", "Item 2", "Page 12 of 30", "Page 23 of 31"]
    left = corpus_pipeline.distinct_lines(spark, docs(spark, [(i, f"own {'abcdefghijk'[i] * 9}\n{x}") for i, x in enumerate(lines)], CLASH), "")
    assert [r["doc_id"] for r in left.orderBy("doc_id").collect() if "\n" in r["text"]] == [0, 2, 5, 7, 8, 9, 10]
    assert linededup.EDITS == ((1, 8), (2, 64))


# --- language ----------------------------------------------------------------------

def test_language_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(d).alias("p").join(d.alias("d"), "doc_id")
    r = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score"), F.max("score")).first()
    assert r[0] >= 0.98 and r[1] > 200 and 0 <= r[2] <= r[3] <= 1


def brute_languages(rows, asked):
    """(language, score) of each asked text from dictionaries of words and n-grams."""
    def words(text):
        return re.findall(r"[^\W\d_]+", text.lower())

    langs = sorted({la for _, la in rows})
    counts = [collections.defaultdict(collections.Counter) for _ in range(langid.MAX_GRAM + 1)]
    for text, la in rows:
        for w in words(text):
            counts[0][w][la] += 1
            for n in range(1, langid.MAX_GRAM + 1):
                for k in range(len(w) - n + 1):
                    counts[n][w[k:k + n]][la] += 1
    total = {la: sum(c[la] for c in counts[0].values()) for la in langs}

    def log(n, key):
        return [np.log((counts[n][key][la] + langid.SMOOTH) / (total[la] + langid.SMOOTH * len(counts[n]))) for la in langs]

    out = []
    for text in asked:
        sums, found = np.zeros(len(langs)), words(text or "")
        for w in found:
            if w in counts[0]:
                sums += log(0, w)
                continue
            for n in range(langid.MAX_GRAM, 0, -1):
                if known := [w[k:k + n] for k in range(len(w) - n + 1) if w[k:k + n] in counts[n]]:
                    sums += np.mean([log(n, g) for g in known], 0)
                    break
        best = int(np.argmax(sums))
        out.append((langs[best], 1 / np.exp(sums - sums[best]).sum()) if found else ("und", 0.0))
    return out


def test_language_equals_dictionaries(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null").select("doc_id", "text", "lang").collect()
    train = [(r["text"], r["lang"]) for r in d if r["lang"] and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    rng = random.Random(2)
    mixed = [" ".join(rng.choices(" ".join(r["text"] for r in rng.sample(d, 2)).split(), k=rng.randint(1, 4))) for _ in range(60)]
    asked = [r["text"] for r in d] + mixed + ["xqz" + w[2:] for w in mixed] + ["", "12 %", "a", "ŋŋŋ word"]
    model = langid.train(spark.createDataFrame([(i, t, la) for i, (t, la) in enumerate(train)], "doc_id long, text string, lang string"), F.lit(True))
    for text, got, want in zip(asked, model.predict(asked), brute_languages(train, asked)):
        assert abs(got[1] - want[1]) < 1e-3, text
        assert got[0] == want[0] or want[1] < 0.51, text


def test_language_backs_off_and_odd(spark):
    rows = [(i, "the cat sat on the mat", "en") for i in range(20)] + [(i, "der hund lag im garten", "de") for i in range(20, 40)]
    asked = [(100, "hundegarten"), (101, "catmat"), (102, None), (103, "12 !!"), (104, "жжж"), (None, "the"), *ODD]
    got = {r["doc_id"]: r for r in langid.identify(docs(spark, rows + asked, CLASH)).collect()}
    assert (got[100]["lang_pred"], got[101]["lang_pred"], got[102]["lang_pred"], got[103]["lang_pred"]) == ("de", "en", "und", "und")
    assert got[102]["score"] == 0 and got[104]["lang_pred"] in ("en", "de") and got[None]["held_out"] is False
    assert {r["held_out"] for r in got.values() if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2} == {True}
    assert {r["lang_pred"] for r in langid.identify(docs(spark, [(1, "a"), (2, None)])).collect()} == {"und"}
    assert langid.identify(docs(spark, [])).count() == 0
    unlabelled = docs(spark, [(1, "a"), (2, None), (3, "12")], CLASH)
    assert sorted(r["doc_id"] for r in langid.accept(unlabelled).collect()) == [1, 2, 3]
    rare = [(i, "le chat est sur la table", "fr") for i in range(2000, 2060)]
    few = langid.train(docs(spark, rows * 20 + rare), F.lit(True), sample_rows=10)
    assert few.langs == ["de", "en", "fr"] and few.predict(["chat la table"])[0][0] == "fr"
    left = langid.accept(docs(spark, rows + asked, CLASH))
    assert left.columns == docs(spark, [], CLASH).columns and left.where("doc_id in (102, 103)").count() == 0 and left.count() > 40


def test_texts_of_no_known_language_go(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    other = ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
             "Все люди рождаются свободными и равными в своем достоинстве и правах.", "人人生而自由", "xkqz jvwq pltk zzxq qwrt vbnm gfhj kjhg", "qzx wvk " * 60]
    extra = docs(spark, [(10**6 + i, t, "en", "src0") for i, t in enumerate(other)])
    asked = d.unionAll(extra.withColumn("lang", F.lit(None).cast("string")))
    left = {r["doc_id"] for r in corpus_pipeline.known_language(spark, asked, "").collect()}
    assert left == {r["doc_id"] for r in d.collect() if any(c.isalpha() for c in r["text"] or "")}
    model = langid.train(d, F.lit(True))
    text = max((r["text"] for r in d.collect()), key=len)
    words = text.split()
    half = " ".join(w if i % 3 else "жщц" + "ъ" * len(w) for i, w in enumerate(words[:600]))
    assert [x[2] for x in model.judge([text, half, other[0] + " ", None, "the", ""])] == [True, brute_known(model, half), False, False, True, False]
    for t in [r["text"] for r in d.limit(30).collect()] + other + ["the xqj of zzv", "Re.", " ".join(words[:5]) + " жщц"]:
        assert model.judge([t])[0][2] == brute_known(model, t), t


def brute_known(model, text):
    """Whether the model knows half of the n-grams, word by word."""
    def has(piece):
        _, start, end, rolling = langid._words([piece])
        return bool(model._known(len(piece), rolling(start, end))[0].all())

    words = [text.lower()[m.start():m.end()] for m in re.finditer(r"[^\W\d_]+", text.lower())]
    n = 4 if sum(map(len, words)) >= 100 else 2
    grams = [w[k:k + n] for w in words for k in range(max(1, len(w) - n + 1))]
    return bool(grams) and sum(map(has, grams)) >= len(grams) / 2


# --- n-gram join ---------------------------------------------------------------------

def brute_components(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    for _ in sets:
        old = dict(label)
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    label[a] = min(label[a], label[b])
        if old == label:
            return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_ngram_components(spark, n, percent):
    random.seed(n)
    words = [f"w{k}" for k in range(30)]
    base = [[random.choice(words) for _ in range(random.choice([1, 2, 8, 60, 120]))] for _ in range(12)]
    rows = []
    for i in range(140):
        w = list(random.choice(base))
        for _ in range(random.randint(0, 3) if len(w) > 8 else 0):
            w[random.randrange(len(w))] = random.choice(words)
        rows.append((i, random.choice([" ", "\n", "\t "]).join(x.upper() if random.random() < 0.1 else x for x in w)))
    rows += [(200, None), (201, ""), (202, " \t"), (203, "\xa0é É"), (204, "w1"), (205, "W1")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.jaccard_components(docs(spark, rows, CLASH), n, percent).collect()}
    assert got == brute_components(rows, n, percent)


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_ngram_groups_around_the_threshold(spark, n, percent):
    """Large groups over one passage whose members are 0.6 to 0.97 alike: few links, and many n-grams that all share."""
    rng = random.Random(percent)
    rows, i = [], 0
    for size, edits in ((60, (2, 6)), (60, (1, 3)), (40, (0, 2)), (30, (4, 9))):
        passage = [f"g{size}{edits}{k}" for k in range(rng.choice([60, 90]))]
        for _ in range(size):
            w = list(passage)
            for _ in range(rng.randint(*edits)):
                at = rng.randrange(len(w))
                w[at:at + rng.choice([0, 1])] = rng.choice([[], [f"n{rng.randrange(40)}"], [f"u{i}-{at}"]])
            rows.append((i, " ".join(w[rng.randrange(3):])))
            i += 1
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.jaccard_components(docs(spark, rows), n, percent).collect()}
    want = brute_components(rows, n, percent)
    assert got == want and len({c for _, c in want.values()}) > 20


def test_ngram_odd_and_long(spark, monkeypatch):
    got = [(r["doc_id"], r["component_id"]) for r in ngramjoin.jaccard_components(docs(spark, ODD, CLASH)).collect()]
    assert len(got) == len(ODD) and {(1, 1), (2, 2), (4, 4), (None, 4)} <= set(got)
    assert ngramjoin.jaccard_components(docs(spark, [])).count() == 0
    left = ngramjoin.keep_one(docs(spark, [(1, "a b c d"), (2, "a b c d"), (3, None), (4, "")], CLASH))
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 3, 4]
    data = np.frombuffer((b"some words and " * 900), np.uint8)
    whole = ngramjoin.set_keys(data, np.array([0, len(data)]), 3)
    monkeypatch.setattr(ngramjoin, "SPLIT", 100)
    assert all((a == b).all() for a, b in zip(whole, ngramjoin.set_keys(data, np.array([0, len(data)]), 3)))


def test_components(spark):
    random.seed(9)
    edges = [(random.randrange(400), random.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(500, 600)] + [(700, k) for k in range(701, 900)]
    label = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in label.items() if k != v}


# --- mixing ------------------------------------------------------------------------------

def test_mixing_stays_within_one_block(spark):
    sizes = {"a": 700, "b": 250, "c": 90, None: 40}
    rows = [(i, "t", None, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    got = mixing.mix_order(docs(spark, rows, CLASH), block_rows=4, cycle=100).toPandas()
    assert sorted(got["position"]) == list(range(len(rows)))
    assert ((got["release"] <= got["slot"]) & (got["slot"] < got["deadline"])).all()
    blocks = got.fillna({"source": ""}).groupby(["source", "block"])["slot"].agg(["min", "max"]).reset_index()
    assert (blocks["min"] == blocks["max"]).all()
    supply = blocks.groupby("source")["max"].max().min()  # until the first source has run out
    share = {s: len(b[b["min"] < 100]) / 100 for s, b in blocks.groupby("source")} if supply >= 100 else None
    weight = {s: n ** 0.5 for s, n in ((s or "", n) for s, n in sizes.items())}
    cycle = {s: int(100 * w / sum(weight.values())) for s, w in weight.items()}
    for s, b in blocks.groupby("source"):
        taken = np.sort(b["min"].to_numpy())
        c = share[s] if share else None
        for k, slot in enumerate(taken):
            low = cycle[s] / 100 if c is None else c
            assert k - 1 < (slot + 1) * (low + 0.0101) and (k + 2) > slot * low
    order = mixing.mix(docs(spark, rows, CLASH), block_rows=4, cycle=100)
    assert order.columns == docs(spark, [], CLASH).columns
    assert [r["doc_id"] for r in order.collect()] == list(got.sort_values("position")["doc_id"])


def test_mixing_odd(spark):
    rows = [(None, "a"), (None, "b"), (1, None), (1, None), (1, "z")]
    got = mixing.mix_order(docs(spark, rows)).collect()
    assert sorted(r["position"] for r in got) == [0, 1, 2, 3, 4]
    assert mixing.mix(docs(spark, rows, CLASH)).count() == 5
    assert mixing.mix_order(docs(spark, [])).count() == 0 and mixing.mix(docs(spark, [])).count() == 0
    named = mixing.mix_order(docs(spark, [(i, "t", None, "ab"[i % 2]) for i in range(400)]), {"a": 3, "b": 1}, block_rows=1, cycle=8).toPandas()
    first = named[named["position"] < 80]["source"].value_counts()
    assert abs(first["a"] - 60) <= 10 and abs(first["b"] - 20) <= 10


@pytest.mark.parametrize("m", [10, 500, 999, 1000, 1001])
def test_mixing_shares_follow_the_weights(spark, m):
    """One source of weight 0.9, one of a fiftieth, the others alike: after any number of slots in a cycle every share is
    within two blocks of its target (one for the whole cycle's rounding, one for the place in it), at a cycle's end within one."""
    weights = {"heavy": 0.9, "second": 0.02} | {f"s{k}": 0.08 / (m - 2) for k in range(m - 2)}
    names = ["heavy"] * 4000 + ["second"] * 100 + [f"s{k}" for k in range(m - 2) for _ in range(max(2, 500 // m))]
    rows = [(i, "t", None, s) for i, s in enumerate(names)]
    got = mixing.mix_order(docs(spark, rows), weights, block_rows=1).toPandas()
    period = 1000 if 0.08 / (m - 2) * 1000 >= 1 else mixing.POOLED * mixing.CYCLE
    for source, w in weights.items():
        taken = np.sort(got["slot"][got["source"] == source].to_numpy())
        for t in (10, 100, 333, 999, period):
            have = (taken < t).sum()
            if have < len(taken):  # not run out
                assert abs(have - t * w) < (1.001 if t == period else 2), (source, t, have, t * w)


def test_mixing_more_sources_than_slots(spark):
    names = ["large"] * 400 + ["middle"] * 90 + [f"s{k}" for k in range(1009) for _ in range(1 + 19 * (k % 7 == 0))]
    rows = [(i, "t", None, s) for i, s in enumerate(names)]
    got = mixing.mix_order(docs(spark, rows, CLASH)).toPandas()
    assert sorted(got["doc_id"]) == list(range(len(rows))) == sorted(got["position"])
    assert ((got["release"] <= got["slot"]) & (got["slot"] < got["deadline"])).all()
    assert (got.groupby("slot")[["source", "block"]].nunique() == 1).all().all()  # a slot is one block's
    assert sorted(r["doc_id"] for r in mixing.mix(docs(spark, rows, CLASH)).collect()) == list(range(len(rows)))
    few = mixing.mix_order(docs(spark, [(i, "t", None, str(i % 12)) for i in range(120)]), {"3": 5, "4": 1}, block_rows=2, cycle=8).toPandas()
    assert sorted(few["doc_id"]) == list(range(120)) == sorted(few["position"])
    assert ((few["release"] <= few["slot"]) & (few["slot"] < few["deadline"])).all()


# --- HTML -----------------------------------------------------------------------------------

ARTICLE = "<h1>Title &amp; more</h1><p>First <b>bold</b> paragraph, long enough to count as text.<p>Second&nbsp;one<br>with a break.</p>"
WANT = "Title & more First bold paragraph, long enough to count as text. Second one with a break."


@pytest.mark.parametrize("around", [
    '<nav><ul><li><a href="/a">Menu</a></ul></nav><article>{}</article><footer>Foot</footer>',
    '<div class="header">Head</div><div class="content">{}<div class="comments"><p>Reader says so.</p></div></div><div id="sidebar">Side</div>',
    '<nav><ul><li>Menu<li>left open<article>{}</article>',
    '<header>Site</header><main><div class="ad">Buy</div>{}<form><p>Sign up</p><input></form></main><aside>Side</aside>',
    '<script>var t="</p><p>no</p>";</script><style>p{{}}</style><!-- <p>gone</p> --><section class="post-12">{}</section><div class="cookie-notice">ok</div>',
])
def test_main_text(around):
    page = f"<!DOCTYPE html><html><head><title>T</title></head><body>{around.format(ARTICLE)}</body></html>"
    assert htmltext.main_text(page, []) == WANT


@pytest.mark.parametrize("around", [
    *(f'<div class="{c}">{{}}<div class="sidebar"><p>Side</p></div></div>' for c in ("content no-sidebar", "main-content with-comments", "has_widgets")),
    *(f'<div class="{c}"><article>{{}}</article><div class="widget">Side</div></div>' for c in ("layout has-sidebar", "sidebar-right", "page-header-wrap")),
    '<div class="elementor-widget-container">{}</div><div class="elementor-widget-nav-menu"><p>Menu</p></div>',
    '<div id="widget-area">{}</div><div class="comments"><p>' + "A reader says more than the article. " * 20 + "</p></div>",
    '<div class="share-layout"><article>{}<div class="related"><article><p>Card</p></article></div></article></div>',
    '<main>{}</main><div class="sidebar"><article><p>' + "A long card in the sidebar. " * 20 + "</p></article></div>",
    '<div class="feedback-page"><article>{}</article></div>',
])
def test_layout_words_on_wrappers(around):
    assert htmltext.main_text(f"<body><nav>Menu</nav>{around.format(ARTICLE)}<footer>Foot</footer></body>", []) == WANT


BODY = "<p>" + "The body of the article is much longer than its lead. " * 12 + "</p>"


@pytest.mark.parametrize("page", [
    '<article><h1>Title</h1><p class="lead">Lead.</p><div class="entry-content">{}</div></article><div class="x"><p>Beside</p></div>',
    '<main><h1>Title</h1><div><p>Lead.</p></div><div class="text"><div class="inner">{}</div></div></main>',
    '<article><section class="intro"><h1>Title</h1><p>Lead.</p></section><section class="long">{}</section></article>',
    '<div class="post"><h1>Title</h1><p>Lead.</p><div class="entry-content">{}</div></div><div class="list"><p>Beside</p></div>',
    '<div class="wrap"><div class="post"><h1>Title</h1><p>Lead.</p><div class="story">{}</div></div><div class="list"><a href="/1">One more</a> <a href="/2">Two</a></div></div>',
])
def test_nested_and_sectioned_articles(spark, page):
    html_ = f"<body><nav>Menu</nav>{page.format(BODY)}<footer>Foot</footer></body>"
    want = "Title Lead. " + BODY[3:-4].strip()
    assert htmltext.main_text(html_, []) == want
    table = spark.createDataFrame([(i, f"https://a.example/{i}", html_) for i in range(3)], "page_id long, url string, html string")
    assert {r["text"] for r in htmltext.extract(table).collect()} == {want}


def test_host_consensus(spark):
    good = '<body><div class="story-{}"><p>{}</p></div><div class="list"><p>{}</p></div></body>'
    rows = [(i, f"https://Host.example:80/{i}", good.format(i, "main text of the page " * 9, "x")) for i in range(6)]
    rows.append((9, "https://host.example/9", good.format(9, "short main text", "a long list of other things " * 30)))
    rows += [(10, None, None), (11, "odd", ""), (12, "odd", "<p>bare"), (13, "odd", "<div><p>cut &am"), (None, "odd", "<nav>menu</nav>")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("x")).withColumn("paths", F.lit(1))
    got = {r["page_id"]: r for r in htmltext.extract(table).collect()}
    assert got[9]["text"] == "short main text" and len(got) == len(rows)
    assert (got[10]["text"], got[11]["text"], got[12]["text"], got[13]["text"], got[None]["text"]) == ("", "", "bare", "cut &am", "")
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert htmltext.extract(table.limit(0)).count() == 0


def test_host_paths_of_many_classes(spark, monkeypatch):
    monkeypatch.setattr(htmltext, "SHARES", 7)
    names = ["rare" + chr(97 + i // 26) + chr(97 + i % 26) for i in range(200)] + ["often"] * 9 + ["next"] * 5 + ["third"] * 3
    rows = [(h, f'<div class="{c}"><p>Some text of the page.</p></div>') for h in ("", "a.example") for c in names]
    got = htmltext.host_paths(spark.createDataFrame(rows, "host string, html string"))
    assert {(r["host"], tuple(r["paths"])) for r in got.collect()} == {(h, tuple(f"/#root/div.{c}" for c in ("often", "next", "third"))) for h in ("", "a.example")}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan  # ranked before any host's paths are gathered


def test_pages_of_the_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in htmltext.extract(d).join(d.select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)[1]
        assert r["text"] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))).split())


def executions(spark, run):
    """What ``run`` returns, and how many executions of Spark SQL it took."""
    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return spark._jsparkSession.sharedState().statusStore().executionsCount()

    before = total()
    return run(), total() - before


def test_rows_are_counted_while_they_are_saved(spark):
    df = spark.range(1000)
    for rows in (df, df.where("id % 7 = 0").distinct(), df.where("id < 0"), df.limit(0), df.join(df.where("id < -1"), "id")):
        (saved, n), took = executions(spark, lambda: save_counted(rows, shared_dir(spark, "t")))
        assert n == saved.count() == rows.count() and took == 1


def test_components_take_one_execution_a_step(spark):
    star = spark.createDataFrame([(1, k) for k in range(2, 9)], "a long, b long")
    found, took = executions(spark, lambda: components(star))
    assert {tuple(r) for r in found.collect()} == {(k, 1) for k in range(2, 9)} and took == 2
    found, took = executions(spark, lambda: components(star.where("a = b")))
    assert found.count() == 0 and took == 1


def test_ngram_rounds_without_a_link_are_few_steps(spark):
    """Pairs that are alike but not enough: no round finds a link, so none labels or compares more than it must."""
    common = [f"w{i}" for i in range(60)]
    rows = [(d, " ".join(common[:45] + [f"o{d}x{i}" for i in range(15)])) for d in range(8)] + [(9, None), (10, common[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found, took = executions(spark, lambda: ngramjoin.keep_one(docs, n=5, percent=80))
    assert sorted(r[0] for r in found.collect()) == [*range(8), 9, 10] and took <= 28, took
    linked = docs.unionAll(spark.createDataFrame([(20, rows[3][1] + " end"), (21, "start " + rows[3][1] + " end")], docs.schema))
    assert sorted(r[0] for r in ngramjoin.keep_one(linked, n=5, percent=80).collect()) == [*range(8), 9, 10]


def test_ngram_pairs_in_one_tile_and_in_many(spark, monkeypatch):
    random.seed(4)
    sets = {d: sorted(random.sample(range(40), 25)) for d in range(12)}
    pairs = [(a, b, 25, 25) for a in sets for b in sets if a < b]
    want = {(a, b): len(set(sets[a]) & set(sets[b])) for a, b, _, _ in pairs}
    kept = spark.createDataFrame([(d, f, [x for x in s if x % 2 == f]) for d, s in sets.items() for f in (0, 1)], "doc_id long, frag int, keys array<long>")
    asked = spark.createDataFrame(pairs, "a long, b long, na int, nb int")
    for block in (ngramjoin.BLOCK, 5):
        monkeypatch.setattr(ngramjoin, "BLOCK", block)
        got = ngramjoin._Verifier(kept, kept, 2, 50, shared_dir(spark, "t"))._overlaps(asked, kept, 2, "sets")
        assert {(r["a"], r["b"]): r["overlap"] for r in got.collect()} == want
