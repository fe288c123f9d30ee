"""Suffix dedup, conversation repair and centroid clustering against brute force, and their odd inputs."""

import hashlib
import heapq
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import convrepair, htmltext, kmeans, linededup, suffixdedup
from corpusloom.llm.common import CLEANUP, save_counted, shared_dir

# --- conversation repair ------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest_repair(rows, faults):
    """(cost, audit, repaired rows) by a search over all edits, least (cost, audit) first."""
    heap, done, best = [(0, "", 0, 0, ())], set(), None
    while heap:
        cost, audit, i, state, kept = heapq.heappop(heap)
        if best and cost > best[0]:
            break
        if i == len(rows) and state in (0, 3) and (not best or audit < best[1]):
            best = (cost, audit, kept)
        if (i, state, cost, audit) in done or len(audit) > 2 * len(rows) + 4:
            continue
        done.add((i, state, cost, audit))
        roles = [r for r in ("user", "assistant") if (state, r[0]) in NEXT]
        for r in roles:
            heapq.heappush(heap, (cost + 3, audit + "I", i, NEXT[state, r[0]], (*kept, (r, ""))))
        if i < len(rows):
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, kept))
            if faults[i] in "kt":
                more, (_, role, text) = 3 * (faults[i] == "t"), rows[i]
                for r in roles:
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, NEXT[state, r[0]], (*kept, (r, text))))
                if (state, role[:1]) in NEXT:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, NEXT[state, role[:1]], (*kept, (role, text))))
    return best


def repaired_by_hand(rows):
    convs, out = defaultdict(list), {}
    for c, turn, role, text in rows:
        c_, t_, role, text = (" " if v is None else str(v) for v in (c, turn, role, text))
        kind, held = zlib.crc32(f"{c_}:{t_}".encode()) % 20, convs[c]
        text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
        held += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for c, held in convs.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        faults, seen = [], set()
        for _, role, text in held:
            faults.append("b" if not text.strip(WHITE) else "d" if (role, text) in seen else "k" if text.strip(WHITE)[-1] in ".!?" else "t")
            seen.add((role, text))
        turns = {t for t, _, _ in held if t is not None}
        cost, audit, kept = cheapest_repair(held, faults)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
        out[c] = (c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
                  illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())
    return out


def repaired(df, **options):
    return {r[0]: tuple(r) for r in convrepair.digests(convrepair.repair(convrepair.damaged(df), **options)).collect()}


@pytest.mark.parametrize("stretch", [1024, 3, 1])
def test_repair(spark, stretch):
    random.seed(stretch)
    ids, roles = [None, *range(9)], ["system", "user", "assistant", "tool", "", None, "user", "assistant"]
    texts = ["Hi.", "Hi", "", None, " \n", "What?", "x ", "Yes. ", "No!\t", "ok .", "end. "]
    rows = [(random.choice(ids), random.choice([None, *range(5)]), random.choice(roles), random.choice(texts)) for _ in range(50)]
    df = spark.createDataFrame(rows, TURNS).withColumn("conv", F.lit(1)).withColumn("h", F.lit("x")).withColumn("n", F.lit(2))
    assert repaired(df, stretch=stretch) == repaired_by_hand(rows)


def test_repair_odd(spark):
    assert repaired(spark.createDataFrame([], TURNS)) == {}
    gone = next(i for i in range(999) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert repaired(spark.createDataFrame([(gone, 0, "user", "x")], TURNS))[gone] == (
        gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    far = [(1, -2**63, "user", "a."), (1, 2**63 - 1, "assistant", "b.")]
    assert repaired(spark.createDataFrame(far, TURNS))[1][1] is None


def test_repair_of_one_very_long_conversation(spark):
    """A third of a million rows would not fit the search; equal rows are deletions but for the first."""
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(3000)] + [(2, 5, "user", "Same.")] * 2000
    got = repaired(spark.createDataFrame(rows, TURNS), stretch=256)
    assert got[2][3] >= 1999 and got[2][7].count("D") >= 1999
    parts = convrepair.repair(convrepair.damaged(spark.createDataFrame(rows, TURNS)), stretch=64).where("conv_id = 1 and position > 0")
    roles = "".join(r["role"][0] for r in parts.orderBy("position").collect())
    assert set(roles[::2]) == {"u"} and set(roles[1::2]) == {"a"} and len(roles) % 2 == 0
    assert got[1] == repaired(spark.createDataFrame(rows, TURNS).where("conv_id = 1"))[1]


# --- centroids ------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def clustered_by_hand(rows, k, rounds, dims):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    centres = [v for _, _, v in sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v, v) for i, v in kept if i is not None)[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for c in range(len(centres)):
            if mine := [v for (_, v), n in zip(kept, of) if n == c]:
                centres[c] = [sum(x) // len(mine) for x in zip(*mine)]
    done = [(i, *near(v)) for i, v in kept]
    return [(i, c, d, sum(e for _, e, b in done if b == c), sum(e for _, e, _ in done),
             hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, d, c in done]


def as_rows(found):
    return sorted(found, key=str)


@pytest.mark.parametrize("dims,k,spread", [(64, 8, 1.0), (3, 4, 0.01), (2, 5, 300.0)])
def test_clusters(spark, dims, k, spread):
    r = np.random.default_rng(dims)
    rows = [(int(i) if i % 17 else None, [float(np.float32(x)) for x in r.normal(0, spread, dims)]) for i in range(1, 120)]
    rows += [(7, rows[0][1]), (200, [0.0] * dims), (201, [-0.0] * dims), (202, [math.nan] * dims), (203, [math.inf] * dims), (204, None),
             (205, [0.5] * (dims + 1)), (206, []), (207, [None] * dims), (7, rows[0][1])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).withColumn("cluster", F.lit(9)).withColumn("apex", F.lit(9))
    got = kmeans.cluster(df, k=k, rounds=4, dims=dims)
    assert as_rows(map(tuple, got.collect())) == as_rows(clustered_by_hand(rows, k, 4, dims))


def test_clusters_odd(spark):
    assert kmeans.cluster(spark.createDataFrame([], VECTORS)).count() == 0
    one = spark.createDataFrame([(None, [1.0, 2.0], 0)], VECTORS)
    assert kmeans.cluster(one, dims=2).count() == 0
    same = kmeans.cluster(spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(30)], VECTORS), dims=2).collect()
    assert {(r["cluster"], r["distance"], r["inertia"]) for r in same} == {(0, 0, 0)}
    huge = [(1, [3e38, -3e38]), (2, [1e-40, 0.0]), (3, [3e38, -3e38]), (4, [-1.0, 1.0])]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in huge]
    got = kmeans.cluster(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS), dims=2, k=2, rounds=3).collect()
    want = {i: (c, d if d < 2**63 else None, e if e < 2**63 else None, s) for i, c, d, e, _, s in clustered_by_hand(rows, 2, 3, 2)}
    assert {r["vec_id"]: (r["cluster"], r["distance"], r["cluster_inertia"], r["centroid_sha256"]) for r in got} == want


def test_simplex_bounds_hold():
    r = np.random.default_rng(1)
    x = np.floor(r.normal(0, 500, (400, 16)))
    simplex = kmeans.Simplex(np.concatenate([x[:5], x[:2], x[:1] + 1e-9]))
    assert len(simplex.pivots) == 5
    a, true = simplex.apex(x), np.sqrt(((x[:, None] - x[None, :40]) ** 2).sum(2))
    inner = ((a[:, None, :-1] - a[None, :40, :-1]) ** 2).sum(2)
    low, high = (np.sqrt(inner + (a[:, None, -1] - s * a[None, :40, -1]) ** 2) for s in (1, -1))
    assert (low <= true + 1e-3).all() and (true <= high + 1e-3).all()
    assert simplex.candidates(a, a[:40])[np.arange(400), true.argmin(1)].all()
    assert simplex.candidates(a, a[:5]).sum(1).max() < 5  # exact for centroids among the pivots


# --- suffix dedup -----------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def removed_by_hand(texts, length):
    """(bytes, removed, spans, kept) of each text."""
    bodies = [(t or "").encode() for t in texts]
    count, out = Counter(b[i:i + length] for b in bodies for i in range(len(b) - length + 1)), []
    for b in bodies:
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i + 1:i + 1 + length] = True
        spans = np.flatnonzero(gone[1:] != gone[:-1]).reshape(-1, 2)
        out.append((len(b), int(gone.sum()), [tuple(map(int, s)) for s in spans], bytes(x for x, g in zip(b, gone[1:]) if not g)))
    return out


@pytest.mark.parametrize("length", [1, 6, 7, 13, 20])
def test_merged_transforms(length):
    r = random.Random(length)
    for alphabet in (b"ab", b"abc\x00\xff", bytes(range(256))):
        base, texts = bytes(r.choices(alphabet, k=60)), []
        for _ in range(40):
            at = r.randint(0, 50)
            texts.append(bytes(r.choices(alphabet, k=r.randint(0, 30))) + base[at:at + r.randint(0, 40)] + bytes(r.choices(alphabet, k=5)))
        count = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
        for shard in (1, 100, 10**6):
            got = suffixdedup.repeated_windows(texts, length, shard)
            for flags, t in zip(got, texts):
                want = [count[t[i:i + length]] > 1 for i in range(len(t) - length + 1)]
                assert flags[:len(want)].tolist() == want and not flags[len(want):].any()


def test_merge_gives_common_prefixes():
    shards = [suffixdedup.Shard([b"banana", b"bandana"]), suffixdedup.Shard([b"ananas"])]
    who, rank, common = suffixdedup.merge(shards, 14)
    suffixes = []
    for k, j in zip(who, rank):
        s = shards[k]
        p = int(s.order[j])
        suffixes.append(bytes((s.symbols[p:p + s.left[p]] - np.uint64(1)).astype(np.uint8)))
    assert suffixes == sorted(suffixes) and len(suffixes) == 22
    assert common.tolist() == [0] + [14 if a == b else 0 if a[:7] != b[:7] else 7 for a, b in zip(suffixes, suffixes[1:])]


@pytest.mark.parametrize("options", [{}, {"group": 1}, {"merge_size": 50, "shard": 40}])
def test_remove_repeats(spark, options):
    r = random.Random(7)
    words = ["".join(r.choices("abcdeé", k=r.randint(1, 6))) for _ in range(60)]
    shared = [" ".join(r.choices(words, k=30)) for _ in range(4)]
    texts = [" ".join(r.choices(words, k=r.randint(0, 40))) + " " + r.choice(shared)[r.randint(0, 40):] + r.choice(["", "xy", " é"])
             for _ in range(60)]
    texts += texts[:5] * 3 + [None, "", "short", "ab" * 200, "a" * 500, "日本" * 40, "x" * 24, "y" * 23]
    rows = [(i // 2 if i % 9 else None, t, None, None, 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS).withColumn("tid", F.lit(1)).withColumn("body", F.lit("x")).withColumn("anchor", F.lit(1))
    got = suffixdedup.remove_repeats(df, length=24, gram=8, **options).collect()
    have = Counter((g["doc_id"], g["n_bytes"], g["n_removed"], tuple(map(tuple, g["spans"])), bytes(g["kept"])) for g in got)
    assert have == Counter((i, a, b, tuple(c), d) for (i, *_), (a, b, c, d) in zip(rows, removed_by_hand(texts, 24)))


def test_remove_repeats_odd(spark):
    assert suffixdedup.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0
    long = "".join(random.Random(1).choices("abcdefgh \n", k=400_000))
    got = suffixdedup.remove_repeats(spark.createDataFrame([(1, long, "", "", 0), (2, long[1000:1200], "", "", 0), (3, long[5000:5199], "", "", 0)],
                                                           DOCS)).orderBy("doc_id").collect()
    assert [(g["n_bytes"], g["n_removed"], len(g["spans"])) for g in got] == [(400_000, 200, 1), (200, 200, 1), (199, 0, 0)]


@pytest.mark.parametrize("block", [64, 1000, 1 << 23])
def test_pieces_do_not_depend_on_blocks(monkeypatch, block):
    """The pieces of long texts partition their windows, and equal windows share anchor and place."""
    monkeypatch.setattr(suffixdedup, "BLOCK_TEXT", block)
    r = random.Random(3)
    texts = [bytes(r.choices(b"abcd", k=n)) for n in (0, 10, 31, 32, 500, 2000)] + [b"ab" * 700]
    texts.append(texts[5][100:900])
    batch = pa.record_batch({"tid": pa.array(range(len(texts))), "body": pa.array(texts, pa.binary())})
    windows = defaultdict(set)
    starts = Counter()
    for out in suffixdedup.occurrences(iter([batch]), 32, 8):
        for g, _, tid, at in zip(*(c.to_pylist() for c in out.columns)):
            for s in range(at >> 16, (at >> 16) + (at & 0xFFFF)):
                windows[texts[tid][s:s + 32]].add(g)
                starts[tid, s] += 1
    assert starts == {(t, s): 1 for t, b in enumerate(texts) for s in range(len(b) - 31)}
    assert all(len(g) == 1 for g in windows.values())


# --- main text: what the article holds, whatever its markup is called -------------------

LONG = "<p>" + "Long paragraph text that counts here. " * 5 + "</p>"


def _text(markup):
    return htmltext.main_text(markup, [])


def test_layout_words_in_an_article_are_judged_by_what_they_hold():
    searched = '<section class="search"><h2>How search works</h2><p>Search looks things up in an index.</p></section>'
    assert "How search works Search looks things up" in _text(f"<article>{LONG}{searched}{LONG}</article>")
    assert "Mind the gap" in _text(f'<article>{LONG}<div class="alert alert-info"><p>Mind the gap, please.</p></div>{LONG}</article>')
    for word in ("social", "tags", "widget-7"):
        links = f'<div class="{word}"><a href="x">Share this</a> <a href="y">Follow that</a></div>'
        assert "Share" not in _text(f"<article>{LONG}{links}{LONG}</article>")
    assert "Aside text" not in _text(f'<article>{LONG}<div class="sidebar"><p>Aside text here.</p></div></article>')
    assert "Told you" not in _text(f'<article>{LONG}</article><div class="alert"><p>Told you.</p></div>')


def test_the_head_of_an_article_stays():
    page = f"<header><h1>Site</h1></header><article><header><h1>Title</h1></header>{LONG}</article>"
    assert _text(page).startswith("Title Long") and "Site" not in _text(page)


def test_paths_tell_all_classes_and_depths():
    page = f'<body><div class="a b c d main1">{LONG}{LONG}</div><div class="a b c d zzz"><p>unrelated words</p></div></body>'
    assert "unrelated" not in _text(page)
    deep = "<div>" * 90
    page = htmltext.read_page(f"<body>{deep}<p class=x>one</p></div><p class=x>two</p>")
    inner, outer = (k for k, key in enumerate(page.key) if key == "p.x")
    assert page.path[inner] != page.path[outer] and len({len(p) for p in page.path}) == 1
    assert _text(f"<body>{'<div>' * 300}{LONG * 50}") == htmltext.main_text(LONG * 50, [])


def test_random_pages_equal_a_walk_of_what_was_built(spark):
    """Pages built from known blocks: the text is what stands in the article, in order."""
    rng, rows, want = random.Random(6), [], {}
    around = ['<nav><a href="/">Home</a></nav>', '<div class="sidebar"><p>Side text.</p></div>', "<footer>Foot</footer>",
              '<div class="comments"><p>Reader says so at length, again and again.</p></div>', "<script>var p='<p>no</p>'</script>",
              '<div class="cookie-notice">We use cookies</div>', "<!-- <p>gone</p> -->", "<form><input><p>Sign up</p></form>"]
    for k in range(150):
        blocks, text = [], []
        for b in range(rng.randint(2, 9)):
            words = " ".join(rng.choices(["alpha", "beta", "gamma &amp; co", "caf&eacute;", "x&lt;y", "delta"], k=rng.randint(8, 30)))
            tag = rng.choice(["p", "h2", "li", "blockquote", "pre"])
            inner = rng.choice([words, f"<em>{words}</em>", words.replace(" ", "\n ", 2)])
            blocks.append(f"<ul><li class='c{b}'>{inner}</ul>" if tag == "li" else f"<{tag} class='c{b} d e f g'>{inner}</{tag}>")
            text.append(words.replace("&amp;", "&").replace("&eacute;", "é").replace("&lt;", "<"))
            if rng.random() < 0.3:
                blocks.append(rng.choice(around))
        wrap = rng.choice(["<article>{}</article>", "<main><article class='post-{k}'>{}</article></main>", "<div class='layout'><article><div>{}</div></article></div>"])
        page = "".join(rng.sample(around, 2)) + wrap.replace("{k}", str(k)).replace("{}", "".join(blocks)) + "".join(rng.sample(around, 2))
        rows.append((k // 2 * 2, f"http://h{k % 3}.org/{k}", f"<html><body>{page}</body></html>"))
        want.setdefault(k // 2 * 2, []).append(" ".join(text))
    rows.append((999, None, "<p>" + "long text " * 200_000 + "</p>"))
    want[999] = [("long text " * 200_000).strip()]
    got = defaultdict(list)
    for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect():
        got[r["page_id"]].append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


# --- steps on disk --------------------------------------------------------------

def test_saved_steps_leave_no_shuffle_files(spark):
    def files():
        held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for n in (held.apply(i).getName() for i in range(held.size())) if n.startswith("shuffle_")}

    before, kept, folder = files(), spark.conf.get(CLEANUP), shared_dir(spark, "t")
    assert kept == "false"
    rows = spark.range(2000).select((F.col("id") % 700).alias("n")).groupBy("n").count()
    held, n = save_counted(rows, f"{folder}/a")
    lines = linededup.store_lines(held.select(F.concat(F.lit("line "), "n").alias("line")), f"{folder}/lines")
    assert not files() - before
    assert (n, lines.count(), spark.conf.get(CLEANUP)) == (700, 700, kept)
    with pytest.raises(Exception):
        save_counted(rows.select(F.raise_error(F.lit("no")).alias("x")), f"{folder}/b")
    assert spark.conf.get(CLEANUP) == kept
