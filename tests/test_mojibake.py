"""Text repair (K-09): chains of layers, mixed damage, and text that must stay."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import mojibake as M

WHOLE = ["L'été à l'œuvre — « déjà » vu… 5 € l'unité", "Größe über Maß, Äpfel; ÉCOLE À NÎMES", "¿Mañana? ¡Sí, señor! 100 ½ °C",
         "Привет, мир! Ёлка", "Ελληνικά και Ώρα", "日本語の文章です。漢字", "한국어 문장", "emoji 😀👍 ok", "naïve façade — “quoted” ‘text’ ™", "plain ascii"]


def broken(text, *codecs):
    for codec in codecs:
        text = "".join(M.CODECS[codec][b] for b in text.encode())
    return text


@pytest.mark.parametrize("layers", [c for n in (1, 2) for c in itertools.product(["cp1252", "latin-1", "mac-roman"], repeat=n)])
def test_layers_are_undone(layers):
    latin = [t for t in WHOLE if all(ord(c) < 0x370 or 0x2010 <= ord(c) < 0x2123 for c in t)]
    for text in latin if "mac-roman" in layers else WHOLE:
        got, n = M.repaired(broken(text, *layers), {})
        assert got == text and n == (0 if text.isascii() else len(layers)), (text, layers)


def test_whole_text_stays():
    for text in WHOLE + ["Ãgua", "Â", "SÃO PAULO", "É»", "«étage»", "–é", "…à", "ÀÉÎÕÜ", "ɻɐ ə", "\x85\x92", ""]:
        assert M.repaired(text, {})[0] == text


def test_mixed_damage():
    for a, b in itertools.permutations(WHOLE, 2):
        assert M.repaired(broken(a, "cp1252") + " " + b, {})[0] == a + " " + b
    assert M.repaired(broken("é", "cp1252") + "é" + broken("è", "latin-1"), {})[0] == "ééè"
    assert M.repaired(broken("déjà", "cp1252") + " " + broken("déjà", "mac-roman") + " " + broken("déjà", "latin-1", "cp1252"), {})[0] == "déjà déjà déjà"


def test_long_runs_are_searched_in_parts():
    text = "".join(random.Random(1).choices("éèàùâêîôû", k=3000))
    assert M.repaired(broken(text, "cp1252"), {})[0] == text
    assert M.repaired(text, {})[0] == text


def test_repair_frame(spark):
    rows = [(i, broken(t, "cp1252") if i % 2 else t) for i, t in enumerate(WHOLE)] + [(98, None), (99, "")]
    df = spark.createDataFrame(rows, "i int, t string").withColumn("layers", F.lit("x"))
    got = {r["i"]: r for r in M.repair(df, "t", "n").collect()}
    assert all(got[i]["t"] == t and got[i]["n"] == (i % 2) * (not t.isascii()) for i, t in enumerate(WHOLE))
    assert got[98]["t"] is None and got[99]["t"] == "" and got[0]["layers"] == "x"
    assert M.repair(df.limit(0), "t").columns == df.columns
    for codec in M.CODECS:
        made = df.where("i = 1").select(M.damaged("t", codec).alias("d"), "t").first()
        assert made["d"] == broken(made["t"], codec)
