"""The literal parser (F-17) against Python's own, and its broken cells."""

import ast
import json
import random

from corpusloom.functions.literal import literal_to_json, parse_literal_list

SCHEMA = "struct<word:string,ok:boolean,score:double>"


def test_broken_cells_give_an_empty_list_and_only_those(spark):
    good = [("[{'word': \"it's\", 'score': 0.5}]", [("it's", None, 0.5)]),
            ("[{'word': 'a\\'b\"c', 'ok': True}, {'word': None, 'score': .5},]", [('a\'b"c', True, None), (None, None, 0.5)]),
            ("[{'word': 'l1\\nl2\\x41\\u00e9\\U0001F600\\101', 'score': 1e-3}\n {'word': 'b', 'score': -2}]",
             [("l1\nl2Aé😀A", None, 0.001), ("b", None, -2.0)]),
            ("({'word': 'a' 'b', 'score': +5.},)", [("ab", None, 5.0)]), ("[]", []), (" ( ) \n", []),
            ("[{'word': '\\q\\\\', 'score': 1_000}]", [("\\q\\", None, 1000.0)]),
            ("[{'word': '[{(,:', 'ok': False}]", [("[{(,:", False, None)])]
    bad = ["[{'word': 'x'", "[{'word': 'x')]", "[{'word': 'x'}] tail", "", "   ", None, "nope", "[1 2]", "[{'word':: 'x'}]", "[,]",
           "[{'word': 'x',, 'ok': True}]", "[{'word': '\\U00110000'}]", "[{'word': 007}]", "[{'word': 'x}]", "]", "{'word': 'x'}]"]
    rows = [(i, c) for i, c in enumerate([c for c, _ in good] + bad)]
    got = spark.createDataFrame(rows, "i int, c string").select("i", parse_literal_list("c", SCHEMA).alias("p")).collect()
    for r in got:
        want = good[r["i"]][1] if r["i"] < len(good) else []
        assert [tuple(x) for x in r["p"]] == want, rows[r["i"]]


def test_random_literals_equal_python(spark):
    rng = random.Random(5)
    letters = "ab'\"\\\n\t é😀[]{}(),:#\x07\x00"

    def value(depth):
        kind = rng.randrange(8 if depth else 5)
        if kind == 0:
            return rng.choice([None, True, False])
        if kind == 1:
            return rng.randint(-10**6, 10**6)
        if kind == 2:
            return rng.choice([0.5, -1e-7, 1e300, 12.0])
        if kind < 5:
            return "".join(rng.choices(letters, k=rng.randrange(8)))
        if kind == 5:
            return tuple(value(depth - 1) for _ in range(rng.randrange(4)))
        if kind == 6:
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        return {"".join(rng.choices(letters, k=3)): value(depth - 1) for _ in range(rng.randrange(4))}

    cells = [repr(value(3)) for _ in range(300)]
    cells += [c[:rng.randrange(len(c))] for c in cells]
    rows = spark.createDataFrame(list(enumerate(cells)), "i int, c string").select("i", literal_to_json("c").alias("j")).collect()
    for r in rows:
        try:
            want = ast.literal_eval(cells[r["i"]].strip())
        except (SyntaxError, ValueError):
            want = None if r["j"] is None else ValueError
        got = None if r["j"] is None else json.loads(r["j"])
        assert got == json.loads(json.dumps(want)) if want is not ValueError else False, (cells[r["i"]], r["j"])
