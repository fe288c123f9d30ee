"""Parser of printed Python literals (F-17) as a column expression.

A cell such as ``[{'name': "it's", 'score': 0.5},\\n {...}]`` is cut into
tokens by one pattern, each token becomes its JSON form (strings with their
escapes, ``None``, ``True``, tuples as lists), and a fold over the tokens
keeps the open brackets and what may come next.  The fold refuses whatever is
no literal, drops the comma before a closing bracket and sets the one that a
line break between two elements stands for (printed arrays have none).  The
JSON text is then read with the wanted schema.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the tokens of a literal, and the escapes of a string in it
_STRING = r"'(?:[^'\\]|\\[\s\S])*'" + r'|"(?:[^"\\]|\\[\s\S])*"'
_NUMBER = r"[+-]?(?:\d[\d_]*\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
TOKEN = rf"\s*(?:{_STRING}|{_NUMBER}|[A-Za-z_]+|\S)"
PIECE = r"\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8}|\\[0-7]{1,3}|\\[\s\S]|[^\\]+"
CONSTANTS = {"None": "null", "True": "true", "False": "false", "nan": '"NaN"', "inf": '"Infinity"'}
OPEN, CLOSE = {"[": "[", "(": "[", "{": "{"}, {"]": "]", ")": "]", "}": "}"}


def _unicode(code: Column) -> Column:
    """JSON escape of a code point (a pair beyond the first plane)."""
    def four(c):
        return F.concat(F.lit("\\u"), F.lpad(F.hex(c), 4, "0"))

    rest = code - 0x10000
    pair = F.concat(four(F.shiftright(rest, 10) + 0xD800), four(rest.bitwiseAND(F.lit(0x3FF)) + 0xDC00))
    return F.when(code < 0x10000, four(code)).when(code <= 0x10FFFF, pair)


def _piece(p: Column) -> Column:
    """One piece of a string's body as JSON; NULL for a code point out of range."""
    kind = F.substring(p, 2, 1)
    number = F.conv(F.substring(p, 3, 8), 16, 10).cast("long")
    octal = F.conv(F.substring(p, 2, 3), 8, 10).cast("long")
    plain = p
    for raw, safe in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        plain = F.replace(plain, F.lit(raw), F.lit(safe))
    return (F.when(~p.startswith("\\"), plain)
            .when(kind.isin("x", "u", "U") & (F.length(p) > 2), _unicode(number))
            .when(kind.isin("n", "r", "t", "b", "f"), p)
            .when(kind == "a", F.lit("\\u0007")).when(kind == "v", F.lit("\\u000b"))
            .when(kind == "\n", F.lit(""))
            .when(kind == "'", kind).when(kind == '"', F.lit('\\"')).when(kind == "\\", F.lit("\\\\"))
            .when(kind.between("0", "7"), _unicode(octal))
            .otherwise(F.concat(F.lit("\\\\"), kind)))  # an unknown escape stands for itself


def _string(token: Column) -> Column:
    body = F.substring(token, F.lit(2), F.length(token) - 2)
    pieces = F.transform(F.regexp_extract_all(body, F.lit(PIECE), F.lit(0)), _piece)
    broken = F.exists(pieces, lambda x: x.isNull())
    return F.when(~broken, F.concat(F.lit('"'), F.array_join(pieces, ""), F.lit('"')))


def _number(token: Column) -> Column:
    """JSON has no leading plus sign or point, no point at the end, and no
    underscores; Python has no number that begins with a needless zero."""
    t = F.regexp_replace(F.replace(token, F.lit("_"), F.lit("")), r"^\+", "")
    t = F.regexp_replace(F.regexp_replace(t, r"^(-?)\.", "$10."), r"\.(?=$|[eE])", ".0")
    return F.when(~t.rlike(r"^-?0\d"), t)


def _token(x: Column) -> Column:
    """Kind, JSON text and whether a line break stands before: v a value, s a
    string, o and c brackets, p a comma or colon, NULL what is none of these."""
    t = F.ltrim(x, F.lit(" \t\n\r\f\v"))
    constant = F.create_map(*[F.lit(y) for pair in CONSTANTS.items() for y in pair])
    bracket = F.create_map(*[F.lit(y) for pair in (OPEN | CLOSE).items() for y in pair])
    kind = (F.when(F.substring(t, 1, 1).isin("'", '"') & (F.length(t) > 1), "s").when(t.rlike(r"^[+\-.]?\d") | t.isin(*CONSTANTS), "v")
            .when(t.isin(*OPEN), "o").when(t.isin(*CLOSE), "c").when(t.isin(",", ":"), "p"))
    text = (F.when(kind == "s", _string(t)).when(t.isin(*CONSTANTS), F.try_element_at(constant, t)).when(kind == "v", _number(t))
            .when(kind.isin("o", "c"), F.try_element_at(bracket, t)).when(kind == "p", t))
    return F.struct(F.when(text.isNotNull(), kind).alias("k"), text.alias("t"), F.contains(x, F.lit("\n")).alias("line"), t.alias("raw"))


def _written(tokens: Column) -> Column:
    """The JSON text of ``tokens``, each with the commas and quotes that its neighbours ask for."""
    def one(x: Column, i: Column) -> Column:
        before, after = F.get(tokens, i - 1), F.get(tokens, i + 1)
        glued_on = (before["k"] == "s") & (x["k"] == "s") & ~x["line"]
        glued_to = (after["k"] == "s") & (x["k"] == "s") & ~after["line"]
        body = F.substring(x["t"], F.lit(2), F.length(x["t"]) - 2)
        string = F.concat(F.when(F.coalesce(glued_on, F.lit(False)), "").otherwise('"'), body, F.when(F.coalesce(glued_to, F.lit(False)), "").otherwise('"'))
        key = (x["k"] == "v") & (after["t"] == ":")
        text = (F.when(x["k"] == "s", string).when(F.coalesce(key, F.lit(False)), F.concat(F.lit('"'), x["raw"], F.lit('"')))
                .when((x["t"] == ",") & F.coalesce(after["k"] == "c", F.lit(False)), "").otherwise(x["t"]))
        broken = before["k"].isin("v", "s", "c") & x["k"].isin("v", "s", "o") & x["line"]
        return F.when(F.coalesce(broken, F.lit(False)), F.concat(F.lit(","), text)).otherwise(text)

    return F.array_join(F.transform(tokens, one), "")


def _well_formed(tokens: Column) -> Column:
    """Whether ``tokens`` are one whole value with matching brackets."""
    start = F.struct(F.lit("").alias("stack"), F.lit("").alias("last"), F.lit(True).alias("ok"))

    def step(a: Column, x: Column) -> Column:
        ended = a["last"].isin("v", "s", "c")
        inside = F.length(a["stack"]) > 0
        value = x["k"].isin("v", "s", "o")
        follows = ended & inside & x["line"] | (a["last"] == "s") & (x["k"] == "s")  # a comma is set, or strings are one
        fits = (F.when(value, (a["last"] == "") | a["last"].isin("o", ",", ":") | follows)
                .when(x["k"] == "c", (F.right(a["stack"], F.lit(1)) == F.translate(x["raw"], "])}", "[({")) & (ended | a["last"].isin("o", ",")))
                .otherwise(ended & inside & ((x["t"] == ",") | (F.right(a["stack"], F.lit(1)) == "{"))))
        stack = (F.when(x["k"] == "o", F.concat(a["stack"], x["raw"]))
                 .when(x["k"] == "c", F.substring(a["stack"], F.lit(1), F.length(a["stack"]) - 1)).otherwise(a["stack"]))
        last = F.when(x["k"] == "p", x["t"]).otherwise(x["k"])
        return F.struct(stack.alias("stack"), last.alias("last"), (a["ok"] & F.coalesce(fits, F.lit(False))).alias("ok"))

    return F.aggregate(tokens, start, step, lambda a: a["ok"] & (a["stack"] == "") & a["last"].isin("v", "s", "c"))


def literal_to_json(c) -> Column:
    """The printed Python literal ``c`` as JSON text, NULL if it is none."""
    c = F.rtrim(F.col(c) if isinstance(c, str) else c, F.lit(" \t\n\r\f\v"))
    cell = F.array(F.struct(F.transform(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), _token).alias("t")))
    # a one-element array binds the tokens once for the two readings of them
    return F.get(F.transform(cell, lambda x: F.when(_well_formed(x["t"]), _written(x["t"]))), F.lit(0))


def parse_literal(c, schema: str) -> Column:
    """F-17: the printed Python literal ``c`` read as ``schema``; a cell that
    is no literal, or not of that schema, is NULL."""
    return F.from_json(literal_to_json(c), schema)


def parse_literal_list(c, element: str) -> Column:
    """F-17: a printed list of ``element``; a broken cell is an empty list."""
    kind = f"array<{element}>"
    return F.coalesce(parse_literal(c, kind), F.array().cast(kind))
