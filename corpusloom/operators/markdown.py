"""HTML to Markdown by structure (K-11): headings, paragraphs, nested and
numbered lists, tables, quotes, code, links, images and emphasis, with all
character references.  Pages are converted row by row in Arrow batches; the
JVM regex chain of ``textprep.html_to_text`` stays the cheap form."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements whose content is no text of the page, and those that begin a block.
HIDDEN = {"script", "style", "head", "template", "noscript", "svg", "iframe"}
BLOCK = {"p", "div", "section", "article", "main", "header", "footer", "aside", "nav", "form", "figure", "figcaption", "address", "dl", "dt", "dd",
         "fieldset", "details", "summary", "body", "html"}
EMPHASIS = {"b": "**", "strong": "**", "i": "*", "em": "*", "s": "~~", "del": "~~", "strike": "~~"}


class _Converter(HTMLParser):
    """Collects blocks: (prefix of the first line, prefix of further lines, text)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str, str]] = []
        self.line: list[str] = []
        self.hidden = 0
        self.lists: list[list] = []  # [kind, number, whether its item has begun]
        self.quotes = self.pre = 0
        self.head, self.href = "", []
        self.tables: list[list[list[str]]] = []  # rows of cells of the open tables
        self.outer: list[list[str]] = []  # lines that tables interrupted
        self.cell: list[bool] = []  # whether a cell is open in each

    # --- blocks -----------------------------------------------------------------
    def _flush(self) -> None:
        text = "".join(self.line)
        self.line = []
        if not self.pre:
            text = "\n".join(re.sub(r"[ \t\r\n\f]+", " ", x).strip() for x in text.split("\v"))
        if not text.strip():
            return
        quote = "> " * self.quotes
        first = rest = quote
        if self.lists:
            pad = "  " * (len(self.lists) - 1)
            kind, number, fresh = self.lists[-1]
            mark = f"{number}. " if kind == "ol" else "* "
            first = quote + pad + (mark if fresh else " " * len(mark))
            rest = quote + pad + " " * len(mark)
            self.lists[-1][2] = False
        self.blocks.append((first + self.head, rest, text.strip("\n")))

    def handle_starttag(self, tag: str, attrs) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag in HIDDEN:
            self.hidden += 1
        if self.hidden:
            return
        if tag == "br":
            self.line.append(" " if self.tables else "\v")
        elif tag == "hr":
            self._flush()
            self.blocks.append(("", "", "---"))
        elif tag == "img":
            self.line.append(f"![{a.get('alt', '')}]({a.get('src', '')})")
        elif tag in EMPHASIS:
            self.line.append(EMPHASIS[tag])
        elif tag == "code" and not self.pre:
            self.line.append("`")
        elif tag == "a":
            self.href.append((a.get("href", ""), len(self.line)))
        elif tag == "table":
            self.outer.append(self.line)
            self.line = []
            self.tables.append([])
            self.cell.append(False)
        elif self.tables:  # inside a cell all is one line
            if tag == "tr":
                self._cell()
                self.tables[-1].append([])
            elif tag in ("td", "th"):
                self._cell()
                self.cell[-1] = True
            elif tag in BLOCK or tag == "li" or re.fullmatch("h[1-6]", tag):
                self.line.append(" ")
        elif tag in ("ul", "ol"):
            self._flush()
            self.lists.append([tag, int(a["start"]) - 1 if a.get("start", "").isdecimal() else 0, False])
        elif tag == "li":
            self._flush()
            if not self.lists:
                self.lists.append(["ul", 0, False])
            self.lists[-1][1] += 1
            self.lists[-1][2] = True
        elif tag == "blockquote":
            self._flush()
            self.quotes += 1
        elif tag == "pre":
            self._flush()
            self.pre += 1
        elif re.fullmatch("h[1-6]", tag):
            self._flush()
            self.head = "#" * int(tag[1]) + " "
        elif tag in BLOCK:
            self._flush()

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
            return
        if self.hidden:
            return
        if tag in EMPHASIS:
            self.line.append(EMPHASIS[tag])
        elif tag == "code" and not self.pre:
            self.line.append("`")
        elif tag == "a" and self.href:
            href, at = self.href.pop()
            text = re.sub(r"\s+", " ", "".join(self.line[at:])).strip()
            if href and text:
                self.line[at:] = [f"[{text}]({href})"]
        elif tag == "table" and self.tables:
            self._cell()
            self._table(self.tables.pop())
        elif self.tables:
            if tag in ("td", "th", "tr"):
                self._cell()
        elif tag in ("ul", "ol") and self.lists:
            self._flush()
            self.lists.pop()
        elif tag == "li":
            self._flush()
        elif tag == "blockquote" and self.quotes:
            self._flush()
            self.quotes -= 1
        elif tag == "pre" and self.pre:
            code = "".join(self.line).strip("\n")
            self.line, self.pre = [], self.pre - 1
            if code.strip():
                self.blocks.append(("", "", f"```\n{code}\n```"))
        elif re.fullmatch("h[1-6]", tag):
            self._flush()
            self.head = ""
        elif tag in BLOCK:
            self._flush()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.line.append(data if self.pre else data.replace("\v", " "))

    # --- tables -----------------------------------------------------------------
    def _cell(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.line)).strip()
        self.line = []
        rows = self.tables[-1]
        if text or self.cell[-1]:
            if not rows:
                rows.append([])
            rows[-1].append(text if len(self.tables) > 1 else text.replace("|", "\\|"))
        self.cell[-1] = False

    def _table(self, rows: list[list[str]]) -> None:
        self.cell.pop()
        inner = self.tables  # a table in a cell becomes its text
        rows = [r for r in rows if any(r)]
        self.line = self.outer.pop()
        if inner:
            self.line.append(" " + " ".join(c for r in rows for c in r) + " ")
            return
        self._flush()
        if rows:
            width = max(map(len, rows))
            lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
            lines.insert(1, "| " + " | ".join(["---"] * width) + " |")
            self.blocks.append(("", "", "\n".join(lines)))

    def result(self) -> str:
        while self.tables:
            self._cell()
            self._table(self.tables.pop())
        self._flush()
        out: list[str] = []
        for k, (first, rest, text) in enumerate(self.blocks):
            lines = text.split("\n")
            block = "\n".join([first + lines[0], *(rest + x for x in lines[1:])])
            item = re.match(r"(?:> )*\s*(?:\*|\d+\.) ", first) is not None or (first.strip() == "" and first != "")
            before = k and re.match(r"(?:> )*\s*(?:\*|\d+\.) ", self.blocks[k - 1][0]) is not None
            out.append(("" if not k else "\n" if item and before else "\n\n") + block)
        return "".join(out)


def to_markdown(html: str | None) -> str | None:
    """Markdown of one page; unclosed elements end with the page, NULL stays NULL."""
    if html is None:
        return None
    converter = _Converter()
    converter.feed(html)
    converter.close()
    return converter.result()


def html_to_markdown(c, banner: list[str] | None = None) -> Column:
    """K-11 + F-09: Markdown of an HTML column, without the literal ``banner`` texts."""
    def run(pages: pa.Array) -> pa.Array:
        return pa.array([to_markdown(p) for p in pages.to_pylist()], pa.string())

    out = F.arrow_udf(run, "string")(F.col(c) if isinstance(c, str) else c)
    for text in sorted(banner or [], key=len, reverse=True):
        out = F.replace(out, F.lit(text), F.lit(""))
    return out
