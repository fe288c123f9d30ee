"""Main text of web pages by host-wide consensus.

Each page is read into a flat list of elements and text.  Its containers are
scored by the paragraphs they hold, and the page votes for the generalised
tag-class path of its best one.  Spark counts the votes per host.  Every page
is then read again and yields the text below its host's winning path; a page
that lacks the path follows the next one, and at last its own best container.
"""

from __future__ import annotations

import functools
import hashlib
import html
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import arrow_schema, maybe_broadcast, save, shared_dir

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Never part of the main text.
SKIP = RAW | {"head", "nav", "header", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "svg",
              "canvas", "audio", "video", "object", "label", "fieldset"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
          "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u",
          "var", "wbr"}
CONTAINER = {"article", "body", "div", "main", "section", "td", "center", "blockquote", "content"}
PARAGRAPH = {"p", "pre", "li", "dd", "dt", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "blockquote", "figcaption"}
#: Elements that a new one of the same group ends.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}}
ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4",
          "h5", "h6", "header", "hr", "main", "nav", "ol", "pre", "section", "table", "ul"}
SCOPE = {"article", "aside", "blockquote", "body", "div", "dl", "footer", "form", "header", "main", "nav", "ol", "section", "table", "ul"}
#: Words of a class, id or role that mark what is around the article.
AROUND = re.compile(r"(?:^|[-_\s])(?:ad|ads|adv|advert\w*|banner|breadcrumbs?|comments?|complementary|consent|contentinfo|cookies?|"
                    r"dialog|disclaimer|disqus|footer|gdpr|header|login|masthead|menu|modal|nav\w*|newsletter|notices?|pager|"
                    r"pagination|popup|promo\w*|recommend\w*|related|replies|reply|respond|search|share|sharing|sidebar\w*|"
                    r"signup|social|sponsor\w*|subscribe|tags|teaser|toolbar|widget\w*|alert|feedback|copyright|skip)(?:$|[-_\s\d])", re.I)
#: Of these, words of text that may be longer than the article; the others also name layouts.
BESIDE = re.compile(r"(?:^|[-_])(?:ad|ads|adv|advert\w*|comments?|consent|cookies?|copyright|disclaimer|disqus|feedback|gdpr|newsletter|notices?|"
                    r"promo\w*|recommend\w*|related|replies|reply|respond|sponsor\w*|teaser)(?:$|[-_\d])", re.I)
#: Words that say what a page or wrapper has, not what it is, and page builders' names of any block.
STATE = re.compile(r"^(?:has|have|no|not|non|with|without)[-_]|^(?:comments?|sidebar|ads?)[-_](?:open|closed|enabled|disabled|on|off|none)$", re.I)
BUILDER = re.compile(r"^elementor-(?:widget(?:-|$))?", re.I)
#: Layout words that are as often markup of the text: in an article they count only where links outweigh running text.
SOFT = re.compile(r"(?:^|[-_])(?:alert|search|skip|social|tags|widget\w*)(?:$|[-_\d])", re.I)
#: Elements of running text, and the share of it that a layout holds.
PROSE, BULK = {"p", "pre", "blockquote", "dd", "figcaption"}, 2 / 3
LIKELY = re.compile(r"article|body|content|entry|main|page|post|story|text", re.I)
VOTES = 3
#: Shares of a host's paths that are ranked apart.
SHARES = 256


@dataclass
class Page:
    """Elements in page order and the text between them."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    key: list[str] = field(default_factory=list)  # tag and classes
    path: list[str] = field(default_factory=list)  # digest of the keys from the root on
    mark: list[int] = field(default_factory=list)  # 1 layout word, 2 word of BESIDE, 3 tag of SKIP
    soft: set[int] = field(default_factory=set)  # elements marked by words of SOFT only
    skip: list[bool] = field(default_factory=list)  # below a mark that counts
    end: list[int] = field(default_factory=list)  # number of the first element after the subtree
    text: list[tuple[int, str | None]] = field(default_factory=list)  # element and text, None for a break


def read_page(source: str) -> Page:
    """Unclosed elements end with their parent, stray end tags are ignored, an
    unfinished tag at the end is dropped, and script-like elements run to
    their own end tag."""
    page = Page()
    _open(page, [], "#root", "", "")
    stack, at = [0], 0
    while at < len(source):
        m = TOKEN.search(source, at)
        if m is None:
            page.text.append((stack[-1], source[at:]))
            break
        if m.start() > at:
            page.text.append((stack[-1], source[at:m.start()]))
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name == "br":
                page.text.append((stack[-1], None))
            else:
                _close(page, stack, {name}, SCOPE if name in PARAGRAPH or name in INLINE else ())
            if name not in INLINE:
                page.text.append((stack[-1], None))
            continue
        if name in ENDS_P:
            _close(page, stack, {"p"}, SCOPE)
        if name in ("article", "main"):  # never part of a menu that was left open
            _close(page, stack, {"nav", "header"}, {"article", "main", "aside", "footer"})
        if name in CLOSES:
            _close(page, stack, CLOSES[name], SCOPE - CLOSES[name])
        if name not in INLINE:
            page.text.append((stack[-1], None))
        if name in VOID:
            continue
        stack.append(_open(page, stack, name, m[3], page.path[stack[-1]]))
        if name in RAW:
            stop = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*(?:>|\\Z)", re.I).search(source, at)
            at = stop.end() if stop else len(source)
            _close(page, stack, {name}, ())
    for k in stack:
        page.end[k] = len(page.tag)
    _skip(page)
    return page


def _mark(words: str) -> tuple[int, bool]:
    """(mark, whether words of SOFT alone gave it)"""
    found = [w for w in (BUILDER.sub("", w) for w in words.split() if not STATE.search(w)) if AROUND.search(w)]
    if any(map(BESIDE.search, found)):
        return 2, False
    return (1, all(map(SOFT.search, found))) if found else (0, False)


@functools.lru_cache(1 << 16)
def _path(above: str, key: str) -> str:
    return hashlib.blake2b(f"{above}/{key}".encode(errors="surrogatepass"), digest_size=12).hexdigest()


def _inherited(page: Page, least: int) -> list[bool]:
    """Of every element, whether it is at or below a mark of ``least`` or more."""
    out: list[bool] = []
    for m, above in zip(page.mark, page.parent):
        out.append(m >= least or above >= 0 and out[above])
    return out


def _skip(page: Page) -> None:
    """Set ``skip``.  A layout word on a wrapper does not count: when every
    article or main with text is below such words, those around the longest
    one go, and so do those of a path that holds the bulk of the running text.
    Words of BESIDE go only around an article on a page without other text."""
    if not {1, 2} & set(page.mark):
        page.skip = _inherited(page, 1)
        return
    n = len(page.tag)
    size, prose, links = [0] * n, [0] * n, [0] * n
    linked, running, in_article = [False] * n, [False] * n, [False] * n
    for k in range(1, n):
        above, tag = page.parent[k], page.tag[k]
        linked[k] = tag == "a" or linked[above]
        running[k] = tag in PROSE or tag not in CONTAINER and running[above]
        in_article[k] = tag in ("article", "main") or in_article[above]
    for k, t in page.text:
        if t and (length := len(t.strip())):
            size[k] += length
            if linked[k]:
                links[k] += length
            elif running[k]:
                prose[k] += length
    before = list(itertools.accumulate((a - b for a, b in zip(prose, links)), initial=0))
    for k in page.soft:
        if in_article[k] and before[page.end[k]] > before[k]:
            page.mark[k] = 0

    def below(lengths: list[int], hidden: list[bool]) -> list[int]:
        """Length of the text below every element, without what is hidden."""
        sums = [0]
        for k in range(n):
            sums.append(sums[-1] + (0 if hidden[k] else lengths[k]))
        return [sums[page.end[k]] - sums[k] for k in range(n)]

    def lift(around: int, most: int) -> None:
        paths = set()
        while (around := page.parent[around]) > 0:
            if 0 < page.mark[around] <= most:
                paths.add(page.path[around])
        for k in range(n):
            if page.path[k] in paths and page.mark[k] <= most:
                page.mark[k] = 0

    articles = [k for k in range(n) if page.tag[k] in ("article", "main")]
    hidden = _inherited(page, 2)
    whole, shown = below(size, hidden), below(size, _inherited(page, 1))
    if not any(shown[k] for k in articles):
        best = max(articles, key=lambda k: whole[k], default=0)
        if whole[best]:
            lift(best, 1)
    # beside an article or main, only what is in it can be a layout of the text
    skip, inside = _inherited(page, 1), [False] * n
    for k in range(1, n):
        inside[k] = inside[page.parent[k]] or page.tag[k] in ("article", "main") and not skip[k] and whole[k] > 0
    if any(inside):  # all text of an article counts, lists and headings too
        bulk = below([a - b for a, b in zip(size, links)], [h or not i for h, i in zip(hidden, inside)])
    else:
        bulk = below(prose, hidden)
    while True:
        skip, held = _inherited(page, 1), {}
        for k in range(1, n):
            if page.mark[k] == 1 and not skip[page.parent[k]]:
                held[page.path[k]] = held.get(page.path[k], 0) + bulk[k]
        top = max(held, key=lambda p: held[p], default=None)
        if top is None or held[top] <= BULK * bulk[0]:
            break
        for k in range(n):
            if page.path[k] == top and page.mark[k] == 1:
                page.mark[k] = 0
    if articles and not below(size, _inherited(page, 1))[0]:
        text = below(size, _inherited(page, 3))
        best = max(articles, key=lambda k: text[k])
        if text[best]:
            lift(best, 2)
    page.skip = _inherited(page, 1)


def _open(page: Page, stack: list[int], name: str, attributes: str, above: str) -> int:
    mark, key = 3 if name in SKIP else 0, name
    if name == "header" and any(page.tag[k] == "article" for k in stack):
        mark = 0  # an article's own head
    if attributes and "=" in attributes:
        found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
        if not mark and name not in ("html", "body", "article", "main"):
            mark, soft = _mark(" ".join(found.values()))
            if soft:
                page.soft.add(len(page.tag))
        if marks := sorted(set(re.sub(r"\d+", "#", w) for w in found.get("class", "").lower().split())):
            key += "." + ".".join(marks)
    page.parent.append(stack[-1] if stack else -1)
    page.tag.append(name)
    page.key.append(key)
    page.path.append(_path(above, key))
    page.mark.append(mark)
    page.end.append(0)
    return len(page.tag) - 1


def _close(page: Page, stack: list[int], names: set[str], barrier) -> None:
    """End the innermost open element of ``names``, and all inside it, unless
    a ``barrier`` element is met first."""
    for k in range(len(stack) - 1, 0, -1):
        tag = page.tag[stack[k]]
        if tag in names:
            for e in stack[k:]:
                page.end[e] = len(page.tag)
            del stack[k:]
            return
        if tag in barrier:
            return


def best_container(page: Page) -> tuple[int, float]:
    """Element of the highest score, widened to its article: a paragraph's
    length, less what is in links, counts for its container, and half for the
    next one."""
    n = len(page.tag)
    length, linked, in_link = [0] * n, [0] * n, [False] * n
    for k in range(1, n):
        in_link[k] = page.tag[k] == "a" or in_link[page.parent[k]]
    holder = list(range(n))
    for k in range(1, n):
        holder[k] = k if page.tag[k] in PARAGRAPH or page.tag[k] in CONTAINER else holder[page.parent[k]]
    for k, t in page.text:
        if t and not page.skip[k] and (size := len(t.strip())):
            length[holder[k]] += size
            if in_link[k]:
                linked[holder[k]] += size
    score = [0.0] * n
    for k in range(n):
        value = length[k] - 2 * linked[k]
        if value > 0:
            above, share = (k if page.tag[k] in CONTAINER else page.parent[k]), 1.0
            while above >= 0 and share > 0.2:
                if page.tag[above] in CONTAINER or above == 0:
                    score[above] += share * value
                    share /= 2
                above = page.parent[above]
    for k in range(n):
        if page.tag[k] in ("article", "main") or LIKELY.search(page.key[k].partition(".")[2]):
            score[k] *= 1.3
    best = max(range(n), key=lambda k: (score[k], -k))
    return _widened(page, best, length, linked), score[best]


def _widened(page: Page, best: int, length: list[int], linked: list[int]) -> int:
    """The nearest article or main around ``best``; without any, the outermost
    container below the body to which each step up adds text that is not
    mostly links."""
    above = best
    while above > 0:
        if page.tag[above] in ("article", "main"):
            return above
        above = page.parent[above]
    if page.tag[best] in ("body", "html", "#root"):
        return best
    text, links = [0], [0]
    for a, b in zip(length, linked):
        text.append(text[-1] + a)
        links.append(links[-1] + b)
    inner, above = best, page.parent[best]
    while above > 0 and page.tag[above] not in ("body", "html"):
        if page.tag[above] in CONTAINER:
            more, of_links = (x[page.end[above]] - x[above] - x[page.end[inner]] + x[inner] for x in (text, links))
            if 2 * of_links > more:
                break
            inner = above
            if more:
                best = above
        above = page.parent[above]
    return best


def text_below(page: Page, path: str) -> str:
    """Text of all elements of that path, in page order."""
    spans, last = [], 0
    for k, p in enumerate(page.path):
        if p == path and k >= last and not page.skip[k]:
            spans.append((k, page.end[k]))
            last = page.end[k]
    out, at = [], 0
    for k, t in page.text:
        while at < len(spans) and k >= spans[at][1]:
            at += 1
        # an element's text may follow that of its children
        if any(a <= k < b for a, b in spans[max(0, at - 1):at + 1]) if spans else False:
            if not page.skip[k]:
                out.append(" " if t is None else t)
            elif out:
                out.append(" ")
    return " ".join(html.unescape("".join(out)).split())


def main_text(source: str | None, paths: list[str]) -> str:
    """Main text by the first of ``paths`` that yields any, else by the page's
    own best container."""
    if not source:
        return ""
    page = read_page(source)
    have = set(page.path)
    for path in paths:
        if path in have and (text := text_below(page, path)):
            return text
    best, score = best_container(page)
    return text_below(page, page.path[best]) if score > 0 else ""


def host_of(url: str):
    """Host of a url column, lower-cased without port; '' when there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def host_paths(pages: DataFrame, host: str = "host", html_col: str = "html") -> DataFrame:
    """``host`` and its ``paths``: those most voted for, at most ``VOTES``."""
    schema = "host string, path string, score double"
    target = arrow_schema(pages.sparkSession.createDataFrame([], schema).schema)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[tuple[str, str], list] = {}
            hosts, sources = batch.column(0).to_pylist(), batch.column(1)
            for h, source in zip(hosts, sources):
                page = read_page(source.as_py())
                best, score = best_container(page)
                if score > 0:
                    rows.setdefault((h, page.path[best]), []).append(score)
            if rows:
                keys, scores = zip(*rows.items())
                flat = [(h, p, s) for (h, p), all_ in zip(keys, scores) for s in all_]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*flat), target)], schema=target)

    votes = (pages.where(F.length(html_col) > 0).select(host, html_col).mapInArrow(vote, schema)
             .groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(F.log1p("score")).alias("score")))
    ranked = votes.select("host", F.struct("n", F.round("score", 6).alias("score"), "path").alias("v"))
    # class names can make about one path a page: the best of each share of a host's paths, then those of the host
    share = Window.partitionBy("host", F.pmod(F.xxhash64("v.path"), F.lit(SHARES))).orderBy(F.desc("v"))
    ranked = ranked.withColumn("place", F.row_number().over(share)).where(F.col("place") <= VOTES)
    return (ranked.groupBy("host").agg(F.expr(f"slice(reverse(array_sort(collect_list(v))), 1, {VOTES})").alias("v"))
            .select("host", F.col("v.path").alias("paths")))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` for every row of ``pages``.

    Null and empty html give an empty text, as do pages without text outside
    of menus and the like.  Pages without a host (null or odd urls) share the
    host ''.  Repeated rows are read each; empty input gives no rows; other
    columns are ignored."""
    base = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                        F.col(f"`{html_col}`").cast("string").alias("html")).withColumn("host", host_of("url"))
    # saved, so that it is broadcast if small and a hot host can be split otherwise
    paths = save(host_paths(base), f"{shared_dir(pages.sparkSession, 'hosts')}/paths")
    joined = base.join(maybe_broadcast(paths, 200), "host", "left").select("page_id", "url", "html", "paths")
    schema = "page_id long, url string, text string, n_chars long"
    target = arrow_schema(pages.sparkSession.createDataFrame([], schema).schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, sources, paths = batch.columns
            texts = [main_text(s.as_py(), p or []) for s, p in zip(sources, paths.to_pylist())]
            yield pa.RecordBatch.from_arrays([ids, urls.cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=target)

    return joined.mapInArrow(read, schema)
