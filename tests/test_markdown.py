"""HTML to Markdown by structure."""

import html
import random

import pytest

from corpusloom.operators.markdown import html_to_markdown, to_markdown


@pytest.mark.parametrize("page,want", [
    ("<h2>A &amp; B</h2><p>x <b>bold</b>, <em>it</em> <a href='u'>link</a>&#8212;&#x41;<br>next", "## A & B\n\nx **bold**, *it* [link](u)—A\nnext"),
    ("<ul><li>a<ul><li>b<li>c<ol start=3><li>d<li>e</ol></ul><li>f</ul>", "* a\n  * b\n  * c\n    3. d\n    4. e\n* f"),
    ("<table><tr><th>h<th>i</tr><tr><td>1|2<td></tr><tr><td><p>p</p><p>q</p></table>",
     "| h | i |\n| --- | --- |\n| 1\\|2 |  |\n| p q |  |"),
    ("<table><tr><td>a<table><tr><td>x|y<td>z</table>b<td>c</table>", "| a x\\|y z b | c |\n| --- | --- |"),
    ("<blockquote><p>q</p><blockquote>r<br>s</blockquote></blockquote>", "> q\n\n> > r\n> > s"),
    ("<pre>a\n  b</pre>t<code>c</code>", "```\na\n  b\n```\n\nt`c`"),
    ("<script>var a='<p>no</p>'</script><style>p{}</style><!-- no --><p>yes", "yes"),
    ("a  b\n c<hr><img src=i alt=x>", "a b c\n\n---\n\n![x](i)"),
    ("", ""), (None, None), ("</p></table></ul></blockquote>x", "x"), ("<li>lone", "* lone"), ("1 < 2 &unknown; &", "1 < 2 &unknown; &"),
])
def test_pages(page, want):
    assert to_markdown(page) == want


def test_no_word_is_lost():
    rng = random.Random(3)
    for _ in range(200):
        words, page, stack = [], [], []
        for k in range(rng.randint(1, 30)):
            if rng.random() < 0.5:
                tag = rng.choice(["p", "div", "ul", "ol", "li", "table", "tr", "td", "blockquote", "b", "h3", "span", "section"])
                page.append(f"<{tag}>")
                stack.append(tag)
            if stack and rng.random() < 0.4:
                page.append(f"</{stack.pop()}>")
            words.append(f"w{k}é&")
            page.append(html.escape(f" w{k}é& "))
        got = to_markdown("".join(page))
        assert sorted(w for w in got.replace("*", " ").split() if w.startswith("w")) == sorted(words), "".join(page)


def test_column(spark):
    df = spark.createDataFrame([("<h1>Banner</h1><p>text",), (None,)], "h string")
    assert [r[0] for r in df.select(html_to_markdown("h", ["# Banner\n\n", "# Banner"])).collect()] == ["text", None]
