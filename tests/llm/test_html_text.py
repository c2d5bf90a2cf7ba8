import random
import time
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from quadrille.llm.html_text import UNSEEN, VOID, extract_text, html_text

CASES = [
    ("", ""),
    ("plain &amp; simple", "plain & simple"),
    ("<p>a<p>b", "a\n\nb"),
    ("<div>a</div><div>b</div>c", "a\nb\nc"),
    ("<ul><li>x<li>y<ol start=3><li>1<li>2</ol></ul>t", "- x\n- y\n  3. 1\n  4. 2\n\nt"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<title>t</title><style>s</style><script>if (a</p>b) x</script>v", "v"),
    ("<div hidden>n</div><p style='color:red; display : none'>n</p><span style='visibility:hidden'>n</span>y", "y"),
    ("<!-- a > b -->c<!-- open", "c"),
    ("<pre> a\n   b</pre>", " a\n   b"),
    ("  a \n\t b  <b> c</b>d ", "a b cd"),
    ("a&nbsp;b", "a\u00a0b"),
    ("<table><tr><th>A<th>Long head<tr><td>1<td>2<tr><td>longer cell<td>x<br>y</table>", "A            Long head\n1            2\nlonger cell  x\n             y"),
    ("<table><tr><td colspan=2>wide<tr><td>a<td>b</table>", "wide\na  b"),
    ("<b>bo<i>ld</b>x</i> end", "boldx end"),
    ("<a title='a > b'>t</a> 1 < 2", "t 1 < 2"),
    ("<dl><dt>t<dd>d</dl><blockquote>q</blockquote>", "t\n    d\n\n  q"),
    ("<select><option>a<option>b</select><textarea>n</textarea>x", "x"),
    ("text <unfinished", "text"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
    ("<table><tr><td>a<td rowspan=2>b<td>c<tr><td>d<td>e</table>", "a  b  c\nd     e"),
    ("<svg><title>t</title><desc/><path d='x'/><text>one</text><text>two</text></svg>x", "one\ntwo\nx"),
    ("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>hid</annotation></math>", "x=1"),
    ("<div style='visibility:hidden'>n<b style='visibility: visible'>y</b></div>", "y"),
    ("<div style='display:none; display:block'>y</div>", "y"),
    ("<div>" * 260 + "a<div style='display:none'>secret", "a"),
    ("<ul><li><p>a</p><p>b</p><li></ul>", "- a\n\n  b"),
    ("<ul><li><ul><li>x<li>y</ul></ul>", "- - x\n  - y"),
]


@pytest.mark.parametrize("html,text", CASES)
def test_layout(html, text):
    assert html_text(html) == text


def test_time_and_output_are_linear():
    began = time.time()
    pages = ["<div>" * 100_000 + "x", "<ul><li>" * 50_000 + "x", "<a " * 20_000, "<a b='" * 10_000, "<" * 50_000, "<script>" * 10_000, "</p>" * 5_000, "<table><tr><td>" * 20_000 + "x", "<p><button>" + "<div>" * 50_000, "<b><p>" * 30_000 + "</b>" * 30_000]
    pages += ["<table>" + f"<tr><td>{'w' * 400}<td>x" + "<tr><td>a<td>b" * 50_000, "<table><tr>" + "<td>a" * 1000 + "<tr><td colspan=1000><td>x" * 20_000, "<table><tr>" + "<td>a" * 20_000 + "<td>" + "b<br>" * 50_000, "<blockquote>" * 5_000 + "a<br>" * 50_000]
    for html in pages:
        assert len(html_text(html)) < 130 * len(html)
    assert time.time() - began < 60


def naive(tree, depth=0):
    """Paragraphs and lists of a made-up tree as lines, straight from their definition."""
    blocks = []  # (spaced, lines)
    for kind, content in tree:
        if kind == "p":
            blocks.append((True, [content]))
        elif kind == "div":
            blocks.append((False, [content]))
        elif kind == "hidden":
            continue
        else:
            lines = []
            for i, item in enumerate(content):
                mark = "- " if kind == "ul" else f"{i + 1}. "
                lines += [(mark if j == 0 else " " * len(mark)) + x if x else "" for j, x in enumerate(naive(item, depth + 1))]
            blocks.append((not depth, lines))
    out, before = [], False
    for spaced, lines in blocks:
        if lines:
            out += [""] * (bool(out) and (spaced or before)) + lines
            before = spaced
        elif spaced:
            before = True
    return out


def made_up(r, depth=0):
    tree, html = [], []
    for _ in range(r.randint(1, 4)):
        kind = r.choice(["p", "div", "hidden", *(["ul", "ol"] if depth < 4 else [])])
        if kind in ("ul", "ol"):
            items = [made_up(r, depth + 1) for _ in range(r.randint(1, 3))]
            tree.append((kind, [t for t, _ in items]))
            html.append(f"<{kind}>" + "".join(f"<li>{h}" + r.choice(["", "</li>"]) for _, h in items) + f"</{kind}>")
        else:
            word = "".join(r.choice("abc") for _ in range(4))
            tree.append((kind, word))
            html.append({"p": f"<p>{word}" + r.choice(["", "</p>"]), "div": f"<div> {word}\n</div>", "hidden": f"<div hidden>{word}</div>"}[kind])
    return tree, "".join(html)


def test_made_up_pages():
    r = random.Random(11)
    for _ in range(1500):
        tree, html = made_up(r)
        assert html_text(html) == "\n".join(naive(tree)), html


class Visible(HTMLParser):
    """All visible characters but white space, by the standard library's parser; for pages with end tags."""

    def __init__(self):
        super().__init__()
        self.hidden, self.found = [], []

    def handle_starttag(self, tag, attributes):
        a = dict(attributes)
        if tag not in VOID and (self.hidden or tag in UNSEEN or "hidden" in a or "none" in (a.get("style") or "")):
            self.hidden.append(tag)

    def handle_endtag(self, tag):
        if tag in self.hidden:
            while self.hidden.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.hidden:
            self.found.append(data)


def test_all_visible_text_of_pages_is_there():
    """Whatever the layout, no visible character is lost or made up; markers aside."""
    rows = pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist()
    for row in rows:
        other = Visible()
        other.feed(row["html"] or "")
        other.close()
        letters = lambda x: "".join(c for c in x if c.isalpha())
        assert letters(html_text(row["html"] or "")) == letters("".join(other.found)), row["page_id"]


def test_rows(spark):
    pages = spark.createDataFrame([(1, None, "t"), (2, "", "t"), (3, "<p>x", "t"), (3, "<p>x", "t"), (None, "<p>y", "t"), (4, "<p>é " * 50_000, "t")], "page_id long, html string, text string")
    got = sorted((str(r.page_id), r.text[:3]) for r in extract_text(pages).collect())
    assert got == [("1", ""), ("2", ""), ("3", "x"), ("3", "x"), ("4", "é\n\n"), ("None", "y")]
    assert extract_text(pages.limit(0)).count() == 0
