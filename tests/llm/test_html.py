import re
from html.parser import HTMLParser

import pytest

from voxspark.llm import html_text, queries

CASES = [
    ("<p>One<p>Two <b>bold</b>", "One\n\nTwo bold"),
    ("<div>a</div><div>b</div>c", "a\nb\nc"),
    ("<ul><li>x<li>y<ol start=3><li>n<li>m</ol></ul>", "- x\n- y\n  3. n\n  4. m"),
    ("<table><tr><td>a<td>long cell<tr><th>wider<td>b</table>", "a      long cell\nwider  b"),
    ("<td>lone</td>", "lone"),
    ("<head><title>t</title></head><body>x<script>if (a<b) '</p>'</script><style>p{}</style>y", "xy"),
    ('<p style="display: none">no</p><p hidden>no</p><p aria-hidden="true">no</p><p data-hidden="x">yes</p>', "yes"),
    ("a<br>b<br/>c &amp; &eacute;&#33; &lt;tag&gt;", "a\nb\nc & é! <tag>"),
    ("<pre>  two\n   three</pre>z", "  two\n   three\n\nz"),
    ("<!-- no <p>no</p> -->yes<!DOCTYPE html>", "yes"),
    ("<dl><dt>k<dd>v<dt>k2<dd>v2</dl>", "k\n  v\nk2\n  v2"),
    ("a < b and </nothing> c", "a < b and c"),
    ("<p>unclosed <b", "unclosed <b"),
    ("", ""),
    (None, ""),
    ("<h1>T</h1><p>p</p><hr><blockquote>q</blockquote>", "T\n\np\n\n  q"),
]


@pytest.mark.parametrize(("html", "text"), CASES)
def test_cases(html, text):
    assert html_text.render_text(html) == text


class _Visible(HTMLParser):
    """Only the words, by a plain depth count of hidden elements."""

    def __init__(self):
        super().__init__()
        self.hide, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "hr") or tag in html_text.BLOCK:
            self.out.append(" ")
        self.hide += tag in ("script", "style", "head", "title", "noscript", "template")

    def handle_endtag(self, tag):
        self.hide -= tag in ("script", "style", "head", "title", "noscript", "template")
        if tag in html_text.BLOCK:
            self.out.append(" ")

    def handle_data(self, data):
        if not self.hide:
            self.out.append(data)


def test_no_visible_word_is_lost(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in queries.op5_html_text(spark, sf).collect()}
    assert got.keys() == pages.keys()
    for i, html in pages.items():
        v = _Visible()
        v.feed(html)
        own = re.sub(r"^ *(- |\d+\. )", "", got[i], flags=re.M)
        assert sorted(re.findall(r"\w+", own)) == sorted(re.findall(r"\w+", re.sub(r"^ *(- |\d+\. )", "", "".join(v.out), flags=re.M)))


def test_odd_pages(spark):
    rows = [(1, None), (2, ""), (3, "<div>" * 3000 + "deep" + "</div>" * 3000), (4, "<b>" * 3000 + "inline"), (5, "<table>" * 300 + "t"), (6, "x" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "'clash' AS text", "'u' AS url")
    got = {r.page_id: r.text for r in html_text.extract_text(df).collect()}
    assert got[1] == got[2] == "" and got[3] == "deep" and got[4] == "inline" and got[5] == "t" and len(got[6]) == 300_000
    assert html_text.extract_text(df.limit(0)).count() == 0


TABLE_CASES = [
    ("<table><tr><form><td>a</td><td>b</td></form></tr></table>", "a  b"),
    ("<table><tr><a href=x><td>a</td></a><td>b</td></tr></table>", "a  b"),
    ("<table><tr><div>text</div><td>a</td></tr></table>", "text\na"),
    ("<table><tr>text<td>a</td></tr></table>", "text\na"),
    ("<table><tbody><form><tr><td>a</td></tr></form>more</tbody></table>", "more\na"),
    ("<table><thead><p>p</p><tr><td>a</td></tr></thead></table>", "p\na"),
    ("<table><form><tr><td>a<td>b</tr></form></table>", "a  b"),
    ("<table><colgroup><col><col><tr><td>a</td></tr></table>", "a"),
    ("<table><colgroup><col><tbody><tr><td>a<td>b</table>", "a  b"),
    ("<table><colgroup>text<col></colgroup><tr><td>a</table>", "text\na"),
    ("<table><tr hidden><td>no</td></tr><tr><div><table><tr><td>in</table></div><td>a</table>", "in\na"),
    ("<table><tr>x<b>y</b>z<td>a</table>", "x\ny\nz\na"),
]


@pytest.mark.parametrize(("html", "text"), TABLE_CASES)
def test_table_text_outside_of_cells_is_kept(html, text):
    assert html_text.render_text(html) == text


def test_broken_pages_take_linear_time():
    import time

    for html in ("<a " * 350_000, "<a<a" * 250_000, "<b>" * 200_000, "<a \"" * 250_000 + ">", "<a '\"" * 200_000 + "'>", "</p>" * 200_000, "<div>" * 100_000 + "</div>" * 50_000, "<p><table><td>" + "<b>" * 100_000 + "</p>" * 100_000, "<!" * 500_000, "<!--" * 250_000, "<li>" * 100_000, "<table><tr><td>" * 40_000):
        began = time.perf_counter()
        html_text.render_text(html)
        assert time.perf_counter() - began < 15, html[:8]
    assert html_text.render_text("a <b 'c") == "a <b 'c" and html_text.render_text("a <b 'x>y'>c") == "a c"


def test_hidden_at_any_depth():
    for depth in (1, 150, 199, 200, 250, 3000):
        html = "<div>" * depth + "<p style='display:none'>no<b>no</b></p>yes<ul><li hidden>no<li>one<li>two</ul>" + "</div>" * depth + "end"
        words = html_text.render_text(html).replace("- ", "").split()
        assert words == ["yes", "one", "two", "end"], (depth, words)


def test_visibility_is_inherited_and_can_be_turned_back():
    assert html_text.render_text("<div style='visibility:hidden'>a<b style='visibility:visible'>b<i>c</i></b>d</div>e") == "bc\ne"
    assert html_text.render_text("<p style='visibility: collapse'>a</p>b") == "b"


def test_op5_of_no_pages(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/pages.parquet").where("false").write.parquet(f"{tmp_path}/pages.parquet")
    assert queries.op5_html_text(spark, str(tmp_path)).count() == 0
