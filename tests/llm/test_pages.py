"""HTML extraction: markup, alignment, pairing and odd pages."""

import random
import re
from html import unescape

import pytest

from churnkit.llm import pages, queries
from tests.conftest import SF


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@pytest.mark.parametrize("bits", [1 << 28, 16])
def test_alignment_is_a_longest_common_subsequence(bits):
    r = random.Random(1)
    for _ in range(150):
        a, b = ([r.choice("abcde") for _ in range(r.randrange(30))] for _ in range(2))
        at = pages.common(a, b, bits)
        assert at == sorted(set(at)) and len(at) == lcs_length(a, b)
        rest = iter(b)
        assert all(a[i] in rest for i in at)


@pytest.mark.parametrize(("html", "text"), [
    ("", ""), ("plain &amp; <b>bo</b>ld", "plain & bold"), ("<p>a<p>b<br>c", "a b c"), ("<p><b>x.<br><p>y</p>", "x. y"),
    ("<nav>m</nav><article><h1>T</h1><p>a\n b</p></article><footer>f</footer>", "T a b"),
    ("<body class='has-sidebar'><div class=ad>x</div><main><p>a</p><aside>s</aside><form>f<p>g</form><p>b</p></main>rest", "a b"),
    ("<article>one<script>var t='</p>';<!-- x --></script><style>p{}</style> two<!-- c --></article>", "one two"),
    ("<article><p>x</p><section id=comments><article><p>first!</p></article></section></article>", "x"),
    ("<ARTICLE><P>&lt;tag&gt; &#233;&nbsp;z</P></ARTICLE>", "<tag> é z"), ("<article><ul><li>1<li>2</ul><table><tr><td>3<td>4</table>", "1 2 3 4"),
    ("<article><p>a<div role='navigation'>m</div>b</article>", "a b"), ("a < b and <3", "a < b and <3"),
    ("<header><h1>site</h1></header><article><header><h1>T</h1></header>a</article>", "T a"),
    ("<article><p>cut <a href='x", "cut"), ("<article><p>shadow adept</p><p class='lead-in'>z</p></article>", "shadow adept z")])
def test_markup(html, text):
    lines, inside = pages.blocks(html)
    assert " ".join(pages.main_text(lines, inside, None)) == text


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS part", "1 AS lines", "'k' AS key").repartition(4)


def test_unmarked_lines_shared_with_the_nearest_page_go(spark):
    page = lambda *p: "<body>" + "".join(f"<div>{x}</div>" for x in ("Home", "News today", *p, "All rights"))
    rows = [(1, "http://a.com/x/1", page("first story", "more of it")), (2, "http://a.com/x/2", page("second story")),
            (3, "http://a.com/x/2?copy", page("second story")), (4, "http://b.com/x/1", page("alone")), (5, None, None), (6, "", ""), (None, "http://c.com", "<p>q"),
            (7, "http://a.com/x/1", page("first story", "more of it"))]
    rows += [(100 + i, f"http://big.com/n/{i:03d}", page(f"story {i}", "x " * i)) for i in range(60)]
    got = sorted(((r.page_id, r.text) for r in pages.extract(frame(spark, rows)).collect()), key=str)
    want = [(1, "first story more of it"), (7, "first story more of it"), (2, "second story"), (3, "second story"), (4, "Home News today alone All rights"),
            (5, ""), (6, ""), (None, "q")] + [(100 + i, " ".join(f"story {i} {'x ' * i}".split())) for i in range(60)]
    assert got == sorted(want, key=str)
    assert pages.extract(frame(spark, rows).limit(0)).count() == 0


def test_query(spark):
    rows = {r.page_id: r for r in queries.op4_html(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = " ".join(unescape(re.sub(r"<b>|</b>", "", re.sub(r"</?(?:p|h1|br)>", " ", body))).split())
        g = rows.pop(r.page_id)
        assert (g.url, g.text, g.n_chars) == (r.url, want, len(want))
    assert not rows


@pytest.mark.parametrize(("html", "text"), [
    ("<div class='layout has-sidebar'><article><p>a</article></div>", "a"), ("<div id='page' class='no-sidebar'><p>a</div>", "a"),
    ("<div class=sidebar>w<article><p>a</article></div>", "a"), ("<aside><nav>m</nav><main><p>a</main></aside>", "a"),
    ("<body><form id=f><nav>m</nav><main><p>a<button>go</button></main></form></body>", "a"), ("<form><div>a</div><button>go</button></form>", "a"),
    ("<form>find<input></form><p>a", "a"), ("<article><div class='entry-header'><h1>T</h1></div><p class='market-share'>a<p class='related-work'>b</article>", "T a b"),
    ("<article><div class=header>T</div><p class=notice>a<div class=share>x</div><div class='site-footer'>y</div></article>", "T a"),
    ("<article><p>x = <math><mi>y</mi><annotation>tex</annotation></math> <object data=f><param name=q>z</object></article>", "x = y z"),
    ("<article><p>a</article><aside class=related><article>b</article></aside>", "a"),
    ("<article><p>a<div class=related><article>b</article></div></article>", "a"), ("<section id=comments><article>c</article></section><p>a", "a"),
    ("<div class='ad-box'>x</div><div class='ad_2'>y</div><p>a", "a")])
def test_only_chrome_goes(html, text):
    lines, inside = pages.blocks(html)
    assert " ".join(pages.main_text(lines, inside, None)) == text


def test_differencing_finds_an_unmarked_menu_within_the_main_container(spark):
    menu = "<div><a href=/>Home</a> <a href=/n>News</a></div>"
    page = lambda *p: f"<body><main>{menu}{''.join(f'<p>{x}</p>' for x in p)}</main>"
    rows = [(1, "http://a.com/x/1", page("first story", "a quote", "see <a href=q>here</a>")), (2, "http://a.com/x/2", page("second story", "a quote", "its end")),
            (3, "http://b.com/x/1", page("alone")), (4, "http://c.com/1", page("one", "two", "three")), (5, "http://c.com/2", page("one", "two", "other"))]
    got = {r.page_id: r.text for r in pages.extract(frame(spark, rows)).collect()}
    assert got == {1: "first story a quote see here", 2: "second story a quote its end", 3: "Home News alone", 4: "Home News one two three", 5: "Home News one two other"}
