"""Main text: given pages, pages without any telling markup, odd markup, and the tree matching itself."""

import html
import itertools
import re

import numpy as np
import pytest

from siftgate.llm import html_text as ht
from siftgate.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    schema = "page_id long, url string, html string, text string, host string, shape string, id string, key string"
    return spark.createDataFrame([(*r, *[None] * 5) for r in rows], schema)


def texts(spark, rows):
    return {r.id: r.text for r in ht.main_text(frame(spark, rows)).collect()}


def one(page):
    """The text of the leaves that no mark covers, without other pages."""
    shape, found = ht.shape_of(ht.page_tree(page))
    leaves = []

    def visit(node, marked):
        marked = marked or node[0].rstrip("+").endswith("!")
        for child in node[1]:
            visit(child, marked) if child[1] else leaves.append(marked)

    visit(shape, False)
    assert len(leaves) == len(found)
    return " ".join(t for t, marked in zip(found, leaves) if not marked)


def test_given_pages(spark):
    def truth(page):
        inner = re.search(r"<article>(.*?)</article>", page, re.DOTALL).group(1)
        inner = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", inner))
        return " ".join(html.unescape(inner).split())

    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = QUERIES["op12_html_text"](spark, SF)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert {(r.page_id, r.url, r.text, r.n_chars) for r in got.collect()} == {(p.page_id, p.url, truth(p.html), len(truth(p.html))) for p in pages}


def test_constant_nodes_are_template_where_no_mark_tells(spark):
    rng = np.random.default_rng(1)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    rows, wanted = [], {}
    for i in range(40):
        body = [words(rng.integers(20, 60)) for _ in range(rng.integers(1, 15))]
        hint = "<div>Read more on our front page</div>" if i % 3 else ""
        page = f"<div>Our site <a href=/>Home</a></div><div><div>{'</div><div>'.join(body)}</div></div>{hint}<div>All rights reserved</div>"
        rows.append((i, f"http://one.example/{i}", f"<html><body>{page}</body></html>"))
        wanted[i] = " ".join(body)
    rows += [(100 + i, f"http://two.example/{i}", "<div><p>the very same story of some length</p></div>") for i in range(5)]  # copies only
    wanted |= {100 + i: "the very same story of some length" for i in range(5)}
    rows += [(200 + i, f"http://three.example/{i}", f"<article><p>the same story</p></article><div>note {i}</div>") for i in range(9)]
    wanted |= {200 + i: "the same story" for i in range(9)}
    assert texts(spark, rows) == wanted


def test_rounds_of_merging_keep_one_wrapper_a_host(spark, monkeypatch):
    monkeypatch.setattr(ht, "FAN", 2)
    rows, wanted = [], {}
    for i in range(24):
        boxes = "".join(f"<section><div>item {i} {k}</div><div>more {i} {k}</div></section>" for k in range(1 + i % 12))
        rows.append((i, "http://a.example", f"<div>Logo</div><main>{boxes}</main><div>Imprint</div>"))
        wanted[i] = " ".join(f"item {i} {k} more {i} {k}" for k in range(1 + i % 12))
    assert texts(spark, rows) == wanted


def test_odd_rows(spark):
    rows = [(1, None, None), (2, None, ""), (3, "no url", "<p>a&nbsp;b&amp;c&lt;<b>d</b>e"), (4, "http://h/", "<!-- <p>x</p> --><br>"), (None, "http://h/", "plain")]
    rows += [(6, "http://h/", "x " * 300_000 + "end"), (7, "http://h/", "<div>" * 3000 + "deep" + "</div>" * 3000), (3, "no url", "<p>a&nbsp;b&amp;c&lt;<b>d</b>e")]
    rows += [(8, "http://h/", "<a " * 50_000), (9, "http://h/", "a <b 'x> c <i>d")]
    got = ht.main_text(frame(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.id: r.text for r in got}
    assert (by[1], by[2], by[3], by[4], by[None]) == ("", "", "a b&c<de", "", "plain")
    assert by[6] == "x " * 300_000 + "end" and by[7] == "deep" and by[8] == "" and by[9] == "a c d"
    assert ht.main_text(frame(spark, [])).collect() == []


@pytest.mark.parametrize(
    "page,wanted",
    [
        ("<nav>menu</nav><article><header><h1>T</h1></header><p>a<p>b<aside>c</aside><footer>d</footer></article><footer>e</footer>", "T a b"),
        ("<main>a<section class='comments'><article class=comment>c</article></section></main>", "a"),
        ("<div class='has-sidebar'><article>a</article><div id=sidebar>b</div></div>", "a"),
        ("<article>a<div class='ad-box'>b</div><form>c</form><p class=cookieNotice>d<p>e</article>", "a e"),
        ("<article>1 &lt; 2 <script>var a='</p>'</script><style>p</style><noscript>n</noscript>x</article>", "1 < 2 x"),
        ("<article>a<span hidden>b</span><i style='display: none'>c</i>d</article>", "a d"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
        ("<p>a <b>b</p><p>c</b> d", "a b c d"),
        ("<title>no</title><h1>a</h1>b", "a b"),
    ],
)
def test_marks(page, wanted):
    assert one(page) == wanted


def test_alignment_is_a_largest_simple_tree_matching():
    rng = np.random.default_rng(3)

    def tree(depth):
        return ["ab"[rng.integers(2)] if depth < 3 else "r", [tree(depth - 1) for _ in range(rng.integers(0, 4))] if depth else []]

    def largest(a, b):
        if a[0] != b[0]:
            return 0
        best = 0
        for n in range(min(len(a[1]), len(b[1])) + 1):
            for xs in itertools.combinations(a[1], n):
                for ys in itertools.combinations(b[1], n):
                    sizes = [largest(x, y) for x, y in zip(xs, ys)]
                    best = max(best, sum(sizes))
        return 1 + best

    for _ in range(60):
        a, b = tree(3), tree(3)
        pairs = ht.align(a, b)
        assert all(x[0] == y[0] for x, y in pairs) and len(pairs) == largest(a, b)
