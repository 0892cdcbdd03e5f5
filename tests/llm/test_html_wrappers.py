"""Wrappers of hosts, and main texts against plain readings of pages whose parts are known."""

from __future__ import annotations

import html
import os
import random
import re

import pytest

from tracewell.llm import html_wrappers
from tracewell.llm.catalog import op13_html_wrappers
from tracewell.llm.html_wrappers import Item, merge, read, summary

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain_article(page):
    """The blocks between <article> and its end, for pages of h1, p, b and br alone."""
    body = (page or "").partition("<article>")[2].partition("</article>")[0]
    blocks = re.split(r"</?(?:p|h1)>", body)
    texts = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks]
    return "\n\n".join(t for t in texts if t)


def test_query_against_a_plain_version(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = op13_html_wrappers(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, plain_article(pages[r.page_id].html), len(r.text))


def test_expressions_are_folded():
    page = f"<ul><li>a<li>b<li>c</ul><dl>{'<dt>x<dd>y' * 4}<dt>x</dl><div>{'<p>one<p>two<h2>t</h2>' * 4}<p>last</div><h1>a</h1><p>b</p><h1>c</h1>"
    assert str(read(page)[0]) == "(ul(li(#)+)dl((dt(#)dd(#)?)+)div((p(#)+h2(#)?)+)h1(#)p(#)h1(#))"
    assert str(merge(read("<p>a</p><table><tr><td>x</table>")[0], read("<p>a</p><p>b</p><h3>h</h3>")[0], True)) == "(p(#)+table(tr(td(#)))?h3(#)?)"


def test_a_wrapper_matches_whatever_it_was_made_of():
    rng = random.Random(6)

    def page():
        parts = [rng.choice(["<p>t</p>", "<h2>t</h2>", "<div><p>t</div>", "<ul><li>a<li>b</ul>", "<pre>t</pre>"]) for _ in range(rng.randrange(9))]
        return "<body>" + "".join(parts)

    def pattern(item):
        body = "#" if item.label == "#" else "\\(".join([re.escape(item.label), ""]) + "".join(map(pattern, item.kids)) + "\\)" if item.label else "".join(map(pattern, item.kids))
        return f"(?:{body})" + ("*" if item.many and item.maybe else "+" if item.many else "?" if item.maybe else "")

    def stream(text):
        # The page's own blocks, each as label(...), as they follow each other.
        return "".join(
            {"p": "p(#)", "h2": "h2(#)", "div": "div(p(#))", "ul": "ul(li(#)li(#))", "pre": "pre(#)"}[m] for m in re.findall(r"(?<=[>y])<(p|h2|div|ul|pre)>", re.sub(r"<div><p>", "<div>", text))
        )

    for _ in range(40):
        pages = [page() for _ in range(5)]
        wrapper = None
        for p in pages:
            wrapper = summary(p) if wrapper is None else merge(wrapper, summary(p))
        whole = re.compile(pattern(wrapper))
        for p in pages:
            assert whole.fullmatch(f"body({stream(p)})"), (p, str(wrapper))


def template(rng, k):
    own = lambda n: " ".join(f"w{rng.randrange(1000)}" for _ in range(n))
    title, paragraphs = own(4), [own(20) for _ in range(rng.randrange(1, 5))]
    banner = "<div class='cookie-notice'>We use cookies</div>" if k % 2 else ""
    related = f"<div><a href=/x>{own(2)}</a><a href=/y>{own(3)}</a></div>" if k % 3 else ""
    comments = f"<section class=comments><p>{own(5)}</p></section>" if k % 4 else ""
    page = (
        f"<!doctype html><html><head><title>{title}</title><script>if (a<b) x('<p>');</script></head><body>{banner}<div>Welcome to the site</div>"
        f"<ul><li><a href=/>{own(1)}</a><li><a href=/b>{own(1)}</a></ul><div class='c{k}'><h1>{title}</h1>"
        + "".join(f"<p>{p} &amp;\n  <b>{own(1) and 'bold'}</b></p>" for p in paragraphs)
        + f"</div>{related}{comments}<form>name <input></form><div>All rights reserved</div></body></html>"
    )
    return page, "\n\n".join([title, *[f"{p} & bold" for p in paragraphs]])


def test_pages_without_an_article_element(spark):
    rng = random.Random(3)
    made = [template(rng, k) for k in range(24)]
    rows = [(k, f"https://h{k % 2}.example/p/{k}", page, "old") for k, (page, _) in enumerate(made)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_wrappers.extract(pages.repartition(3)).collect()}
    assert got == {k: want for k, (_, want) in enumerate(made)}
    joined = html_wrappers.extract(pages, shared_bytes=0).collect()
    assert {r.page_id: r.text for r in joined} == got
    one, many = (sorted(map(tuple, html_wrappers.infer(pages.repartition(n)).collect())) for n in (1, 5))
    assert one == many and [r[1] for r in one] == [12, 12]


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""), ("", ""), ("plain &lt;text", "plain <text"), ("<p>a<br>b<!-- no --><p>c &nbsp; d\n e", "a b\n\nc d e"),
        ("<nav>menu</nav><p>kept<aside>side</aside>tail", "kept\n\ntail"), ("<style>p{}</style><noscript>x</noscript><script>never ends", ""),
        ("<article><header><h1>T</h1><p>by</p></header><p>body</article><article><p>two</article><p>out", "T\n\nbody\n\ntwo"),
        ("<div class=content-with-sidebar><p>in</p><div class=sidebar>s</div></div><div class=post-footer>f</div>", "in"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"), ('<p title="a>b">x</p><p title="open>y', "x\n\ny"), ("</p></div>a</ul>b", "a\n\nb"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n\n2\n\n3"), ("<p hidden>no<p>yes", "yes"),
    ],
)
def test_odd_pages(page, want):
    assert html_wrappers.text(page or "", None, 0) == want


def test_long_odd_pages_end_in_time():
    for page in ("<a '" * 50_000, "<a '" * 50_000 + ">", "</p>" * 50_000 + "<div>" * 50_000, "<!--" * 50_000, "<p>a<h2>b<ul><li>c</ul>" * 4000):
        html_wrappers.text(page, summary(page), 1)


def test_awkward_and_empty_tables(spark):
    rows = [(1, None, None), (2, "", ""), (3, "no url", "<p>x"), (3, "no url", "<p>x"), (None, "http://u@h:80/p", "<article>y</article>"), (4, "HTTP://H/", "<article><p>z")]
    pages = spark.createDataFrame([(*r, 7, 8) for r in rows], "page_id long, url string, html string, host int, n_pages int")
    out = html_wrappers.extract(pages)
    assert out.columns == ["page_id", "url", "html", "host", "n_pages", "text"]
    assert sorted((r.page_id or 0, r.text) for r in out.collect()) == [(0, "y"), (1, ""), (2, ""), (3, "x"), (3, "x"), (4, "z")]
    assert {r.host: r.n_pages for r in html_wrappers.infer(pages).collect()} == {"": 4, "h": 2}
    assert html_wrappers.extract(pages.limit(0)).count() == 0


def test_items_survive_writing():
    item = summary("<div class='x y1'><p>a<p>b</div>")
    assert Item.of(item.plain()).plain() == item.plain() and "div.x.y(p(#)+)" in str(item)
