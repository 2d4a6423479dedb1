"""HTML extraction: marks, broken pages, and all test pages against a plain tree reader."""

import time
from collections import defaultdict
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from geotiles.llm import html_extract as hx
from geotiles.llm.queries import QUERIES


def text(page):
    return hx.main_text(hx.read_tree(page), set())


@pytest.mark.parametrize("page, want", [
    ('<main><p>Main text.</p><section id="comments"><article>first!</article><article>second</article></section></main>', "Main text."),
    ('<div class="content">Text.</div><div class="comments"><article>c1 is longer than the text</article></div>', "Text."),
    ('<div class="related"><article>Other</article></div><div>Own</div>', "Own"),
    ('<div class="sidebar"><article>Other</article></div><div>The page itself</div>', "The page itself"),
    ('<main><p>Main text, all of it.</p><div><article>reply</article></div></main>', "Main text, all of it.\n\nreply"),
    ('<main><h1>t</h1><article><p>The article</p></article></main><section><article>teaser</article></section>', "The article"),
    ('<main><p>Main text</p></main><section><article>A teaser longer than main</article></section>', "Main text"),
    ('<main></main><article>Body</article>', "Body"),
    ('<article><main><p>in</p></main><p>after</p></article>', "in\n\nafter"),
    ('<article><p>a</p><div class="cookie-bar">x</div><div id="comment-section">x</div><section class="post-comments"><article>x</article></section>'
     '<div class="adsbygoogle">x</div><div class="ad-top">x</div><div hidden>x</div><div style="color:red;display: none">x</div>'
     '<div class="ad_300">x</div><div class="cookie-recipe">b</div><div class="comment-policy-history">c</div></article>', "a\n\nb\n\nc"),
    ('<div class="content no-sidebar"><article><p>Body</p></article></div>', "Body"),
    ('<div class="sidebar"><article><p>Body</p></article></div>', "Body"),
    ('<article><h2 id="related-work">Related</h2><section id="social-history"><p>x</p></section></article>', "Related\n\nx"),
    ('<article><h2 class="related">Related</h2><p class="notice">x</p><span class="ad">y</span></article>', "Related\n\nx\n\ny"),
    ('<article><div class="ad">Buy</div><div class="ad-free">stays</div><div id="comments"><p>said</p></div>z</article>', "stays\n\nz"),
    ("<article><label>l</label><select><option>o</option></select><object>b</object><math>x</math></article>", "lobx"),
    ("<article><form>f<label>l</label></form><p>a</p></article>", "a"),
    ('<article><div role="navigation">n</div><p aria-hidden="true">a</p></article>', "a"),
    ("<b><article><p>one</b> two</p><p>three</p></article>", "one two\n\nthree"),
    ("<article><p>one</q></i></p></section><p>two</article>", "one\n\ntwo"),
    ("<article><p>a &am<b>p; b</b> &lt;c&gt; &#x41;</p></article>", "a &amp; b <c> A"),
    ("<article><!-- x > y --><p>a<!---->b<!-->c</p><p>d</article>", "abc\n\nd"),
    ('<article><p title=a"b>in</p><p>out</p></article>', "in\n\nout"),
    ('<article><p>in</p><p title="x>cut</p></article>', "in\n\ncut"),
    ("<article><table><tr><td>a<p>b</td><td>c</div></td></tr></table><p>d</p></article>", "a\n\nb\n\nc\n\nd"),
])
def test_pages(page, want):
    assert text(page) == want


@pytest.mark.parametrize("page", [
    '<a b="' * 170_000, "</q>" * 250_000, "<i>" * 60_000 + "</q>" * 150_000, "<article>" * 60_000, "<!--" * 250_000,
    "<p>" + "<i>" * 50_000 + "<hr>" * 50_000, "<div class='" + "a " * 400_000 + "'>x", "<" * 500_000, '<a b="x\'>' * 50_000])
def test_broken_pages_take_linear_time(page):
    start = time.time()
    text(page)
    assert time.time() - start < 2 * max(1, len(page) / 1e6) + 2


class Plain(HTMLParser):
    """Nested lists [tag, attributes, children]; implied ends of p, li only."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.top = ["", {}, []]
        self.open = [self.top]

    def handle_starttag(self, tag, attrs):
        if tag in hx.BLOCK and self.open[-1][0] in ("p", "b") and any(n[0] == "p" for n in self.open):
            while self.open.pop()[0] != "p":
                pass
        if tag == "li" and self.open[-1][0] == "li":
            self.open.pop()
        node = [tag, dict(attrs), []]
        self.open[-1][2].append(node)
        if tag not in hx.VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        if any(n[0] == tag for n in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.open[-1][2].append(data)


def said(node):
    return " ".join("".join(x if isinstance(x, str) else said(x) for x in node[2]).split())


def subtree(node):
    return (node[0], tuple(" ".join(x.split()) if isinstance(x, str) else subtree(x) for x in node[2] if not isinstance(x, str) or x.strip()))


def every(node):
    yield node
    for x in node[2]:
        if not isinstance(x, str):
            yield from every(x)


def plain_texts(rows):
    """{page_id: text} by comparing whole subtrees, page by page."""
    trees = {}
    for i, url, page in rows:
        reader = Plain()
        reader.feed(page or "")
        reader.close()
        trees[i] = (urlsplit(url or "").hostname or "", reader.top)
    mains, pages_of = {}, defaultdict(set)
    for i, (host, top) in trees.items():
        mains[i] = next((n for n in every(top) if n[0] == "article"), None) or next((n for n in every(top) if n[0] == "body"), top)
        for n in every(top):
            pages_of[host, subtree(n)].add(subtree(mains[i]))
    hosts = defaultdict(set)
    for i, (host, _) in trees.items():
        hosts[host].add(subtree(mains[i]))

    def gone(host, n, article):
        if n[0] in hx.NEVER or n[0] == "div" and n[1].get("class") == "ad":
            return True
        count, half = len(pages_of[host, subtree(n)]), len(hosts[host]) // 2 + 1
        return n[0] in hx.BLOCK and not (article and n[0] in hx.TEXT_BLOCKS) and count >= 3 and count >= min(10, half) and said(n)

    def blocks(host, n, article, out):
        for x in n[2]:
            if isinstance(x, str):
                out.append(x)
            elif x[0] == "br":
                out.append(" ")
            elif not gone(host, x, article):
                edge = x[0] in hx.BLOCK
                out.extend([None] if edge else [])
                blocks(host, x, article, out)
                out.extend([None] if edge else [])

    texts = {}
    for i, (host, _) in trees.items():
        out = []
        blocks(host, mains[i], mains[i][0] == "article", out)
        runs, last = [], []
        for x in [*out, None]:
            if x is None:
                runs.append(" ".join("".join(last).split()))
                last = []
            else:
                last.append(x)
        texts[i] = "\n\n".join(r for r in runs if r)
    return texts


def test_all_pages_against_plain_reading(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    got = {r.page_id: (r.text, r.n_chars) for r in QUERIES["op10_html_extract"](spark, sf).collect()}
    assert got == {i: (t, len(t)) for i, t in plain_texts(rows).items()}


def test_mirrored_articles_keep_their_boxes(spark):
    """Copies of one article on a host are one page: what stands in them is no template."""
    box = "<article><p>Own words</p><div><p>Kept with the article</p></div></article>"
    pages = [(i, f"http://m.org/{i}", f"<body>{box}</body>") for i in range(30)]
    pages += [(100 + i, f"http://m.org/x{i}", f"<body><div><p>Frame</p></div><p>Own {i}</p></body>") for i in range(20)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("hash", F.lit("clash"))
    got = {r.page_id: r.text for r in hx.extract(df).collect()}
    assert got[3] == "Own words\n\nKept with the article" and got[105] == "Own 5"
