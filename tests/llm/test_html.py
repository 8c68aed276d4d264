"""Page extraction: templates against naive occurrence vectors, odd markup, and time that grows with the page."""

import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sequor.llm import html

SCHEMA = "page_id long, url string, html string"


def host_of_pages(n=6, seed=3):
    """Pages of one host with constant texts that no tag or class name gives away."""
    rnd = random.Random(seed)
    say = lambda k: " ".join(f"w{rnd.randint(0, 999)}" for _ in range(k))
    out, want = [], []
    for _ in range(n):
        paragraphs = [say(rnd.randint(15, 30)) for _ in range(rnd.randint(2, 6))]
        remarks = [say(5) for _ in range(rnd.randint(1, 4))]
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        body += "".join(f"<section><h4>{r}</h4><h5>Yes</h5><h6>No</h6></section>" for r in remarks) + "<p>All of it on one page</p>"
        out.append(f"<body><div class=x>The Daily Page</div><div><p>Read on</p>{body}</div><div>Made by hand</div></body>")
        want.append("\n\n".join([*paragraphs, *remarks]))
    return out, want


def naive_template(pages):
    """The classes of a host from full occurrence vectors: {frozenset of tokens: in a page once}, those with a text."""
    read = [html.read_page(p).tokens for p in pages]
    counts = [Counter(t for t, _ in tokens) for tokens in read]
    texts = {t for tokens in read for t, block in tokens if block >= 0}
    classes = defaultdict(set)
    for t in set().union(*counts):
        vector = tuple(c[t] for c in counts)
        if sum(x > 0 for x in vector) >= max(4, 0.9 * len(pages)):
            classes[vector].add(t)
    return {frozenset(c): max(v) == 1 for v, c in classes.items() if len(c) >= 2 and c & texts}


def texts_of(spark, pages, url="http://h.example/{}"):
    d = spark.createDataFrame([(k, url.format(k), p) for k, p in enumerate(pages)], SCHEMA).repartition(3)
    return [r.text for r in html.extract(d).orderBy("page_id").collect()]


def test_templates_equal_naive_classes(spark):
    for n in (3, 4, 7):  # three pages have no template
        pages, _ = host_of_pages(n, n)
        d = spark.createDataFrame([(k, "h", p) for k, p in enumerate(pages)], "page_id long, host string, html string").repartition(3)
        got = defaultdict(set)
        once = {}
        for r in html.templates(d).collect():
            for x in r.template:
                got[x["of"]].add(x["token"])
                once[x["of"]] = x["once"]
        assert {frozenset(v): once[k] for k, v in got.items()} == naive_template(pages)


def test_slots_of_the_template_are_the_text(spark, monkeypatch):
    pages, want = host_of_pages()
    assert texts_of(spark, pages) == want
    # the template decides: without it the constant texts stay
    none = spark.createDataFrame([], "host string, template array<struct<place:double,of:long,once:boolean,token:long,is_text:boolean>>")
    monkeypatch.setattr(html, "templates", lambda d: none)
    plain = texts_of(spark, pages)
    assert all(x != y and "Read on" in x and "Made by hand" in x for x, y in zip(plain, want, strict=True))


def test_templates_by_shuffle(spark, monkeypatch):
    pages, want = host_of_pages()
    monkeypatch.setattr(html, "BROADCAST_BYTES", 0)
    assert texts_of(spark, pages) == want


def test_copies_of_a_text_are_no_template(spark):
    page = "<body><article><h1>One</h1><p>the same words here</p><p>and these</p></article></body>"
    near = page.replace("these", "those")
    assert texts_of(spark, [page] * 5 + [near]) == ["One\n\nthe same words here\n\nand these"] * 5 + ["One\n\nthe same words here\n\nand those"]


def test_a_line_amid_the_text_is_no_template(spark):
    rnd = random.Random(1)
    say = lambda: " ".join(f"w{rnd.randint(0, 9999)}" for _ in range(20))
    bodies = [[say(), say(), "licensed to all", say()] for _ in range(6)]
    pages = ["<body><div>" + "".join(f"<p>{x}</p>" for x in b) + "</div></body>" for b in bodies]
    assert texts_of(spark, pages) == ["\n\n".join(b) for b in bodies]


def test_divs_instead_of_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    a = html.extract(pages)
    b = html.extract(pages.withColumn("html", F.regexp_replace("html", r"(</?)article", "$1div")))
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0 and a.where("n_chars > 0").count() == 250


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div class='post-sidebar'><article><h1>T</h1><p>x</p></article></div>", "T\n\nx"),
        ("<article><div class='post-header'><h1>T</h1></div><p>x</p></article>", "T\n\nx"),
        ("<article><p>x</p><article class='comment'><p>no</p></article></article>", "x"),
        ("<article><h1>T</h1><div class='related-work'><p>x</p></div><p class=\"search-results wide\">y</p><p class=header-note>z</p></article>", "T\n\nx\n\ny\n\nz"),
        ("<article><p>x</p><div class='comment-list'><p>no</p></div><div class='wide ad'>no</div><div id=cookie-notice>no</div><div class=reader-comments>no</div></article>", "x"),
        ("<div id=comments><article class=comment><p>no</p></article></div><p>x</p>", "x"),
        ("<aside><article><p>no</p></article></aside><p>x</p>", "x"),
        ("<ul><li><a href=/a>A</a></li><li><a href=/b>B</a></li></ul><p>x</p><ul><li>one <a>two</a></li></ul>", "x\n\none two"),
        ("<p title='a > b' data-x=\"<p>\">x</p>", "x"),
        ("<p title=don't>x</p><p>y</p>", "x\n\ny"),
        ("<p title='open>x</p><p>y", "x\n\ny"),
        ("a <b>b</b> 1 < 2 <!-- c > --> d <? e > f <!x> g", "a b 1 < 2 d f g"),
        ("<p>x<script>'</p>'</script><p>y<textarea><p>no", "x\n\ny"),
        ("&amp;lt; &#x41;&#66; &nbsp;&eacute;", "&lt; AB é"),
        ("<!-- never closed <p>x</p>", ""),
        ("</p></div>x", "x"),
        ("\x00 <p\n\n>x", "\x00\n\nx"),
    ],
)
def test_odd_markup(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize("bad", ['<a b="', "<p title='> x ", "<div>", "<div><p>x", "<!-", "<p a=   ", "<br class='", "</p", "<h1><div class=ad>"])
def test_time_grows_with_the_page(bad):
    def seconds(n):
        best = 9.0
        for _ in range(3):
            began = time.perf_counter()
            html.main_text(bad * n)
            best = min(best, time.perf_counter() - began)
        return best

    assert seconds(8000) < 0.5
    assert seconds(32000) < 8 * max(seconds(8000), 0.01)


def test_rising_is_longest():
    rnd = random.Random(2)
    for _ in range(50):
        x = [rnd.randint(0, 12) for _ in range(12)]
        got = html.rising(x)
        assert all(a < b and x[a] < x[b] for a, b in zip(got, got[1:], strict=False))
        best = [1] * 12
        for i in range(12):
            best[i] = 1 + max((best[j] for j in range(i) if x[j] < x[i]), default=0)
        assert len(got) == max(best)
