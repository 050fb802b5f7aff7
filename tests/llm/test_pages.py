"""Main text and URL filter against brute force."""

import html
import re
from urllib.parse import urlsplit

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelake.llm import html_text, queries, url_filter
from pagelake.llm.page_blocks import CHROME, MAIN, OPEN, page_blocks

SF = "/root/testdata/sf0.001"


def test_articles_of_the_page_table(spark):
    found = {r.page_id: r for r in queries.op1_html_text(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(found) == len(pages)
    for page in pages:
        article = re.search(r"<article>(.*?)</article>", page.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", part)).split()) for part in re.split("</?(?:p|h1)>", article)]
        want = "\n".join(b for b in blocks if b)
        assert found[page.page_id].text == want and found[page.page_id].n_chars == len(want)


@pytest.mark.parametrize(
    "page, main",
    [
        (None, []),
        ("", []),
        ("<article><header><h1>T</h1><p>by x</p></header><p>a<b>b</b>c &lt;i&gt; 5 < 6</p></article>", ["T", "abc <i> 5 < 6"]),
        ("<main>one<ul><li>a<li>b</ul><div class='ad-slot'>buy</div><form>f</form>two</main>", ["one", "a", "b", "two"]),
        ("<article>x<section id=comments><article>nice</article></section><aside>s</aside></article>", ["x"]),
        ("<body class='has-sidebar'><div class='cookie-notice'>c</div><div role=main>m</div>", ["m"]),
        ("<article><script>var t='</p><p>no'</script><!-- <p>no --><style>p{}</style>yes", ["yes"]),
        ("<form id='aspnetForm'><nav>n</nav><article><p>a</p><form>f</form></article></form>", ["a"]),
        ("<form><article>a<p>b</article></form><form>c</form>", ["a", "b"]),
        ("<article class='post category-social'><p>a</p></article>", ["a"]),
        ("<article class='post comments-open' id=post-7>a<div class='post-comments'>c</div></article>", ["a"]),
        ("<div class='notice-board search-results'><p>x</p><article>a</article></div>", ["a"]),
        ("<div class='menu-closed'><main>a</main></div>", ["a"]),
        ("<article>a</article><aside><article>r</article></aside><article class='comment-body'>c</article><article class=teaser>t</article>", ["a"]),
        ("<article>a<p class='notice-period'>b</p>c</article>", ["a", "c"]),
        ("<article>a<p class='notice'>b</p><form><article>f</article></form>c</article>", ["a", "c"]),
        ('<article><a title="x > y" href=\'z\'>l</a> &amp &copy &#228; m</article>', ["l & © ä m"]),
    ],
)
def test_blocks_of_articles(page, main):
    assert [text for zone, text in page_blocks(page) if zone == MAIN] == main


def test_zones_without_article():
    page = "<nav>n</nav><header>h</header><div><p>open</div><div id='sidebar'>s</div><footer>f</footer>"
    assert page_blocks(page) == [(CHROME, "n"), (CHROME, "h"), (OPEN, "open"), (CHROME, "s"), (CHROME, "f")]


def test_open_parts_of_articles_and_forms():
    """What names and forms don't settle is open, so that the suffix order decides it."""
    page = "<article>a<p class='notice-period'>b</p></article><article class='post social'>c</article>"
    assert page_blocks(page) == [(MAIN, "a"), (OPEN, "b"), (OPEN, "c")]
    page = "<form><div>s</div><header>h</header><div>o</div><footer>f</footer></form><form>g</form><div class='share'>w</div>"
    assert page_blocks(page) == [(CHROME, "s"), (CHROME, "h"), (OPEN, "o"), (CHROME, "f"), (CHROME, "g"), (CHROME, "w")]


def test_named_blocks_inside_articles_are_judged(spark):
    """A paragraph with a boilerplate name in an article goes if its host repeats it, and stays if it is the page's own."""
    words = lambda k, n, own: " ".join(f"{own}{k}x{j}" for j in range(n))
    box = lambda k: words(0, 12, "box") if k < 5 else words(k, 12, "own")
    page = lambda k: f"<form id='aspnetForm'><article class='post'><p>{words(k, 20, 'body')}</p><p class='notice-period'>{box(k)}</p></article></form>"
    rows = [(k, f"http://a.example/{k}", page(k)) for k in range(7)]
    found = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(7):
        assert found[k] == words(k, 20, "body") + ("" if k < 5 else "\n" + box(k))


def brute_covered(pages, run, least):
    """Tokens inside substrings of `run` tokens that stand on `least` pages, from a plain suffix array."""
    suffixes = sorted((tuple(tokens[at : at + run]), p, at) for p, tokens in enumerate(pages) for at in range(len(tokens) - run + 1))
    marks = [np.zeros(len(tokens), bool) for tokens in pages]
    begin = 0
    for k in range(1, len(suffixes) + 1):
        if k == len(suffixes) or suffixes[k][0] != suffixes[begin][0]:
            group = suffixes[begin:k]
            if len({p for _, p, _ in group}) >= least:
                for _, p, at in group:
                    marks[p][at : at + run] = True
            begin = k
    return marks


def test_suffix_order_alone_removes_host_boilerplate(spark):
    """Without trust in markup: covered tokens and kept blocks as a plain suffix array gives them."""
    draw = np.random.default_rng(3)
    words = lambda n: " ".join(f"w{x}" for x in draw.integers(10_000, size=n))
    top, end, rare = words(12), words(20), words(15)
    rows = []
    for k in range(12):
        own = [words(30), rare if k in (2, 5) else words(9), words(5)]
        body = "".join(f"<p>{b}</p>" for b in own)
        rows.append((k, f"http://a.example/{k}", f"<div>{top}</div>{body}<div>{end}</div>"))
    rows += [(20, "http://b.example/", f"<div>{top}</div><p>{words(9)}</p>"), (21, None, None), (22, "odd", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r for r in html_text.main_text(pages, run=6, least_pages=3, least_share=0.0, trust_markup=False).collect()}
    streams = [[t for _, text in page_blocks(page) for t in text.split()] for _, _, page in rows[:12]]
    for (k, _, page), marks in zip(rows, brute_covered(streams, 6, 3)):
        at, stay = 0, []
        for _, text in page_blocks(page):
            n = len(text.split())
            if marks[at : at + n].mean() <= 0.5:
                stay.append(text)
            at += n
        assert found[k].text == "\n".join(stay) and found[k].covered == marks.sum()
        assert top not in found[k].text and end not in found[k].text
    assert top in found[20].text and found[21].text == found[22].text == "" and found[21].n_chars == 0


def test_open_blocks_beside_an_article_are_judged(spark):
    """A body in a plain div isn't lost to a small article card; repeated runs around it go, the article's own lines stay."""
    words = lambda k, n, own: " ".join(f"{own}{k}x{j}" for j in range(n))
    top, card = words(0, 12, "top"), words(0, 10, "card")
    page = lambda k: f"<nav>menu</nav><div>{top}</div><div>{words(k, 30, 'body')}</div><article>{card}</article><div>{words(k, 9, 'end')}</div>"
    rows = [(k, f"http://a.example/{k}", page(k)) for k in range(6)] + [(9, "http://a.example/9", f"<nav>menu</nav><article>{card}</article>")]
    found = {r.page_id: r for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(6):
        assert found[k].text == "\n".join([words(k, 30, "body"), card, words(k, 9, "end")])
        assert found[k].n_chars == len(found[k].text) and found[k].covered == 13  # the menu's word makes a run with the top line
    assert found[9].text == card and found[9].covered is None


def test_equal_pages_count_once_and_empty_tables_work(spark):
    page = "<p>one two three four five six seven eight nine ten</p>"
    pages = spark.createDataFrame([(k, f"http://x.example/{k}", page, "e") for k in (1, 1, 2, 3, 4)], "page_id long, url string, html string, row string")
    rows = html_text.main_text(pages).collect()
    assert len(rows) == 5 and all(r.text == page[3:-4] for r in rows)
    assert html_text.main_text(pages.where("1 = 0")).count() == 0


def brute_rule(host, path, rules):
    fits = [(len(r), says, r) for says, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits)[1:] if fits else (None, None)


def test_url_filter_against_plain_sets(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    odd = [(1000, None), (1001, "no scheme"), (1002, "HTTP://WWW.Example.ORG/es/x?b=2&utm_source=q&a=1#f"), (1003, "://"), (1004, "x://h.com/fr/?q://y"), (1004, "x://h.com/fr/?q://y"), (1005, "http://com/de/")]
    pages = pages.unionByName(spark.createDataFrame(odd, "page_id long, url string")).withColumn("row", F.lit(1)).withColumn("block", F.lit("x"))
    listed = pages.where("page_id % 3 = 0 OR page_id = 1002").select(url_filter.canonical_url(F.col("url")).alias("canonical"))
    listed = listed.unionByName(listed)
    for rows in (url_filter.judge_urls(pages, listed, queries.RULES).collect(),):
        assert len(rows) == pages.count()
        canonical = {(r.page_id, r.c) for r in pages.select("page_id", url_filter.canonical_url(F.col("url")).alias("c")).collect()}
        on = {r.canonical for r in listed.collect()}
        known = {i: c in on and c is not None for i, c in canonical}
        urls = {r.page_id: r.url for r in pages.collect()}
        for r in rows:
            url = urls[r.page_id] or ""
            rest = url.split("://", 1)[1] if "://" in url else ""
            host = re.split("[/?#]", rest)[0]
            path = re.split("[?#]", rest[len(host) :])[0]
            host = "".join(c.lower() if c.isascii() else c for c in host)
            assert (r.host, r.path) == (host, path)
            says, rule = brute_rule(host, path, queries.RULES)
            assert r.rule == rule and r.listed == known[r.page_id]
            assert r.verdict == (says or ("block" if known[r.page_id] else "allow"))
    assert url_filter.judge_urls(pages.where("1 = 0"), listed, queries.RULES).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, listed.where("1 = 0"), []).collect()} == {"allow"}


def test_bloom_filter_never_misses_and_seldom_errs(spark):
    urls = spark.range(20_000).select(F.concat(F.lit("h.example/"), "id").alias("canonical"))
    listed = urls.where("canonical < 'h.example/5'")
    rows = url_filter.possible_hits(urls, listed)
    wrong = rows.where("possible AND canonical >= 'h.example/5'").count()
    assert rows.where("NOT possible AND canonical < 'h.example/5'").count() == 0 and wrong < 200


def test_canonical_urls(spark):
    rows = [("https://www.a.example:443/x/?b=2&utm_medium=z&a=1#top", "a.example/x?a=1&b=2"), ("http://m.a.example/x", "a.example/x"), ("a.example/x", None), (None, None)]
    found = spark.createDataFrame(rows, "url string, want string").select(url_filter.canonical_url(F.col("url")).alias("got"), "want").collect()
    assert [r.got for r in found] == [r.want for r in found]
    assert urlsplit("http://a.example/x").path == "/x"
