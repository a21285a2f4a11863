import re
from html import unescape

from datascout.llm import html_text as ht
from tests.llm.helpers import saved

PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style></head><body class="has-sidebar"><header><a href=/>Site</a> tagline of the site</header>
<nav><ul><li><a href="/a">Home</a><li><a href="/b">News and more</a></ul></nav><div class="cookie-notice">We use cookies, accept them now please, all of them.</div>
<div id="wrap"><div class="post-content"><h1>Big   title &lt;1&gt;</h1><p>First paragraph, with <b>bold</b>ness and a <a href="x">link</a>; it goes on for a while.
<p>Second&nbsp;paragraph &#8212; also long enough to be text, &eacute;t&eacute;.<br>After the break.<script>var s="<p>no</p>";</script>
<div class="ad">Buy now! The best offer that was ever made to readers.</div><ul><li>one item</li><li>two items</li></ul><!-- <p>not this</p> -->
<blockquote>A quote inside.</blockquote></div><aside>Side story, which is fairly long but not the article at all.</aside>
<div class="related"><a href=1>Other</a></div><section id="comments"><p>I think that this is a long reader comment, and so on and on and on, really a very long comment by a reader who has time to write, and writes more than the article has.</p></section></div>
<form>Subscribe <input name=x></form><footer>Copyright</footer></body>"""
WANT = "Big title <1> First paragraph, with boldness and a link; it goes on for a while. Second paragraph — also long enough to be text, été. After the break. one item two items A quote inside."


def test_one_page():
    assert ht.main_text(PAGE, [])[0] == WANT


def test_broken_input_does_not_crash():
    for cut in range(0, len(PAGE), 7):
        ht.main_text(PAGE[:cut], ["html/body"])
        ht.main_text(PAGE[cut:], [])
    assert ht.main_text("", []) == ("", "") and ht.main_text("<div>" * 3000 + "deep text here" + "</p>" * 50, [])[0] == "deep text here"
    assert ht.main_text("plain text only", [])[0] == "plain text only"
    assert ht.main_text("<p>a < b and c</p>", [])[0] == "a < b and c"


def test_consensus_and_special_rows(spark):
    long_side = "<div class='x'><p>" + "promo words that are many, " * 30 + "</p></div>"
    usual = [f"<body><div class='body{i}'><p>{'article words here, ' * (9 + i)}</p></div><div class='x'><p>short</p></div></body>" for i in range(5)]
    odd = f"<body><div class='body9'><p>small article</p></div>{long_side}</body>"
    rows = [(i, f"http://h.example/{i}", h) for i, h in enumerate(usual)] + [(9, "http://H.example:80/o", odd), (10, None, PAGE), (11, "nonsense", None), (12, "http://other/", ""), (3, "http://h.example/3", usual[3]), (None, "http://h.example/z", "<p>x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS host", "'y' AS path", "1 AS paths")
    got = {(r.page_id, r.text) for r in ht.op2_consensus_extraction(spark, saved(spark, pages=pages)).collect()}
    assert (9, "small article") in got and (10, WANT) in got and {(11, ""), (12, ""), (None, "x")} <= got and len(got) == 10
    assert ht.op2_consensus_extraction(spark, saved(spark, pages=pages.limit(0))).collect() == []


def test_given_pages_against_a_plain_reading(spark):
    """The pages of the test data keep their article in one article element."""
    sf = "/root/testdata/sf0.01"
    want = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [re.sub(r"<[^>]*>", "", b) for b in re.split(r"</?(?:p|h1|br)>", inner)]
        want[r.page_id] = " ".join(t for t in (" ".join(unescape(b).split()) for b in blocks) if t)
    got = {r.page_id: r.text for r in ht.op2_consensus_extraction(spark, sf).collect()}
    assert got == want


def test_short_sections_of_the_article_stay():
    parts = [f"<section><p>{w * n}</p></section>" for w, n in (("long text ", 90), ("short text ", 14), ("tiny ", 1))]
    page = f"<body><div>Tagline</div><article><h1>Title</h1>{''.join(parts)}Direct text<aside>no</aside></article></body>"
    want = " ".join(("Title " + "long text " * 90 + "short text " * 14 + "tiny Direct text").split())
    plain = page.replace("article>", "div>")
    for path in ([], ["html/body/article/section"]):
        assert ht.main_text(page, path)[0] == want
    assert ht.main_text(plain, ["html/body/div/section"])[0] == want
    one = f"<article><h1>Title</h1>{parts[1]}</article>"
    assert ht.main_text(one, ["html/article/section"])[0] == " ".join(("Title " + "short text " * 14).split())


def test_unclosed_elements_lose_nothing():
    for tag in ("svg", "math", "script", "style", "textarea", "iframe"):
        assert ht.main_text(f"<p>before it</p><{tag}><path/><p>after it is a long article</p>", [])[0] == "before it after it is a long article", tag
    assert ht.main_text("<article><p>one</p><svg><p>two</p><svg><path/></svg><p>three</p></article>", [])[0] == "one two three"
    assert ht.main_text("<p>one</p><!-- open <p>two</p>", [])[0] == "one two"
    assert ht.main_text("<p>one</p><script>var a = '<p>no</p>';</script><p>two</p><script>b()<p>three</p>", [])[0] == "one two three"
    assert ht.main_text("<article><p class='byline'>By A</p><div class='tags'>words</div><p>text</p></article><div class='tags'>x y z</div>", [])[0] == "By A words text"


def test_long_and_hostile_pages_take_linear_time():
    import time

    made = ['<x a="', "<div><p>w</p>", "<div>", "<b><p>w", "</i>", "<svg>", "<!--", "<script>", "<a href='", "<ul><li><a href=x>w</a>", "<p>w</div>", "<", "</b", "&amp", "<i><p><b>x</i>"]
    for part in made:
        took = []
        for size in (100_000, 400_000):
            html = part * (size // len(part))
            began = time.process_time()
            ht.main_text(html, [])
            took.append(time.process_time() - began)
        assert took[1] < 12 * took[0] + 1.0, (part, took)
    long = "<article>" + "<p>word and word</p>" * 60_000 + "</article>"
    assert len(ht.main_text(long, [])[0]) == 14 * 60_000 - 1


def test_consensus_against_brute_force(spark):
    """Paths of most votes on the host, found by counting in plain Python, on pages of many layouts, more than any small number of paths a host."""
    import random
    from collections import Counter

    r, rows = random.Random(8), []
    for i in range(160):
        host = f"h{i % 3}.example"
        sizes = [r.randrange(40, 90)] + [r.randrange(1, 5) for _ in range(r.randrange(5))]
        parts = [f"<div class='k{chr(97 + r.randrange(26))}{chr(97 + r.randrange(2))}'><p>{'some words ' * n}</p></div>" for n in r.sample(sizes, len(sizes))]
        rows.append((i, f"http://{host}/{i}", f"<body>{''.join(parts)}</body>"))
    votes, able = Counter(), {}
    for i, url, html in rows:
        elements, _ = ht.parse(html)
        own = ht.best_container(elements)
        votes[url.split("/")[2], own.path] += 1
        able[i] = {e.path for e in elements if e.container is e and ht.weight(e) > 0}
    assert max(Counter(h for h, _ in votes).values()) > 16
    want = {}
    for i, url, html in rows:
        host = url.split("/")[2]
        paths = sorted((p for p in able[i] if (host, p) in votes), key=lambda p: (-votes[host, p], p))
        want[i] = ht.main_text(html, paths)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x.page_id: (x.text, x.path) for x in ht.extract(pages).collect()}
    assert got == want and len({p for _, p in want.values()}) > 20
