"""WARC archives and page extraction."""

import base64
import gzip
import hashlib
import html
import re

import pyspark.sql.functions as F
import pytest

from precis.llm import html_extract as H
from precis.llm import queries as Q
from precis.llm import warc

SF = "/root/testdata/sf0.01"


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


@pytest.mark.parametrize("url,key", [
    ("https://www.Example.org:8080/a/b?x=1#top", "org,example,www:8080)/a/b?x=1"), ("http://u:p@h.com", "com,h)"),
    (None, ""), ("", ""), ("/just/path", "/just/path"), ("http://a.b/x y\r\nEvil: 1", "b,a)/x%20y%0D%0AEvil:%201"),
    ("http://[::1]:80/x", "[::1]:80)/x"),
])
def test_url_keys(url, key):
    assert warc.url_key(url) == key


def test_records_round_trip_and_damage_shows():
    cfg = warc.DEFAULT
    for body in (b"", "é\r\n\r\nx".encode(), b"\x00" * 5000):
        r = warc.parse(warc.record(7, "http://a.b/\r\nx", body, None, cfg, False))
        assert (r["payload"], r["page_id"], r["digest"], r["bytes"], r["refers_to"]) == (body, 7, digest(body), len(body), None)
        r = warc.parse(warc.record(None, None, body, 3, cfg, True))
        assert (r["type"], r["payload"], r["page_id"], r["refers_to"], r["bytes"]) == ("revisit", None, None, 3, len(body))
    bad = warc.record(1, "u", b"abc", None, cfg, False).replace(b"abc\r\n\r\n", b"abd\r\n\r\n")
    with pytest.raises(ValueError):
        warc.parse(bad)


ROWS = [(i, f"http://h{i % 3}.org/{i % 7}", f"page {i % 11}" * (i % 11)) for i in range(60)] + [
    (60, None, None), (61, "", ""), (None, "http://h0.org/0", "page 1"), (None, "http://n.org", "only null"), (5, "http://h2.org/5", ROW5 := "page 5" * 5)]


def test_archive_index_and_lookup(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "'x' as digest", "0 as low")
    cfg = warc.WarcConfig(block_lines=2, part_rows=10)
    for name, c in (("wide", cfg), ("join", warc.WarcConfig(block_lines=2, broadcast_rows=0))):
        cap = warc.write(pages.repartition(3), f"file://{tmp_path}/{name}", cfg=c)
        found = warc.lookup(spark, cap, pages.select(warc.keys_of(F.col("url")).alias("key"))).collect()
        low = {}
        for i, _, h in ROWS:
            if i is not None:
                low[h or ""] = min(low.get(h or "", i), i)
        want = sorted(((str(i), len((h or "").encode()), digest((h or "").encode()),
                        *(("response", None) if low.get(h or "", i) == i else ("revisit", low[h or ""]))) for i, _, h in ROWS), key=str)
        assert sorted(((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["type"], r["refers_to"]) for r in found), key=str) == want
        bodies = {r["page_id"]: bytes(r["payload"]) for r in found if r["type"] == "response" and r["page_id"] is not None}
        assert all(bodies[i] == (h or "").encode() for i, _, h in ROWS if i in bodies)
        one = warc.lookup(spark, cap, spark.createDataFrame([("org,h1)/4",), ("no,such)/",), (None,), ("org,h1)/4",)], "key string")).collect()
        assert sorted(r["page_id"] for r in one) == [i for i, u, _ in ROWS if u == "http://h1.org/4"]
    first = sorted((tmp_path / "wide" / "archive").iterdir())[0]
    text = gzip.decompress(first.read_bytes())  # members follow each other, as other readers expect
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and text.count(b"WARC/1.1\r\n") > 5


def test_payloads_below_the_least_are_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    cap = warc.write(pages, f"file://{tmp_path}/w", cfg=warc.WarcConfig(min_bytes=3))
    got = warc.lookup(spark, cap, spark.createDataFrame([("u",)], "key string")).collect()
    assert sorted((r["page_id"], r["type"], r["refers_to"]) for r in got) == [
        (1, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3)]
    empty = warc.write(pages.limit(0), f"file://{tmp_path}/e")
    assert warc.lookup(spark, empty, spark.createDataFrame([("u",)], "key string")).count() == 0


# --- page extraction ------------------------------------------------------------------

SITE = """<!DOCTYPE html><html><head><title>Site</title><style>p{x}</style><script>var t="</p><p>no";</script></head><body class="ad">
<header><h1>My site</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul></nav><!-- <p>no</p> -->
<div class="cookie-notice"><p>We use cookies.</p></div>%s<aside><p>Related things here</p></aside>
<section id="comments"><p>First comment! I like words and words.</p></section>
<form><p>Write to us</p><input name=a><button>Send</button></form><footer><p>&copy; us</p></footer></body></html>"""
BODY = """<article><header><h1>Big&nbsp;title</h1></header><p>One <b>two</b>three &amp;lt; four.<p>Five
 six<br>seven<div class="ad-box"><p>Buy now</p></div><ul><li>Item <a href=x>link</a></ul><p title="a>b">End</p></article>"""
TEXT = "Big title One twothree &lt; four. Five six seven Item link End"


def test_article_without_its_surroundings():
    learned = H.learn([SITE % BODY.replace("ad-box", f"ad{i}") for i in range(5)])
    for w in (H.Weights(), learned):
        assert H.extract(SITE % BODY, w) == TEXT
        plain = BODY.replace("<article>", "<div>").replace("</article>", "</div>").replace("<header>", "").replace("</header>", "")
        assert H.extract(SITE % plain, w) == TEXT


@pytest.mark.parametrize("page,text", [
    ("", ""), ("   ", ""), ("just words", "just words"), ("<p>a<script>x", "a"), ("<p>a<!-- b", "a"), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
    ("<nav>menu</nav>", ""), ("<p>&#x41;&#1114112;&eacute;&unknown;</p>", "A�é&unknown;"), ("</p></div>x<b>y", "xy"),
    ("<article><p>a</p><aside>no</aside><p>b</p></article>", "a b"), ("<p>a</p><p hidden>b</p><P>c</P>", "a c"),
])
def test_damaged_and_small_pages(page, text):
    assert H.extract(page, H.Weights()) == text


STORY = "<h1>Title</h1><p>One two three four five six.</p>"


@pytest.mark.parametrize("page,text", [
    (f"<div class='layout has-sidebar'><main>{STORY}</main></div>", "Title One two three four five six."),
    (f"<div class='widget'><main>{STORY}</main></div><p>By us</p>", "Title One two three four five six."),
    (f"<form action=/x><div>{STORY}</div></form>", "Title One two three four five six."),
    (f"<form><div><nav>menu</nav><article>{STORY}</article></div></form>", "Title One two three four five six."),
    (f"<article>{STORY}<h2 id='related-work'>Related work</h2><p>a</p><section id='search-results'><h2 class=search>Search</h2><p>b</p>"
     "</section></article>", "Title One two three four five six. Related work a Search b"),
    (f"<article>{STORY}<section id=notice><p id=share>c</p></section></article>", "Title One two three four five six. c"),
    (f"<div class='related-work'>{STORY}</div>", "Title One two three four five six."),
    # what is left out stays out
    (f"<article>{STORY}<form><p>Write to us</p></form><div class='share-buttons'>Like</div></article>", "Title One two three four five six."),
    (f"<article>{STORY}<div class=comments><article>No</article><article>{STORY * 3}</article></div></article>", "Title One two three four five six."),
    (f"<div>{STORY}</div><div class=related><article>Other story</article></div>", "Title One two three four five six."),
    (f"<article>{STORY}</article><div class=related><article>Other</article></div><form><p>Write</p></form>", "Title One two three four five six."),
])
def test_names_do_not_cut_the_article(page, text):
    for w in (H.Weights(), H.learn([SITE % BODY] * 3)):
        assert H.extract(page, w) == text


def test_teasers_are_not_the_article():
    story = "".join(f"<p>Sentence {i} of the story, which is told at some length here.</p>" for i in range(30))
    told = " ".join(f"Sentence {i} of the story, which is told at some length here." for i in range(30))
    cards = "<div><article><h3>Other</h3><p>A teaser</p></article><article><h3>More</h3><p>A second teaser</p></article></div>"
    for w in (H.Weights(), H.learn([SITE % BODY] * 3), H.learn([f"<div>{story}</div>{cards}"])):
        assert told in H.extract(f"<body><div>{story}</div>{cards}</body>", w)
        assert told in H.extract(f"<body>{cards}<div>{story}</div></body>", w)
        # a mark that holds most of the text still decides, and nothing between its parts is dropped
        assert H.extract(f"<p>By us</p><article>{story}</article><p>All rights</p>", w) == told
        both = H.extract(f"<article>{story}</article><p>In between</p><article>{story}</article>", w)
        assert both == f"{told} In between {told}"
    assert H.learn([f"<div>{story}</div>{cards}"]) == H.Weights()


def test_deep_and_long_pages():
    assert H.extract("<div>" * 3000 + "word" + "</div>" * 3000, H.Weights()).startswith("word")
    long = "<article>" + "<p>some words here</p>" * 50_000 + "</article>"
    assert H.extract(long, H.Weights()) == " ".join(["some words here"] * 50_000)


def test_extraction_query(spark):
    out = {r["page_id"]: r for r in Q.op10_main_text(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        a = re.sub(r"</?(b|i|em|strong|a|span)\b[^>]*>", "", re.search(r"<article>(.*)</article>", r["html"], re.S)[1])
        want = " ".join(html.unescape(re.sub(r"<[^>]+>", " ", a)).split())
        got = out[r["page_id"]]
        assert got["text"] == want and got["n_chars"] == len(want) and got["url"] == r["url"]


def test_null_pages(spark):
    df = spark.createDataFrame([(1, None), (1, ""), (None, "<p>x</p>")], "page_id long, html string").selectExpr("*", "0 as o", "1 as h")
    w = H.train(df, "html", "page_id")
    assert [r[0] for r in df.select(H.main_text(F.col("html"), w)).collect()] == ["", "", "x"]
    assert H.train(df.limit(0), "html", "page_id") == H.Weights()


@pytest.mark.parametrize("page,text", [
    # a quote opens a value only after an equals sign
    ("<p title=it's>ONE</p><p title=it's>TWO</p>", "ONE TWO"),
    # a marked place that holds the whole story is none
    *[(f"<div class='{c}'><p>A story of seven words is told</p></div><p>By us</p>", "A story of seven words is told By us")
      for c in ("widget", "overlay", "banner", "notice", "modal")],
    # what readers write and adverts, in whatever element of the article they stand
    *[(f"<article>{STORY}{junk}<p>End.</p></article>", "Title One two three four five six. End.") for junk in (
        "<div class='comment-list'><p>I disagree</p></div>", "<section class='comments'><p>First!</p></section>", "<p class='ad'>Buy</p>",
        "<table class=ads><tr><td>Buy</table>", "<div id=comments>No</div>", "<ol class='reader-comments'><li>No</ol>", "<span class=ad>Buy</span>")],
    # and on a page without a marked article
    (f"<div>{STORY * 4}</div><div class='reader-comments-list'><p>I disagree with it all</p></div><div class='sidebar-left-col'>More</div>",
     " ".join(["Title One two three four five six."] * 4)),
    # what only sounds like it stays
    (f"<article>{STORY}<p class='ad-hoc'>Ad hoc</p><p>No comment.</p><section id='ads'><h2 class=comments>On ads</h2></section></article>",
     "Title One two three four five six. Ad hoc No comment."),
    (f"<article>{STORY}<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</p></article>", "Title One two three four five six. Let x=1 be"),
])
def test_places_are_told_by_their_names(page, text):
    assert H.extract(page, H.Weights()) == text


def test_deep_pages_take_linear_time():
    import time

    t = time.perf_counter()
    H.extract("<div>" * 20_000 + "</span>" * 20_000 + "<b>" * 20_000 + "<hr>" * 20_000, H.Weights())
    assert time.perf_counter() - t < 2


WORDS = "river stone window garden letter morning yellow market silver engine paper bridge winter candle".split()
VOCABULARIES = [
    ("post", "entry-content", "comments-area", "widget-area"), ("story-body", "paragraph", "reader-comments", "sidebar-left"),
    ("content", "text", "comment-list", "related-links"), ("article-body", "lead", "disqus_thread", "share-buttons"),
    ("page", "copy", "user-comments", "newsletter-box"), ("news", "intro", "comments", "cookie-notice"),
    ("wrapper-main", "body-text", "respond", "promo-box"), ("blog", "p1", "commentThread", "social-bar"),
    ("doc", "chapter", "comment-section", "ad-slot"), ("reading", "block-text", "commentsBlock", "advert"),
]


def test_generated_pages_of_ten_class_vocabularies():
    """Word F1 of 200 pages against their known article, with and without <article>."""
    import random

    rng = random.Random(4)
    sentence = lambda n: " ".join(rng.choice(WORDS) for _ in range(n)) + "."
    scores = []
    for i in range(200):
        outer, inner, comments, side = VOCABULARIES[i % 10]
        paragraphs = [sentence(rng.randint(8, 30)) for _ in range(rng.randint(3, 9))]
        body = "".join(f"<p class='{inner}'>{p}</p>" if rng.random() < 0.7 else f"<div><p>{p}</p></div>" for p in paragraphs)
        says = "".join(f"<li><p>{sentence(6)}</p></li>" for _ in range(rng.randint(1, 4)))
        junk = f"<section class='{comments}'><ol>{says}</ol></section>" if i % 3 else f"<div class='{comments}'><ul>{says}</ul></div>"
        aside = f"<div class='{side}'><p>{sentence(7)}</p><a href=x>{sentence(2)}</a></div>"
        tag = "article" if i % 2 else "div"
        within = rng.random() < 0.5
        page = (f"<html><head><title>t</title></head><body><nav><a href=1>Home</a> <a href=2>News</a></nav>{aside}<{tag} class='{outer}'><h1>Title here</h1>{body}"
                f"{junk if within else ''}</{tag}>{'' if within else junk}<footer>All rights</footer></body></html>")
        want, got = ("Title here " + " ".join(paragraphs)).split(), H.extract(page, H.Weights()).split()
        both = sum((__import__("collections").Counter(want) & __import__("collections").Counter(got)).values())
        scores.append(2 * both / (len(want) + len(got)))
    assert sum(scores) / len(scores) >= 0.97, sorted(scores)[:10]
