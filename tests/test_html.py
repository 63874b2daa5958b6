"""HTML to text: the standard's tokenizer on odd pages."""

import time

import pytest
from pyspark.sql import functions as F

from precis.functions import text as T
from precis.functions.html import text_of, unescape

PAGES = [
    # attributes
    ("<a title='x>y'>hi</a>", "hi"), ('<a title="x>y">hi</a>', "hi"), ("<p title=it's>ONE</p><p title=it's>TWO</p>", "ONE TWO"),
    ("<p a='b>c", ""), ("<a href=x>y>z</a>", "y>z"), ("<a = '>'>t</a>", "'>t"), ("<img alt=>t", "t"), ("<a b=c/>t", "t"),
    ("<a b = \"1>2\" c>t", "t"), ("<a \"b\">t", "t"), ("<br/>x<br />y", "x y"), ("<a\nhref='>'\n>t", "t"), ("<a b='1'c='>'>t", "t"),
    # what begins markup and what does not
    ("a < b and c > d", "a < b and c > d"), ("1<2", "1<2"), ("a<", "a<"), ("a</", "a</"), ("a</>b", "ab"), ("a</ b>c", "a c"),
    ("<3 you", "<3 you"), ("a<b", "a"), ("x<?php echo '>' ?>y", "x ' ?>y"), ("<!DOCTYPE html><p>x", "x"), ("<!x>y", "y"),
    ("<![CDATA[x]]>y", "y"), ("a<!>b", "a b"), ("<<p>x", "< x"), ("<p<b>x", "x"),
    # comments
    ("a<!-- <p>b</p> -->c", "a c"), ("a<!-->b", "a b"), ("a<!--->b", "a b"), ("a<!-- x --!>b", "a b"), ("a<!-- x", "a"),
    ("a<!-- - -- > x -->b", "a b"),
    # elements with text of their own kind
    ("a<script>if (x<y) '</p>'</script>b", "a b"), ("a<SCRIPT>x</Script >b", "a b"), ("a<script>x</scripts>y</script>b", "a b"),
    ("a<style>p{}</style>b", "a b"), ("a<script>x", "a"), ("<title>a<b>c &amp; d</title>e", "a<b>c & d e"), ("<textarea><p>x</textarea>y", "<p>x y"),
    ("<xmp><p>&amp;</xmp>y", "<p>&amp; y"), ("a<plaintext><p>x</plaintext>", "a <p>x</plaintext>"), ("a<script/>b</script>c", "a c"),
    ("a<template>x<template>y</template>z</template>b", "a b"), ("a</template>b", "a b"), ("a<template>b", "a"), ("a<template><script></template></script>x</template>b", "a b"),
    ("a<noscript>b</noscript>", "a b"),
    # references
    ("&copy2024", "©2024"), ("&#128;", "€"), ("&#x80;&#150;&#129;", "€–\x81"), ("&notit; &notin; &not", "¬it; ∉ ¬"), ("&amp;lt;", "&lt;"), ("&ampx", "&x"),
    ("AT&T &unknown; &", "AT&T &unknown; &"), ("&#65&#x42;", "AB"), ("&#;&#x;", "&#;&#x;"), ("&#0;&#55296;&#1114112;", "���"), ("&NotEqualTilde;", "≂̸"),
    ("&lt;b&gt;", "<b>"), ("&AMP;&LT&GT", "&<>"), ("<p>&eacute;t&eacute", "été"), ("", ""), ("plain", "plain"), ("🙂<b>ü", "🙂 ü"),
]


def test_there_are_enough_pages():
    assert len(PAGES) >= 50


def test_odd_pages(spark):
    df = spark.createDataFrame([(i, page) for i, (page, _) in enumerate(PAGES)] + [(-1, None)], "i int, page string")
    got = {r["i"]: r["t"] for r in df.select("i", F.trim(F.regexp_replace(T.html_to_text("page"), " +", " ")).alias("t")).collect()}
    assert got.pop(-1) is None
    assert {PAGES[i][0]: got[i] for i in got} == dict(PAGES)


def test_cleaning_reads_pages_by_the_same_tokenizer(spark):
    df = spark.createDataFrame([("<p title='a>b'>It works.Next &copy2024 <b>one</b> http://x.y/z</p>",), ("plain text",), (None,)], "t string")
    assert [r[0] for r in df.select(T.clean_text("t")).collect()] == ["It works. Next ©2024 one", "plain text", ""]


@pytest.mark.parametrize("page", ["<" * 300_000, "<a " * 100_000, "&" * 300_000, "<!--" * 100_000, "<template>" * 60_000,
                                  "&" + "a" * 300_000, "<a b='" * 100_000, "</" * 150_000, "<script>" * 100_000, "<title>" + "</titl" * 80_000])
def test_time_is_linear(page):
    t = time.perf_counter()
    text_of(page)
    assert time.perf_counter() - t < 3


def test_all_references_of_the_standard():
    from html.entities import html5

    for name, char in html5.items():
        assert unescape(f"&{name}") == char or name + ";" in html5  # some names go on
        if name.endswith(";"):
            assert unescape(f"x&{name}y") == f"x{char}y"
