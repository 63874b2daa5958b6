"""Cleaning functions and the sentence splitter on the FIXTURES rows."""

import pytest

from precis.functions import text as T
from precis.functions.sentences import split_sentences
from tests.conftest import one


@pytest.mark.parametrize(
    "inp,expected",
    [
        ("(CNN) -- Harry won.", "Harry won."),
        ("LONDON, England (Reuters) -- Harry Potter", "Harry Potter"),
        ("PARIS - Rain fell", "Rain fell"),
        ("Well-known artists met.", "known artists met."),
        ("Met. Well-known. High-end shop, a-b", "end shop, a-b"),
        ("Élan-vital won", "Élan-vital won"),
        ("plain text - no", "plain text - no"),
    ],
)
def test_news_prefix(spark, inp, expected):
    assert one(spark, T.strip_news_prefix, inp) == expected


def test_editor_note(spark):
    assert one(spark, T.strip_editor_note, "x. Editor's note: abc v1.2 def. After") == "x.  . After"
    assert one(spark, T.strip_editor_note, "Editor's note: one\ntwo. End") == "Editor's note: one\ntwo. End"
    assert one(spark, T.strip_editor_note, "EDITOR'S NOTE: tail") == " "


def test_copyright_promo_urls_punct(spark):
    assert one(spark, T.strip_copyright, "A. Copyright 2009 Reuters. All rights reserved.This") == "A.  This"
    assert one(spark, T.strip_copyright, "Copyright 2009 X\nAll rights reserved.") == "Copyright 2009 X\nAll rights reserved."
    assert one(spark, T.strip_promo, "Spread more.") == "Sp "
    assert one(spark, T.strip_urls, "see HTTP://a.b/c?x=1, and www.z.org.") == "see   and  "
    assert one(spark, T.fix_punct_spacing, "end.Next one!Two U.S.A. v1.2") == "end. Next one! Two U. S. A. v1.2"


def test_whitespace_and_counts(spark):
    assert one(spark, T.normalize_ws, "  a\t\nb c ") == "a b c"
    assert one(spark, T.normalize_ws, "a b c") == "a b c"
    assert one(spark, T.normalize_ws, None) == ""
    assert one(spark, T.word_count, "") == 0
    assert one(spark, T.word_count, "a b") == 2
    assert one(spark, T.word_count, None) == 0


def test_html_to_text(spark):
    html = '<script>var t="</p>";</script><p>a<b>b</b> &amp;lt;'
    out = one(spark, lambda c: T.normalize_ws(T.html_to_text(c)), html)
    assert out.split() == ["a", "b", "&lt;"]
    assert one(spark, lambda c: T.normalize_ws(T.html_to_text(c)), "x &#233;&#x41; <!-- c --> y") == "x éA y"


def test_clean_text_summary_keeps_prefix(spark):
    assert one(spark, lambda c: T.clean_text(c, True), "(CNN) -- Hi there. Read more.") == "(CNN) -- Hi there."
    assert one(spark, lambda c: T.clean_text(c, False), "(CNN) -- Hi there. Read more.") == "Hi there."


def test_compression_ratio(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(100, 25), (0, 0)], "w long, s long")
    got = [r[0] for r in df.select(T.compression_ratio(F.col("w"), F.col("s"))).collect()]
    assert got == [75.0, 0.0]


def test_preview(spark):
    assert one(spark, lambda c: T.preview(c, 3), "abcdef") == "abc..."
    assert one(spark, lambda c: T.preview(c, 10), "ab") == "ab..."


@pytest.mark.parametrize(
    "inp,expected",
    [
        ("He met Dr. Smith. Then he left! ok? yes. no", ["He met Dr. Smith.", "Then he left!", "ok?", "yes. no"]),
        ("A. B. C. D. Fin. Élan. 3 cats.", ["A. B. C. D. Fin.", "Élan.", "3 cats."]),
        ("", []),
        ("   ", []),
        ("One sentence", ["One sentence"]),
        ('He said "Stop." Then left.', ['He said "Stop."', "Then left."]),
    ],
)
def test_split_sentences(spark, inp, expected):
    assert one(spark, split_sentences, inp) == expected
