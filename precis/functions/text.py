"""Text-cleaning scalar functions (T1-T15): ``Column -> Column``.

All of them are native Catalyst expressions (regexp_replace, trim, split, ...), so they
run inside whole-stage code generation; only texts with HTML markup leave the JVM, for
the tokenizer of T2.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from precis import config as C
from precis.functions import patterns as P
from precis.functions.html import html_text, unescaped


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def coerce_text(col) -> Column:
    """Null -> '', anything else -> its string form."""
    return F.coalesce(_c(col).cast("string"), F.lit(""))


def decode_entities(col) -> Column:
    """Every HTML character reference, decoded once; what is no character becomes U+FFFD."""
    return unescaped(_c(col))


def html_to_text(col) -> Column:
    """The text nodes of a page, joined by blanks; character references decoded once.

    Comments, script, style and template content are no text; see :mod:`precis.functions.html`.
    """
    return html_text(_c(col))


def strip_urls(col) -> Column:
    """T3."""
    return F.regexp_replace(_c(col), P.J_URL, " ")


def strip_news_prefix(col) -> Column:
    """T4: the first of three anchored patterns that matches removes one prefix."""
    c = _c(col)
    p1, p2, p3 = P.J_NEWS
    return (
        F.when(c.rlike(p1), F.regexp_replace(c, p1, ""))
        .when(c.rlike(p2), F.regexp_replace(c, p2, ""))
        .when(c.rlike(p3), F.regexp_replace(c, p3, ""))
        .otherwise(c)
    )


def strip_editor_note(col) -> Column:
    """T5."""
    return F.regexp_replace(_c(col), P.J_EDITOR, " ")


def strip_copyright(col) -> Column:
    """T6."""
    return F.regexp_replace(_c(col), P.J_COPYRIGHT, " ")


def strip_promo(col) -> Column:
    """T7."""
    return F.regexp_replace(_c(col), P.J_PROMO, " ")


def fix_punct_spacing(col) -> Column:
    """A space after sentence punctuation directly followed by a capital."""
    return F.regexp_replace(_c(col), P.J_PUNCT, P.J_PUNCT_REPL)


def normalize_ws(col) -> Column:
    """Unicode whitespace runs -> one space, trimmed; null -> ''."""
    return F.trim(F.regexp_replace(coerce_text(col), P.WS_RUN, " "))


def clean_text(col, is_summary: bool = False) -> Column:
    """T1 -> T2 -> T3 -> (articles: T4, T5) -> T6 -> T7 -> T8 -> T9."""
    c = html_to_text(coerce_text(col))
    c = strip_urls(c)
    if not is_summary:
        c = strip_news_prefix(c)
        c = strip_editor_note(c)
    c = strip_copyright(c)
    c = strip_promo(c)
    c = fix_punct_spacing(c)
    return normalize_ws(c)


def word_count(col) -> Column:
    """``len(text.split())`` — number of non-whitespace runs (0 for '').

    Counted as the pieces of the whitespace-normalised text (one regex pass
    plus a split), several times cheaper than counting regex matches.
    """
    return words_of_normalized(normalize_ws(col))


def words_of_normalized(col) -> Column:
    """Word count of text already normalised by T9 (cheaper: no regex)."""
    # one reference to the input (it may be an expensive expression); only
    # '' yields an empty piece in normalised text
    return F.size(F.array_remove(F.split(_c(col), " "), "")).cast("bigint")


def compression_ratio(words, summary_words) -> Column:
    """(1 - summary_words / words) * 100, 0 when the input has no words."""
    w, s = _c(words), _c(summary_words)
    return F.when(w > 0, (F.lit(1.0) - s / w) * 100.0).otherwise(F.lit(0.0))


def preview(col, n: int = C.DEFAULT.preview_chars) -> Column:
    """The first n characters plus '...' (always appended)."""
    return F.concat(F.substring(coerce_text(col), 1, n), F.lit("..."))
