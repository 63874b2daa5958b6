"""Tokenisers: TF-IDF terms (F1) and ROUGE tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from precis import config as C
from precis.functions import patterns as P
from precis.functions.text import _c


def terms(col) -> Column:
    """lower-cased runs of >= 2 word characters (stop words kept; they are
    dropped after the explode, where ``isin`` is a hash-set lookup)."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(P.TERM), 0)


def is_stop_word(col) -> Column:
    return _c(col).isin(list(C.english_stop_words()))


def rouge_tokens(col) -> Column:
    """Lower-case, anything but [a-z0-9] separates tokens."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(col), F.lit(""))), F.lit(P.ROUGE_TOKEN), 0)
