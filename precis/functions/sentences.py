"""Rule-based sentence splitter (N1) as one Catalyst expression.

On whitespace-normalised text:

1. protect dots that do not end a sentence (a listed abbreviation or a single
   capital letter, preceded by start/space/'(' and followed by a space) by
   turning them into a marker (Java: one pass with a look-ahead; RE2, which
   has none, needs two consuming passes for the same result);
2. a run of ``!``/``?`` (plus closing quotes/brackets) followed by a space is a
   boundary;
3. a ``.`` (plus closers) followed by a space and a character that is not a
   lower-case letter is a boundary;
4. restore protected dots and split on the boundary marker.

Markers rather than look-arounds, so RE2 (the DuckDB oracle) can run the
same steps.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from precis.functions import patterns as P
from precis.functions.text import _c, normalize_ws


def mark_boundaries(normalized) -> Column:
    c = _c(normalized)
    # one look-ahead pass == the two consuming passes of the RE2 form
    c = F.regexp_replace(c, P.J_SENT_PROTECT, "$1$2" + P.PROTECT_MARK)
    c = F.regexp_replace(c, P.SENT_BANG, "$1" + P.BOUNDARY_MARK)
    c = F.regexp_replace(c, P.SENT_DOT, "$1" + P.BOUNDARY_MARK + "$2")
    return F.replace(c, F.lit(P.PROTECT_MARK), F.lit("."))


def split_sentences(col, normalized: bool = False) -> Column:
    """Text -> ARRAY<STRING> of sentences; '' / null -> []."""
    c = _c(col) if normalized else normalize_ws(col)
    parts = F.split(mark_boundaries(c), P.BOUNDARY_MARK)
    return F.filter(parts, lambda s: s != "")
