"""Regular expressions shared by the Spark functions and the DuckDB oracle.

The fixed patterns of :mod:`precis.config` are written in Python syntax.  Here
they are adapted once, per engine:

* ``\\s``/``\\S`` become the explicit Unicode whitespace class (Python's
  ``str.isspace`` set), because Java's and RE2's ``\\s`` are ASCII-only;
* Java gets ``(?u)`` with ``(?i)`` (Unicode case folding, as Python's
  ``re.IGNORECASE``) and ``(?d)`` where ``.`` or ``$`` occur (only ``\\n`` is a
  line terminator, as in Python);
* RE2 has no look-ahead, so the editor's-note pattern captures the stop and
  puts it back.
"""

from __future__ import annotations

from precis import config as C


def _ws(p: str) -> str:
    return p.replace(r"\s", C.WS).replace(r"\S", C.NON_WS)


# --- Java (Spark) -----------------------------------------------------------
J_URL = "(?iu)" + _ws(C.URL_PATTERN)
J_NEWS = tuple(_ws(p) for p in C.NEWS_PREFIX_PATTERNS)
J_EDITOR = "(?iud)" + _ws(C.EDITOR_NOTE_PATTERN)
J_COPYRIGHT = "(?iud)" + _ws(C.COPYRIGHT_PATTERN).replace(r"\d", r"\p{Nd}")
J_PROMO = "(?iu)" + C.PROMO_PATTERN
J_PUNCT = C.PUNCT_SPACING_PATTERN
J_PUNCT_REPL = "$1 $2"

# --- RE2 (DuckDB oracle) ----------------------------------------------------
R_URL = "(?i)" + _ws(C.URL_PATTERN)
R_NEWS = J_NEWS
R_EDITOR = "(?i)Editor's note:.*?(\\." + C.WS + "|\\n$|$)"
R_EDITOR_REPL = " \\1"
R_COPYRIGHT = "(?i)" + _ws(C.COPYRIGHT_PATTERN).replace(r"\d", r"\p{Nd}")
R_PROMO = "(?i)" + C.PROMO_PATTERN
R_PUNCT = C.PUNCT_SPACING_PATTERN
R_PUNCT_REPL = "\\1 \\2"

# --- both ------------------------------------------------------------------
WS_RUN = C.WS + "+"
WORD = C.NON_WS + "+"

HTML_COMMENT = "(?s)<!--.*?-->"
HTML_BLOCKS = tuple(
    f"(?is)<{tag}(?:[^>a-zA-Z0-9][^>]*)?>.*?(?:</{tag}[^>]*>|\\z)" for tag in ("script", "style", "template")
)
HTML_TAG = "<[!/?a-zA-Z][^>]*>"

# Sentence splitter (N1): markers instead of look-arounds so both engines agree.
# normalised text has no white space but single blanks, so these cannot occur in it
PROTECT_MARK = "\t"
BOUNDARY_MARK = "\n"
ABBREV_ALT = "|".join(a.replace(".", "\\.") for a in C.ABBREVIATIONS)
SENT_PROTECT = "(^|[ (])(" + ABBREV_ALT + "|\\p{Lu})\\. "
# Java only: the same protection in one pass — the look-ahead leaves the space
# for a neighbouring initial, which is why RE2 needs the two-pass form above
J_SENT_PROTECT = "(^|[ (])(" + ABBREV_ALT + "|\\p{Lu})\\.(?= )"
SENT_BANG = "([!?][\"')\\]]*) "
SENT_DOT = "(\\.[\"')\\]]*) ([^\\p{Ll} ])"

# Terms (F1) and ROUGE tokens
TERM = "[\\p{L}\\p{N}_]{2,}"
ROUGE_TOKEN = "[a-z0-9]+"
