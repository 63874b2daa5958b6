"""DuckDB SQL fragments mirroring :mod:`precis.functions` (oracle side).

Each helper takes a SQL expression and returns one, using the very same
pattern constants as the Spark functions.
"""

from __future__ import annotations

from precis import config as C
from precis.functions import patterns as P


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rr(x: str, pat: str, repl: str = "' '") -> str:
    return f"regexp_replace({x}, {lit(pat)}, {repl}, 'g')"


def coerce(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), '')"


def normalize(x: str) -> str:
    return f"trim({rr(coerce(x), P.WS_RUN)})"


def decode_entities(x: str) -> str:
    names = "MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in C.html_entities().items()) + "}"
    name = f"{names}[regexp_extract(p, '^([A-Za-z][A-Za-z0-9]*);', 1)]"
    dec = "regexp_replace(regexp_extract(p, '^#([0-9]+);', 1), '^0+', '')"
    hx = "regexp_replace(regexp_extract(p, '^#[xX]([0-9a-fA-F]+);', 1), '^0+', '')"
    dec_code = f"(CASE WHEN len({dec}) <= 7 THEN TRY_CAST({dec} AS INTEGER) END)"
    hex_code = f"(CASE WHEN len({hx}) <= 6 THEN TRY_CAST('0x' || {hx} AS INTEGER) END)"
    rest = "substr(p, instr(p, ';') + 1)"

    def char(code: str) -> str:
        return f"CASE WHEN {code} BETWEEN 1 AND 1114111 AND {code} NOT BETWEEN 55296 AND 57343 THEN chr({code}) ELSE chr(65533) END"

    piece = (
        "CASE WHEN i = 1 THEN p "
        f"WHEN regexp_matches(p, '^#[0-9]+;') THEN {char(dec_code)} || {rest} "
        f"WHEN regexp_matches(p, '^#[xX][0-9a-fA-F]+;') THEN {char(hex_code)} || {rest} "
        f"WHEN {name} IS NOT NULL THEN {name} || {rest} "
        "ELSE '&' || p END"
    )
    return (
        f"CASE WHEN instr({x}, '&') > 0 THEN array_to_string(list_transform(string_split({x}, '&'), "
        f"lambda p, i: {piece}), '') ELSE {x} END"
    )


def html_to_text(x: str) -> str:
    c = rr(x, P.HTML_COMMENT)
    for b in P.HTML_BLOCKS:
        c = rr(c, b)
    c = rr(c, P.HTML_TAG)
    return decode_entities(c)


def strip_urls(x):
    return rr(x, P.R_URL)


def strip_news_prefix(x):
    p1, p2, p3 = P.R_NEWS
    return (
        f"CASE WHEN regexp_matches({x}, {lit(p1)}) THEN regexp_replace({x}, {lit(p1)}, '') "
        f"WHEN regexp_matches({x}, {lit(p2)}) THEN regexp_replace({x}, {lit(p2)}, '') "
        f"WHEN regexp_matches({x}, {lit(p3)}) THEN regexp_replace({x}, {lit(p3)}, '') ELSE {x} END"
    )


def strip_editor_note(x):
    return rr(x, P.R_EDITOR, lit(P.R_EDITOR_REPL))


def strip_copyright(x):
    return rr(x, P.R_COPYRIGHT)


def strip_promo(x):
    return rr(x, P.R_PROMO)


def fix_punct_spacing(x):
    return rr(x, P.R_PUNCT, lit(P.R_PUNCT_REPL))


def clean_text(x: str, is_summary: bool = False) -> str:
    c = html_to_text(coerce(x))
    c = strip_urls(c)
    if not is_summary:
        c = strip_news_prefix(c)
        c = strip_editor_note(c)
    c = strip_copyright(c)
    c = strip_promo(c)
    c = fix_punct_spacing(c)
    return normalize(c)


def word_count(x: str) -> str:
    return f"CAST(len(regexp_extract_all({coerce(x)}, {lit(P.WORD)})) AS BIGINT)"


def words_of_normalized(x: str) -> str:
    return f"CAST(CASE WHEN {x} = '' THEN 0 ELSE len(string_split({x}, ' ')) END AS BIGINT)"


def split_sentences(x: str, normalized: bool = False) -> str:
    c = x if normalized else normalize(x)
    prot = "'\\1\\2' || chr(9) || ' '"
    c = f"regexp_replace({c}, {lit(P.SENT_PROTECT)}, {prot}, 'g')"
    c = f"regexp_replace({c}, {lit(P.SENT_PROTECT)}, {prot}, 'g')"
    c = f"regexp_replace({c}, {lit(P.SENT_BANG)}, '\\1' || chr(10), 'g')"
    c = f"regexp_replace({c}, {lit(P.SENT_DOT)}, '\\1' || chr(10) || '\\2', 'g')"
    c = f"replace({c}, chr(9), '.')"
    return f"list_filter(string_split({c}, chr(10)), lambda s: s <> '')"


def terms(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {lit(P.TERM)})"


def stop_list() -> str:
    return "(" + ", ".join(lit(w) for w in C.english_stop_words()) + ")"


def rouge_tokens(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), {lit(P.ROUGE_TOKEN)})"
