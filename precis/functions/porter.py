"""Porter stemmer (E2) as one SQL expression, for Spark and for DuckDB.

The stemmer follows Porter (1980) with the widely used "NLTK extensions"
variant (irregular forms, ``ies``/``ied`` on 4-letter words, ``alli``/``fulli``
/``logi`` in step 2, the (*c and not c) Y -> I rule, 2-letter cvc), which is
what the ROUGE scorer applies to tokens longer than three characters.

It is generated as SQL text so that the Spark plan (``F.expr``) and the DuckDB
oracle evaluate literally the same expression.  Intermediate words are bound
with a one-element ``transform`` (Spark has no ``let``) so the expression grows
linearly with the number of steps.  The consonant/vowel pattern of a word is
computed once per step with ``aggregate``; the pattern of a prefix is the
prefix of the pattern, so measures of candidate stems are substrings of it.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F

from precis import config as C

# Rule tables (suffix, replacement): the first suffix that matches decides.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
    ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
    ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
    ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
STEP3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
    ("ful", ""), ("ness", ""),
)
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)


class _Gen:
    def __init__(self, dialect: str):
        assert dialect in ("spark", "duckdb")
        self.d = dialect
        self._ids = itertools.count()

    def var(self, p: str) -> str:
        return f"{p}{next(self._ids)}"

    def bind(self, expr: str, body) -> str:
        v = self.var("w")
        inner = body(v)
        if self.d == "spark":
            return f"element_at(transform(array({expr}), {v} -> {inner}), 1)"
        return f"(list_transform([{expr}], lambda {v}: {inner}))[1]"

    def cv(self, w: str) -> str:
        """Consonant/vowel pattern: 'c'/'v' per character (y by its left side)."""
        a, h = self.var("a"), self.var("h")
        step = (
            f"CASE WHEN {h} IN ('a','e','i','o','u') THEN 'v' "
            f"WHEN {h} = 'y' THEN (CASE WHEN {a} = '' OR right({a}, 1) = 'v' THEN 'c' ELSE 'v' END) "
            f"ELSE 'c' END"
        )
        if self.d == "spark":
            exact = f"aggregate(split({w}, ''), '', ({a}, {h}) -> concat({a}, {step}))"
        else:
            exact = f"list_reduce(string_split({w}, ''), lambda {a}, {h}: {a} || ({step}), '')"
        # fast path: map letters, then settle each y from its left neighbour
        # with non-overlapping passes (every pair settles >= 1 y of each run);
        # a y left after two pairs (runs of 4+) takes the exact path above
        g = "" if self.d == "spark" else ", 'g'"

        def rr(x, pat, rep):
            return f"regexp_replace({x}, '{pat}', '{rep}'{g})"

        fast = rr(f"translate({w}, '{_LETTERS}', '{_CV_MAP}')", "^y", "c")
        for _ in range(2):
            fast = rr(rr(fast, "cy", "cv"), "vy", "vc")
        return self.bind(fast, lambda v: f"CASE WHEN instr({v}, 'y') > 0 THEN {exact} ELSE {v} END")


# letters and digits of ROUGE tokens -> v (a e i o u), y (resolved later), c
_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
_CV_MAP = "".join("v" if ch in "aeiou" else "y" if ch == "y" else "c" for ch in _LETTERS)


def _q(s: str) -> str:
    return "'" + s + "'"


def _ends(w, s):
    return f"right({w}, {len(s)}) = {_q(s)}"


def _drop(w, n):
    return f"substr({w}, 1, length({w}) - {n})"


def _pre(cv, w, n):
    """cv pattern of the stem w[:-n]."""
    return f"substr({cv}, 1, length({w}) - {n})"


def _m(p):
    return f"((length({p}) - length(replace({p}, 'vc', ''))) / 2)"


def _cvc(stem, p):
    return (
        f"((length({stem}) >= 3 AND right({p}, 3) = 'cvc' AND right({stem}, 1) NOT IN ('w','x','y')) "
        f"OR (length({stem}) = 2 AND {p} = 'vc'))"
    )


def _rule_list(w, cv, rules, cond, extra: str = "") -> str:
    """First matching suffix decides; a failing condition keeps the word."""
    parts = []
    for suf, rep in rules:
        stem = _drop(w, len(suf))
        ok = cond(suf, _pre(cv, w, len(suf)))
        parts.append(f"WHEN {_ends(w, suf)} THEN (CASE WHEN {ok} THEN {stem} || {_q(rep)} ELSE {w} END)")
    return "CASE " + " ".join(parts) + f" {extra} ELSE {w} END"


def stem_sql(word: str, dialect: str = "spark") -> str:
    """SQL text stemming the lower-case token expression ``word``."""
    g = _Gen(dialect)

    def with_cv(expr, body):
        return g.bind(expr, lambda w: g.bind(g.cv(w), lambda cv: body(w, cv)))

    def step1a(w):
        return (
            f"CASE WHEN {_ends(w, 'ies')} AND length({w}) = 4 THEN {_drop(w, 3)} || 'ie' "
            f"WHEN {_ends(w, 'sses')} THEN {_drop(w, 2)} "
            f"WHEN {_ends(w, 'ies')} THEN {_drop(w, 2)} "
            f"WHEN {_ends(w, 'ss')} THEN {w} "
            f"WHEN {_ends(w, 's')} THEN {_drop(w, 1)} ELSE {w} END"
        )

    def after_ed_ing(s, cv):
        ps = f"substr({cv}, 1, length({s}))"
        dbl = f"(length({s}) >= 2 AND right({s}, 1) = substr({s}, length({s}) - 1, 1) AND right({ps}, 1) = 'c')"
        return (
            f"CASE WHEN {_ends(s, 'at')} OR {_ends(s, 'bl')} OR {_ends(s, 'iz')} THEN {s} || 'e' "
            f"WHEN {dbl} THEN (CASE WHEN right({s}, 1) NOT IN ('l','s','z') THEN {_drop(s, 1)} ELSE {s} END) "
            f"WHEN {_m(ps)} = 1 AND {_cvc(s, ps)} THEN {s} || 'e' ELSE {s} END"
        )

    def step1b(w, cv):
        ed = g.bind(_drop(w, 2), lambda s: after_ed_ing(s, cv))
        ing = g.bind(_drop(w, 3), lambda s: after_ed_ing(s, cv))
        return (
            f"CASE WHEN {_ends(w, 'ied')} THEN (CASE WHEN length({w}) = 4 THEN {_drop(w, 3)} || 'ie' ELSE {_drop(w, 3)} || 'i' END) "
            f"WHEN {_ends(w, 'eed')} THEN (CASE WHEN {_m(_pre(cv, w, 3))} > 0 THEN {_drop(w, 1)} ELSE {w} END) "
            f"WHEN {_ends(w, 'ed')} AND instr({_pre(cv, w, 2)}, 'v') > 0 THEN {ed} "
            f"WHEN {_ends(w, 'ing')} AND instr({_pre(cv, w, 3)}, 'v') > 0 THEN {ing} "
            f"ELSE {w} END"
        )

    def step1c(w, cv):
        return (
            f"CASE WHEN {_ends(w, 'y')} AND length({w}) > 2 AND substr({cv}, length({w}) - 1, 1) = 'c' "
            f"THEN {_drop(w, 1)} || 'i' ELSE {w} END"
        )

    def step2_pre(w, cv):
        return (
            f"CASE WHEN {_ends(w, 'alli')} AND {_m(_pre(cv, w, 4))} > 0 "
            f"THEN {_drop(w, 4)} || 'al' ELSE {w} END"
        )

    def step2(w, cv):
        # 'logi' -> 'log' keeps the 'l' with the stem for the measure test
        logi = f"WHEN {_ends(w, 'logi')} THEN (CASE WHEN {_m(_pre(cv, w, 3))} > 0 THEN {_drop(w, 1)} ELSE {w} END)"
        return _rule_list(w, cv, STEP2, lambda suf, p: f"{_m(p)} > 0", extra=logi)

    def step3(w, cv):
        return _rule_list(w, cv, STEP3, lambda suf, p: f"{_m(p)} > 0")

    def step4(w, cv):
        def cond(suf, p):
            if suf == "ion":
                return f"({_m(p)} > 1 AND substr({w}, length({w}) - 3, 1) IN ('s','t'))"
            return f"{_m(p)} > 1"

        return _rule_list(w, cv, tuple((s, "") for s in STEP4), cond)

    def step5a(w, cv):
        p = _pre(cv, w, 1)
        stem = _drop(w, 1)
        return (
            f"CASE WHEN {_ends(w, 'e')} AND ({_m(p)} > 1 OR ({_m(p)} = 1 AND NOT {_cvc(stem, p)})) "
            f"THEN {stem} ELSE {w} END"
        )

    def step5b(w, cv):
        return f"CASE WHEN {_ends(w, 'll')} AND {_m(_pre(cv, w, 1))} > 1 THEN {_drop(w, 1)} ELSE {w} END"

    def top(w):
        e = g.bind(w, step1a)
        for st in (step1b, step1c, step2_pre, step2, step3, step4, step5a, step5b):
            e = with_cv(e, st)
        irregular = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in C.STEM_IRREGULAR)
        return f"CASE WHEN length({w}) <= 2 THEN {w} ELSE (CASE {w} {irregular} ELSE {e} END) END"

    return g.bind(word, top)


def rouge_stem_sql(token: str, dialect: str = "spark") -> str:
    """Stem only tokens longer than three characters (the ROUGE tokenizer rule)."""
    return f"CASE WHEN length({token}) > 3 THEN {stem_sql(token, dialect)} ELSE {token} END"


def stem(col_name: str) -> Column:
    """Porter stem of the lower-case token column ``col_name`` (Spark)."""
    return F.expr(stem_sql(f"`{col_name}`"))


def stem_tokens(array_col_name: str) -> Column:
    """ROUGE stemming of every token of an ``ARRAY<STRING>`` column, in place."""
    return F.expr(f"transform(`{array_col_name}`, tk -> {rouge_stem_sql('tk')})")
