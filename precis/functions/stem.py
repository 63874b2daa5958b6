"""Porter stemming of token arrays (E2) in Arrow batches.

The same algorithm as :mod:`precis.functions.porter`, which writes it as SQL: a batch's
tokens are dictionary-encoded, every distinct token is stemmed once, and the stems are
dealt back by the dictionary.  Frequent tokens are remembered between batches.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from precis import config as C
from precis.functions.porter import STEP2, STEP3, STEP4

_IRREGULAR = dict(C.STEM_IRREGULAR)


def _pattern(w: str) -> str:
    """'v' and 'c' for each character; y is a vowel after a consonant."""
    out = []
    for ch in w:
        vowel = ch in "aeiou" or ch == "y" and out and out[-1] == "c"
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(pattern: str) -> int:
    return pattern.count("vc")


def _short(stem: str, pattern: str) -> bool:
    """Whether the stem ends consonant, vowel, consonant (not w, x, y), or is vowel, consonant."""
    return len(stem) >= 3 and pattern[-3:] == "cvc" and stem[-1] not in "wxy" or len(stem) == 2 and pattern == "vc"


def _plural(w: str) -> str:
    if w.endswith("ies"):
        return w[:-3] + "ie" if len(w) == 4 else w[:-2]
    if w.endswith("sses"):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-3] + ("ie" if len(w) == 4 else "i")
    pattern = _pattern(w)
    if w.endswith("eed"):
        return w[:-1] if _measure(pattern[:-3]) > 0 else w
    for ending in ("ed", "ing"):
        n = len(w) - len(ending)
        if w.endswith(ending) and "v" in pattern[:n]:
            stem, pattern = w[:n], pattern[:n]
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if len(stem) >= 2 and stem[-1] == stem[-2] and pattern[-1] == "c":
                return stem if stem[-1] in "lsz" else stem[:-1]
            return stem + "e" if _measure(pattern) == 1 and _short(stem, pattern) else stem
    return w


def _by_rules(w: str, rules, least: int) -> str:
    """The first suffix that matches decides; it is replaced if the stem's measure exceeds ``least``."""
    pattern = _pattern(w)
    for suffix, replacement in rules:
        if w.endswith(suffix):
            n = len(w) - len(suffix)
            good = _measure(pattern[:n]) > least
            if suffix == "ion" and least == 1:
                good = good and w[n - 1:n] in ("s", "t")
            return w[:n] + replacement if good else w
    return w


def stem(w: str) -> str:
    """Porter stem of a lower-case token."""
    if len(w) <= 2:
        return w
    if w in _IRREGULAR:
        return _IRREGULAR[w]
    w = _past(_plural(w))
    if len(w) > 2 and w[-1] == "y" and _pattern(w)[-2] == "c":
        w = w[:-1] + "i"
    if w.endswith("alli") and _measure(_pattern(w)[:-4]) > 0:
        w = w[:-4] + "al"
    if w.endswith("logi") and not w.endswith(tuple(s for s, _ in STEP2)):
        w = w[:-1] if _measure(_pattern(w)[:-3]) > 0 else w
    else:
        w = _by_rules(w, STEP2, 0)
    w = _by_rules(w, STEP3, 0)
    w = _by_rules(w, tuple((s, "") for s in STEP4), 1)
    if w.endswith("e"):
        pattern = _pattern(w)[:-1]
        if _measure(pattern) > 1 or _measure(pattern) == 1 and not _short(w[:-1], pattern):
            w = w[:-1]
    if w.endswith("ll") and _measure(_pattern(w)[:-1]) > 1:
        w = w[:-1]
    return w


_KNOWN: dict[str, str] = {}  # stems of a worker's tokens, emptied when it holds 2^16


def rouge_stem(token: str) -> str:
    """Stem only tokens longer than three characters (the ROUGE tokenizer rule)."""
    if len(token) <= 3:
        return token
    found = _KNOWN.get(token)
    if found is None:
        if len(_KNOWN) >= 1 << 16:
            _KNOWN.clear()
        found = _KNOWN[token] = stem(token)
    return found


def stemmed(tokens: pa.Array) -> pa.Array:
    """The stems of a string array, each distinct token stemmed once."""
    d = pc.dictionary_encode(tokens)
    stems = pa.array([None if t is None else rouge_stem(t) for t in d.dictionary.to_pylist()], pa.string())
    return stems.take(d.indices)


def _stem_lists(lists: pa.Array) -> pa.Array:
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    offsets = pa.array([0, *sizes.cumsum().tolist()], pa.int32())
    return pa.ListArray.from_arrays(offsets, stemmed(pc.list_flatten(lists).cast(pa.string())))


def stem_arrays(tokens: Column) -> Column:
    """ROUGE stems of every token of an ARRAY<STRING> column; a null array is empty."""
    return F.arrow_udf(_stem_lists, "array<string>")(tokens)


def _rouge_1(sentences: pa.Array, reference: pa.Array) -> pa.Array:
    """ROUGE-1 F of every sentence (a list of tokens) against the row's reference tokens."""
    out = []
    for sents, ref in zip(sentences.to_pylist(), reference.to_pylist()):
        ref = [rouge_stem(t) for t in ref or []]
        count: dict = {}
        for t in ref:
            count[t] = count.get(t, 0) + 1
        scores = []
        for toks in sents or []:
            left, overlap = {}, 0
            for t in toks:
                t = rouge_stem(t)
                c = left.get(t, count.get(t, 0))
                overlap += c > 0
                left[t] = c - 1
            p = overlap / len(toks) if toks else 0.0
            r = overlap / len(ref) if ref else 0.0
            scores.append(2 * p * r / (p + r) if p + r > 0 else 0.0)
        out.append(scores)
    return pa.array(out, pa.list_(pa.float64()))


def rouge_1_of_sentences(sentences: Column, reference: Column) -> Column:
    """ROUGE-1 F-measures, one for each sentence: token arrays of the sentences and of the reference."""
    return F.arrow_udf(_rouge_1, "array<double>")(sentences, reference)
