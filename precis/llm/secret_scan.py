"""Secret scan: fixed patterns, and a battery of randomness tests with false-discovery control.

Fixed patterns (``BASE``) are always reported.  Besides, every long token of a text
is a candidate, or what a fixed pattern leaves of it; a token that fits no alphabet is
one for each of its parts between signs.  Its encoding (hex, base32, base64, ...) is inferred from the
characters it uses, and three tests ask whether it can be a uniformly random string
of that alphabet: chi-squared uniformity, a runs test and the lag-1 serial
correlation.  Fisher's method joins them into one p-value, uniform for random
strings and near 0 for words, paths and counters.

Which p-values are secret is decided over the corpus and per length: in each group
of tokens of one encoding and similar length the histogram of p-values shows how
many are random (the flat part), so the share of ordinary tokens above any cut can
be estimated; the cut is the smallest one that keeps that share at or below
``fdr``.  Every group's histogram starts from the same few assumed tokens, so the
rule holds for rare encodings too: alone they are cut at a small p-value, and the
more tokens there are the more these decide.  Only that histogram, whose size is fixed, reaches the driver.

The scan itself is a row-local Arrow UDF.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precis.llm import common


@dataclass(frozen=True)
class SecretConfig:
    min_token: int = 20  # characters of a candidate
    fdr: float = 0.05
    flat_from: float = 0.5  # p-values above this show the share of random strings
    bins: int = 100  # of the p-value
    known: float = 60.0  # tokens assumed in each group: so many random ones and as many ordinary ones
    ordinary: float = 0.03  # p-values of the assumed ordinary tokens are below this
    fallback: float = 0.3  # cut where there is no token at all


DEFAULT = SecretConfig()

ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}")  # every access, hex and candidate span lies in one
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
PART = re.compile(r"[A-Za-z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "random")  # their order in results

# Encodings in the order in which they are tried, with their alphabets.
ENCODINGS = (
    ("decimal", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("hex_upper", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/"),
    ("base64url", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_"),
)
_RANK = [{c: i for i, c in enumerate(a)} for _, a in ENCODINGS]
_LENGTHS = (24, 32, 40, 64, 128)  # upper ends of the length groups; longer tokens form the last one

SCAN_TYPE = "struct<base:array<struct<start:int,kind:int,end:int>>,found:array<struct<start:int,end:int,grp:int,bin:int>>>"


def infer_encoding(token: str) -> int | None:
    """Index of the smallest alphabet that holds the token, or None."""
    used = set(token)
    for i, rank in enumerate(_RANK):
        if used <= rank.keys():
            return i
    return None


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _cells(encoding: int, n: int) -> np.ndarray:
    """The cell of every symbol for the uniformity test of ``n`` characters.

    Cells keep to one class (digits, capitals, small letters, signs), so that a
    missing class shows, and each class is cut into parts of about five expected
    characters, eight parts at most.
    """
    alphabet = ENCODINGS[encoding][1]
    kind = np.array([0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3 for c in alphabet])
    cell, at = np.zeros(len(alphabet), np.int64), 0
    for k in np.unique(kind):
        members = np.flatnonzero(kind == k)
        parts = min(len(members), 8, max(1, int(len(members) * n / len(alphabet) / 5)))
        cell[members] = at + np.arange(len(members)) * parts // len(members)
        at += parts
    if at == 1:
        return (np.arange(len(alphabet)) >= len(alphabet) / 2).astype(np.int64)
    return cell


def randomness_p(token: str, encoding: int) -> float:
    """P-value of the hypothesis that the token is uniformly random in its alphabet."""
    size, n = len(_RANK[encoding]), len(token)
    x = np.fromiter((_RANK[encoding][c] for c in token), np.int64, n)
    cell = _cells(encoding, n)
    expect = np.bincount(cell) * (n / size)
    chi = float(((np.bincount(cell[x], minlength=len(expect)) - expect) ** 2 / expect).sum())
    df = len(expect) - 1
    p_chi = _normal_tail(((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))  # Wilson-Hilferty
    # runs above and below the middle of the alphabet
    high = x >= size / 2
    n1 = int(high.sum())
    n0 = n - n1
    if n1 == 0 or n0 == 0:
        p_runs = 2.0 ** (1 - n)
    else:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 2 * n1 * n0 / n + 1
        var = max(1e-9, (mean - 1) * (mean - 2) / (n - 1))
        p_runs = 2 * _normal_tail(max(0.0, abs(runs - mean) - 0.5) / math.sqrt(var))
    # serial correlation of neighbours
    d = x - x.mean()
    total = float((d * d).sum())
    r = float((d[1:] * d[:-1]).sum()) / total if total > 0 else 1.0
    p_serial = 2 * _normal_tail(abs(r + 1 / n) * math.sqrt(n))
    h = -sum(math.log(min(1.0, max(p, 1e-300))) for p in (p_chi, p_runs, p_serial))  # Fisher: chi-squared, 6 degrees
    return math.exp(-h) * (1 + h + h * h / 2)


def base_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start and kind."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    for a, b in runs:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, a, b)]
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text, a, b)]
    return sorted(out)


def scan_text(text: str, cfg: SecretConfig = DEFAULT):
    """(base spans, candidates as (start, end, group, p-value bin)) of a whole text.

    A candidate lies in no base span; decimal strings are numbers, not candidates.  A
    run that fits an alphabet with signs is a candidate as a whole and in its parts,
    which may overlap in the result.
    """
    runs = [m.span() for m in RUN.finditer(text)]
    base = base_spans(text, runs)
    found = []
    for a, b in beside(text, runs, base):
        if b - a < cfg.min_token:
            continue
        enc = infer_encoding(text[a:b])
        parts = [] if enc is None else [(a, b, enc)]
        # signs may join a key to a path as well as belong to it: the whole run and its parts are tested, under one control
        parts += [(*m.span(), infer_encoding(m[0])) for m in PART.finditer(text, a, b)
                  if m.end() - m.start() >= cfg.min_token and m.span() != (a, b)]
        for s, e, enc in parts:
            if enc:  # not decimal
                p = randomness_p(text[s:e], enc)
                found.append((s, e, group_of(enc, e - s), min(cfg.bins - 1, int(p * cfg.bins))))
    return base, found


def beside(text: str, runs: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """What base spans leave of the runs, without the sign that joins it to a span."""
    covered: list[list[int]] = []
    for s, _, e in base:
        if covered and s <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], e)
        else:
            covered.append([s, e])
    i = 0
    for a, b in runs:
        while i < len(covered) and covered[i][1] <= a:
            i += 1
        j, joined = i, False
        while j < len(covered) and covered[j][0] < b:
            s, e = covered[j]
            if a < s:
                yield a + (joined and text[a] in "+/_-"), s - (text[s - 1] in "+/_-")
            a, joined = max(a, e), True
            j += 1
        if a < b:
            yield a + (joined and text[a] in "+/_-"), b


def group_of(enc: int, length: int) -> int:
    return enc * (len(_LENGTHS) + 1) + sum(length > x for x in _LENGTHS)


def scan(text: Column, cfg: SecretConfig = DEFAULT) -> Column:
    """Base spans and candidates of a text column (null: empty text)."""

    @F.arrow_udf(SCAN_TYPE)
    def secrets(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
        cand = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("grp", pa.int32()), ("bin", pa.int32())])
        kind = pa.struct([("base", pa.list_(span)), ("found", pa.list_(cand))])
        for a in common.portions(it):
            rows = [scan_text(t, cfg) for t in common.texts_of(a)]
            yield pa.array([{
                "base": [dict(zip(("start", "kind", "end"), x)) for x in base],
                "found": [dict(zip(("start", "end", "grp", "bin"), x)) for x in found],
            } for base, found in rows], kind)

    return secrets(text)


def cuts(scanned: DataFrame, column: str = "scan", cfg: SecretConfig = DEFAULT) -> dict[int, int]:
    """The lowest p-value bin that counts as secret, for each group of candidates.

    Reads the histogram (group, bin) of all candidates: at most
    ``groups * cfg.bins`` rows whatever the size of the corpus.
    """
    hist: dict[int, np.ndarray] = {}
    rows = (
        scanned.select(F.explode(F.col(column)["found"]).alias("c"))
        .groupBy(F.col("c.grp").alias("grp"), F.col("c.bin").alias("bin")).count().collect()
    )
    for r in rows:
        hist.setdefault(r["grp"], np.zeros(cfg.bins))[r["bin"]] += r["count"]
    return {g: cut_of(h, cfg) for g, h in hist.items()}


def cut_of(hist: np.ndarray, cfg: SecretConfig = DEFAULT) -> int:
    """Smallest bin above which ordinary tokens are estimated to be at most ``cfg.fdr`` of the tokens.

    Random strings spread evenly over the bins; ``cfg.bins`` if no bin qualifies.
    """
    if not hist.sum():
        return int(cfg.fallback * cfg.bins)
    low = max(1, round(cfg.ordinary * cfg.bins))
    hist = hist + cfg.known / cfg.bins
    hist[:low] += cfg.known / low
    flat = int(cfg.flat_from * cfg.bins)
    per_bin = hist[flat:].sum() / (cfg.bins - flat)  # random strings in each bin
    for cut in range(cfg.bins):
        above = hist[cut:].sum()
        if above and 1 - min(1.0, per_bin * (cfg.bins - cut) / above) <= cfg.fdr:
            return cut
    return cfg.bins


def spans(scan_col: Column, cut: dict[int, int]) -> Column:
    """All spans as array<struct<start, kind, end>> by start and kind, the accepted candidates as kind 3."""
    base = scan_col["base"]
    if not cut:
        return base
    table = F.create_map(*[F.lit(x) for kv in sorted(cut.items()) for x in kv])
    added = F.transform(
        F.filter(scan_col["found"], lambda c: c["bin"] >= table[c["grp"]]),
        lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")),
    )
    return F.array_sort(F.concat(base, added))


def as_text(span_col: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(span_col, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(span_col: Column, kind: str) -> Column:
    k = KINDS.index(kind)
    return F.size(F.filter(span_col, lambda s: s["kind"] == k)).cast("long")


def redact_text(text: str, found: list[tuple[int, int]], mark: str) -> str:
    """The text with every span (overlapping ones as one) replaced by a mark."""
    out, at = [], 0
    for a, b in sorted(found):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def redact(text: Column, cut: dict[int, int], cfg: SecretConfig = DEFAULT, mark: str = "[secret]") -> Column:
    """The text column without its secrets; a null text stays null."""

    @F.arrow_udf("string")
    def masked(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in common.portions(it):
            out = []
            for t in a.to_pylist():
                if t:
                    base, found = scan_text(t, cfg)
                    hit = [(s, e) for s, _, e in base] + [(s, e) for s, e, g, b in found if b >= cut.get(g, cfg.bins)]
                    t = redact_text(t, hit, mark)
                out.append(t)
            yield pa.array(out, pa.string())

    return masked(text)
