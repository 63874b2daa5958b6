"""Toxicity: character n-gram vectors averaged into a linear softmax.

A text is read in windows of a few words.  A window is the bag of the character
n-grams (3 to 6, with word-boundary marks) of its lower-cased words; each n-gram
hashes to one row of an embedding table, and the mean of the rows goes through a
two-class softmax.  A document scores as its most toxic window, because one insult
makes a long text toxic and its share of the whole text says little.  Embeddings
and softmax are trained together by Adam in numpy, from document labels alone.  A
misspelled or inflected word shares most of its n-grams, and so its vectors, with
the words seen in training.

Scoring needs one number per n-gram row (its embedding projected on the
difference of the class weights), so a text costs a few vectorised passes; it is
a row-local Arrow UDF without any shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precis.llm import common


@dataclass(frozen=True)
class ToxicityConfig:
    ngrams: tuple = (3, 4, 5, 6)
    buckets: int = 1 << 16
    dim: int = 8
    window: int = 8  # words that are averaged together
    per_class: int = 2500  # training documents of each class, at most
    max_chars: int = 10_000  # longest training document
    epochs: int = 30
    batch: int = 64
    lr: float = 0.005
    l2: float = 1e-6
    scale: float = 10.0  # of the mean before the softmax
    seed: int = 7
    prior: float = 0.0  # score of every text when there is nothing to learn from
    block: int = 1 << 17  # characters that are worked on at once


DEFAULT = ToxicityConfig()
_SEP = re.compile(r"[\W_]+")
_REPEAT = re.compile(r"( [^ ]+)\1+(?= )")
_MUL = np.uint32(0x9E3779B1)


def normalise(text: str) -> str:
    """Lower case, everything but letters and digits as one blank, a word said again and again once."""
    return _REPEAT.sub(r"\1", " " + _SEP.sub(" ", text.lower()).strip() + " ")


def ngram_rows(codes: np.ndarray, cfg: ToxicityConfig):
    """For each n of the settings: (bucket of the n-gram at each place, whether it counts).

    ``codes``: code points in which a blank stands between words.  An n-gram counts
    if it holds no inner blank: it may begin or end at a word's border.
    """
    sep = codes == 32
    h, inner = codes.copy(), np.zeros(len(codes), bool)
    for n in range(2, max(cfg.ngrams) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            return
        h = h[:m] * _MUL + codes[n - 1:]
        if n >= 3:
            inner = inner[:m] | sep[n - 2:n - 2 + m]
        else:
            inner = inner[:m]
        if n in cfg.ngrams:
            x = h * np.uint32(0x85EBCA6B)
            yield ((x ^ (x >> np.uint32(15))) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - cfg.buckets.bit_length() + 1), ~inner


def blocks(text: str, size: int) -> Iterator[np.ndarray]:
    """Code points of the normalised text, cut between words into blocks of about ``size``.

    A single word longer than a block is cut where the block ends.
    """
    norm = normalise(text)
    start = 0
    while start < len(norm):
        end = start + size
        if end < len(norm):
            cut = norm.rfind(" ", start + 1, end)
            end = cut + 1 if cut > start else end
        yield np.frombuffer(norm[start:end].encode("utf-32-le", "surrogatepass"), np.uint32)
        start = end - 1 if end < len(norm) and norm[end - 1] == " " else end


def window_bags(text: str, cfg: ToxicityConfig):
    """N-gram buckets of a text in the order of their windows, and where each window starts."""
    ids, starts, size = [], [], 0
    for codes in blocks(text, cfg.block):
        per_n, first = [], window_starts(codes, cfg.window)
        for rows, keep in ngram_rows(codes, cfg):
            per_n.append((np.searchsorted(first, np.flatnonzero(keep), "right") - 1, rows[keep]))
        if not per_n:
            continue
        win, rows = (np.concatenate(x) for x in zip(*per_n))
        order = np.argsort(win, kind="stable")
        win, rows = win[order], rows[order]
        begin = np.flatnonzero(np.diff(win, prepend=-1))
        ids.append(rows.astype(np.uint16 if cfg.buckets <= 1 << 16 else np.int32))
        starts.append(begin + size)
        size += len(rows)
    if not size:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(ids), np.concatenate(starts)


def window_starts(codes: np.ndarray, words: int) -> np.ndarray:
    """Places where each window of so many words begins (at the blank before its first word)."""
    return np.concatenate([[0], np.flatnonzero(codes[:-1] == 32)[words::words]]) if len(codes) else np.zeros(0, np.int64)


@dataclass
class ToxicityModel:
    """One logit per n-gram row and an intercept; ``constant`` when nothing was learned."""

    cfg: ToxicityConfig
    logits: np.ndarray | None = None
    bias: float = 0.0
    constant: float | None = None

    def window_logits(self, codes: np.ndarray) -> np.ndarray:
        first = window_starts(codes, self.cfg.window)
        total, count = np.zeros(len(first)), np.zeros(len(first))
        for rows, keep in ngram_rows(codes, self.cfg):
            n = int(np.searchsorted(first, len(rows)))
            total[:n] += np.add.reduceat(np.where(keep, self.logits[rows], 0.0), first[:n])
            count[:n] += np.add.reduceat(keep.astype(np.int64), first[:n])
        return total / np.maximum(count, 1)

    def score(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        z = np.zeros(len(texts))
        for i, text in enumerate(texts):
            best = [self.window_logits(codes).max() for codes in blocks(text, self.cfg.block) if len(codes) > 2]
            z[i] = max(best, default=self.empty)
        return 1 / (1 + np.exp(-np.clip(z + self.bias, -50, 50)))

    @property
    def empty(self) -> float:
        """The logit of a text without a word: low, there is nothing toxic in it."""
        return -10.0


def fit(texts: list[str], y: np.ndarray, share: float | None, cfg: ToxicityConfig = DEFAULT) -> ToxicityModel:
    """Joint training of the n-gram vectors and the softmax on a bounded sample.

    Each step scores every window of a batch of documents and moves the vectors of
    each document's highest window.  Without both classes the model scores every
    text alike: 1 or 0 for the only class, ``cfg.prior`` without rows.
    """
    if len(texts) == 0:
        return ToxicityModel(cfg, constant=cfg.prior)
    if y.min() == y.max():
        return ToxicityModel(cfg, constant=float(y[0]))
    rng = np.random.default_rng(cfg.seed)
    bags = [window_bags(t, cfg) for t in texts]
    known = [i for i, b in enumerate(bags) if len(b[0])]
    p = {
        "E": rng.normal(0, 0.3, (cfg.buckets, cfg.dim)).astype(np.float32),
        "W": rng.normal(0, 1.0, (cfg.dim, 2)).astype(np.float32),
        "b": np.zeros(2, np.float32),
    }
    m, v = np.zeros_like(p["E"]), np.zeros_like(p["E"])
    small: dict = {}
    real = min(max(share if share is not None else y.mean(), 1e-6), 1 - 1e-6)
    pos = y[known].mean()
    weight = np.where(y == 1, real / pos, (1 - real) / (1 - pos)).astype(np.float32)
    step = 0
    for epoch in range(cfg.epochs):
        lr = cfg.lr * (1 - 0.9 * epoch / cfg.epochs)
        order = rng.permutation(known)
        for at in range(0, len(order), cfg.batch):
            step += 1
            idx = order[at:at + cfg.batch]
            logit = p["E"] @ (p["W"][:, 1] - p["W"][:, 0])
            top = []
            for i in idx:
                ids, starts = bags[i]
                ends = np.append(starts[1:], len(ids))
                mean = np.add.reduceat(logit[ids], starts) / (ends - starts)
                w = int(mean.argmax())
                top.append(ids[starts[w]:ends[w]])
            lens = np.array([len(t) for t in top])
            used, inv = np.unique(np.concatenate(top), return_inverse=True)
            dense = np.zeros((len(idx), len(used)), np.float32)
            np.add.at(dense, (np.repeat(np.arange(len(idx)), lens), inv), np.repeat(cfg.scale / lens, lens))
            x = dense @ p["E"][used]
            z = x @ p["W"] + p["b"]
            z -= z.max(1, keepdims=True)
            prob = np.exp(z)
            prob /= prob.sum(1, keepdims=True)
            prob[np.arange(len(idx)), y[idx].astype(int)] -= 1
            prob *= weight[idx, None] / len(idx)
            gE = dense.T @ (prob @ p["W"].T) + cfg.l2 * p["E"][used]
            common.adam(p, {"W": x.T @ prob + cfg.l2 * p["W"], "b": prob.sum(0)}, small, lr, step)
            # Adam on the rows that occur in the batch
            m[used] = 0.9 * m[used] + 0.1 * gE
            v[used] = 0.999 * v[used] + 0.001 * gE * gE
            p["E"][used] -= lr * (m[used] / (1 - 0.9**step)) / (np.sqrt(v[used] / (1 - 0.999**step)) + 1e-8)
    w = p["W"][:, 1] - p["W"][:, 0]
    return ToxicityModel(cfg, (p["E"] @ w * cfg.scale).astype(np.float64), float(p["b"][1] - p["b"][0]))


def train(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig = DEFAULT) -> ToxicityModel:
    """Fit on the labelled documents that are not held out (a bounded sample, see the settings)."""
    model = fit(*common.labelled_sample(docs, labels, "toxic", cfg.per_class, cfg.max_chars), cfg)
    common.give_back()  # of the driver: texts and features of the sample
    return model


def score(text: Column, model: ToxicityModel) -> Column:
    """Toxicity of a text column, 0 to 1.

    Null and empty texts, and texts without a letter or digit, score near 0.
    """
    shared = {"model": model}

    @F.arrow_udf("double")
    def toxicity(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in common.portions(it):
            yield pa.array(shared["model"].score(common.texts_of(a)))

    return toxicity(text)
