"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of fixed length that cover the whole text.  Every
passage is described by counts (character classes, hashed character trigrams,
repetition) and encoded by a small layer; gated attention weighs the encoded
passages, and a logistic unit scores the weighted sum.  Encoder, attention and
score are trained together by Adam in numpy, from document labels alone.

Training uses a bounded sample; scoring is a row-local Arrow UDF without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precis.llm import common


@dataclass(frozen=True)
class QualityConfig:
    passage: int = 512  # characters
    trigrams: int = 256  # hash buckets
    hidden: int = 24
    attention: int = 12
    per_class: int = 2000  # training documents of each class, at most
    max_chars: int = 20_000  # longest training document
    epochs: int = 25
    batch: int = 64
    lr: float = 0.004
    l2: float = 1e-5
    seed: int = 11
    prior: float = 1.0  # score of every text when there is nothing to learn from
    block: int = 1 << 17  # characters that are worked on at once


DEFAULT = QualityConfig()

# Character classes whose rates describe a passage.
_GROUPS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",;:", "!", "?",
           "|", "%", "$", "#", "&", "*", "@", "\"'`", "()[]{}", "<>", "/\\", "-_", "=+~^")
_CLASSES = len(_GROUPS) + 2  # other ASCII, beyond ASCII
_CLASS = np.full(128, len(_GROUPS), np.uint8)
for _k, _g in enumerate(_GROUPS):
    _CLASS[[ord(c) for c in _g]] = _k


def n_features(cfg: QualityConfig) -> int:
    return _CLASSES + cfg.trigrams + 3


def passage_features(codes: np.ndarray, cfg: QualityConfig) -> np.ndarray:
    """One row of features for every passage of a text given as code points (at least one row)."""
    n = len(codes)
    rows = max(1, -(-n // cfg.passage))
    out = np.zeros((rows, n_features(cfg)), np.float32)
    if n == 0:
        return out
    at = np.arange(n, dtype=np.int64) // cfg.passage
    size = np.bincount(at, minlength=rows)[:, None]
    cls = np.where(codes < 128, _CLASS[np.minimum(codes, 127)], _CLASSES - 1).astype(np.int64)
    out[:, :_CLASSES] = np.sqrt(np.bincount(at * _CLASSES + cls, minlength=rows * _CLASSES).reshape(rows, -1) / size)
    if n > 2:
        x = (codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1]) * np.uint32(0x85EBCA6B) + codes[2:]
        x = ((x ^ (x >> np.uint32(15))) * np.uint32(0xC2B2AE35)) >> np.uint32(8)
        hist = np.bincount(at[2:] * cfg.trigrams + (x % np.uint32(cfg.trigrams)), minlength=rows * cfg.trigrams)
        hist = hist.reshape(rows, -1)
        out[:, _CLASSES:_CLASSES + cfg.trigrams] = np.sqrt(hist / size)
        # repetition: buckets in use, and the share of the most frequent one
        out[:, -3] = (hist > 0).sum(1) / np.minimum(size[:, 0], cfg.trigrams)
        out[:, -2] = hist.max(1) / size[:, 0]
    out[:, -1] = np.log1p(size[:, 0]) / 10
    return out


def features(text: str, cfg: QualityConfig) -> np.ndarray:
    """Passage features of a whole text; long texts are worked on block by block."""
    step = cfg.block - cfg.block % cfg.passage
    if len(text) <= step:
        return passage_features(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), cfg)
    return np.concatenate([features(text[i:i + step], cfg) for i in range(0, len(text), step)])


def _forward(p: dict, X: np.ndarray, starts: np.ndarray, lens: np.ndarray):
    H = np.tanh((X - p["mu"]) / p["sd"] @ p["W"] + p["b"])
    t, g = np.tanh(H @ p["V"]), 1 / (1 + np.exp(-np.clip(H @ p["U"], -30, 30)))
    s = (t * g) @ p["w"]
    s = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), lens))
    a = s / np.repeat(np.add.reduceat(s, starts), lens)
    z = np.add.reduceat(a[:, None] * H, starts)
    return H, t, g, a, z, z @ p["c"] + p["c0"]


@dataclass
class QualityModel:
    """Weights of the encoder, the gated attention and the score; ``constant`` when nothing was learned."""

    cfg: QualityConfig
    params: dict | None = None
    constant: float | None = None

    def score(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts))
        if self.constant is not None:
            return out + self.constant
        for a, b in common.slices(len(texts), [len(t) for t in texts], self.cfg.block):
            bags = [features(t, self.cfg) for t in texts[a:b]]
            lens = np.array([len(x) for x in bags])
            logit = _forward(self.params, np.concatenate(bags), np.cumsum(lens) - lens, lens)[-1]
            out[a:b] = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
        return out

    def attention(self, text: str) -> np.ndarray:
        """The weight of every passage of a text."""
        x = features(text, self.cfg)
        if self.constant is not None:
            return np.full(len(x), 1 / len(x))
        return _forward(self.params, x, np.zeros(1, np.int64), np.array([len(x)]))[3]


def fit(texts: list[str], y: np.ndarray, share: float | None, cfg: QualityConfig = DEFAULT) -> QualityModel:
    """Train encoder, attention and score on a bounded sample of labelled documents.

    ``share``: label 1's share among all training labels; the sample's classes are
    weighted back to it.  Without both classes the model scores every text alike:
    1 or 0 for the only class, ``cfg.prior`` without rows.
    """
    if len(texts) == 0:
        return QualityModel(cfg, constant=cfg.prior)
    if y.min() == y.max():
        return QualityModel(cfg, constant=float(y[0]))
    rng = np.random.default_rng(cfg.seed)
    bags = [features(t, cfg) for t in texts]
    X = np.concatenate(bags)
    n, d, k = n_features(cfg), cfg.hidden, cfg.attention
    f32 = np.float32
    p = {
        "mu": X.mean(0), "sd": X.std(0) + 0.02,
        "W": rng.normal(0, n**-0.5, (n, d)).astype(f32), "b": np.zeros(d, f32),
        "V": rng.normal(0, d**-0.5, (d, k)).astype(f32), "U": rng.normal(0, d**-0.5, (d, k)).astype(f32),
        "w": rng.normal(0, k**-0.5, k).astype(f32), "c": rng.normal(0, d**-0.5, d).astype(f32), "c0": np.zeros(1, f32),
    }
    real = min(max(share if share is not None else y.mean(), 1e-6), 1 - 1e-6)
    weight = np.where(y == 1, real / y.mean(), (1 - real) / (1 - y.mean()))
    state: dict = {}
    step = 0
    for epoch in range(cfg.epochs):
        lr = cfg.lr * (1 - 0.9 * epoch / cfg.epochs)
        order = rng.permutation(len(bags))
        for at in range(0, len(order), cfg.batch):
            step += 1
            idx = order[at:at + cfg.batch]
            x = np.concatenate([bags[i] for i in idx])
            lens = np.array([len(bags[i]) for i in idx])
            starts = np.cumsum(lens) - lens
            H, t, g, a, z, logit = _forward(p, x, starts, lens)
            dl = ((1 / (1 + np.exp(-np.clip(logit, -50, 50))) - y[idx]) * weight[idx] / len(idx)).astype(f32)
            dz = np.repeat(dl[:, None] * p["c"], lens, 0)
            da = (H * dz).sum(1)
            ds = a * (da - np.repeat(np.add.reduceat(a * da, starts), lens))
            dtg = ds[:, None] * p["w"]
            dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
            dpre = (a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - H * H)
            common.adam(p, {
                "W": ((x - p["mu"]) / p["sd"]).T @ dpre + cfg.l2 * p["W"], "b": dpre.sum(0),
                "V": H.T @ dt + cfg.l2 * p["V"], "U": H.T @ dg + cfg.l2 * p["U"],
                "w": (t * g).T @ ds, "c": z.T @ dl + cfg.l2 * p["c"], "c0": dl.sum(keepdims=True),
            }, state, lr, step)
    return QualityModel(cfg, p)


def train(docs: DataFrame, labels: DataFrame, cfg: QualityConfig = DEFAULT) -> QualityModel:
    """Fit on the labelled documents that are not held out (a bounded sample, see the settings)."""
    model = fit(*common.labelled_sample(docs, labels, "quality", cfg.per_class, cfg.max_chars), cfg)
    common.give_back()  # of the driver: texts and features of the sample
    return model


def score(text: Column, model: QualityModel) -> Column:
    """Quality of a text column, 0 to 1.

    A null text counts as empty; an empty text is one passage without characters
    and gets the score the model gives to that.
    """
    shared = {"model": model}

    @F.arrow_udf("double")
    def quality(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in common.portions(it):
            yield pa.array(shared["model"].score(common.texts_of(a)))

    return quality(text)
