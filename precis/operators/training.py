"""Training of the importance network over blocks of rows.

The task, the start weights and the optimiser are those of Spark ML's
``MultilayerPerceptronClassifier``: sigmoid hidden layers, softmax output, the mean over
blocks of 128 rows of the blocks' mean cross-entropy, L-BFGS of 10 corrections with a strong
Wolfe line search (Breeze).  One evaluation of loss and gradient is one Spark job, and an
epoch needs about 17 of them; here a job passes thousands of rows through a layer at once,
in matrix products over blocks that are kept in memory, and returns one gradient for each of
a few tasks.  The driver holds weights and gradients only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame

STACK = 128  # rows of a block, over which losses are averaged first (Spark's block size)
PACK = 64 * STACK  # rows that are stored as one value
CHUNK = 16 * STACK  # rows that pass the layers together
MOST_TASKS = 256  # of an evaluation: so many gradients reach the driver
CORRECTIONS = 10


def _pack(x: np.ndarray, weight: np.ndarray) -> bytes:
    return np.vstack([x, weight[None]]).tobytes()


def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(is_val, stacks, body): the rows (features, label, is_val) of a task in large values, in their order.

    A body holds the features, the label and the row's share of the mean: one part of its
    stack of ``STACK`` training rows (the last one of a task may be smaller), or 1 for a
    row to validate.
    """
    held: dict[bool, list[np.ndarray]] = {False: [], True: []}

    def value(is_val: bool, x: np.ndarray) -> pa.RecordBatch:
        n = x.shape[1]
        stacks = -(-n // STACK)
        share = np.ones(n) if is_val else np.full(n, 1.0 / STACK)
        if not is_val and n % STACK:
            share[n - n % STACK:] = 1.0 / (n % STACK)
        return pa.RecordBatch.from_arrays(
            [pa.array([is_val]), pa.array([stacks], pa.int64()), pa.array([_pack(x, share)], pa.binary())], ["is_val", "stacks", "body"])

    for b in batches:
        if any(b.column(i).null_count for i in range(b.num_columns - 1)):
            raise ValueError("a feature or label of a training row is null")
        x = np.array([b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns - 1)], np.float64).reshape(b.num_columns - 1, -1)
        if np.isnan(x).any() or not np.isin(x[-1], (0.0, 1.0)).all():
            raise ValueError("a feature of a training row is no number, or its label neither 0 nor 1")
        side = b.column(b.num_columns - 1).fill_null(False).to_numpy(zero_copy_only=False)
        for is_val in (False, True):
            rows = np.concatenate([*held[is_val], x[:, side == is_val]], axis=1)
            whole = rows.shape[1] - rows.shape[1] % PACK
            for a in range(0, whole, PACK):
                yield value(is_val, rows[:, a:a + PACK])
            held[is_val] = [rows[:, whole:]]
    for is_val, rest in held.items():
        if rest and rest[0].shape[1]:
            yield value(is_val, rest[0])


def _layers(w: np.ndarray, sizes: list[int]):
    at, out = 0, []
    for n_in, n_out in zip(sizes, sizes[1:]):
        out.append((w[at:at + n_in * n_out].reshape(n_in, n_out).T, w[at + n_in * n_out:at + n_in * n_out + n_out]))  # column by column
        at += n_in * n_out + n_out
    return out


def _forward(x: np.ndarray, layers) -> tuple[list[np.ndarray], np.ndarray]:
    """(inputs of every layer, logarithms of the classes' probabilities) of columns ``x``."""
    inputs = [x]
    for i, (weights, bias) in enumerate(layers):
        z = weights @ inputs[-1]
        z += bias[:, None]
        if i < len(layers) - 1:
            np.negative(z, out=z)
            with np.errstate(over="ignore"):
                np.exp(z, out=z)
            z += 1.0
            np.reciprocal(z, out=z)
            inputs.append(z)
    z -= z.max(axis=0)
    return inputs, z - np.log(np.exp(z).sum(axis=0))


def _chunks(body: bytes, features: int):
    x = np.frombuffer(body, np.float64).reshape(features + 2, -1)
    for a in range(0, x.shape[1], CHUNK):
        c = x[:, a:a + CHUNK]
        yield np.ascontiguousarray(c[:features]), c[features], c[features + 1]


def loss_and_gradient(bodies: Iterator[bytes], w: np.ndarray, sizes: list[int]) -> tuple[float, np.ndarray]:
    """Sums over the rows, each with its share."""
    layers, loss = _layers(w, sizes), 0.0
    sums = [(np.zeros(a.shape), np.zeros(b.shape)) for a, b in layers]
    for body in bodies:
        for x, y, share in _chunks(body, sizes[0]):
            inputs, logs = _forward(x, layers)
            of = np.vstack([1.0 - y, y])
            loss -= float(((of * logs).sum(axis=0) * share).sum())
            delta = (np.exp(logs) - of) * share
            for i in range(len(layers) - 1, -1, -1):
                sums[i][0][...] += delta @ inputs[i].T
                sums[i][1][...] += delta.sum(axis=1)
                if i:
                    delta = layers[i][0].T @ delta
                    delta *= inputs[i]
                    np.subtract(1.0, inputs[i], out=inputs[i])
                    delta *= inputs[i]
    return loss, np.concatenate([p for a, b in sums for p in (a.T.ravel(), b)])


def validation_loss(bodies: Iterator[bytes], w: np.ndarray, sizes: list[int], eps: float = 1e-15) -> tuple[float, int]:
    """(sum of -log of the label's probability, kept within eps and 1 - eps; rows)."""
    layers, loss, rows = _layers(w, sizes), 0.0, 0
    for body in bodies:
        for x, y, _ in _chunks(body, sizes[0]):
            logs = _forward(x, layers)[1]
            own = np.where(y == 1.0, logs[1], logs[0])
            loss -= float(np.clip(own, np.log(eps), np.log1p(-eps)).sum())
            rows += len(y)
    return loss, rows


class Blocks:
    """The rows of a training set, kept in blocks where the executors are."""

    def __init__(self, rows: DataFrame, features: list[str]):
        """``rows``: features, label, is_val."""
        src = rows.select(*features, "label", "is_val")
        packed = src.mapInArrow(pack_rows, "is_val boolean, stacks long, body binary")
        self.kept = packed.rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)
        sizes = self.kept.map(lambda r: (r[0], r[1], len(r[2]))).collect()  # three numbers for each 8,192 rows
        self.stacks = sum(n for is_val, n, _ in sizes if not is_val)
        self.validated = any(is_val for is_val, _, _ in sizes)
        sc = rows.sparkSession.sparkContext
        tasks = min(self.kept.getNumPartitions(), MOST_TASKS, max(1, sc.defaultParallelism))
        self.dealt = self.kept.coalesce(tasks)

    def sums(self, part: Callable, w: np.ndarray, sizes: list[int], is_val: bool) -> list:
        """``part`` of each task's blocks, in the order of the tasks."""
        w = np.asarray(w, np.float64)

        def run(it):
            yield part((r[2] for r in it if r[0] == is_val), w, sizes)

        return self.dealt.mapPartitions(run).collect()

    def objective(self, w: np.ndarray, sizes: list[int]) -> tuple[float, np.ndarray]:
        loss, gradient = 0.0, np.zeros(len(w))
        for a, g in self.sums(loss_and_gradient, w, sizes, False):
            loss += a
            gradient += g
        n = self.stacks or float("nan")
        return loss / n, gradient / n

    def close(self) -> None:
        self.kept.unpersist()


class SearchFailed(Exception):
    """A step of the search is impossible from where it is."""


def _between(left, right) -> float:
    """Minimum of the cubic through two points (t, value, slope), away from both ends."""
    (lt, lv, ld), (rt, rv, rd) = left, right
    d1 = ld + rd - 3 * (lv - rv) / (lt - rt)
    with np.errstate(invalid="ignore", divide="ignore"):
        d2 = np.sqrt(np.float64(d1 * d1 - ld * rd))
        t = rt - (rt - lt) * (rd + d2 - d1) / (rd - ld + 2 * d2)
    low, high = lt + 0.1 * (rt - lt), lt + 0.9 * (rt - lt)
    return float(low if t < low else high if t > high else t)


def strong_wolfe(phi: Callable[[float], tuple[float, float, float]], t: float, c1: float = 1e-4, c2: float = 0.9) -> float:
    """A step that meets the strong Wolfe conditions; ``phi``: (t, value, slope) at a step."""
    low = phi(0.0)
    value, slope = low[1], low[2]
    if slope > 0:
        raise SearchFailed("no descent")

    def zoom(low, high):
        for _ in range(10):
            c = phi(_between(high, low) if low[0] > high[0] else _between(low, high))
            if c[1] > value + c1 * c[0] * slope or c[1] >= low[1]:
                high = c
            else:
                if abs(c[2]) <= c2 * abs(slope):
                    return c[0]
                if c[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        raise SearchFailed("no step between two bounds")

    for i in range(10):
        c = phi(t)
        if not np.isfinite(c[1]):
            t /= 2.0
            continue
        if c[1] > value + c1 * t * slope or c[1] >= low[1] and i > 0:
            return zoom(low, c)
        if abs(c[2]) <= c2 * abs(slope):
            return c[0]
        if c[2] >= 0:
            return zoom(c, low)
        low = c
        t *= 1.5
    raise SearchFailed("no step")


def _direction(gradient: np.ndarray, steps: list[np.ndarray], changes: list[np.ndarray]) -> np.ndarray:
    """Minus the approximate inverse Hessian times the gradient; the newest correction comes first."""
    scale = 1.0
    if steps:
        sy = float(steps[0] @ changes[0])
        if not sy >= 0:
            raise SearchFailed("a correction of negative curvature")
        with np.errstate(invalid="ignore", divide="ignore"):
            scale = np.float64(sy) / float(changes[0] @ changes[0])
    out, parts = gradient.copy(), []
    for s, y in zip(steps, changes):
        with np.errstate(invalid="ignore", divide="ignore"):
            a = np.float64(s @ out) / float(s @ y)
        if np.isnan(a):
            raise SearchFailed("an empty correction")
        parts.append(a)
        out -= a * y
    out *= scale
    for s, y, a in reversed(list(zip(steps, changes, parts))):
        out += (a - float(y @ out) / float(s @ y)) * s
    return -out


def minimised(objective: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, max_iter: int, tol: float) -> np.ndarray:
    """L-BFGS from ``x``: at most ``max_iter`` steps."""
    last: list = [None, 0.0, None]

    def at(p: np.ndarray):
        if last[0] is None or not np.array_equal(p, last[0]):
            last[:] = [p, *objective(p)]
        return last[1], last[2]

    steps, changes, failed, it = [], [], False, 0
    x = np.asarray(x, np.float64)
    value, gradient = at(x)
    while it < max_iter and not np.linalg.norm(gradient) <= max(tol * value, 1e-8):
        try:
            way = _direction(gradient, steps, changes)

            def phi(t: float, x=x, way=way):
                v, g = at(x + way * t)
                return t, v, float(g @ way)

            t = strong_wolfe(phi, 1.0 / float(np.linalg.norm(way)) if it == 0 else 1.0)
            if t * float(np.linalg.norm(gradient)) < 1e-10:
                raise SearchFailed("the step is too small")
        except SearchFailed:
            if failed:
                break  # from the gradient alone, too
            failed, steps, changes = True, [], []
            continue
        new = x + way * t
        new_value, new_gradient = at(new)
        steps, changes = [new - x, *steps][:CORRECTIONS], [new_gradient - gradient, *changes][:CORRECTIONS]
        x, value, gradient, it, failed = new, new_value, new_gradient, it + 1, False
    return x


@dataclass
class Fitted:
    """Weights after an epoch, as Spark orders them."""

    weights: np.ndarray
    sizes: list[int]

    def losses(self, blocks: Blocks) -> list[tuple[float, int]]:
        return blocks.sums(validation_loss, self.weights, self.sizes, True)
