"""Hard-negative mining with a GNAT-style multiway hyperplane tree.

A split point of the tree is a stored vector; every vector below a node goes to the
nearest of the node's split points, and each split point keeps the least and greatest
distance from it to the vectors of every sibling.  A search asks for the vectors whose
score lies in a window; with one more component that makes all vectors equally long
the scores become distances and the window an annulus around the anchor.  A sibling is
left out when, for any split point, its range and the annulus shifted by the anchor's
distance from that point do not meet.  Leaves are scored exactly.

The tree's first level is a Spark table: rows go to the cell of their nearest root
point, the ranges between root points and cells are minima and maxima over all rows,
and an anchor is sent only to the cells that its window reaches.  A cell is cut evenly
into shards of a bounded size; each shard's lower tree is built once and stored, and
windows stream past it, for the positives first and then for the negatives.  The bar
of each search, its k-th best score so far, starts from a bounded sample of the rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from precis.llm import vectors
from precis.llm.topk import quantise
from precis.session import checkpoint_dir


@dataclass(frozen=True)
class MiningConfig:
    every: int = 100  # anchors: ids divisible by it
    positives: int = 5
    negatives: int = 5
    low: int = 80  # a negative's score is at least this many hundredths of its positive's
    high: int = 100  # and at most this many
    shard_rows: int = 8_192
    root_points: int = 256  # split points of the first level, at most
    sample: int = 2_048  # rows that give root points and first bars
    split: int = 8  # split points of a node
    leaf_rows: int = 256
    block_windows: int = 4_096  # windows that pass a tree at once


DEFAULT = MiningConfig()
SLACK = 1e-7  # of the radius: rounding of distances, which never decides a result


def _distance(A: np.ndarray, B: np.ndarray, radius: float) -> np.ndarray:
    """Distances between vectors that one more component makes ``radius`` long (anchors: has none, so they keep theirs)."""
    a = np.einsum("ij,ij->i", A, A)[:, None]
    return np.sqrt(np.maximum(0.0, a + radius**2 - 2.0 * (A @ B.T)))


def _between(A: np.ndarray, B: np.ndarray, radius: float) -> np.ndarray:
    """Distances between stored vectors, both with their additional component."""
    up = [np.sqrt(np.maximum(0.0, radius**2 - np.einsum("ij,ij->i", M, M))) for M in (A, B)]
    return np.sqrt(np.maximum(0.0, 2.0 * (radius**2 - A @ B.T - np.outer(*up))))


def _spread(X: np.ndarray, m: int, radius: float) -> np.ndarray:
    """Rows of up to ``m`` distinct vectors, each the farthest from those before it."""
    at = [0]
    near = _between(X, X[:1], radius)[:, 0]
    while len(at) < m:
        k = int(near.argmax())
        if near[k] <= SLACK * radius or (X[at] == X[k]).all(axis=1).any():
            break
        at.append(k)
        near = np.minimum(near, _between(X, X[k:k + 1], radius)[:, 0])
    return np.array(at)


def build(ids: np.ndarray, labels: np.ndarray, X: np.ndarray, radius: float, cfg: MiningConfig = DEFAULT) -> dict:
    """The tree of one shard: its rows in leaf order, and nodes (points, children, lo, hi) or (first, end)."""
    order = np.arange(len(X))
    nodes: list = []

    def grow(first: int, end: int) -> int:
        me = len(nodes)
        nodes.append((first, end))
        if end - first <= cfg.leaf_rows:
            order[first:end] = order[first:end][np.argsort(ids[order[first:end]], kind="stable")]
            return me
        rows = order[first:end]
        P = X[rows[_spread(X[rows], cfg.split, radius)]]
        if len(P) < 2:  # copies of one vector
            order[first:end] = rows[np.argsort(ids[rows], kind="stable")]
            return me
        D = _between(X[rows], P, radius)
        of = D.argmin(axis=1)
        by = np.argsort(of, kind="stable")
        order[first:end] = rows[by]
        cuts = np.searchsorted(of[by], np.arange(len(P) + 1))
        lo, hi = _ranges(D, of, len(P))
        children = [grow(first + cuts[j], first + cuts[j + 1]) if cuts[j] < cuts[j + 1] else -1 for j in range(len(P))]
        nodes[me] = (P, children, lo, hi)
        return me

    if len(X):
        grow(0, len(X))
    codes, names = _coded(labels[order])
    return {"nodes": nodes, "ids": ids[order], "labels": codes, "names": names, "X": X[order], "radius": radius}


def _coded(labels: list | np.ndarray):
    """Labels as numbers, and the number of each label."""
    names: dict = {}
    return np.array([names.setdefault(x, len(names)) for x in labels], np.int32), names


def _codes(labels, names: dict) -> np.ndarray:
    return np.array([names.get(x, -1) for x in labels], np.int32)


def _ranges(D: np.ndarray, of: np.ndarray, m: int):
    """lo, hi [point, child]: least and greatest distance from each point to each child's vectors (D: row, point)."""
    lo, hi = np.full((m, m), np.inf), np.full((m, m), -np.inf)
    for j in range(m):
        mine = D[of == j]
        if len(mine):
            lo[:, j], hi[:, j] = mine.min(axis=0), mine.max(axis=0)
    return lo, hi


def _meets(D: np.ndarray, lo: np.ndarray, hi: np.ndarray, inner: np.ndarray, outer: np.ndarray, slack) -> np.ndarray:
    """[anchor, child]: whether the annulus around the anchor can hold a vector of the child, by every point's range.

    ``D``: distance from anchor to point; ``lo``, ``hi``: [point, child].  A vector x of
    the child lies |D - d(point, x)| to D + d(point, x) from the anchor.
    """
    near = np.maximum(D[:, :, None] - hi, lo - D[:, :, None]).max(axis=1)
    far = (D[:, :, None] + hi).min(axis=1)
    return (near <= (outer + slack)[:, None]) & (far >= (inner - slack)[:, None])


def _annulus(norm2: np.ndarray, low: np.ndarray, high: np.ndarray, radius: float):
    """Radii between which vectors with a score in [low, high] lie, seen from an anchor of squared length norm2."""
    most = norm2 + radius**2
    return np.sqrt(np.maximum(0.0, most - 2.0 * high)), np.sqrt(np.maximum(0.0, most - 2.0 * low))


def search(tree: dict, anchors: np.ndarray, own: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray,
           same: bool, k: int, bar: np.ndarray):
    """(window, id, score) with every vector of the tree that can be among the ``k`` best of a window.

    A window asks for vectors of the anchor's label (``same``) or of others, not with the
    id ``own``, whose score is in [low, high]; ``bar`` is a lower bound of its k-th best.
    """
    X, ids, kinds, radius = tree["X"], tree["ids"], tree["labels"], tree["radius"]
    labels = _codes(labels, tree["names"])
    norm2 = np.einsum("ij,ij->i", anchors, anchors)
    slack = SLACK * (radius + np.sqrt(norm2)) + 1e-6
    bar = np.maximum(bar, low)
    top = np.full((len(anchors), k), -np.inf)
    got: list[tuple] = []

    def leaf(first: int, end: int, live: np.ndarray):
        for at in range(first, end, 1024):
            rows = slice(at, min(end, at + 1024))
            s = anchors[live] @ X[rows].T
            fits = (labels[live][:, None] == kinds[rows][None, :]) == same
            fits &= (own[live][:, None] != ids[rows][None, :]) & (s >= bar[live, None]) & (s <= high[live, None])
            some = fits.any(axis=1)
            if not some.any():
                continue
            at_live, s = live[some], np.where(fits[some], s[some], -np.inf)
            top[at_live] = -np.sort(-np.concatenate([top[at_live], s], axis=1), axis=1)[:, :k]
            bar[at_live] = np.maximum(bar[at_live], top[at_live, k - 1])
            # above the bar, and of those that equal it the k smallest ids of the leaf
            level = s == bar[at_live, None]
            q, x = np.nonzero((s > bar[at_live, None]) | level & (np.cumsum(level, axis=1) <= k))
            got.append((at_live[q], ids[rows][x], s[q, x]))

    def visit(node: int, live: np.ndarray):
        n = tree["nodes"][node]
        if len(n) == 2:
            leaf(*n, live)
            return
        P, children, lo, hi = n
        D = _distance(anchors[live], P, radius)
        for j in np.argsort(D.mean(axis=0)):
            if children[j] < 0:
                continue
            inner, outer = _annulus(norm2[live], bar[live], high[live], radius)
            meets = _meets(D, lo[:, j:j + 1], hi[:, j:j + 1], inner, outer, slack[live])[:, 0]
            if meets.any():
                visit(children[j], live[meets])

    if len(anchors) and tree["nodes"]:
        visit(0, np.flatnonzero(low <= high))
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    q, x, s = (np.concatenate(p) for p in zip(*got))
    o = np.lexsort((x, -s, q))
    o = o[np.arange(len(o)) - np.searchsorted(q[o], q[o]) < k]
    return q[o], x[o], s[o]


class _Index:
    """The stored index of one dimension's vectors: root points, cell ranges, shards of every cell, a sample."""

    def __init__(self, dim, radius, points, lo, hi, parts, ids, labels, X):
        self.dim, self.radius, self.points, self.lo, self.hi, self.parts = dim, radius, points, lo, hi, parts
        self.ids, self.X = ids, X
        self.labels, self.names = _coded(labels)

    def first_bar(self, A, own, labels, low, high, same, k) -> np.ndarray:
        s = A @ self.X.T
        fits = (_codes(labels, self.names)[:, None] == self.labels[None, :]) == same
        fits &= (own[:, None] != self.ids[None, :]) & (s <= high[:, None]) & (s >= low[:, None])
        s = np.where(fits, s, -np.inf)
        if s.shape[1] < k:
            return np.full(len(A), -np.inf)
        return np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]

    def route(self, A, low, high, bar) -> list[list[int]]:
        """The shards that each window goes to."""
        norm2 = np.einsum("ij,ij->i", A, A)
        D = _distance(A, self.points, self.radius)
        out = np.zeros((len(A), len(self.points)), bool)
        inner, outer = _annulus(norm2, np.maximum(low, bar), high, self.radius)
        slack = SLACK * (self.radius + np.sqrt(norm2)) + 1e-6
        for j in range(len(self.points)):  # a cell at a time: [window, point, cell] would be large
            out[:, j] = _meets(D, self.lo[:, j:j + 1], self.hi[:, j:j + 1], inner, outer, slack)[:, 0]
        return [[j * MAX_PARTS + p for j in np.flatnonzero(r) for p in range(self.parts[j])] for r in out]


MAX_PARTS = 1 << 20


def _cells(rows: DataFrame, of_dim: dict[int, tuple]) -> DataFrame:
    """Rows with the cell of their nearest root point."""
    @F.pandas_udf("int")
    def place(v: pd.Series) -> pd.Series:
        cell, sizes = np.zeros(len(v), np.int32), v.str.len().to_numpy()
        for dim in np.unique(sizes):
            radius, points = of_dim[int(dim)]
            at = np.flatnonzero(sizes == dim)
            cell[at] = _between(np.stack(v.iloc[at].to_numpy()), points, radius).argmin(axis=1)
        return pd.Series(cell)

    return rows.withColumn("cell", place("v"))


def _cell_ranges(placed: DataFrame, of_dim: dict[int, tuple]) -> DataFrame:
    """dim, point, cell, lo, hi over all rows: every task folds its rows before the shuffle."""
    def fold(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in it:
            t = pa.Table.from_batches([batch])
            sizes = t.column("dim").to_numpy()
            for dim in np.unique(sizes):
                radius, points = of_dim[int(dim)]
                for part in _pieces(t.filter(pa.array(sizes == dim)), 2048):
                    now = _ranges(_between(vectors.matrix(part, "v"), points, radius), part.column("cell").to_numpy(), len(points))
                    lo, hi = found.get(dim, now)
                    found[dim] = np.minimum(lo, now[0]), np.maximum(hi, now[1])
        for dim, (lo, hi) in found.items():
            i, j = np.nonzero(lo <= hi)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), dim, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                 pa.array(lo[i, j]), pa.array(hi[i, j])], ["dim", "point", "cell", "lo", "hi"])

    parts = placed.select("dim", "cell", "v").mapInArrow(fold, "dim int, point int, cell int, lo double, hi double")
    return parts.groupBy("dim", "point", "cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _index(rows: DataFrame, cfg: MiningConfig):
    """(index of each dimension, stored rows' trees: dim, shard, tree)."""
    dims = rows.groupBy("dim").agg(
        F.count("*").alias("n"), F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("radius")).collect()
    of_dim, samples = {}, {}
    for r in dims:  # one entry for each dimension that occurs
        dim = r["dim"]
        s = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(cfg.sample).select("vec_id", "label", "v").collect()
        X, radius = np.array([x["v"] for x in s]), max(float(r["radius"]), 1.0)
        cells = min(cfg.root_points, max(1, -(-r["n"] // cfg.shard_rows)))
        of_dim[dim] = (radius, X[_spread(X, cells, radius)])
        samples[dim] = (np.array([x["vec_id"] for x in s]), np.array([x["label"] for x in s], object), X)
    placed = _cells(rows, of_dim).checkpoint()
    ranges = _cell_ranges(placed, of_dim).collect()  # at most root_points ** 2 rows for each dimension
    sizes = {(r["dim"], r["cell"]): r["count"] for r in placed.groupBy("dim", "cell").count().collect()}
    found = {}
    for dim, (radius, points) in of_dim.items():
        m = len(points)
        lo, hi = np.full((m, m), np.inf), np.full((m, m), -np.inf)
        for r in ranges:
            if r["dim"] == dim:
                lo[r["point"], r["cell"]], hi[r["point"], r["cell"]] = r["lo"], r["hi"]
        parts = [-(-sizes.get((dim, j), 0) // cfg.shard_rows) for j in range(m)]
        found[dim] = _Index(dim, radius, points, lo, hi, parts, *samples[dim])
    return found, placed, sizes


def _trees(placed: DataFrame, sizes: dict, index: dict, cfg: MiningConfig) -> DataFrame:
    """One row for each shard with its stored tree."""
    table = placed.sparkSession.createDataFrame(
        [(d, c, -(-n // cfg.shard_rows)) for (d, c), n in sizes.items()], "dim int, cell int, parts int")
    # copies of a vector, however many, are dealt evenly over the shards of their cell
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("parts"))  # stored rows: the same in every attempt
    rows = placed.join(F.broadcast(table), ["dim", "cell"]).select(
        "vec_id", "label", "v", "dim", (F.col("cell").cast("long") * MAX_PARTS + salt).alias("shard"))
    radius = {d: i.radius for d, i in index.items()}

    def grow(t: pa.Table) -> pa.Table:
        dim = t.column("dim")[0].as_py()
        tree = build(t.column("vec_id").to_numpy(), _labels(t.column("label")), vectors.matrix(t, "v"), radius[dim], cfg)
        return pa.table({
            "dim": pa.array([dim], pa.int32()), "shard": pa.array([t.column("shard")[0].as_py()], pa.int64()),
            "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    return rows.groupBy("dim", "shard").applyInArrow(grow, "dim int, shard long, tree binary").checkpoint()


def _labels(column) -> np.ndarray:
    out = np.empty(len(column), object)
    out[:] = column.to_pylist()
    return out


WINDOW = "anchor long, place int, dim int, v array<double>, label {kind}, low double, high double, bar double"


def _search(windows: DataFrame, trees: DataFrame, index: dict, same: bool, k: int, cfg: MiningConfig) -> DataFrame:
    """anchor, place, vec_id, score: each shard's ``k`` best for the windows (anchor, place, dim, v, label, low, high)."""
    kind = dict(windows.dtypes)["label"]

    def prepare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            t = pa.Table.from_batches([batch])
            sizes = t.column("dim").to_numpy()
            for dim in np.unique(sizes):
                for part in _pieces(t.filter(pa.array(sizes == dim)), 512):
                    A, own, labels, low, high, _ = _columns(part)
                    i = index[int(dim)]
                    bar = i.first_bar(A, own, labels, low, high, same, k)
                    shards = i.route(A, low, high, bar)
                    part = part.append_column("bar", pa.array(bar)).append_column("shard", pa.array(shards, pa.list_(pa.int64())))
                    yield from part.to_batches()

    cols = ["anchor", "place", "dim", "v", "label", "low", "high"]
    routed = windows.select(*cols).mapInArrow(prepare, WINDOW.format(kind=kind) + ", shard array<long>")
    routed = routed.withColumn("shard", F.explode("shard"))
    both = trees.select("dim", "shard", "tree").unionByName(routed, allowMissingColumns=True)
    shards = sum(sum(i.parts) for i in index.values())

    def stream(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree = None, None
        for batch in it:
            t = pa.Table.from_batches([batch])
            keys = list(zip(t.column("dim").to_pylist(), t.column("shard").to_pylist()))
            first = 0
            while first < len(keys):
                end = first
                while end < len(keys) and keys[end] == keys[first]:
                    end += 1
                part = t.slice(first, end - first)
                if keys[first] != at:  # a shard's first row is its tree
                    at, tree = keys[first], pickle.loads(part.column("tree")[0].as_py())
                    part = part.slice(1)
                first = end
                for p in _pieces(part, cfg.block_windows):
                    A, own, labels, low, high, bar = _columns(p)
                    q, x, s = search(tree, A, own, labels, low, high, same, k, bar)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(own[q], pa.int64()), pa.array(p.column("place").to_numpy()[q], pa.int32()),
                        pa.array(x, pa.int64()), pa.array(np.rint(s).astype(np.int64))], ["anchor", "place", "vec_id", "score"])

    # about one shard a task: twice as many tasks where shards are few
    dealt = both.repartition(max(1, shards if shards > 1000 else 2 * shards), "dim", "shard").sortWithinPartitions("dim", "shard", F.col("tree").isNull(), "anchor", "place")
    return dealt.mapInArrow(stream, "anchor long, place int, vec_id long, score long")


def _pieces(t: pa.Table, rows: int) -> Iterator[pa.Table]:
    for i in range(0, t.num_rows, rows):
        yield t.slice(i, rows)


def _columns(t: pa.Table):
    bar = t.column("bar").to_numpy() if "bar" in t.column_names else None
    return (vectors.matrix(t, "v"), t.column("anchor").to_numpy(), _labels(t.column("label")),
            t.column("low").to_numpy(), t.column("high").to_numpy(), None if bar is None else bar.copy())


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
         cfg: MiningConfig = DEFAULT) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are integer inner products of floor(256 x).  Anchors are the rows whose id is
    divisible by ``every``; an anchor's positives are its best rows of its own label, and
    for each positive the best rows of other labels with low * positive <= 100 * score
    <= high * positive follow (all, if fewer than asked for); ties go to the smaller id.
    A positive with a negative score has an empty window.

    Rows with a null id, label or vector, an empty vector, or a null or non-finite
    component take no part; zero vectors do.  Rows with the anchor's id are its own.  A
    repeated anchor asks once, with its smallest (vector, label); repeated rows are
    separate positives and negatives.  Vectors only meet those of their dimension.
    """
    checkpoint_dir(df.sparkSession)
    rows = vectors.clean(df, vec_id, quantise(F.col(vector)), zeros=True, more=(F.col(label).alias("label"),))
    rows = rows.where(F.col("label").isNotNull()).checkpoint()
    index, placed, sizes = _index(rows, cfg)
    trees = _trees(placed, sizes, index, cfg)

    anchors = (
        rows.where(F.col("vec_id") % cfg.every == 0).groupBy(F.col("vec_id").alias("anchor"))
        .agg(F.min(F.struct("v", "label")).alias("a"))
        .select("anchor", F.lit(0).alias("place"), F.size("a.v").alias("dim"), "a.v", "a.label",
                F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))
    )
    positives = _ranked(_search(anchors, trees, index, True, cfg.positives, cfg), ["anchor"], cfg.positives).select(
        "anchor", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).checkpoint()
    score = F.col("positive_score").cast("decimal(38,0)")
    windows = positives.join(anchors.select("anchor", "dim", "v", "label"), "anchor").withColumns({
        "low": F.ceil(score * cfg.low / 100).cast("double"), "high": F.floor(score * cfg.high / 100).cast("double")})
    windows = windows.where(F.col("low") <= F.col("high"))
    found = _ranked(_search(windows, trees, index, False, cfg.negatives, cfg), ["anchor", "place"], cfg.negatives)
    return found.join(positives, ["anchor", "place"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
