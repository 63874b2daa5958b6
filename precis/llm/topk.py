"""Exact top-k inner products: norm-sorted vectors, rotated partial sums, Cauchy-Schwarz bounds.

Vectors are dealt to shards by falling length.  Within a shard they are processed
block by block by falling length, in the basis of the shard's singular vectors, which
gathers the length in the first coordinates.  For each query the k-th best score so
far is a bar: once the query's length times the block's greatest length is below it
the query is done, and a pair whose partial sum over the first coordinates plus the
product of the remaining lengths is below it is dropped.  What survives is scored
exactly.  The bar starts at the k-th best score among some of the longest vectors of
the table, so shards of short vectors are mostly skipped.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precis.llm import vectors


@dataclass(frozen=True)
class TopkConfig:
    shard_rows: int = 16_384
    block_rows: int = 2_048  # queries of a block
    step: int = 1_024  # vectors compared at once
    bands: int = 32  # ranges of length that shards are made of, at most
    head: int = 1_024  # long vectors that give the first bar
    stages: tuple = (0.25, 0.5)  # shares of the coordinates after which pairs are dropped
    few: float = 0.1  # share of pairs left below which pairs are scored one by one


DEFAULT = TopkConfig()


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """k-th largest value of each row, -inf if there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def search(ids: np.ndarray, X: np.ndarray, qids: np.ndarray, Q: np.ndarray, k: int, head_ids=(), head=None,
           cfg: TopkConfig = DEFAULT):
    """(query ids, vector ids, scores) with every vector that can be among a query's k best.

    Integer components; scores are exact while |q| * |x| is below 2**53.  ``head``:
    other vectors of the same table, whose scores are a lower bound of the k-th best.
    """
    norm = np.linalg.norm(X, axis=1)
    order = np.lexsort((ids, -norm))
    X, ids, norm = X[order], ids[order], norm[order]
    basis = np.linalg.eigh(X.T @ X)[1][:, ::-1]
    XR, QR = X @ basis, Q @ basis
    qnorm = np.linalg.norm(Q, axis=1)
    slack = 1e-9 * (qnorm * (norm[0] if len(norm) else 0.0)) + 1e-6  # rounding of the rotated sums
    cuts = sorted({max(1, int(X.shape[1] * s)) for s in cfg.stages})
    bar = np.full(len(Q), -np.inf)
    if head is not None and len(head):
        s = Q @ head.T
        s[qids[:, None] == np.asarray(head_ids)[None, :]] = -np.inf
        bar = np.maximum(bar, _kth(s, k))
    top = np.full((len(Q), k), -np.inf)
    got: list[tuple] = []
    for at in range(0, len(X), cfg.step):
        live = np.flatnonzero(qnorm * norm[at] + slack >= bar)
        if not len(live):
            break  # the rest is shorter
        block = slice(at, at + cfg.step)
        by_id = at + np.argsort(ids[block], kind="stable")
        alive = None
        part, done = 0.0, 0
        for c in cuts:
            part = part + QR[live, done:c] @ XR[by_id, done:c].T
            done = c
            rest = np.linalg.norm(QR[live, c:], axis=1)[:, None] * np.linalg.norm(XR[by_id, c:], axis=1)[None, :]
            alive = part + rest + slack[live, None] >= bar[live, None]
            if alive.mean() < cfg.few:
                break
        if alive is not None and alive.mean() < cfg.few:
            s = np.full(alive.shape, -np.inf)
            q, x = np.nonzero(alive)
            s[q, x] = np.einsum("ij,ij->i", Q[live[q]], X[by_id[x]])
        else:
            s = Q[live] @ X[by_id].T
        s[qids[live][:, None] == ids[by_id][None, :]] = -np.inf
        top[live] = -np.sort(-np.concatenate([top[live], s], axis=1), axis=1)[:, :k]
        bar[live] = np.maximum(bar[live], top[live, k - 1])
        # above the bar, and of those that equal it the k smallest ids of the block
        level = s == bar[live, None]
        q, x = np.nonzero(np.isfinite(s) & ((s > bar[live, None]) | level & (np.cumsum(level, axis=1) <= k)))
        got.append((live[q], ids[by_id[x]], s[q, x]))
    if not got:
        return [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.int64)]
    q, x, s = (np.concatenate(p) for p in zip(*got))
    o = np.lexsort((x, -s, q))
    o = o[np.arange(len(o)) - np.searchsorted(q[o], q[o]) < k]
    return [qids[q[o]], x[o], np.rint(s[o]).astype(np.int64)]


def quantise(vector: Column) -> Column:
    """floor(256 x) of every component, x as double; null and non-finite components stay what they are."""
    def one(x):
        x = x.cast("double")
        return F.when(F.abs(x) < float("inf"), F.floor(x * 256.0).cast("double")).otherwise(x)

    return F.transform(vector, one)


def top_k(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5,
          cfg: TopkConfig = DEFAULT) -> DataFrame:
    """For every row whose id is divisible by ``every``: the ``k`` rows of greatest integer inner product.

    Columns query_id, rank, vec_id, score (long) over the quantised vectors; exact,
    ties to the smaller id.  Vectors that are null, empty or hold null or non-finite
    components take no part, nor do rows without an id; zero vectors do.  Rows with
    the query's id are its own; a query only meets vectors of its dimension; repeated
    rows are separate candidates.
    """
    rows = vectors.clean(df, vec_id, quantise(F.col(vector)), zeros=True)
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    bands = cfg.bands
    n, nq, cuts, high = rows.agg(
        F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1)),
        F.percentile_approx("norm", [i / bands for i in range(1, bands)], 1000),
        F.percentile_approx("norm", F.lit(1.0), 1000),
    ).first()
    if not n:
        cuts, high = [], 0.0
    # longest first; equal lengths, however many, are dealt evenly over the shards of their band
    share = cfg.head / max(1, n)
    floor = high if share < 1 / bands and n else 0.0
    floor = cuts[-1] if cuts and share < 1 / bands else floor
    head = {
        d: g for d, g in _by_dim(rows.where(F.col("norm") >= floor).select("vec_id", "v", "dim").limit(cfg.head).collect())
    }
    band = F.lit(0)
    for c in sorted(set(cuts)):
        band = band + (F.col("norm") <= c).cast("int")
    per_band = max(1, -(-n // cfg.shard_rows // max(1, len(set(cuts)) + 1)))
    small = max(1, -(-n // cfg.shard_rows))
    if small < bands:  # fewer shards than bands: neighbouring bands share one
        band = F.floor(band * small / bands).cast("int")
    rows = rows.withColumn("band", band)
    sizes = {r["band"]: r["count"] for r in rows.groupBy("band").count().collect()}  # at most cfg.bands rows
    split = F.lit(1)
    for b, c in sizes.items():
        split = F.when(F.col("band") == b, F.lit(max(per_band, -(-c // cfg.shard_rows)))).otherwise(split)
    rows = rows.withColumn("parts", split)
    rows = rows.select(
        "vec_id", "v", "dim",
        (F.col("band") * 1_000_000 + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("parts"))).cast("int").alias("shard"),
    )
    numbers = [b * 1_000_000 + i for b, c in sizes.items() for i in range(max(per_band, -(-c // cfg.shard_rows)))]
    shards = rows.select("dim").distinct().withColumn("shard", F.explode(F.array(*[F.lit(x) for x in numbers or [0]])))

    def run(ids, X, qids, Q):
        h = head.get(X.shape[1])
        return search(ids, X, qids, Q, k, *(h or ((), None)), cfg=cfg)

    found = vectors.search(
        rows, vectors.queries_of(rows.drop("shard"), every), max(1, -(-nq // cfg.block_rows)), shards, run,
        "query_id long, vec_id long, score long",
    )
    return vectors.best(found, k)


def _by_dim(rows) -> list:
    out = []
    for d in {r["dim"] for r in rows}:
        mine = [r for r in rows if r["dim"] == d]
        out.append((d, (np.array([r["vec_id"] for r in mine]), np.array([r["v"] for r in mine]))))
    return out
