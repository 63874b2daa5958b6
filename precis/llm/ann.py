"""Approximate nearest neighbours by a hash-prefix forest.

Every shard of the vectors is indexed by a forest of prefix trees.  A tree hashes a
vector to a long bit string (signs of random orthogonal projections around their
medians) and keeps the strings as a sorted array, so every prefix is a range of it.
A query descends in each tree to its longest matching prefix and then ascends in all
trees at once, one bit at a time, until the ranges together hold enough candidates;
prefixes therefore are as long as the data's density allows.  Candidates are scored
exactly; queries that share a range share one matrix product.

Equal vectors are one member of the trees, which carries all its ids.  Single
precision only leaves out members that its error bound keeps below the k best, so
however many candidates tie, the smallest ids are found.

Nearness is the inner product.  Vectors get one more component that makes them
equally long, so that the angle orders them as the inner product does.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precis.llm import vectors


@dataclass(frozen=True)
class ForestConfig:
    trees: int = 48
    bits: int = 24  # of the hash strings, at most the dimension + 1
    share: float = 0.8  # candidates (over all trees, repeats counted) as a share of the shard
    least: int = 2_000  # candidates at least
    shard_rows: int = 16_384
    block_rows: int = 4_096  # queries of a block
    block_pairs: int = 1 << 17  # candidates that are scored exactly at once
    seed: int = 5


DEFAULT = ForestConfig()


class Forest:
    """The trees of one shard, over its distinct vectors."""

    def __init__(self, X: np.ndarray, cfg: ForestConfig = DEFAULT):
        raw = np.ascontiguousarray(X + 0.0).view(np.dtype((np.void, X.shape[1] * X.itemsize))).ravel()
        _, self.rows, self.of = np.unique(raw, return_index=True, return_inverse=True)  # 0.0 and -0.0 are equal
        X = X[self.rows]
        self.cfg, self.n = cfg, len(X)
        norm = np.linalg.norm(X, axis=1)
        self.top = float(norm.max()) or 1.0
        A = np.column_stack([X, np.sqrt(np.maximum(0.0, self.top**2 - norm**2))])
        self.bits = min(cfg.bits, A.shape[1])
        rng = np.random.default_rng(cfg.seed)
        self.trees = []
        for _ in range(cfg.trees):
            R = np.linalg.qr(rng.normal(size=(A.shape[1], A.shape[1])))[0][:, :self.bits]
            P = A @ R
            middle = np.median(P, axis=0)
            key = self._strings(P, middle)
            order = np.argsort(key, kind="stable")
            self.trees.append((R, middle, order, key[order]))

    def _strings(self, P, middle):
        return (P > middle).astype(np.int64) @ (1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64))

    def ranges(self, Q: np.ndarray):
        """(first, end) of each query's candidates in each tree's sorted array: two arrays [tree, query]."""
        norm = np.linalg.norm(Q, axis=1, keepdims=True)
        A = np.column_stack([Q * (self.top / np.where(norm > 0, norm, 1.0)), np.zeros(len(Q))])
        keys = [self._strings(A @ R, middle) for R, middle, _, _ in self.trees]
        want = max(self.cfg.least, int(self.cfg.share * self.n))
        first = np.zeros((len(self.trees), len(Q)), np.int64)
        end = np.full_like(first, self.n)
        open_ = np.arange(len(Q))
        for level in range(self.bits, 0, -1):  # all trees ascend together
            lo, hi = [], []
            for key, (_, _, _, strings) in zip(keys, self.trees):
                prefix = (key[open_] >> (self.bits - level)) << (self.bits - level)
                lo.append(np.searchsorted(strings, prefix))
                hi.append(np.searchsorted(strings, prefix + (1 << (self.bits - level))))
            lo, hi = np.array(lo), np.array(hi)
            enough = (hi - lo).sum(0) >= want
            first[:, open_[enough]], end[:, open_[enough]] = lo[:, enough], hi[:, enough]
            open_ = open_[~enough]
            if not len(open_):
                break
        return first, end

    def search(self, X: np.ndarray, ids: np.ndarray, Q: np.ndarray, qids: np.ndarray, k: int):
        """(query ids, vector ids, scores) of the ``k`` best candidates of each query, its own id left out.

        ``X`` and ``ids`` are the rows that the forest was made of.
        """
        X = X[self.rows]
        listed = np.lexsort((ids, self.of))  # the rows of each vector by id
        ids, of = ids[listed], self.of[listed]
        begin = np.searchsorted(of, np.arange(self.n + 1))
        own, own_rows = self._own(ids, of, qids)
        alone = own[own_rows == np.diff(begin)[own % self.n]]  # vectors that only the query itself has
        norm = np.linalg.norm(Q, axis=1, keepdims=True)
        X32, Q32 = (X / self.top).astype(np.float32), (Q / np.where(norm > 0, norm, 1.0)).astype(np.float32)
        # a product is off by at most so much, however it is summed
        off = ((X.shape[1] + 8) * 2.0**-23 * np.linalg.norm(X, axis=1) / self.top + 1e-30).astype(np.float32)
        first, end = self.ranges(Q)
        found = np.zeros((len(Q), self.n), bool)
        for t, (_, _, order, _) in enumerate(self.trees):
            pair = first[t] * (self.n + 1) + end[t]
            by = np.argsort(pair, kind="stable")
            for group in np.split(by, np.flatnonzero(np.diff(pair[by])) + 1):
                a, b = first[t][group[0]], end[t][group[0]]
                if a == b:
                    continue
                members = order[a:b]
                s = Q32[group] @ X32[members].T
                if len(alone):
                    place = np.full(self.n, -1)
                    place[members] = np.arange(b - a)
                    at = np.full(len(Q), -1)
                    at[group] = np.arange(len(group))
                    r, c = at[alone // self.n], place[alone % self.n]
                    both = (r >= 0) & (c >= 0)
                    s[r[both], c[both]] = -np.inf
                if b - a > k:
                    least = s - off[members]
                    least.partition(b - a - k, axis=1)
                    s += off[members]
                    r, c = np.nonzero(s >= least[:, b - a - k, None])
                else:
                    r, c = np.nonzero(s > -np.inf)
                found[group[r], members[c]] = True
        found[alone // self.n, alone % self.n] = False
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        total = np.cumsum(found.sum(1))
        i = 0
        while i < len(Q):
            upto = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + self.cfg.block_pairs, "right")))
            q, x = np.nonzero(found[i:upto])
            q += i
            s = np.einsum("ij,ij->i", Q32[q], X32[x])
            low = s - off[x]
            o = np.lexsort((-low, q))
            place = np.arange(len(o)) - np.searchsorted(q[o], q[o])
            least = np.full(len(Q), -np.inf, np.float32)
            least[q[o][place == k - 1]] = low[o][place == k - 1]
            near = s + off[x] >= least[q]
            q, x = q[near], x[near]
            s = np.einsum("ij,ij->i", Q[q], X[x])
            # the smallest k ids of each vector besides the query's own
            key = q * self.n + x
            where = np.searchsorted(own, key)
            hit = where < len(own)
            hit[hit] = own[where[hit]] == key[hit]
            more = np.zeros(len(q), np.int64)
            more[hit] = own_rows[where[hit]]
            # of each query the k best vectors by score and smallest id hold its k best rows
            low_id = ids[begin[x]]
            for j in np.flatnonzero(hit):
                mine = ids[begin[x[j]]:begin[x[j] + 1]]
                low_id[j] = mine[mine != qids[q[j]]][0]
            o = np.lexsort((low_id, -s, q))
            place = np.arange(len(o)) - np.searchsorted(q[o], q[o])
            o = o[place < k]
            q, x, s, more = q[o], x[o], s[o], more[o]
            size = np.minimum(begin[x + 1] - begin[x], k + more)
            each = np.repeat(np.arange(len(q)), size)
            row = begin[x][each] + np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size)
            q, s, vec = q[each], s[each], ids[row]
            other = vec != qids[q]
            q, s, vec = q[other], s[other], vec[other]
            o = np.lexsort((vec, -s, q))
            place = np.arange(len(o)) - np.searchsorted(q[o], q[o])
            o = o[place < k]
            out.append((qids[q[o]], vec[o], s[o]))
            i = upto
        return [np.concatenate(p) for p in zip(*out)]

    def _own(self, ids: np.ndarray, of: np.ndarray, qids: np.ndarray):
        """(query * n + vector, rows) where rows of the vector have the query's id, ascending."""
        by = np.argsort(ids, kind="stable")
        lo, hi = np.searchsorted(ids[by], qids), np.searchsorted(ids[by], qids, "right")
        size = hi - lo
        q = np.repeat(np.arange(len(qids)), size)
        row = by[np.repeat(lo, size) + np.arange(len(q)) - np.repeat(np.cumsum(size) - size, size)]
        return np.unique(q * self.n + of[row], return_counts=True)


def nearest(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20,
            cfg: ForestConfig = DEFAULT) -> DataFrame:
    """For every row whose id is divisible by ``every``: its ``k`` nearest rows found.

    Columns query_id, rank, vec_id, score (inner product in double precision).
    Vectors that are null, empty, zero or hold null or non-finite components take no
    part, nor do rows without an id.  Rows with the query's id are its own; a query
    only meets vectors of its dimension; repeated rows are separate candidates.
    Queries without candidates give no row.
    """
    rows = vectors.clean(df, vec_id, F.col(vector), zeros=False)
    n, nq = rows.agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    count = max(1, -(-n // cfg.shard_rows))
    rows = rows.withColumn("shard", vectors.even(count))
    shards = (
        rows.select("dim").distinct().withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    )

    def run(ids, X, qids, Q):
        return Forest(X, cfg).search(X, ids, Q, qids, k)

    found = vectors.search(
        rows, vectors.queries_of(rows.drop("shard"), every), max(1, -(-nq // cfg.block_rows)), shards, run,
        "query_id long, vec_id long, score double",
    )
    return vectors.best(found, k)
