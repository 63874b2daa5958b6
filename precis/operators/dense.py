"""TextRank of documents over a user's sentence vectors, and each sentence's strongest neighbours.

A document is one row with an array of vectors, one for each sentence, so its graph is
solved where the row is: nothing is shuffled.  With W the vectors at length 1, the
similarities are S = W Wᵀ without its diagonal:

* negative similarities kept, as in the original: one PageRank step is
  ``W (Wᵀ y) - y |w|²``, O(sentences x dimensions), and many documents are solved in
  one vectorised iteration;
* ``negative_edges="clip"``: max(0, S) has no such form; its product with ``y`` is
  built from tiles of rows, which are bounded by ``TILE`` numbers whatever the
  document's size, and kept from step to step only while the whole matrix is that small.

Strongest neighbours come from the sparse sentence vectors, a tile of the similarity matrix
at a time: terms of many sentences by a matrix product, rarer ones by the pairs that share
them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from precis import config as C

TILE = 1 << 21  # numbers of a matrix or of a tile of rows that are held at once
BATCH = 1 << 13  # sentences that are solved at once; a longer document alone
SCORES = "struct<scores:array<double>,converged:boolean,iterations:int>"


def unit_rows(vectors: pa.Array, n_sent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, first): the sentences' vectors at length 1, document after document, and where each document begins.

    A sentence without a vector, or with a null, empty or non-finite one, has the zero
    vector; vectors beyond the sentences do not count; short vectors end in zeros.
    """
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    inner = pc.list_flatten(vectors)
    lengths = pc.fill_null(pc.list_value_length(inner), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(inner).to_numpy(zero_copy_only=False).astype(np.float64)
    M = np.zeros((len(lengths), int(lengths.max(initial=0))))
    row = np.repeat(np.arange(len(lengths)), lengths)
    M[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    M[~np.isfinite(M).all(axis=1)] = 0.0
    M /= np.maximum(np.abs(M).max(axis=1, keepdims=True, initial=0.0), np.finfo(float).tiny)  # no overflow below
    norm = np.sqrt(np.einsum("ij,ij->i", M, M))
    M /= np.where(norm > 0, norm, 1.0)[:, None]
    first = np.r_[0, np.cumsum(n_sent)]
    W = np.zeros((int(first[-1]), M.shape[1]))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(M)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    fits = place < n_sent[doc]
    W[first[doc[fits]] + place[fits]] = M[fits]
    return W, first


def _step(x, xs, dangling_mass, n, damping):
    return damping * (xs + dangling_mass / n) + (1.0 - damping) / n


def pagerank_kept(W: np.ndarray, first: np.ndarray, damping: float, tol: float, max_iter: int):
    """(scores, converged, iterations) of many documents' graphs at once; negative similarities stay."""
    n_doc = np.diff(first)
    out, converged, steps = np.zeros(len(W)), np.zeros(len(n_doc), bool), np.zeros(len(n_doc), np.int32)
    docs = np.flatnonzero(n_doc > 0)
    converged[n_doc == 0] = True
    rows = np.arange(len(W))
    while len(docs):  # until a half of the documents is done; then the others alone
        n = n_doc[docs]
        begin = np.cumsum(n) - n
        of = np.repeat(np.arange(len(docs)), n)
        V, size = W[rows], n[of].astype(float)
        sq = np.einsum("ij,ij->i", V, V)
        degree = np.einsum("ij,ij->i", V, np.add.reduceat(V, begin)[of]) - sq
        dangling = np.abs(degree) <= 1e-12 * size
        inverse = np.where(dangling, 0.0, 1.0 / np.where(dangling, 1.0, degree))
        x = np.where(steps[docs][of] > 0, out[rows], 1.0 / size)
        live, it = np.ones(len(docs), bool), steps[docs].max(initial=0)
        while it < max_iter and live.sum() * 2 > len(docs):
            y = x * inverse
            with np.errstate(over="ignore", invalid="ignore"):
                xs = np.einsum("ij,ij->i", V, np.add.reduceat(V * y[:, None], begin)[of]) - y * sq
                xs[dangling] = 0.0
                new = _step(x, xs, np.add.reduceat(np.where(dangling, x, 0.0), begin)[of], size, damping)
                err = np.add.reduceat(np.abs(new - x), begin)
            it += 1
            x = np.where(live[of], new, x)
            steps[docs[live]] = it
            done = live & (err < n * tol)
            converged[docs[done]] = True
            live &= ~done
        out[rows] = x
        if it >= max_iter:
            break
        docs, rows = docs[live], rows[live[of]]
    return out, converged, steps


def pagerank_clipped(W: np.ndarray, damping: float, tol: float, max_iter: int):
    """(scores, converged, iterations) of one document's graph without its negative similarities."""
    n = len(W)
    if n == 0:
        return np.zeros(0), True, 0
    rows = max(1, TILE // n)
    cuts = [slice(a, min(n, a + rows)) for a in range(0, n, rows)]

    def tile(cut: slice) -> np.ndarray:
        s = np.maximum(W[cut] @ W.T, 0.0)
        s[np.arange(cut.stop - cut.start), np.arange(cut.start, cut.stop)] = 0.0
        s[s < 1e-15] = 0.0  # rounding of orthogonal vectors
        return s

    kept = [tile(cuts[0])] if len(cuts) == 1 else None

    def times(y: np.ndarray) -> np.ndarray:
        return np.concatenate([(kept[i] if kept else tile(cut)) @ y for i, cut in enumerate(cuts)])

    degree = times(np.ones(n))
    dangling = degree == 0
    inverse = np.where(dangling, 0.0, 1.0 / np.where(dangling, 1.0, degree))
    x = np.full(n, 1.0 / n)
    for it in range(1, max_iter + 1):
        new = _step(x, times(x * inverse), x[dangling].sum(), n, damping)
        err, x = np.abs(new - x).sum(), new
        if err < n * tol:
            return x, True, it
    return x, False, max_iter


def _solve(vectors: pa.Array, sentences: pa.Array, negative_edges: str, settings: C.Settings) -> pa.Array:
    n_sent = np.maximum(pc.fill_null(sentences, 0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    numbers = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, lists, converged, steps = 0, [], [], []
    while at < len(n_sent):
        end, total = at, 0
        while end < len(n_sent) and (end == at or total < BATCH):
            total += max(int(n_sent[end]), int(numbers[end]))
            end += 1
        W, first = unit_rows(vectors.slice(at, end - at), n_sent[at:end])
        if negative_edges == "clip":
            found = [pagerank_clipped(W[a:b], settings.damping, settings.tol, settings.max_iter) for a, b in zip(first, first[1:])]
            x = np.concatenate([f[0] for f in found]) if found else np.zeros(0)
            ok, it = np.array([f[1] for f in found], bool), np.array([f[2] for f in found], np.int32)
        else:
            x, ok, it = pagerank_kept(W, first, settings.damping, settings.tol, settings.max_iter)
        size = np.repeat(n_sent[at:end], n_sent[at:end])
        x = np.where(np.repeat(ok, n_sent[at:end]), x, 1.0 / np.maximum(size, 1))
        lists.append(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(x)))
        converged.append(ok)
        steps.append(it)
        at = end
    if not lists:
        return pa.array([], pa.struct([("scores", pa.list_(pa.float64())), ("converged", pa.bool_()), ("iterations", pa.int32())]))
    return pa.StructArray.from_arrays(
        [pa.concat_arrays(lists), pa.array(np.concatenate(converged)), pa.array(np.concatenate(steps).astype(np.int32))],
        ["scores", "converged", "iterations"])


def dense_scores(vectors: Column, n_sent: Column, negative_edges: str = "keep", settings: C.Settings = C.DEFAULT,
                 movable: bool = True) -> Column:
    """G1-G4, G6 for one document a row: struct<scores, converged, iterations>, a score for each sentence.

    ``vectors``: array of the sentences' vectors.  A graph that does not converge has
    the uniform 1/n for every sentence.  Null vectors stand for zero vectors.
    """
    if negative_edges not in ("keep", "clip"):
        raise ValueError(f"negative edges are either kept or clipped; got {negative_edges!r}")

    def run(v: pa.Array, n: pa.Array) -> pa.Array:
        return _solve(v, n, negative_edges, settings)

    given = vectors.cast("array<array<double>>")
    udf = F.arrow_udf(run, SCORES)
    return (udf if movable else udf.asNondeterministic())(given, n_sent.cast("int"))


def textrank_vectors(docs: DataFrame, id_col: str, vectors: Column, n_sent: Column, negative_edges: str = "keep",
                     settings: C.Settings = C.DEFAULT) -> DataFrame:
    """:func:`dense_scores` as rows (id, sent_idx, textrank, converged, iterations), one for each sentence."""
    # evaluated once, below the generator: Spark must not move the UDF into it
    scores = dense_scores(vectors, n_sent, negative_edges, settings, movable=False)
    r = docs.select(id_col, scores.alias("r")).select(id_col, "r.scores", "r.converged", "r.iterations")
    return r.select(id_col, "converged", "iterations", F.posexplode("scores").alias("sent_idx", "textrank")).select(
        id_col, "sent_idx", "textrank", "converged", "iterations")


def best_positions(scores: Column, k: int) -> Column:
    """K1 within a row: the 0-based positions of the ``k`` best scores, ascending; ties go to the later sentence."""
    keyed = F.transform(scores, lambda s, i: F.struct((-F.round(s, 9)).alias("s"), (-i).alias("i")))
    return F.sort_array(F.transform(F.slice(F.sort_array(keyed), 1, int(k)), lambda x: -x["i"]))


def pick(sentences: Column, positions: Column) -> Column:
    """K2 within a row: the sentences at the positions, joined by blanks."""
    return F.array_join(F.transform(positions, lambda i: F.element_at(sentences, i + 1)), " ")


# ---------------------------------------------------------------------------
# Strongest neighbours of sparse sentence vectors
# ---------------------------------------------------------------------------

OFTEN = 8  # a term in more than a sentence of so many goes into a matrix product, a rarer one is listed by pairs


def _similarities(sent: np.ndarray, code: np.ndarray, weight: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, rows of the similarity matrix) of ``n`` sentences, in tiles of at most ``TILE`` numbers.

    ``code``: numbers of the terms, from 0; entries are sorted by them.
    """
    count = np.bincount(code)
    often = count > max(1, n // OFTEN)
    dense = often[code]
    place = np.cumsum(often) - 1
    width = int(often.sum())
    s, c, w = sent[~dense], code[~dense], weight[~dense]
    begin = np.searchsorted(c, c)  # of an entry's term
    size = np.where(often, 0, count)[c]
    by_sent = np.argsort(s, kind="stable")
    edges = np.searchsorted(s[by_sent], np.arange(n + 1))
    rows = max(1, TILE // max(n, width))
    parts = [np.arange(a, min(width, a + max(1, TILE // n))) for a in range(0, width, max(1, TILE // n))]
    entries = [np.flatnonzero(dense)] if len(parts) == 1 else [np.flatnonzero(dense & (place[code] >= p[0]) & (place[code] <= p[-1])) for p in parts]
    for first in range(0, n, rows):
        last = min(n, first + rows)
        out = np.zeros((last - first, n))
        for p, e in zip(parts, entries):  # so many of the frequent terms at once that their matrix is a tile
            m = np.bincount(sent[e] * len(p) + place[code[e]] - p[0], weights=weight[e], minlength=n * len(p)).reshape(n, len(p))
            out += m[first:last] @ m.T
        mine = by_sent[edges[first]:edges[last]]
        ends = np.cumsum(size[mine])
        at = 0
        while at < len(mine):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TILE, side="right")))
            e = mine[at:to]
            k = size[e]
            own = np.repeat(e, k)
            other = np.arange(len(own)) - np.repeat(np.cumsum(k) - k, k) + begin[own]
            out += np.bincount((s[own] - first) * n + s[other], weights=w[own] * w[other], minlength=out.size).reshape(out.shape)
            at = to
        yield first, out


def nearest_of_document(sent: np.ndarray, term: np.ndarray, weight: np.ndarray, m: int):
    """(sentence, other, similarity) of the ``m`` most similar sentences of each sentence of one document.

    ``sent``, ``term``, ``weight``: the non-zeros of the sentence vectors, no weight
    negative.  Ranked by rounded similarity, ties to the earlier sentence; sentences
    that share no term are no neighbours.
    """
    n = int(sent.max(initial=-1)) + 1
    out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
    if n:
        by_term = np.argsort(term, kind="stable")
        code = np.unique(term[by_term], return_inverse=True)[1]
        for first, total in _similarities(sent[by_term].astype(np.int64), code, weight[by_term], n):
            here = np.arange(len(total))
            total[here, here + first] = 0.0
            sim = np.round(total, 9)
            found = total > 0
            if n > m:  # only those that reach the m-th best
                found &= sim >= np.partition(sim, n - m, axis=1)[:, n - m, None]
            i, j = np.nonzero(found)
            order = np.lexsort((j, -sim[i, j], i))
            i, j = i[order], j[order]
            best = np.arange(len(i)) - np.searchsorted(i, i) < m
            i, j = i[best], j[best]
            for o, x in zip(out, (i + first, j, total[i, j])):
                o.append(x)
    return tuple(np.concatenate(o) for o in out)


def strongest_neighbours(vectors: DataFrame, m: int, id_col: str = "doc_id") -> DataFrame:
    """G3 without a pair table: (id, sent_idx, rank, neighbour, similarity), at most ``m`` rows for each sentence.

    ``vectors``: the rows of :func:`precis.operators.textrank.sentence_vectors`,
    partitioned by the id.  Memory is bounded by a document's vectors.
    """
    from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type

    from precis.operators.textrank import document_batches

    if m < 1:
        raise ValueError(f"a sentence needs at least one neighbour to look for, got {m}")
    src = vectors.select(id_col, "sent_idx", "term", "weight").where(F.col("weight") != 0)
    schema = pa.schema([
        pa.field(id_col, to_arrow_type(src.schema[id_col].dataType)), pa.field("sent_idx", pa.int32()), pa.field("rank", pa.int32()),
        pa.field("neighbour", pa.int32()), pa.field("similarity", pa.float64())])

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = t.column(id_col).combine_chunks()
        border = pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False)
        begin = np.r_[0, np.flatnonzero(border) + 1, len(ids)]
        sent = t.column("sent_idx").to_numpy()
        term = pc.dictionary_encode(t.column("term").combine_chunks()).indices.to_numpy()
        weight = t.column("weight").to_numpy()
        for a, b in zip(begin, begin[1:]):
            i, j, sim = nearest_of_document(sent[a:b], term[a:b], weight[a:b], m)
            if len(i):
                rank = np.arange(len(i)) - np.searchsorted(i, i) + 1
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(np.full(len(i), a))), pa.array(i.astype(np.int32)), pa.array(rank.astype(np.int32)),
                     pa.array(j.astype(np.int32)), pa.array(sim)], schema=schema)

    out: StructType = from_arrow_schema(schema)
    return src.sortWithinPartitions(id_col).mapInArrow(document_batches(id_col, solve), out)
