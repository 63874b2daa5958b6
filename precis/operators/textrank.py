"""Similarity graph and TextRank / PageRank.

The graph is the cosine-similarity matrix S of the sentence vectors with a
zero diagonal.  PageRank needs ``x @ D^-1 S`` each iteration, and for vectors
W (rows L2-normalised) ``S = W W^T - diag``, so

    (y S)_j = w_j . (sum_i y_i w_i) - y_j ||w_j||^2,      y = x / d

which costs O(non-zeros) per iteration and never forms a sentence pair.  The
row sums d come from the same identity with y = 1.  Two executions of it:

* ``textrank_scores`` — one graph per document.  A document is one input row,
  so its term rows are bounded by its text.  ``mapInArrow`` runs one
  vectorised numpy power iteration over all documents of an Arrow batch (the
  input is already partitioned and sorted by the id: no exchange, no sort);
  ``power_iteration`` is the same iteration for a single graph.
* ``pagerank_groups`` — dense vectors whose graph is a whole group of any
  size (one group may hold a third of all rows).  The iteration is a Spark
  job: per-group vector sums (``Summarizer``, partial aggregation map-side),
  joined back to the nodes, lineage cut with ``checkpoint()``.

Semantics (networkx-style PageRank): damping 0.85, uniform teleport and
dangling redistribution, stop when sum|x' - x| < n * tol, at most max_iter
iterations; a node without edges is dangling.  Negative similarities (dense
vectors) are kept, as in the original; such graphs usually diverge, and a
graph that does not converge gets the uniform 1/n fallback (G6) with
``converged = false``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from precis import config as C
from precis.operators.sentences import CARRY, hash_partition
from precis.operators.tfidf import riders, tfidf_weights


def sentence_vectors(sent: DataFrame, id_col: str = "doc_id", min_df: int = C.DEFAULT.min_df_hybrid,
                     min_sent: int = 1, carry_text: bool = False) -> DataFrame:
    """G1 (default provider): L2-normalised TF-IDF rows, zero for pruned terms.

    One row per (id, sentence, term) plus a null-term row per sentence, so
    every sentence of every document is present (with ``carry_text`` that row
    holds the sentence text).
    """
    w = tfidf_weights(sent, id_col, min_df=min_df, min_sent=min_sent, carry_text=carry_text)
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col, "sent_idx")))
    return w.select(
        id_col,
        "n_sent",
        "sent_idx",
        F.when(F.col("keep"), F.col("term")).alias("term"),
        F.when(F.col("keep"), F.col("w") / norm).otherwise(F.lit(0.0)).alias("weight"),
        *(["sentence", *riders(w)] if carry_text else []),
    )


def power_iteration(n, rows, cols, vals, damping, tol, max_iter):
    """PageRank over S = W W^T (zero diagonal) from W's non-zeros.

    rows: sentence index, cols: term code, vals: weight (rows L2-normed).
    Returns (x, converged, iterations).  ``tol == 0`` runs exactly
    ``max_iter`` iterations and reports the result as final.
    """
    n_terms = int(cols.max()) + 1 if len(cols) else 0
    df_t = np.bincount(cols, minlength=n_terms)
    has_edge = np.bincount(rows, weights=(df_t[cols] >= 2).astype(float), minlength=n) > 0
    colsum = np.bincount(cols, weights=vals, minlength=n_terms)
    diag = np.bincount(rows, weights=vals * vals, minlength=n)
    d = np.bincount(rows, weights=vals * colsum[cols], minlength=n) - diag
    dangling = ~has_edge
    inv_d = np.where(dangling, 0.0, 1.0 / np.where(dangling, 1.0, d))
    x = np.full(n, 1.0 / n)
    it = 0
    for it in range(1, max_iter + 1):
        y = x * inv_d
        u = np.bincount(cols, weights=y[rows] * vals, minlength=n_terms)
        xs = np.bincount(rows, weights=vals * u[cols], minlength=n) - y * diag
        xs[dangling] = 0.0
        x_new = damping * (xs + x[dangling].sum() / n) + (1.0 - damping) / n
        err = np.abs(x_new - x).sum()
        x = x_new
        if tol > 0 and err < n * tol:
            return x, True, it
    return x, tol == 0, it


def _batch_power_iteration(doc_ix, n_doc, node, cols, vals, n_nodes, damping, tol, max_iter):
    """Power iteration of many independent document graphs at once.

    doc_ix: document of each node; n_doc: sentences per document; node/cols/
    vals: the non-zeros of all W (node id, (doc, term) code, weight).
    Each document stops at its own convergence (its x is frozen).
    """
    n_docs = len(n_doc)
    n_cols = int(cols.max()) + 1 if len(cols) else 0
    df_t = np.bincount(cols, minlength=n_cols)
    has_edge = np.bincount(node, weights=(df_t[cols] >= 2).astype(float), minlength=n_nodes) > 0
    colsum = np.bincount(cols, weights=vals, minlength=n_cols)
    diag = np.bincount(node, weights=vals * vals, minlength=n_nodes)
    d = np.bincount(node, weights=vals * colsum[cols], minlength=n_nodes) - diag
    dangling = ~has_edge
    inv_d = np.where(dangling, 0.0, 1.0 / np.where(dangling, 1.0, d))
    n_node = n_doc[doc_ix].astype(float)
    x = 1.0 / n_node
    active = np.ones(n_docs, dtype=bool)
    done_at = np.full(n_docs, max_iter, dtype=np.int32)
    for it in range(1, max_iter + 1):
        y = x * inv_d
        u = np.bincount(cols, weights=y[node] * vals, minlength=n_cols)
        xs = np.bincount(node, weights=vals * u[cols], minlength=n_nodes) - y * diag
        xs[dangling] = 0.0
        dmass = np.bincount(doc_ix, weights=np.where(dangling, x, 0.0), minlength=n_docs)
        x_new = damping * (xs + dmass[doc_ix] / n_node) + (1.0 - damping) / n_node
        live = active[doc_ix]
        x_new = np.where(live, x_new, x)
        if tol > 0:
            err = np.bincount(doc_ix, weights=np.abs(x_new - x), minlength=n_docs)
            newly = active & (err < n_doc * tol)
            done_at[newly] = it
            active &= ~newly
        x = x_new
        if not active.any():
            break
    converged = ~active if tol > 0 else np.ones(n_docs, dtype=bool)
    return x, converged, done_at


def document_batches(id_col: str, solve):
    """The body of a ``mapInArrow`` over rows sorted by ``id_col`` that hands whole documents to ``solve``.

    ``solve(table)`` returns record batches; a table holds all rows of its documents.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        pending, last = [], None  # chunks of the document that may go on in the next batch, and its id
        for b in batches:
            if b.num_rows == 0:
                continue
            t = pa.Table.from_batches([b])
            ids = t.column(id_col)
            end = ids[t.num_rows - 1]
            first_tail = int(np.argmax(pc.equal(ids, end).to_numpy(zero_copy_only=False)))
            if first_tail > 0:
                yield from solve(pa.concat_tables([*pending, t.slice(0, first_tail)]))
                pending = []
            elif pending and last != end:
                yield from solve(pa.concat_tables(pending))
                pending = []
            pending.append(t.slice(first_tail))
            last = end
        if pending:
            yield from solve(pa.concat_tables(pending))

    return run


def _arrow_kernel(id_col: str, id_type, damping: float, tol: float, max_iter: int, carry_text: bool, keep_top=None,
                  emit=None, passthrough=(), carry_type=None, also=()):
    import pyarrow as pa
    import pyarrow.compute as pc

    out_fields = [
        pa.field(id_col, id_type), pa.field("n_sent", pa.int32()), pa.field("sent_idx", pa.int32()),
        pa.field("textrank", pa.float64()), pa.field("converged", pa.bool_()), pa.field("iterations", pa.int32()),
    ]
    if carry_text:
        out_fields.append(pa.field("sentence", pa.string()))
    if passthrough:  # per-sentence values handed through, plus the G5/G6 feature
        out_fields += [pa.field(c, pa.float64()) for c in passthrough]
        out_fields.append(pa.field("textrank_feature", pa.float64()))
    out_fields += also  # any values of the sentences, handed through
    if emit is not None:  # multi-method selection: (id, n_sent, method, sent_idx, sentence)
        out_fields = [pa.field(id_col, id_type), pa.field("n_sent", pa.int32()), pa.field("method", pa.string()),
                      pa.field("sent_idx", pa.int32()), pa.field("sentence", pa.string())]
    core = pa.schema(out_fields)
    schema = core if carry_type is None else core.append(pa.field(CARRY, carry_type))
    blank = {pa.float64(): 0.0, pa.bool_(): True, pa.int32(): 0}

    def solve_all(t: "pa.Table"):
        """The sentences' rows, and the documents' own rows with what they carry."""
        if carry_type is None:
            yield solve(t, core)
            return
        alone = t.column("sent_idx").is_null()
        own, rest = t.filter(alone), t.filter(pc.invert(alone))
        if rest.num_rows:
            found = solve(rest.drop_columns([CARRY]), core)
            yield pa.RecordBatch.from_arrays([*found.columns, pa.nulls(found.num_rows, carry_type)], schema=schema)
        if own.num_rows:
            n = own.num_rows
            given = {id_col: own.column(id_col), "n_sent": own.column("n_sent").cast(pa.int32()), CARRY: own.column(CARRY),
                     "sent_idx": pa.nulls(n, pa.int32())}
            columns = [
                given[f.name] if f.name in given else pa.array([blank[f.type]] * n, f.type) if f.type in blank else pa.nulls(n, f.type)
                for f in schema
            ]
            yield from pa.Table.from_arrays(columns, schema=schema).to_batches()

    def solve(t: "pa.Table", schema) -> "pa.RecordBatch":
        doc = t.column(id_col).combine_chunks()
        border = pc.not_equal(doc.slice(1), doc.slice(0, len(doc) - 1)).to_numpy(zero_copy_only=False)
        starts = np.r_[0, np.flatnonzero(border) + 1]
        row_doc = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(doc)]))
        docs = doc.take(pa.array(starts))
        n_doc = t.column("n_sent").to_numpy(zero_copy_only=False).astype(np.int64)[starts]
        nodes_per_doc = np.maximum(n_doc, 1)  # an empty document keeps one null row
        offset = np.r_[0, np.cumsum(nodes_per_doc)[:-1]]
        n_nodes = int(nodes_per_doc.sum())
        sidx = t.column("sent_idx").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        node_of_row = offset[row_doc] + sidx
        w = t.column("weight").fill_null(0.0).to_numpy(zero_copy_only=False).astype(np.float64)
        kept = w != 0.0
        term = t.column("term").filter(pa.array(kept))
        codes = pc.dictionary_encode(term).combine_chunks().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        key = row_doc[kept] * (int(codes.max()) + 1 if len(codes) else 1) + codes
        _, cols = np.unique(key, return_inverse=True)
        node_doc = np.repeat(np.arange(len(docs)), nodes_per_doc)
        x, conv, iters = _batch_power_iteration(
            node_doc, np.maximum(n_doc, 1), node_of_row[kept], cols.astype(np.int64), w[kept],
            n_nodes, damping, tol, max_iter,
        )
        local = np.arange(n_nodes) - offset[node_doc]
        empty = (n_doc == 0)[node_doc]

        def top(score):
            # same rule as select.top_k: score rounded to 9 digits desc, later sentence first
            order = np.lexsort((-local, -np.round(score, 9), node_doc))
            rank = np.empty(n_nodes, dtype=np.int64)
            rank[order] = np.arange(n_nodes) - offset[node_doc[order]]
            return np.flatnonzero(rank < keep_top)

        if emit is not None:
            sent = t.column("sentence")
            has = sent.is_valid().to_numpy(zero_copy_only=False)
            texts = np.full(n_nodes, None, dtype=object)
            texts[node_of_row[has]] = sent.filter(pa.array(has)).to_numpy(zero_copy_only=False)
            per_node = {}
            for name in emit:
                if name == "textrank":
                    per_node[name] = top(x)
                elif name == "lead":
                    per_node[name] = np.flatnonzero(local < keep_top)
                else:  # a score column carried on the one text row of each sentence
                    col = t.column(name).fill_null(0.0).to_numpy(zero_copy_only=False).astype(np.float64)
                    vals = np.zeros(n_nodes)
                    vals[node_of_row[has]] = col[has]
                    per_node[name] = top(vals)
            parts = [(m, idx) for m, idx in per_node.items()]
            sel_all = np.concatenate([idx for _, idx in parts])
            meth = np.concatenate([np.full(len(idx), m, dtype=object) for m, idx in parts])
            nd = node_doc[sel_all]
            return pa.RecordBatch.from_arrays(
                [docs.take(pa.array(nd)), pa.array(n_doc[nd].astype(np.int32)), pa.array(meth, type=pa.string()),
                 pa.array(local[sel_all].astype(np.int32), mask=empty[sel_all]),
                 pa.array(texts[sel_all], type=pa.string())],
                schema=schema,
            )

        sel = np.arange(n_nodes)
        if keep_top is not None:
            sel = top(x)
        nd = node_doc[sel]
        arrays = [
            docs.take(pa.array(nd)), pa.array(n_doc[nd].astype(np.int32)),
            pa.array(local[sel].astype(np.int32), mask=empty[sel]), pa.array(np.where(empty, 0.0, x)[sel]),
            pa.array(conv[nd]), pa.array(np.where(empty, 0, iters[node_doc])[sel].astype(np.int32)),
        ]
        if carry_text:
            sent = t.column("sentence")
            has = sent.is_valid().to_numpy(zero_copy_only=False)
            texts = np.full(n_nodes, None, dtype=object)
            texts[node_of_row[has]] = sent.filter(pa.array(has)).to_numpy(zero_copy_only=False)
            arrays.append(pa.array(texts[sel], type=pa.string()))
        if passthrough:
            # window values are equal on every row of a sentence: any row will do
            for c in passthrough:
                vals = np.zeros(n_nodes)
                vals[node_of_row] = t.column(c).fill_null(0.0).to_numpy(zero_copy_only=False).astype(np.float64)
                arrays.append(pa.array(vals[sel]))
            # / max over the document when > 0; not converged -> 1/n
            mx = np.maximum.reduceat(x, offset) if n_nodes else np.zeros(0)
            mxn = mx[node_doc]
            feat = np.where(mxn > 0, x / np.where(mxn > 0, mxn, 1.0), x)
            feat = np.where(conv[node_doc], feat, 1.0 / np.maximum(n_doc, 1)[node_doc])
            arrays.append(pa.array(np.where(empty, 0.0, feat)[sel]))
        if also:
            any_row = np.zeros(n_nodes, np.int64)
            any_row[node_of_row] = np.arange(t.num_rows)
            arrays += [t.column(f.name).combine_chunks().take(pa.array(any_row[sel])) for f in also]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    return document_batches(id_col, solve_all), schema


def textrank_scores(
    vectors: DataFrame,
    id_col: str = "doc_id",
    damping: float = C.DEFAULT.damping,
    tol: float = C.DEFAULT.tol,
    max_iter: int = C.DEFAULT.max_iter,
    carry_text: bool = False,
    partitioned: bool = True,
    keep_top: int | None = None,
    emit=None,
    extra=(),
    passthrough=(),
    also=(),
) -> DataFrame:
    """G2-G4 per document: (id, n_sent, sent_idx, textrank, converged, iterations[, sentence]).

    ``vectors`` is the output of :func:`sentence_vectors` (sparse rows).  With
    ``tol=0`` exactly ``max_iter`` iterations run (the reproducible form).

    The rows of a document must share a partition — true for every table
    built on :func:`prepare_documents` (``partitioned=True``); otherwise pass
    ``partitioned=False`` and they are repartitioned by the id first.  Within
    a partition the rows are sorted by id (already the case after the
    per-sentence windows, so no extra sort), and ``mapInArrow`` solves all
    documents of an Arrow batch in one vectorised power iteration.

    Where the vectors have a ``_carry`` column, so has the result: null but for one row
    of each document (sent_idx null), its own.  With ``keep_top=k`` only each document's k best sentences are emitted
    (ranked like :func:`precis.operators.select.top_k`): the kernel's output
    carries no partitioning, so selecting here means only k rows per
    document — not every sentence and its text — cross the following shuffle.
    """
    carry = CARRY in vectors.columns and bool(carry_text or emit)
    cols = [id_col, "n_sent", "sent_idx", "term", "weight", *(["sentence"] if carry_text or emit else []),
            *extra, *passthrough, *also, *([CARRY] if carry else [])]
    src = vectors.select(*cols)
    if not partitioned:
        src = src.repartition(id_col)
    # only non-zero weights and the one null-term row per sentence are needed
    src = src.filter((F.col("weight") != 0.0) | F.col("term").isNull())
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(src.schema[id_col].dataType)
    fn, schema = _arrow_kernel(id_col, id_type, damping, tol, max_iter, carry_text, keep_top, emit, tuple(passthrough),
                               to_arrow_type(src.schema[CARRY].dataType) if carry else None,
                               [pa.field(c, to_arrow_type(src.schema[c].dataType)) for c in also])
    from pyspark.sql.pandas.types import from_arrow_schema

    return src.sortWithinPartitions(id_col).mapInArrow(fn, from_arrow_schema(schema))


def textrank_feature(tr: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """/ max when max > 0; a graph that did not converge -> 1/n."""
    tr = hash_partition(tr, id_col)  # the kernel's rows have no partitioning
    doc = Window.partitionBy(id_col)
    mx = F.max("textrank").over(doc)
    n = F.count(F.lit(1)).over(doc)
    scaled = F.when(mx > 0, F.col("textrank") / mx).otherwise(F.col("textrank"))
    return tr.withColumn("textrank_feature", F.when(F.col("converged"), scaled).otherwise(F.lit(1.0) / n))


# ---------------------------------------------------------------------------
# Dense vectors, groups of any size: PageRank as an iterative Spark job.
# ---------------------------------------------------------------------------

def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, z: acc + z)


def _group_sums(nodes: DataFrame, group_col: str, weight, with_err: bool = False) -> DataFrame:
    """Per group: sum_i weight_i * e_i (as an array), the dangling mass and,
    with ``with_err``, the L1 change of the last step."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    scaled = array_to_vector(F.transform("e", lambda v: v * weight))
    agg = nodes.groupBy(group_col).agg(
        Summarizer.sum(scaled).alias("_u"),
        F.sum(F.when(F.col("dangling"), F.col("x")).otherwise(F.lit(0.0))).alias("dmass"),
        (F.sum(F.abs(F.col("x") - F.col("x_prev"))) if with_err else F.lit(None).cast("double")).alias("err"),
    )
    return agg.select(group_col, vector_to_array("_u").alias("u"), "dmass", "err")


def _join_groups(nodes: DataFrame, groups: DataFrame, group_col: str, n_groups, max_rows: int) -> DataFrame:
    """Broadcast the per-group table when its checked size allowed it
    (``n_groups`` is None otherwise), else a plain shuffle join."""
    side = F.broadcast(groups) if n_groups is not None else groups
    return nodes.join(side, group_col)


def _unit_vectors(df: DataFrame, group_col: str, id_col: str, vec_col: str) -> DataFrame:
    e = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    norm = F.sqrt(_dot(e, e))
    return df.select(
        group_col,
        id_col,
        F.when(norm > 0, F.transform(e, lambda v: v / norm)).otherwise(F.transform(e, lambda v: v * 0.0)).alias("e"),
    ).withColumn("sq", _dot(F.col("e"), F.col("e")))


def similarity_degrees(df: DataFrame, group_col: str, id_col: str, vec_col: str,
                       settings: C.Settings = C.DEFAULT) -> DataFrame:
    """G2-G3 aggregated: each node's weighted degree sum_j cos(i, j), j != i,
    within its group — e_i . (sum_j e_j) - ||e_i||^2, no pairs formed."""
    base = _unit_vectors(df, group_col, id_col, vec_col)
    stats = base.agg(F.countDistinct(group_col).alias("g"), F.max(F.size("e")).alias("dim")).first()
    n_groups = stats["g"] if (stats["g"] or 0) * ((stats["dim"] or 0) + 4) <= settings.broadcast_max_rows else None
    colsum = _group_sums(
        base.withColumn("dangling", F.lit(False)).withColumn("x", F.lit(0.0)), group_col, F.lit(1.0)
    ).drop("err", "dmass")
    j = _join_groups(base, colsum, group_col, n_groups, settings.broadcast_max_rows)
    return j.select(group_col, id_col, (_dot(F.col("e"), F.col("u")) - F.col("sq") + F.lit(0.0)).alias("degree"))


def pagerank_groups(
    df: DataFrame,
    group_col: str,
    id_col: str,
    vec_col: str,
    damping: float = C.DEFAULT.damping,
    tol: float = C.DEFAULT.tol,
    max_iter: int = C.DEFAULT.max_iter,
    checkpoint_every: int = C.DEFAULT.checkpoint_every,
    settings: C.Settings = C.DEFAULT,
) -> DataFrame:
    """PageRank of the cosine graph of each group; never forms node pairs.

    Returns (group, id, pagerank, converged, iterations): the raw score when
    the group converged, else the uniform 1/n fallback.
    """
    from precis.session import checkpoint_dir

    spark = df.sparkSession
    checkpoint_dir(spark)
    base = _unit_vectors(df, group_col, id_col, vec_col)

    # the group table (one vector per group) is broadcast only when its size,
    # groups x dimensions, is within the bound; otherwise a shuffle join
    stats = base.agg(F.countDistinct(group_col).alias("g"), F.max(F.size("e")).alias("dim")).first()
    n_groups = stats["g"] if (stats["g"] or 0) * ((stats["dim"] or 0) + 4) <= settings.broadcast_max_rows else None
    sizes = base.groupBy(group_col).agg(F.count(F.lit(1)).alias("n"))
    colsum = _group_sums(
        base.withColumn("dangling", F.lit(False)).withColumn("x", F.lit(0.0)), group_col, F.lit(1.0)
    ).drop("err")
    nodes = (
        _join_groups(base, colsum.join(sizes, group_col), group_col, n_groups, settings.broadcast_max_rows)
        .withColumn("d", _dot(F.col("e"), F.col("u")) - F.col("sq"))
        .withColumn("dangling", (F.col("n") <= 1) | (F.col("sq") == 0) | (F.col("d") == 0))
        .withColumn("x", F.lit(1.0) / F.col("n"))
        .select(group_col, id_col, "e", "sq", "n", "d", "dangling", "x",
                F.lit(None).cast("double").alias("x_prev"), F.lit(None).cast("int").alias("at"))
        .checkpoint()
    )
    it = 0

    for it in range(1, max_iter + 1):
        # one aggregation per iteration: the group vector for this step and
        # the L1 change of the previous step (convergence test of step it-1)
        y = F.when(F.col("dangling"), F.lit(0.0)).otherwise(F.col("x") / F.col("d"))
        sums = _group_sums(nodes, group_col, y, with_err=True)
        upd = _join_groups(nodes, sums, group_col, n_groups, settings.broadcast_max_rows)
        newly = F.col("at").isNull() & F.col("err").isNotNull() & (F.col("err") < F.col("n") * tol)
        at = F.coalesce(F.col("at"), F.when(newly, F.lit(it - 1)))
        xs = F.when(F.col("dangling"), F.lit(0.0)).otherwise(_dot(F.col("e"), F.col("u")) - y * F.col("sq"))
        x_new = F.lit(damping) * (xs + F.col("dmass") / F.col("n")) + F.lit(1.0 - damping) / F.col("n")
        nodes = upd.select(
            group_col, id_col, "e", "sq", "n", "d", "dangling",
            F.when(at.isNull(), x_new).otherwise(F.col("x")).alias("x"),
            F.col("x").alias("x_prev"),
            at.alias("at"),
        )
        if it % checkpoint_every == 0 or it == max_iter:
            nodes = nodes.checkpoint()
            if nodes.filter(F.col("at").isNull()).limit(1).count() == 0:
                break

    # convergence test of the last step
    last = nodes.groupBy(group_col).agg(F.sum(F.abs(F.col("x") - F.col("x_prev"))).alias("err"))
    fin = _join_groups(nodes, last, group_col, n_groups, settings.broadcast_max_rows)
    at = F.coalesce(F.col("at"), F.when(F.col("err") < F.col("n") * tol, F.lit(it)))
    return fin.select(
        group_col,
        id_col,
        F.when(at.isNotNull(), F.col("x")).otherwise(F.lit(1.0) / F.col("n")).alias("pagerank"),
        at.isNotNull().alias("converged"),
        F.coalesce(at, F.lit(it)).alias("iterations"),
    )
