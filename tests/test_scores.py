"""TF-IDF, TextRank and summaries: formula rows, brute force, properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from precis.operators import sentences as N
from precis.operators import summarize as SM
from precis.operators import textrank as TR
from precis.operators import tfidf as TF

TEXT = "Cats chase mice. Mice eat cheese. Dogs chase cats quickly."


def _sent(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return N.sentence_table(SM.prepare_documents(df), "doc_id")


def _scores(spark, rows, **kw):
    s = TF.tfidf_scores(_sent(spark, rows), **kw)
    return {(r.doc_id, r.sent_idx): (round(r.score, 6), r.status) for r in s.collect()}


def test_tfidf_formula(spark):
    got = _scores(spark, [(1, TEXT)], min_df=2)
    assert [got[(1, i)][0] for i in range(3)] == [0.433013, 0.25, 0.282843]
    got = _scores(spark, [(1, TEXT)], min_df=1)
    assert [got[(1, i)][0] for i in range(3)] == [0.433013, 0.42979, 0.39635]
    got = _scores(spark, [(1, TEXT)], min_df=1, max_scaled=True)
    assert [got[(1, i)][0] for i in range(3)] == [1.0, 0.992558, 0.915331]


def test_positions_and_lengths(spark):
    s = N.with_norm_lengths(N.with_positions(_sent(spark, [(1, TEXT)])))
    rows = sorted(s.collect(), key=lambda r: r.sent_idx)
    assert [r.position for r in rows] == [0.0, 0.5, 1.0]
    assert [round(r.norm_length, 6) for r in rows] == [0.9, 0.9, 1.2]


def test_no_vocabulary_fallback_and_tie(spark):
    got = _scores(spark, [(1, "Alpha beta. Gamma delta.")], min_df=2)
    assert got[(1, 0)] == (0.5, "no_vocabulary") and got[(1, 1)] == (0.5, "no_vocabulary")
    df = spark.createDataFrame([(1, "Alpha beta. Gamma delta.")], "doc_id long, text string")
    assert SM.summarize(df, k=1).first().summary == "Gamma delta."
    one = _scores(spark, [(2, "Only one sentence here.")], min_df=1, max_scaled=True)
    assert one[(2, 0)][0] == 1.0


def test_summary_top2_in_order(spark):
    df = spark.createDataFrame([(1, TEXT), (2, ""), (3, "Short one. Two.")], "doc_id long, text string")
    got = {r.doc_id: r.summary for r in SM.summarize(df, k=2).collect()}
    assert got == {1: "Cats chase mice. Dogs chase cats quickly.", 2: "", 3: "Short one. Two."}


def _dense_pagerank(S, damping=0.85, iters=30):
    n = len(S)
    d = S.sum(1)
    dangling = d == 0
    P = np.divide(S, d[:, None], out=np.zeros_like(S), where=~dangling[:, None])
    x = np.full(n, 1.0 / n)
    for _ in range(iters):
        x = damping * (x @ P + x[dangling].sum() / n) + (1 - damping) / n
    return x


def _tfidf_matrix(rows):
    """Brute force: dense L2-normalised TF-IDF rows (min_df 1) per sentence."""
    terms = sorted({t for r in rows for t in r})
    n = len(rows)
    tf = np.array([[r.count(t) for t in terms] for r in rows], float)
    df = (tf > 0).sum(0)
    keep = (df >= 1) & (df <= 0.85 * n)
    w = tf[:, keep] * (np.log((1 + n) / (1 + df[keep])) + 1)
    norm = np.linalg.norm(w, axis=1, keepdims=True)
    return np.divide(w, norm, out=np.zeros_like(w), where=norm > 0)


def test_textrank_matches_brute_force(spark):
    text = ("Cats chase mice. Mice eat cheese. Dogs chase cats quickly. Birds sing loudly. "
            "Cheese pleases mice and cats. Zebras graze.")
    sent = _sent(spark, [(1, text)])
    vec = TR.sentence_vectors(sent)
    got = {r.sent_idx: r.textrank for r in TR.textrank_scores(vec, tol=0.0, max_iter=30).collect()}
    toks = [["cats", "chase", "mice"], ["mice", "eat", "cheese"], ["dogs", "chase", "cats", "quickly"],
            ["birds", "sing", "loudly"], ["cheese", "pleases", "mice", "cats"], ["zebras", "graze"]]
    W = _tfidf_matrix(toks)
    S = W @ W.T
    np.fill_diagonal(S, 0)
    expect = _dense_pagerank(S)
    assert np.allclose([got[i] for i in range(6)], expect, atol=1e-9)
    assert abs(sum(got.values()) - 1) < 1e-9


def test_textrank_star_and_dangling_graphs():
    # S = W W^T with these W give the star / dangling graphs of FIXTURES 4.2
    x, conv, _ = TR.power_iteration(3, np.array([0, 1, 0, 2]), np.array([0, 0, 1, 1]),
                                    np.array([np.sqrt(.5), 1.0, np.sqrt(.5), 1.0]), 0.85, 1e-12, 1000)
    S = np.array([[0, np.sqrt(.5), np.sqrt(.5)], [np.sqrt(.5), 0, 0], [np.sqrt(.5), 0, 0]])
    assert conv and np.allclose(x, _dense_pagerank(S, iters=1000), atol=1e-9)
    assert np.allclose(x, [0.486486, 0.256757, 0.256757], atol=1e-6)
    x, conv, _ = TR.power_iteration(3, np.array([0, 1]), np.array([0, 0]), np.array([1.0, 1.0]), 0.85, 1e-12, 1000)
    assert np.allclose(x, [0.465116, 0.465116, 0.069767], atol=1e-6)


def test_batch_kernel_equals_per_document(spark):
    rows = [(i, " ".join(f"W{(i * 7 + j) % 13} w{(i + j * 3) % 5} x{j % 4}." for j in range(i % 6 + 2))) for i in range(30)]
    rows.append((99, ""))
    sent = N.sentence_table(SM.prepare_documents(spark.createDataFrame(rows, "doc_id long, text string")),
                            "doc_id", min_sent=0, outer=True)
    vec = TR.sentence_vectors(sent)
    batch = {(r.doc_id, r.sent_idx): r.textrank for r in TR.textrank_scores(vec, tol=0.0, max_iter=30).collect()}
    pdf = vec.toPandas()
    for doc, g in pdf.groupby("doc_id"):
        n = int(g.n_sent.iloc[0])
        if n == 0:
            assert (doc, None) in batch
            continue
        k = g[g.weight != 0]
        codes = k.term.astype("category").cat.codes.to_numpy()
        x, _, _ = TR.power_iteration(n, k.sent_idx.to_numpy().astype(np.int64), codes.astype(np.int64), k.weight.to_numpy(), 0.85, 0.0, 30)
        assert np.allclose([batch[(doc, i)] for i in range(n)], x, atol=1e-12)


def test_pagerank_groups_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = []
    for g in range(3):
        for i in range(6 + g):
            rows.append((g, g * 100 + i, [float(v) for v in rng.random(8) + 0.1]))
    df = spark.createDataFrame(rows, "grp int, vid long, vec array<double>")
    got = {r.vid: (r.pagerank, r.converged) for r in TR.pagerank_groups(df, "grp", "vid", "vec", checkpoint_every=4).collect()}
    for g in range(3):
        E = np.array([r[2] for r in rows if r[0] == g])
        E = E / np.linalg.norm(E, axis=1, keepdims=True)
        S = E @ E.T
        np.fill_diagonal(S, 0)
        ids = [r[1] for r in rows if r[0] == g]
        expect = _dense_pagerank(S, iters=200)
        assert all(got[i][1] for i in ids)
        assert np.allclose([got[i][0] for i in ids], expect, atol=1e-6)


def _is_subsequence_join(summary, sents, k):
    """summary == " ".join(sents[i] for i in idx), idx increasing, len(idx) == k."""
    from functools import lru_cache

    @lru_cache(maxsize=None)
    def go(pos, start, left):
        if left == 0:
            return pos == len(summary)
        for i in range(start, len(sents)):
            s = sents[i] if pos == 0 else " " + sents[i]
            if summary.startswith(s, pos) and go(pos + len(s), i + 1, left - 1):
                return True
        return False

    return go(0, 0, k)


def test_summary_properties(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = {r.doc_id: r.sentences for r in SM.prepare_documents(d).collect()}
    for method in ("tfidf", "textrank", "lead"):
        out = SM.summarize(d, method=method, k=3).collect()
        assert len(out) == d.count()
        for r in out:
            sents = docs[r.doc_id]
            assert _is_subsequence_join(r.summary, tuple(sents), min(3, len(sents))), (method, r.doc_id)


def test_partition_count_independent(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a = sorted(SM.summarize(d).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        b = sorted(SM.summarize(d).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a == b
