"""TextRank over a user's vectors and strongest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from precis import config as C
from precis.operators import dense as D
from precis.operators import sentences as N
from precis.operators import summarize as SM
from precis.operators import textrank as TR

S = C.DEFAULT


def brute(W, clip=False):
    """PageRank over the full similarity matrix; (scores, converged, iterations)."""
    W = np.asarray(W, float)
    n = len(W)
    norm = np.linalg.norm(W, axis=1, keepdims=True)
    W = W / np.where(norm > 0, norm, 1.0)
    sim = W @ W.T
    sim[np.abs(sim) < 1e-13] = 0.0
    np.fill_diagonal(sim, 0.0)
    sim = np.maximum(sim, 0.0) if clip else sim
    degree = sim.sum(axis=1)
    dangling = np.abs(degree) < 1e-12 * n
    step = sim / np.where(dangling, 1.0, degree)[:, None]
    step[dangling] = 0.0
    x = np.full(n, 1.0 / n)
    for it in range(1, S.max_iter + 1):
        new = S.damping * (x @ step + x[dangling].sum() / n) + (1 - S.damping) / n
        err, x = np.abs(new - x).sum(), new
        if err < n * S.tol:
            return x, True, it
    return np.full(n, 1.0 / n), False, S.max_iter


def scores(spark, docs, mode="keep"):
    df = spark.createDataFrame([(i, v, n) for i, (v, n) in enumerate(docs)], "i int, v array<array<double>>, n int")
    rows = df.select("i", D.dense_scores(F.col("v"), F.col("n"), mode).alias("r")).collect()
    return {r["i"]: r["r"] for r in rows}


@pytest.mark.parametrize("mode", ["keep", "clip"])
def test_scores_equal_brute_force(spark, mode):
    rng = np.random.default_rng(2)
    docs = [np.abs(rng.normal(size=(n, 8))) for n in (1, 2, 3, 40, 200)]
    docs += [rng.normal(size=(30, 8)) + 1.0, rng.normal(size=(25, 4)), np.zeros((4, 3)), np.eye(5), np.ones((6, 2)),
             np.vstack([np.eye(3), np.eye(3)]), np.vstack([np.zeros((2, 4)), np.ones((3, 4))])]
    got = scores(spark, [(d.tolist(), len(d)) for d in docs], mode)
    for i, d in enumerate(docs):
        x, ok, it = brute(d, mode == "clip")
        assert got[i]["converged"] == ok, i
        if ok:
            assert abs(got[i]["iterations"] - it) <= 1
        np.testing.assert_allclose(got[i]["scores"], x, atol=1e-7, err_msg=str(i))


def test_clipped_product_is_tiled(monkeypatch):
    rng = np.random.default_rng(4)
    d = rng.normal(size=(1500, 16)) + 0.2
    x, ok, _ = brute(d, True)
    assert ok
    monkeypatch.setattr(D, "TILE", 1 << 15)  # 21 rows at once
    W, _ = D.unit_rows(__import__("pyarrow").array([d.tolist()]), np.array([1500]))
    got, ok, _ = D.pagerank_clipped(W, S.damping, S.tol, S.max_iter)
    assert ok
    np.testing.assert_allclose(got, x, atol=1e-9)


def test_odd_vectors(spark):
    good = [[1.0, 0.0], [1.0, 1.0], [0.5, 1.0]]
    same = brute(good)[0]
    got = scores(spark, [
        (good, 3), (None, 2), ([], 0), (good, 0), ([*good, [9.0, 9.0]], 3), (good[:2], 3), ([[1.0], [None], None, [float("nan")]], 4),
        ([[1.0, 0.0, 0.0], [1.0, 1.0], [0.5, 1.0]], 3), ([[1e300, 0.0], [1e300, 1e300], [5e299, 1e300]], 3), (None, None), ([], 2)])
    np.testing.assert_allclose(got[0]["scores"], same, atol=1e-9)
    assert got[1]["scores"] == [0.5, 0.5] and got[1]["converged"]  # no vectors: nothing is similar
    assert got[2]["scores"] == [] and got[3]["scores"] == [] and got[9]["scores"] == []
    for i in (4, 7, 8):  # surplus vectors, short vectors, great lengths
        np.testing.assert_allclose(got[i]["scores"], same, atol=1e-9)
    np.testing.assert_allclose(got[5]["scores"], brute([*good[:2], [0.0, 0.0]])[0], atol=1e-9)
    assert got[6]["scores"] == [0.25] * 4 and got[10]["scores"] == [0.5, 0.5]


def test_summaries_of_documents_with_vectors(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(30):
        n = int(rng.integers(0, 9))
        rows.append((i % 7 if i % 5 else None, " ".join(f"Sentence {j} of text {i}." for j in range(n)), np.abs(rng.normal(size=(n, 5))).tolist(), i))
    df = spark.createDataFrame(rows, "doc_id int, text string, vecs array<array<double>>, n_row int")  # null and repeated ids
    got = {r["n_row"]: r for r in SM.summarize(df, method="textrank", k=2, vectors="vecs", keep=("n_row", "text")).collect()}
    assert len(got) == 30
    for doc_id, text, vecs, i in rows:
        sents = [f"Sentence {j} of text {i}." for j in range(len(vecs))]
        best = sorted(sorted(range(len(vecs)), key=lambda j: (-round(brute(vecs)[0][j], 9), -j))[:2]) if vecs else []
        assert (got[i]["doc_id"], got[i]["text"], got[i]["n_sent"]) == (doc_id, text, len(vecs))
        assert got[i]["summary"] == " ".join(sents[j] for j in best)
    plan = SM.summarize(df, method="textrank", vectors="vecs")._jdf.queryExecution().toString()
    assert "Exchange" not in plan.split("== Physical Plan ==")[1]
    with pytest.raises(ValueError):
        SM.summarize(df, method="textrank", vectors="vecs", negative_edges="abs")
    with pytest.raises(ValueError):
        SM.summarize(df, method="tfidf", vectors="vecs")


def neighbours(W, m):
    sim = np.round(W @ W.T, 9)
    out = []
    for i in range(len(W)):
        js = sorted((j for j in range(len(W)) if j != i and (W[i] * W[j]).any()), key=lambda j: (-sim[i, j], j))[:m]
        out += [(i, r + 1, j, sim[i, j]) for r, j in enumerate(js)]
    return out


@pytest.mark.parametrize("m", [1, 3, 50])
def test_strongest_neighbours_equal_brute_force(m):
    rng = np.random.default_rng(m)
    for n, terms, share in ((1, 5, 0.5), (2, 3, 0.9), (60, 30, 0.15), (150, 400, 0.05), (40, 6, 0.6)):
        W = np.where(rng.random((n, terms)) < share, rng.integers(1, 4, (n, terms)).astype(float), 0.0)
        W[n // 2:n // 2 + 5] = W[0]  # equal sentences
        norm = np.linalg.norm(W, axis=1, keepdims=True)
        W = W / np.where(norm > 0, norm, 1.0)
        s, t = np.nonzero(W)
        shuffled = rng.permutation(len(s))
        i, j, sim = D.nearest_of_document(s[shuffled], t[shuffled], W[s, t][shuffled], m)
        want = neighbours(W, m)
        assert [(a, b) for a, _, b, _ in want] == list(zip(i.tolist(), j.tolist()))
        np.testing.assert_allclose(sim, [w[3] for w in want], atol=2e-9)


def test_strongest_neighbours_of_a_table(spark):
    texts = ["Cats chase mice. Dogs chase cats. Mice eat cheese. Nothing alike here.", "", "One sentence only."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    vec = TR.sentence_vectors(N.sentence_table(SM.prepare_documents(df), "doc_id"))
    got = [tuple(r)[:4] for r in D.strongest_neighbours(vec, 2).orderBy("doc_id", "sent_idx", "rank").collect()]
    assert {(i, j) for _, i, _, j in got} == {(0, 1), (0, 2), (1, 0), (2, 0)}
    assert D.strongest_neighbours(vec.limit(0), 2).count() == 0
    with pytest.raises(ValueError):
        D.strongest_neighbours(vec, 0)
