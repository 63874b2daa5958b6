"""Vector searches and the similarity join against brute force."""

import random

import numpy as np
import pytest

from precis.llm import ann, graph, jaccard, topk
from precis.llm import queries as Q

SF = "/root/testdata/sf0.01"
ODD = [(1000, None), (1001, []), (1002, [0.0, None, 1.0]), (1003, [float("nan"), 1.0, 1.0]), (1020, [float("inf"), 0.0, 1.0]),
       (None, [1.0, 0.0, 0.0]), (1040, [0.0, 0.0, 0.0]), (1060, [1.0, 2.0])]


def vectors(spark, extra=ODD, n=120):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 3) / 4]) for i in range(n)]
    rows += [(7, rows[7][1]), (7, rows[7][1]), (20, rows[20][1])]  # repeated rows
    df = spark.createDataFrame(rows + extra, "vec_id long, embedding array<double>")
    return df.selectExpr("*", "1 as query_id", "'x' as shard", "2 as score"), rows


def test_topk_with_ties_zero_vectors_and_odd_rows(spark):
    df, rows = vectors(spark)
    rows = rows + [(1040, [0.0, 0.0, 0.0])]
    cfg = topk.TopkConfig(shard_rows=20, block_rows=2, step=8, head=5)
    got = {}
    for r in topk.top_k(df, every=20, k=5, cfg=cfg).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    z = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows}
    for q in {i for i, _ in rows if i % 20 == 0}:
        all_ = sorted((-int(z[q] @ np.floor(256 * np.array(v)).astype(int)), i) for i, v in rows if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(all_)]
    assert 1060 not in got  # the only vector of its dimension
    assert topk.top_k(df.limit(0)).count() == 0


def test_bounds_never_drop_a_result():
    rng = np.random.default_rng(0)
    for _ in range(20):
        X = np.floor(rng.normal(size=(300, 12)) * 40 * rng.exponential(size=(300, 1)) ** 2)
        X[50:80] = X[50]
        ids = rng.permutation(1000)[:300]
        Q_, qids = X[::10], ids[::10]
        out = topk.search(ids, X, qids, Q_, 4, ids[:40], X[:40], topk.TopkConfig(step=32))
        for i, q in enumerate(qids):
            s = (X @ Q_[i]).astype(int)
            want = sorted((-s[j], ids[j]) for j in range(300) if ids[j] != q)[:4]
            mine = out[0] == q
            assert list(zip((-out[2][mine]).tolist(), out[1][mine].tolist())) == [(int(a), int(b)) for a, b in want]


def test_nearest_recall_and_scores(spark):
    r = Q.op2_nearest(spark, SF).toPandas()
    t = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    X, ids = np.stack(t.embedding.values).astype(float), t.vec_id.values
    where, hit = {i: k for k, i in enumerate(ids)}, 0
    for q, g in r.groupby("query_id"):
        g = g.sort_values("rank")
        s = X @ X[where[q]]
        assert len(g) == 20 and q not in set(g.vec_id) and list(g["rank"]) == list(range(1, 21))
        assert np.allclose(g.score, s[[where[i] for i in g.vec_id]], atol=1e-12) and (np.diff(g.score) <= 0).all()
        s[where[q]] = -9
        hit += len(set(ids[np.lexsort((ids, -s))[:20]]) & set(g.vec_id))
    assert r.query_id.nunique() == (ids % 20 == 0).sum() and hit / len(r) >= 0.9


def test_nearest_odd_rows_and_ties(spark):
    df, rows = vectors(spark)
    rows = [(i, v) for i, v in rows if any(v)]
    cfg = ann.ForestConfig(shard_rows=40, block_rows=3, share=5.0)  # all are candidates: exact
    got = {}
    for r in ann.nearest(df, every=20, k=6, cfg=cfg).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], round(r["score"], 9)))
    v = dict(rows)
    for q in {i for i, _ in rows if i % 20 == 0}:
        want = sorted((-round(float(np.dot(v[q], x)), 9), i) for i, x in rows if i != q)[:6]
        assert [(s, i) for _, i, s in sorted(got[q])] == [(-s, i) for s, i in want]
    assert ann.nearest(df.limit(0)).count() == 0


def test_nearest_with_thousands_of_copies():
    """Of any number of tied candidates those with the smallest ids stay, whatever the order of the rows."""
    rng = np.random.default_rng(5)
    X = rng.normal(size=(8000, 12))
    X /= np.linalg.norm(X, axis=1, keepdims=True)
    X[:3000] = X[0]  # copies
    X[3000:6000] = 0.0
    X[3000:6000, :2] = X[0, :2]  # equal scores by vectors that differ in what no query sees
    X[3000:6000, 11] = np.arange(3000) / 1e5
    ids = rng.permutation(len(X)).astype(np.int64)
    Q = np.vstack([X[0], X[7000], np.r_[X[0, :2], np.zeros(10)]])
    ids[6999] = ids[0]  # an id that also stands elsewhere
    qids = np.array([ids[0], ids[7000], -1])
    got = ann.Forest(X, ann.ForestConfig(share=50.0)).search(X, ids, Q, qids, 20)  # all are candidates: exact
    for i, q in enumerate(qids):
        s = np.einsum("ij,ij->i", np.tile(Q[i], (len(X), 1)), X)
        want = [r for r in np.lexsort((ids, -s)) if ids[r] != q][:20]
        mine = got[0] == q
        assert got[1][mine].tolist() == ids[want].tolist() and np.allclose(got[2][mine], s[want], atol=1e-12)


def test_forest_prefix_ranges_grow_until_enough():
    rng = np.random.default_rng(1)
    X = rng.normal(size=(500, 16))
    f = ann.Forest(X, ann.ForestConfig(trees=4, share=0.2, least=10))
    a, b = f.ranges(X[:20])
    assert ((b - a).sum(0) >= 100).all() and (a < b).any()
    assert all((np.diff(strings) >= 0).all() for _, _, _, strings in f.trees)
    more = ann.Forest(X, ann.ForestConfig(trees=4, share=0.6, least=10)).ranges(X[:20])
    assert (more[0] <= a).all() and (more[1] >= b).all()  # ascending only widens


# --- similarity join ----------------------------------------------------------------

def brute(texts, k, num, den):
    """component (smallest id) and set size of every document by all pairs."""
    sets = {}
    for i, t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed, n):
    rng = random.Random(seed)
    out, passage = [], [f"p{i}" for i in range(20)]
    for i in range(n):
        if i % 3 and out:
            w = list(rng.choice(out)[1].split())
            for _ in range(rng.choice((0, 1, 1, 2, 6))):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        else:
            w = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 150))] + passage * (i % 2)
        out.append((i, " ".join(w)))
    return out + [(n, ""), (n + 1, None), (n + 2, " \n\t"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "one two"), (n + 6, "é É")]


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80)])
@pytest.mark.parametrize("block", [1000, 4])
def test_join_matches_all_pairs(spark, k, num, block):
    texts = near_copies(k * block, 260)
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "0 as sid", "1 as n", "'x' as root")
    cfg = jaccard.JaccardConfig(words=k, num=num, block_docs=block, groups=32, leaf=4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.components(df.repartition(3), cfg=cfg).collect()}
    assert got == brute(texts, k, num, 100)


def test_join_prefixes_share_a_token():
    rng = np.random.default_rng(0)
    for cfg in (jaccard.JaccardConfig(words=3, num=90), jaccard.DEFAULT):
        counts = rng.integers(0, 50, 1 << cfg.count_bits).astype(np.uint32)
        seen = 0
        for _ in range(1500):
            a = np.unique(rng.integers(0, 2**63, rng.integers(1, 120)).astype(np.uint64))
            b = np.unique(np.concatenate([rng.permutation(a)[rng.integers(0, 1 + len(a) // 6):],
                                          rng.integers(0, 2**63, rng.integers(0, 1 + len(a) // 6)).astype(np.uint64)]))
            if len(b) and jaccard.linked(a, b, cfg):
                small, large = sorted((a, b), key=len)
                p, short = jaccard.prefix(small, counts, cfg)
                assert len(np.intersect1d(p[short], jaccard.prefix(large, counts, cfg)[0]))
                tree = jaccard.CountTree(np.array([jaccard.count_vector(b, cfg)]), cfg)
                assert len(tree.candidates(jaccard.count_vector(a, cfg))) == 1
                seen += 1
        assert seen > 300


def test_long_text_is_cut_between_words():
    text = (" ".join(f"w{i % 5000}" for i in range(120_000))).encode()
    whole, = jaccard.Shingler(3).sets([text])
    assert len(whole) == 5000 and (next(iter(jaccard.Shingler(3).sets([text[:1000], text]))) != whole[:1]).any()


def test_join_empty_null_ids_and_repeats(spark):
    df = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, "x y z"), (9, None)], "doc_id long, text string")
    out = [(r["doc_id"], r["component_id"]) for r in jaccard.components(df).collect()]
    assert sorted(out, key=str) == sorted([(None, 5), (None, None), (5, 5), (5, 5), (9, 9)], key=str)
    assert jaccard.components(df.limit(0)).count() == 0


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(400):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root
