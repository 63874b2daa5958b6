"""Merkle proofs, hard negatives and line dedup against plain Python."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from precis.llm import hard_negatives, line_dedup, merkle
from precis.llm import oracles
from precis.llm import queries as Q

SF = "/root/testdata/sf0.001"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree_and_paths(leaves):
    """The root of a list of hashes, and each leaf's (side, sibling) steps."""
    steps = [[] for _ in leaves]
    nodes = [(h, [i]) for i, h in enumerate(leaves)]
    while len(nodes) > 1:
        up = []
        for k in range(0, len(nodes), 2):
            pair = nodes[k:k + 2]
            for j, (_, under) in enumerate(pair):
                for i in under:
                    steps[i].append(("-", "") if len(pair) == 1 else ("L" if j else "R", pair[1 - j][0]))
            up.append((H(*[h for h, _ in pair]), [i for _, under in pair for i in under]))
        nodes = up
    return nodes[0][0], steps


def manifest(rows):
    """What manifest_proofs returns for (doc_id, source, lang, n_chars, text) rows, in plain Python."""
    first = lambda x, zero: (x is not None, x if x is not None else zero)
    leaf = lambda r: H(*map(field, r))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda x: first(x.encode() if x is not None else None, b""))
    subs = []
    for g in langs:
        groups[g].sort(key=lambda r: (first(r[0], 0), leaf(r)))
        subs.append(tree_and_paths([leaf(r) for r in groups[g]]))
    root, above = tree_and_paths([s for s, _ in subs])
    out = []
    for g, (sub, steps), up in zip(langs, subs, above):
        for r, path in zip(groups[g], steps):
            h = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                h = H(*map(field, (*r[:3], r[3] + 1, r[4])))
            for side, s in path + up:
                h = H(s, h) if side == "L" else H(h, s) if side == "R" else H(h)
            out.append((r[0], leaf(r), sub, root, H(*[s for _, s in path + up]), h, h == root))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, rank string, leaf int, part string"
KEY = lambda r: tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("levels", [1, 3, 10])
def test_merkle_proofs_with_odd_rows(spark, levels):
    rng = random.Random(levels)
    rows = [(i, rng.choice(["a", None]), rng.choice(["en"] * 9 + ["de", None]), rng.choice([5, None, 17]), rng.choice(["x", "", None, "ü🙂" * 50]))
            for i in rng.sample(range(-50, 5000), 120)]
    rows += [(900_000, "s", "one", 1, "alone"), (900_001, "s", "é", 1, "t"), (900_001, "s", "é", 1, "t"), (900_001, "s", "é", 2, "u"),
             (None, None, None, None, None), (None, None, None, None, None), (7, "", "", 0, "")]
    df = spark.createDataFrame([(*r, "x", 1, None) for r in rows], SCHEMA)
    cfg = merkle.MerkleConfig(block_levels=levels, broadcast_mb=0 if levels == 3 else 16)
    got = [tuple(r) for r in merkle.manifest_proofs(df, cfg).collect()]
    want = manifest(rows)
    assert sorted(got, key=KEY) == sorted(want, key=KEY)
    assert {r[-1] for r in got} == {True, False}


def test_merkle_small_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest_proofs(df).count() == 0
    one = [(1, "a", None, 3, "t")]
    got = [tuple(r) for r in merkle.manifest_proofs(spark.createDataFrame([(*one[0], "", 0, "")], SCHEMA)).collect()]
    assert got == manifest(one) and got[0][4] == H("")


def dedup(texts, least, chars=1):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(strip))
    count = {}
    for t in texts:
        for k in {key(x) for x in (t or "").split("\n")}:
            count[k] = count.get(k, 0) + 1
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < chars or count[key(x)] < least]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("mb", [24, 0])
def test_line_dedup_with_odd_rows(spark, mb):
    rng = random.Random(5)
    words = ["Menu", " menu\t", "MENU\r", "\x85x", "ÄB", "äb", "x y", "", " ", "rare one", "a\x00b", " "]
    texts = ["\n".join(rng.choice(words) for _ in range(rng.randint(0, 6))) for _ in range(60)]
    texts += [None, "", "\n", "\n\n", "menu", "menu", "last\n", " \x0b", "long " * 200_000 + "\nmenu\n" * 500]
    rows = [(None if i % 9 == 0 else i % 20, t, "x", 1, i) for i, t in enumerate(texts)]  # null and repeated ids
    df = spark.createDataFrame(rows, "doc_id long, text string, lines string, row int, n int")
    cfg = line_dedup.LineConfig(min_docs=4, broadcast_mb=mb)
    got = {r["n"]: tuple(r["lines"]) for r in line_dedup.drop_common(df, cfg=cfg).collect()}
    assert [got[i] for i in range(len(texts))] == dedup(texts, 4)
    assert line_dedup.drop_common(df.limit(0)).count() == 0
    longer = {r["n"]: tuple(r["lines"]) for r in line_dedup.drop_common(df, cfg=line_dedup.LineConfig(min_chars=3, min_docs=3)).collect()}
    assert [longer[i] for i in range(len(texts))] == dedup(texts, 3, 3)


def test_line_dedup_of_files_and_of_tables_made_from_them(spark, tmp_path):
    texts = ["a\nb"] * 3 + ["a\nc\na", "d"]
    spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    cfg = line_dedup.LineConfig(min_docs=4)
    assert sorted(r["lines"]["kept"] for r in line_dedup.drop_common(docs, cfg=cfg).collect()) == ["b", "b", "b", "c", "d"]
    twice = docs.unionAll(docs)  # every row of the files stands twice
    assert sorted(r["lines"]["kept"] for r in line_dedup.drop_common(twice, cfg=cfg).collect()) == [""] * 6 + ["c"] * 2 + ["d"] * 2


def mine(rows, every, k, low=80, high=100):
    z = [(i, lab, np.floor(256 * np.array(v)).astype(int)) for i, v, lab in rows]
    out = []
    for a in sorted({i for i, _, _ in z if i % every == 0}):
        v, lab = min((tuple(v), lab) for i, lab, v in z if i == a)
        s = [(-int(np.dot(v, x)), i, y) for i, y, x in z if i != a and len(x) == len(v)]
        for p, i, _ in sorted(x for x in s if x[2] == lab)[:k]:
            window = sorted(x for x in s if x[2] != lab and -low * p <= -100 * x[0] <= -high * p)[:k]
            out += [(a, i, r + 1, n, -p, -q) for r, (q, n, _) in enumerate(window)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["int", "string"])
def test_hard_negatives_with_odd_rows(spark, kind):
    rng = np.random.default_rng(3)
    lab = (lambda x: int(x)) if kind == "int" else (lambda x: f"l{x}")
    rows = [(i, [float(x) for x in rng.integers(-3, 5, 3) / 4 + 0.5], lab(rng.integers(0, 3))) for i in range(300)]
    rows += [(i, [0.5, 0.5, 0.75], lab(i % 2)) for i in range(300, 380)]  # copies of one vector
    rows += [(7, rows[7][1], rows[7][2]), (20, rows[20][1], lab(9)), (400, [0.0, 0.0, 0.0], lab(1)), (420, [1.0, 2.0], lab(1))]
    odd = [(1000, None, lab(1)), (1020, [], lab(1)), (1040, [0.0, None, 1.0], lab(0)), (1060, [float("nan"), 1.0, 1.0], lab(0)),
           (1080, [float("inf"), 0.0, 1.0], lab(0)), (None, [1.0, 0.0, 0.0], lab(0)), (1100, [1.0, 0.0, 0.0], None)]
    df = spark.createDataFrame(rows + odd, f"vec_id long, embedding array<double>, label {kind}")
    df = df.selectExpr("*", "1 as anchor", "'x' as shard", "2 as v", "3 as dim")
    cfg = hard_negatives.MiningConfig(every=20, positives=3, negatives=3, shard_rows=60, sample=40, split=4, leaf_rows=8, block_windows=7)
    got = sorted(tuple(r) for r in hard_negatives.mine(df, cfg=cfg).collect())
    assert got == mine(rows, 20, 3) and got
    assert hard_negatives.mine(df.limit(0), cfg=cfg).count() == 0


def test_tree_never_drops_a_result_and_prunes_clusters():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16)) * 200
    X = np.floor(centres[rng.integers(0, 12, 4000)] + rng.normal(size=(4000, 16)) * 12)
    ids, labels = rng.permutation(9000)[:4000], rng.integers(0, 4, 4000)
    radius = float(np.linalg.norm(X, axis=1).max())
    cfg = hard_negatives.MiningConfig(leaf_rows=32)
    tree = hard_negatives.build(ids, labels, X, radius, cfg)
    A, own, kinds = X[:60], ids[:60], labels[:60]
    high = np.einsum("ij,ij->i", A, A) * rng.uniform(0.5, 1.1, 60)
    low = np.ceil(high * 0.8)
    q, x, s = hard_negatives.search(tree, A, own, kinds, low, high, False, 5, np.full(60, -np.inf))
    for i in range(60):
        z = X @ A[i]
        want = sorted((-z[j], ids[j]) for j in range(4000) if labels[j] != kinds[i] and low[i] <= z[j] <= high[i])[:5]
        assert list(zip(-s[q == i], x[q == i])) == want
    # most of the tree lies outside of the annuli
    D = hard_negatives._distance(A, X, radius)
    inner, outer = hard_negatives._annulus(np.einsum("ij,ij->i", A, A), low, high, radius)
    P, children, lo, hi = tree["nodes"][0]
    meets = hard_negatives._meets(hard_negatives._distance(A, P, radius), lo, hi, inner, outer, np.full(60, 1e-3))
    assert meets.mean() < 0.7
    for i in range(60):  # no vector of an eliminated sibling lies in the window
        inside = (D[i] >= inner[i]) & (D[i] <= outer[i])
        of = hard_negatives._between(X, P, radius).argmin(axis=1)
        assert set(of[inside]) <= set(np.flatnonzero(meets[i]))


def digest(rows):
    return sorted(tuple(r) for r in rows)


@pytest.mark.parametrize("name", ["op11_merkle", "op12_hard_negatives", "op13_line_dedup"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = Q.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({oracles.oracle_sql()[name]})").fetchall()
    assert digest(got.select(*cols).collect()) == digest(want) and want
