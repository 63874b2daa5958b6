"""Rows that the fixtures lack, and figures that must not grow faster than the input."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from precis import config as C
from precis.llm import jaccard
from precis.operators import dense, training
from precis.operators import model as MD
from precis.operators.features import FEATURES, train_val_split
from precis.plans import queries as Q

LONG = "The river is wide and cold here. " + " ".join(["Rain"] * 40) + "."


@pytest.fixture(scope="module")
def sparse(spark, tmp_path_factory):
    """Documents without a sentence among others."""
    path = str(tmp_path_factory.mktemp("sparse"))
    rows = [(1, LONG), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name, ids", [("corpus_scan", [1, 2, 3, 4, 5, None]), ("drop_blank", [1, 5]), ("length_filter", [1, 5]), ("clean_corpus", [1])])
def test_documents_without_a_sentence_have_empty_highlights(spark, sparse, name, ids):
    rows = {r.doc_id: r.highlights for r in Q.queries()[name](spark, sparse).collect()}
    first = "The river is wide and cold here."
    assert rows == {i: first if i in (1, 5) else "" for i in ids}


def _passages(n):
    """Texts that share a passage and differ by eight words: in one neighbourhood, but no two link."""
    passage = [f"p{i}" for i in range(40)]
    return [(i, " ".join(passage + [f"w{i}x{j}" for j in range(8)])) for i in range(n)]


@pytest.mark.parametrize("listed", [1_000_000, 50])
def test_block_pairs_of_a_neighbourhood_come_in_rounds_of_few_copies(spark, monkeypatch, listed):
    rows, sizes, solve = _passages(120), [], jaccard.solve_blocks

    def measured(dealt, cfg):
        sizes.append(dealt.count())
        return solve(dealt, cfg)

    monkeypatch.setattr(jaccard, "solve_blocks", measured)
    cfg = jaccard.JaccardConfig(block_docs=10, block_tokens=400, broadcast_rows=listed, count_bits=6)  # few groups: the passage is no rarer than the rest
    near = [(1000 + i, rows[i][1].replace("w%dx7" % i, "other")) for i in range(3)]  # each links with its original
    df = spark.createDataFrame(rows + near, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard.components(df, cfg=cfg).collect()}
    assert got == {i: i % 1000 for i in got} and len(got) == 123
    assert sum(sizes) > 123 * 10  # all pairs of some 13 blocks
    assert max(sizes) <= 123 * 4, sizes  # but never many copies at once


def test_shuffles_of_a_stored_query_go_with_it(spark):
    from precis.llm.common import freed_shuffles

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    with freed_shuffles(spark):
        assert spark.conf.get(key) == "true"
        df = spark.range(100).repartition(3, "id")
        assert df.count() == df.count() == 100  # made again where they are needed again
    assert spark.conf.get(key) == before


def test_packed_texts_come_back():
    for text in (b"x", b"a b " * 100_000, "é \0".encode()):
        assert jaccard.unpacked(jaccard.packed(text)) == text
    assert len(jaccard.packed(b"a b " * 100_000)) < 10_000


def _rows(spark, n=700, parts=3):
    rnd = random.Random(3)
    rows = [(i // 4, *[rnd.random() for _ in range(5)]) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, tfidf double, textrank double, position double, length double, norm_length double")
    return df.withColumn("label", ((F.col("tfidf") + F.col("position") * F.col("length")) > 0.9).cast("double")).repartition(parts, "doc_id")


def test_training_takes_the_steps_of_spark_ml(spark):
    data = train_val_split(_rows(spark)).persist()
    start = MD._classifier(spark, C.DEFAULT)
    blocks = training.Blocks(data, list(FEATURES))
    fitted = MD._mlp(C.DEFAULT, 5, start.weights.toArray()).fit(blocks)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(data)
    spark_ml = MultilayerPerceptronClassifier(layers=[5, 64, 32, 2], maxIter=5, seed=C.DEFAULT.random_state, blockSize=128, solver="l-bfgs")
    theirs = spark_ml.fit(vectors.where("not is_val"))
    assert fitted.weights == pytest.approx(theirs.weights.toArray(), rel=1e-6, abs=1e-8)
    loss = MulticlassClassificationEvaluator(metricName="logLoss").evaluate(theirs.transform(vectors.where("is_val")))
    assert MD.log_loss(fitted.losses(blocks)) == pytest.approx(loss, rel=1e-8)
    blocks.close()


def test_training_computes_its_features_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(it):
        for b in it:
            seen.add(b.num_rows)
            yield b

    ts = _rows(spark, 300)
    ts = ts.mapInArrow(counted, ts.schema)
    MD.train(ts, epochs=1, iters_per_epoch=2)
    assert seen.value == 300


def test_a_gradient_passes_blocks_of_rows(spark):
    """Of a wide range of rows in a few tasks, each of which returns one gradient."""
    data = train_val_split(_rows(spark, 20_000, 16))
    blocks = training.Blocks(data, list(FEATURES))
    sizes, w = [5, 64, 32, 2], MD._classifier(spark, C.DEFAULT).weights.toArray()
    assert len(blocks.sums(training.loss_and_gradient, w, sizes, False)) <= spark.sparkContext.defaultParallelism
    value, gradient = blocks.objective(w, sizes)
    rnd = random.Random(1)
    for at in rnd.sample(range(len(w)), 6):
        near = w.copy()
        near[at] += 1e-5
        assert (blocks.objective(near, sizes)[0] - value) / 1e-5 == pytest.approx(gradient[at], abs=1e-5)
    blocks.close()


@pytest.mark.parametrize("label, tfidf", [(None, 0.5), (2.0, 0.5), (1.0, None), (1.0, float("nan"))])
def test_rows_that_cannot_be_learned_from_are_an_error(spark, label, tfidf):
    bad = spark.createDataFrame([(10_000, tfidf, 0.1, 0.1, 0.1, 0.1, label)], _rows(spark).schema)
    with pytest.raises(Exception, match="training row"):
        training.Blocks(train_val_split(_rows(spark).unionAll(bad)), list(FEATURES))


def test_neighbours_of_a_long_document_in_tiles(monkeypatch):
    rng = np.random.default_rng(5)
    sent = np.repeat(np.arange(1500), 12)
    term = (3000 * rng.random(len(sent)) ** 3).astype(int)
    pairs = np.unique(np.column_stack([sent, term]), axis=0)
    sent, term, weight = pairs[:, 0], pairs[:, 1], rng.random(len(pairs))
    W = np.zeros((1500, 3000))
    W[sent, term] = weight
    S = np.round(W @ W.T, 9)
    np.fill_diagonal(S, 0.0)
    most = []
    real = np.bincount
    monkeypatch.setattr(dense, "TILE", 1 << 16)
    monkeypatch.setattr(dense.np, "bincount", lambda *a, **k: most.append(k.get("minlength", 0)) or real(*a, **k))
    i, j, sim = dense.nearest_of_document(sent, term, weight, 5)
    monkeypatch.undo()
    assert 0 < max(most) <= 1 << 16
    for row in rng.choice(1500, 100, replace=False):
        best = [k for k in np.lexsort((np.arange(1500), -S[row]))[:5] if S[row, k] > 0]
        assert list(j[i == row]) == best and sim[i == row] == pytest.approx(S[row, best], abs=2e-9)
