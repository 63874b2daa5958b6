"""ROUGE on the FIXTURES pairs, scaler, model life cycle and the error contract."""

import json

import pytest
from pyspark.sql import functions as F

from precis.operators import corpus as R
from precis.operators import features as M
from precis.operators import model as MD
from precis.operators import rouge as E
from precis.operators import select as SEL
from precis.operators import summarize as SM

PAIRS = [
    (1, "the cat sat", "the cat", 0.8, 2 / 3, 0.8),
    (2, "a b c d", "d c b a", 1.0, 0.0, 0.25),
    (3, "a a b", "a b b", 2 / 3, 0.5, 2 / 3),
    (4, "", "x", 0.0, 0.0, 0.0),
]


def test_rouge_pairs(spark):
    df = spark.createDataFrame([p[:3] for p in PAIRS], "doc_id long, highlights string, prediction string")
    got = {r.doc_id: r for r in E.rouge_scores(df, ["doc_id"]).collect()}
    for i, _, _, r1, r2, rl in PAIRS:
        assert got[i].rouge_1 == pytest.approx(r1) and got[i].rouge_2 == pytest.approx(r2)
        assert got[i].rouge_l == pytest.approx(rl)
    cat = got[1]
    assert cat.rouge_1_p == pytest.approx(1.0) and cat.rouge_1_r == pytest.approx(2 / 3)


def test_rouge_symmetry_and_bounds(spark):
    df = spark.createDataFrame([(1, "Running runners ran quickly today", "the runner runs today")],
                               "doc_id long, a string, b string")
    ab = E.rouge_scores(df, ["doc_id"], "a", "b").first()
    ba = E.rouge_scores(df, ["doc_id"], "b", "a").first()
    for m in ("rouge_1", "rouge_2", "rouge_l"):
        assert 0 <= ab[m] <= 1 and ab[m] == pytest.approx(ba[m])
    assert ab.rouge_1 > 0  # stemming: running/runner/runs share stems


def test_lcs_kernel():
    assert E._lcs_len(list("abcbdab"), list("bdcaba")) == 4
    assert E._lcs_len([], ["x"]) == 0
    long_a = [str(i % 97) for i in range(500)]
    long_b = [str(i % 89) for i in range(400)]
    # brute-force DP
    dp = [[0] * (len(long_b) + 1) for _ in range(len(long_a) + 1)]
    for i, x in enumerate(long_a):
        for j, y in enumerate(long_b):
            dp[i + 1][j + 1] = dp[i][j] + 1 if x == y else max(dp[i][j + 1], dp[i + 1][j])
    assert E._lcs_len(long_a, long_b) == dp[-1][-1]


def test_compare_models_one_row_per_model(spark):
    df = spark.createDataFrame([(1, "the cat sat", "the cat", "a dog")], "doc_id long, highlights string, p1 string, p2 string")
    rows = {r.model: r for r in E.compare_models(df, {"A": "p1", "B": "p2"}).collect()}
    assert set(rows) == {"A", "B"} and rows["A"].rouge_1 == pytest.approx(0.8) and rows["B"].rouge_1 == 0


SCALER = {  # values of the scaler file shipped with the original model
    "data_min": [0.0, -0.7145825624465942, 0.0, 1.0, 0.03325415775179863],
    "data_max": [1.0, 1.0, 1.0, 133.0, 6.151658535003662],
    "data_range": [1.0, 1.7145825624465942, 1.0, 132.0, 6.118404388427734],
    "scale": [1.0, 0.5832323431968689, 1.0, 0.007575757801532745, 0.16344130039215088],
    "min": [0.0, 0.4167676568031311, 0.0, -0.007575757801532745, -0.005435102619230747],
    "n_features_in": 5,
}


def test_scaler_roundtrip_and_values(spark, tmp_path):
    p = str(tmp_path / "scaler")
    MD.save_scaler(spark, SCALER, p)
    back = MD.load_scaler(spark, p)
    assert back["scale"] == SCALER["scale"]
    df = spark.createDataFrame([(0.5, 0.0, 0.5, 67.0, 1.0), (0.5, 0.0, 0.5, 200.0, 1.0)], ",".join(f"{c} double" for c in M.FEATURES))
    out = [r.length for r in M.apply_scaler(df, back).collect()]
    assert out[0] == pytest.approx(0.5, abs=1e-6) and out[1] == pytest.approx(1.5076, abs=1e-4)
    # fallbacks when scale/min are absent
    spark.createDataFrame([json.dumps({k: SCALER[k] for k in ("data_min", "data_max", "data_range")})], "string") \
        .write.mode("overwrite").text(p + "2")
    fb = MD.load_scaler(spark, p + "2")
    assert fb["scale"][3] == pytest.approx(1 / 132) and fb["min"][3] == pytest.approx(-1 / 132)


def test_constant_feature_scales_to_zero(spark):
    df = spark.createDataFrame([(0.2, 1.0, 0.0, 3.0, 1.0), (0.4, 1.0, 1.0, 5.0, 1.0)], ",".join(f"{c} double" for c in M.FEATURES))
    sc = M.fit_scaler(df)
    out = M.apply_scaler(df, sc).collect()
    assert [r.textrank for r in out] == [0.0, 0.0] and [r.tfidf for r in out] == pytest.approx([0.0, 1.0])


def test_model_lifecycle(spark, tmp_path):
    pairs = spark.createDataFrame(
        [(i, "The river runs north. Birds fly south every winter. The river floods in spring. "
             "Farmers plant rice near the river. Winter is cold.", "The river floods. Birds fly south.")
         for i in range(12)], "doc_id long, article string, highlights string")
    ts = M.training_set(pairs).persist()
    bal = M.class_balance(ts).first()
    assert bal.total == 60 and bal.positives + bal.negatives == 60
    model = MD.train(ts, epochs=2)
    assert model.is_trained and len(model.history) >= 1
    pred = MD.predict_importance(model, ts).select("importance").collect()
    assert all(0 <= r.importance <= 1 for r in pred)
    path = str(tmp_path / "m")
    model.save(spark, path)
    back = MD.ImportanceModel.load(spark, path)
    a = sorted(r.importance for r in MD.predict_importance(model, ts).collect())
    b = sorted(r.importance for r in MD.predict_importance(back, ts).collect())
    assert a == pytest.approx(b)
    s = SM.summarize(pairs, "article", "hybrid", 2, model=back).collect()
    assert len(s) == 12 and all(r.summary for r in s)
    assert MD.training_metrics(model, ts).count() >= 1


def test_errors(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "doc_id long, article string")
    with pytest.raises(ValueError):
        R.clean_columns(df)  # no highlights column
    with pytest.raises(ValueError):
        SM.summarize(df, "article", method="lsa")
    with pytest.raises(RuntimeError):
        MD.ImportanceModel().transform(df)
    with pytest.raises(RuntimeError):
        MD.ImportanceModel().save(spark, str(tmp_path / "x"))
    with pytest.raises(RuntimeError):
        SM.summarize(df, "article", method="hybrid")
    with pytest.raises(FileNotFoundError):
        MD.ImportanceModel.load(spark, str(tmp_path / "missing"))
    assert MD.load_optional(spark, str(tmp_path / "missing")) is None
    empty = spark.createDataFrame([], ",".join(f"{c} double" for c in M.FEATURES) + ", label double")
    with pytest.raises(ValueError):
        MD.train(empty)
    with pytest.raises(ValueError):
        R.sample_n(df, 5, strict=True)
    with pytest.raises(ValueError):
        SEL.resolve_k(-1)
    assert SEL.resolve_k(0) == 3 and SEL.resolve_k(None) == 3
    assert SM.resolve_method("TFIDF") == "tfidf"


def test_dedup_keeps_first_and_sample_is_exact(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (5, "b"), (4, "c")], "doc_id long, article string")
    assert sorted(r.doc_id for r in R.dedup_keep_first(df).collect()) == [1, 2, 4]
    assert R.sample_n(df, 3).count() == 3 and R.sample_n(df, 10).count() == 5
    assert sorted(R.sample_n(df, 3).collect()) == sorted(R.sample_n(df.repartition(3), 3).collect())
