"""Every row has its summary, whatever its id; kept columns stay with their row."""

import pytest
from pyspark.sql import functions as F

from precis import config as C
from precis.functions.porter import rouge_stem_sql
from precis.functions.stem import rouge_stem
from precis.operators import features as M
from precis.operators import model as MD
from precis.operators import summarize as SM
from precis.operators.sentences import keyed

TEXTS = [
    "Cats chase mice. Dogs chase cats. Xi omicron pi. Mice run from cats.",
    "Lambda mu nu. Cats sleep. Dogs chase cats. Nu xi omicron.",
    "", None, "One sentence only.", "Alpha beta. Gamma delta alpha. Beta gamma. Alpha delta beta gamma.",
]


def table(spark):
    # ids null and repeated; identical rows; the text of a document under the id of another
    rows = [(None if i % 3 == 0 else 1, TEXTS[i % len(TEXTS)], i, "k%d" % i) for i in range(18)]
    rows += [(7, TEXTS[0], 99, "same")] * 3
    return spark.createDataFrame(rows, "doc_id int, text string, n int, sentence string"), rows


@pytest.mark.parametrize("method", ["tfidf", "textrank", "lead"])
def test_rows_with_null_and_repeated_ids(spark, method):
    df, rows = table(spark)
    # each text on its own, under an id of its own
    alone = {t: SM.summarize(spark.createDataFrame([(i, t)], "doc_id int, text string"), method=method, k=2).first()["summary"]
             for i, t in enumerate(TEXTS)}
    got = SM.summarize(df, method=method, k=2, keep=("n", "text", "sentence"), status=True).collect()
    want = sorted(((r[0], r[2], r[1], r[3], alone[r[1]]) for r in rows), key=str)
    assert sorted(((r["doc_id"], r["n"], r["text"], r["sentence"], r["summary"]) for r in got), key=str) == want
    for r in got:
        assert r["status"] == ("empty" if r["n_sent"] == 0 else "whole" if r["n_sent"] <= 2 else "scored")
    both = SM.summarize_side_by_side(df, methods=(method, "lead"), k=2, keep=("n", "text")).collect()
    assert sorted(((r["doc_id"], r["n"], r["text"], r[f"{method}_summary"]) for r in both), key=str) == \
        sorted(((w[0], w[1], w[2], w[4]) for w in want), key=str)


def test_plan_of_kept_columns_has_one_exchange_and_one_scan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = SM.summarize(docs, keep=("text", "lang"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("FileScan") == 1 and "Join" not in plan


def test_rows_keep_their_numbers_when_their_order_changes(spark):
    df = spark.range(1000).selectExpr("id % 97 as a", "cast(id as string) as b")
    one = {tuple(r) for r in keyed(df.repartition(4, "a")).collect()}
    other = {tuple(r) for r in keyed(df.orderBy(F.desc("b")).repartition(4, "a")).collect()}
    assert one == other and len({r[2] for r in one}) == 1000


class Fixed:
    """A model that scores a sentence by a formula of its features."""

    is_trained = True

    def transform(self, feats):
        return feats.withColumn("importance", F.col("tfidf") - F.col("position") + F.col("textrank") / 3)


def test_hybrid_side_by_side_is_one_branch_and_equals_each_method(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    methods = ("tfidf", "hybrid", "textrank", "lead")
    both = SM.summarize_side_by_side(docs, methods=methods, k=2, model=Fixed())
    assert both._jdf.queryExecution().executedPlan().toString().count("Scan") == 1
    rows = {r["doc_id"]: r for r in both.collect()}
    assert len(rows) == 60
    for m in methods:
        alone = {r["doc_id"]: r["summary"] for r in SM.summarize(docs, method=m, k=2, model=Fixed()).collect()}
        assert alone == {i: r[f"{m}_summary"] for i, r in rows.items()}, m


def test_safe_hybrid_and_available_methods(spark, tmp_path):
    df, rows = table(spark)
    got = SM.summarize_safe(df, k=2, keep=("n",)).collect()
    assert len(got) == len(rows) and {(r["summary"], r["status"]) for r in got} == {("", "untrained")}
    got = SM.summarize_safe(df, k=2, model=Fixed()).collect()
    assert {r["status"] for r in got} == {"empty", "whole", "scored"}
    with pytest.warns(UserWarning):
        out = SM.summarize_available(df, k=2, model_path=str(tmp_path / "none"), keep=("n",))
    assert "hybrid_summary" not in out.columns and out.count() == len(rows)
    assert SM.available_methods(("hybrid", "lead"), Fixed()) == ["hybrid", "lead"]


def test_hybrid_on_sentence_vectors(spark):
    text = "Alpha beta gamma. Delta epsilon. Zeta eta theta iota. Kappa lambda."
    vecs = [[1.0, 0.0], [1.0, 0.2], [0.9, 0.3], [0.0, 1.0]]
    df = spark.createDataFrame([(1, text, vecs), (1, text, vecs)], "doc_id int, text string, v array<array<double>>")

    class ByRank(Fixed):
        def transform(self, feats):
            return feats.withColumn("importance", F.col("textrank"))

    a = SM.summarize(df, method="hybrid", k=2, model=ByRank(), vectors="v").collect()
    b = SM.summarize(df, method="textrank", k=2, vectors="v").collect()
    assert [r["summary"] for r in a] == [r["summary"] for r in b] and len(a) == 2


def test_training_set_of_pairs_with_repeated_and_null_ids(spark):
    pairs = [(1, TEXTS[0], "Dogs chase cats."), (1, TEXTS[1], "Cats sleep all day."), (None, TEXTS[5], "Alpha beta."), (2, TEXTS[0], " "), (3, None, "x")]
    df = spark.createDataFrame(pairs, "doc_id int, article string, highlights string")
    got = M.training_set(df).collect()
    assert len(got) == 12 and sum(r["doc_id"] is None for r in got) == 4
    # each pair alone gives the same rows
    alone = []
    for i, a, h in pairs[:3]:
        alone += M.training_set(spark.createDataFrame([(i, a, h)], df.schema)).collect()
    key = lambda r: tuple(str(round(x, 9) if isinstance(x, float) else x) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, alone))


def test_batch_stems_equal_the_generated_expression(spark):
    words = [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select(
        F.explode(F.split(F.lower("text"), "[^a-z0-9]+"))).distinct().collect()]
    words += ["yyyy", "sayyid", "syzygy", "yoyo", "ied", "dies", "eed", "ing", "sing", "2nds", "ionion", "logi", "biologi", "fullinesses",
              "ational", "alli", "rationalli", "hopping", "ssing", "ally", "agreed", "feed", "ll", "controlle", "y", "", "a1ing", "cryy"]
    suffixes = [s for s in ("ational enci izer bli alli entli ousli ization ator alism iveness fulness aliti iviti biliti fulli icate ative alize "
                            "iciti ical ful ness al ance er ic able ant ement ment ent sion tion ou ism ate iti ous ive ize ed ing eed ies s y ly e").split()]
    words += [a + b + c for a in ("tr", "oa", "happ", "by", "x", "relat") for b in suffixes for c in ("", "s", "ing", "ly")]
    df = spark.createDataFrame([(w,) for w in sorted(set(words))], "w string").withColumn("s", F.expr(rouge_stem_sql("w")))
    assert [(r["w"], r["s"], rouge_stem(r["w"])) for r in df.collect() if rouge_stem(r["w"]) != r["s"]] == []
