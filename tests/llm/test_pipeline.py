"""The corpus pipeline against brute-force versions of its stages."""

import os
import subprocess
import sys

import pyspark.sql.functions as F
import pytest

import corpus_pipeline
import corpus_pipeline as P
from precis.llm import quality, secret_scan, toxicity
from tests.llm.test_searches import brute

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.abspath(P.__file__))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The result of every stage, as the check runs them."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (_, stage) in enumerate(P.STAGES):
        out.append(docs)
        stage(spark, docs, SF).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return [*out, docs]


def test_columns_and_result(spark, stored):
    assert all(d.columns == stored[0].columns for d in stored[:-1])
    run = P.run(spark, SF)
    key = [c for c in run.columns if not c.startswith("bin")]
    assert sorted(map(tuple, run.select(*key).collect())) == sorted(map(tuple, stored[-1].select(*key).collect()))


def test_filters_follow_the_scores(spark, stored):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for before, after, mod, good in ((stored[0], stored[1], quality, lambda s: s >= 0.3), (stored[1], stored[2], toxicity, lambda s: s < 0.5)):
        model = mod.train(before, labels)
        rows = before.select("doc_id", "text").collect()
        want = {r["doc_id"] for r, s in zip(rows, model.score([r["text"] or "" for r in rows])) if good(s)}
        assert {r["doc_id"] for r in after.select("doc_id").collect()} == want


def test_one_of_each_group_stays(stored):
    texts = [(r["doc_id"], r["text"]) for r in stored[2].collect()]
    groups = brute(texts, 5, 80, 100)
    assert sorted(r["doc_id"] for r in stored[3].select("doc_id").collect()) == sorted(i for i, (_, low) in groups.items() if low == i)


def test_near_duplicates_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "x y"), (None, "x y"), (7, None), (8, ""), (None, None), (2, "q r")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' as sid", "3 as n", "4 as place")
    kept = [(r["doc_id"], r["text"]) for r in P.stage_near_duplicates(spark, df, SF).collect()]
    want = [(1, "a b c d e f"), (None, "x y"), (7, None), (8, ""), (None, None), (2, "q r")]
    assert sorted(kept, key=str) == sorted(want, key=str)
    assert P.stage_near_duplicates(spark, df.limit(0), SF).count() == 0


def test_secrets_are_masked_and_nothing_goes(stored):
    before = {r["doc_id"]: r for r in stored[3].collect()}
    after = {r["doc_id"]: r for r in stored[4].collect()}
    assert before.keys() == after.keys()
    for i, r in after.items():
        base = secret_scan.scan_text(before[i]["text"])[0]
        assert (r["text"] == before[i]["text"]) or base or "[secret]" in r["text"]
        assert r["n_chars"] == len(r["text"])
        assert not [x for x in secret_scan.scan_text(r["text"])[0] if x[1] > 0]


def test_every_document_is_packed(stored):
    words = {r["doc_id"]: len((r["text"] or "").split()) + 1 for r in stored[4].collect()}
    got = {r["doc_id"]: r["n"] for r in stored[5].groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert got == words


def test_the_rest_works_without_the_subpackage(tmp_path):
    """Entry module and queries import where corpus_pipeline.py and the subpackage are missing."""
    os.symlink(f"{ROOT}/__spark_entry__.py", tmp_path / "__spark_entry__.py")
    code = (
        "import sys; sys.modules['precis.llm'] = None\n"
        f"sys.path[:0] = [{ROOT!r}]\n"
        "import importlib.util as u\n"
        "sys.meta_path.insert(0, type('B', (), {'find_spec': staticmethod(lambda n, *a: (_ for _ in ()).throw("
        "ModuleNotFoundError(n, name=n)) if n == 'corpus_pipeline' else None)}))\n"
        "import __spark_entry__ as e\n"
        "assert not [k for k in e.queries() if k.startswith('op') or k == 'pipeline'] and e.oracle_sql()\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)


def test_near_duplicates_of_a_table_with_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([("b", text, 1, 2), ("a", text, 3, 4), (None, text, 5, 6), ("c", "other words entirely", 7, 8), ("d", None, 9, 9), ("e", "", 9, 9)],
                               "doc_id string, text string, __row int, sid int")
    kept = corpus_pipeline.stage_near_duplicates(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(tuple(r) for r in kept.select("doc_id", "__row").collect()) == [("a", 3), ("c", 7), ("d", 9), ("e", 9)]
