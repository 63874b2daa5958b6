"""Physical-plan checks and a DuckDB oracle run on sf0.001."""

import os

import duckdb
import pytest

import __spark_entry__ as ENTRY
from scripts.check_oracle import TABLES, digest

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tfidf_summary_plan_has_one_shuffle_and_no_udf(spark):
    p = plan(ENTRY.queries()["summaries_tfidf"](spark, SF))
    assert p.count("Exchange hashpartitioning") == 1
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin", "SortMergeJoin"):
        assert bad not in p
    assert "WindowGroupLimit" in p


def test_scoring_and_ngram_plans_have_no_extra_exchange(spark):
    for q in ("tfidf_scores", "term_freq", "sentence_lengths"):
        p = plan(ENTRY.queries()[q](spark, SF))
        assert p.count("Exchange") == 1, q
        assert "BatchEvalPython" not in p and "CartesianProduct" not in p


def test_textrank_uses_vectorised_kernel_without_new_shuffle(spark):
    p = plan(ENTRY.queries()["textrank_scores"](spark, SF))
    assert "MapInArrow" in p and p.count("Exchange") == 1 and "FlatMapGroupsInPandas" not in p


def test_clean_corpus_cleans_once(spark):
    p = plan(ENTRY.queries()["length_filter"](spark, SF))  # what clean_corpus stores
    assert "Generate explode(array(struct(" in p  # filters stay above the cleaning
    assert "CartesianProduct" not in p and "BatchEvalPython" not in p


def test_parquet_scan_is_pruned(spark):
    p = plan(ENTRY.queries()["summaries_tfidf"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p


def test_entry_smoke(spark):
    df = ENTRY.entry(spark)
    assert df.columns == ["doc_id", "n_sent", "summary"] and df.count() > 0


ORACLE_SUBSET = ["summaries_tfidf", "tfidf_scores", "summaries_textrank", "clean_corpus", "html_to_text",
                 "rouge_l", "weak_labels", "scaler_fit", "dedup_keep_first", "sample_n"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", ORACLE_SUBSET)
def test_oracle_matches(spark, duck, name):
    sp = ENTRY.queries()[name](spark, SF).toPandas()
    dk = duck.execute(ENTRY.oracle_sql()[name]).df()
    c1, _, h1 = digest(sp)
    c2, _, h2 = digest(dk)
    assert c1 == c2 and len(sp) == len(dk) and h1 == h2


def test_every_query_has_an_oracle_or_is_rows_only():
    from precis.plans import oracles, queries

    rows_only = {"train_importance", "training_metrics_trained", "predict_importance_trained", "summaries_hybrid_trained",
                 "textrank_clipped"}
    q, o = set(queries.queries()), set(oracles.oracle_sql())
    assert o <= q and q - o <= rows_only
    assert q <= set(ENTRY.queries()) and o <= set(ENTRY.oracle_sql()) <= set(ENTRY.queries())


def test_kernels_run_without_package_on_worker_path(tmp_path):
    """UDF/kernel code is pickled by value: a driver started elsewhere works."""
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = tmp_path / "run.py"
    script.write_text(
        "import sys\n"
        f"sys.path.insert(0, {repo!r})\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "import __spark_entry__ as E\n"
        "print('N', E.queries()['summaries_textrank'](s, '/root/testdata/sf0.001').count(),"
        " E.queries()['rouge_l'](s, '/root/testdata/sf0.001').count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, str(script)], cwd=str(tmp_path), env=env, capture_output=True,
                         text=True, timeout=600)
    assert "N 200" in out.stdout, out.stderr[-2000:]


def test_side_by_side_reads_its_input_once(spark):
    p = plan(ENTRY.queries()["summaries_side_by_side"](spark, SF))
    assert p.count("FileScan parquet") == 1 and "Join" not in p
    assert p.count("MapInArrow") == 1


def test_texts_are_not_aggregated(spark):
    """Keep-first de-duplication: texts are stored once, then dropped by place."""
    p = plan(ENTRY.queries()["clean_corpus"](spark, SF))
    assert "SortAggregate" not in p and "Exchange hashpartitioning" not in p
    for name, scans in (("summary_log", 1), ("compression_ratio", 1), ("training_set", 2), ("rouge_1", 2), ("compare_models", 2)):
        p = plan(ENTRY.queries()[name](spark, SF))
        assert p.count("FileScan") == scans, name


def test_queries_run_no_job_while_planned(spark, monkeypatch):
    from precis.plans import queries as Q

    read = {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "conversations")}  # reading a schema is a job
    monkeypatch.setattr(Q, "table", lambda spark, sf_dir, name: read[name])
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "planning")
    for name in ("scaler_transform", "training_set", "summaries_hybrid", "compare_all_models", "summary_log", "textrank_vectors"):
        Q.queries()[name](spark, SF)
    assert len(tracker.getJobIdsForGroup("planning")) == 0
    spark.sparkContext.setJobGroup("", "")


def test_partitions_follow_the_size_of_the_input(spark, monkeypatch):
    from precis.operators import sentences as N

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    size = os.path.getsize(f"{SF}/documents.parquet")
    assert N.hash_partition(docs, "doc_id").rdd.getNumPartitions() == 8
    monkeypatch.setattr(N, "MOST_BYTES", size // 30)
    assert 30 <= N.hash_partition(docs, "doc_id").rdd.getNumPartitions() <= 32
    joined = docs.join(docs.select("doc_id"), "doc_id")  # the sources' sizes, not a product
    assert N.hash_partition(joined, "doc_id").rdd.getNumPartitions() <= 64
    unknown = spark.createDataFrame(spark.sparkContext.parallelize([(1,)]), "doc_id int")
    assert N.hash_partition(unknown, "doc_id").rdd.getNumPartitions() == 8
