"""Sources/sinks round trips and the streaming wrapper."""

import os

import pytest
from pyspark.sql import functions as F

from precis.operators import summarize as SM
from precis.sources import io as S
from precis.streaming import summaries as ST

SF = "/root/testdata/sf0.001"


def test_csv_round_trip_and_reuse(spark, tmp_path):
    rows = [(1, 'He said "hi",\nthen left. Second line here.', "He left."), (2, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, article string, highlights string")
    p = str(tmp_path / "raw.csv")
    S.write_table(df.coalesce(1), p, "csv")
    back = S.read_corpus(spark, p, "csv")
    assert sorted(back.collect()) == sorted(df.collect())
    with pytest.raises(ValueError):
        S.read_corpus(spark, p, "csv", id_col="missing")
    clean = str(tmp_path / "clean")
    assert not S.path_exists(spark, clean)
    first = S.load_or_build_clean(spark, p, clean)
    assert S.path_exists(spark, clean)
    assert sorted(first.collect()) == sorted(S.load_or_build_clean(spark, p, clean).collect())


def test_missing_column_raises(spark, tmp_path):
    p = str(tmp_path / "bad.parquet")
    spark.createDataFrame([(1, "a")], "doc_id long, article string").write.parquet(p)
    with pytest.raises(ValueError):
        S.read_corpus(spark, p)


def test_text_documents_and_summary_sink(spark, tmp_path):
    d = tmp_path / "docs"
    d.mkdir()
    (d / "a.txt").write_text("First point. Second point. Third point. Fourth point.", encoding="utf-8")
    (d / "b.txt").write_text("Only one.", encoding="utf-8")
    docs = S.read_text_documents(spark, str(d))
    out = SM.summarize(docs, k=2, keep=("path",))
    got = {os.path.basename(r.path): r.summary for r in out.collect()}
    assert got["b.txt"] == "Only one." and len(got["a.txt"].split(". ")) == 2
    S.write_summaries(out, str(tmp_path / "sum_txt"), "text")
    assert spark.read.text(str(tmp_path / "sum_txt")).count() == 2
    lit = SM.summarize(S.literal_documents(spark, "A b. C d. E f. G h."), k=1)
    assert lit.count() == 1


def test_stream_equals_batch(spark, tmp_path):
    out = str(tmp_path / "stream_out")
    q = ST.summarize_stream(ST.document_stream(spark, SF, glob="documents.parquet"), out, available_now=True,
                            name="t1")
    q.awaitTermination(300)
    streamed = spark.read.parquet(out).drop("epoch")
    batch = SM.summarize(spark.read.parquet(f"{SF}/documents.parquet"))
    assert sorted(streamed.collect()) == sorted(batch.collect())
