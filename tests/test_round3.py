"""Term streams whose memory grows no faster than the input."""

import random
import re

import pytest
from pyspark.sql import functions as F

from precis.operators import sentences as N
from precis.operators import summarize as SM
from precis.operators import textrank as TR
from precis.operators import tfidf as TF
from precis.plans import queries as Q


def _docs(spark, path, n=60):
    rnd = random.Random(7)
    words = ["the", "river", "rice", "farm", "boat", "rain", "is", "wide", "cold", "bank"]
    rows = [(i, " ".join(" ".join(rnd.choices(words, k=6)).capitalize() + "." for _ in range(rnd.randint(1, 9)))) for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def test_partitions_hold_few_megabytes_of_stored_text(spark, tmp_path):
    wide = F.concat(*[F.sha2(F.concat_ws("-", F.col("id"), F.lit(i)), 256) for i in range(16)])
    spark.range(30_000).select(F.col("id").alias("doc_id"), wide.alias("text")).coalesce(2).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    # 30 MB: 8 partitions, the session's setting, would hold 4 MB each
    assert N.hash_partition(docs, "doc_id").rdd.getNumPartitions() >= 12


def test_partitions_follow_the_input_behind_the_kernel_too(spark, tmp_path, monkeypatch):
    docs = _docs(spark, f"{tmp_path}/d")
    monkeypatch.setattr(N, "MOST_BYTES", N._stored_bytes(docs) // 40)
    sent = N.sentence_table(SM.prepare_documents(docs), "doc_id")
    feature = TR.textrank_feature(TR.textrank_scores(TR.sentence_vectors(sent)))
    assert feature.rdd.getNumPartitions() >= 40
    for method in ("textrank", "tfidf"):
        assert SM.summarize(docs, method=method).rdd.getNumPartitions() >= 40, method
    assert SM.summarize_side_by_side(docs).rdd.getNumPartitions() >= 40


def test_stop_words_have_no_rows_but_every_sentence_has_one(spark):
    sent = spark.createDataFrame([(1, 2, 0, 4, "The river is wide."), (1, 2, 1, 2, "It is."), (2, 0, None, None, None)],
                                 "doc_id long, n_sent int, sent_idx int, n_words long, sentence string")
    rows = TF.term_rows(sent, carry_text=True).collect()
    got = sorted((r.doc_id, -1 if r.sent_idx is None else r.sent_idx, r.term or "", r.sentence or "") for r in rows)
    assert got == [(1, 0, "", "The river is wide."), (1, 0, "river", ""), (1, 0, "wide", ""), (1, 1, "", "It is."), (2, -1, "", "")]
    scores = {(r.doc_id, r.sent_idx): r.score for r in TF.tfidf_scores(sent, min_df=1).collect()}
    assert set(scores) == {(1, 0), (1, 1), (2, None)} and scores[1, 0] > 0 == scores[1, 1] == scores[2, None]


TERM_STREAM = ("sentence_features", "textrank_scores", "sentence_vectors", "strongest_neighbours", "textrank_feature", "tfidf_feature",
               "tfidf_scores", "top_sentences", "tfidf_weights", "pruned_vocab", "doc_freq")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Two document tables of some 8 and 16 MB."""
    path = tmp_path_factory.mktemp("stored")
    wide = F.concat(*[F.sha2(F.concat_ws("-", F.col("id"), F.lit(i)), 256) for i in range(16)])
    for part, n in (("small", 8_000), ("large", 16_000)):
        d = spark.range(n).select(F.col("id").alias("doc_id"), wide.alias("text"))
        d.coalesce(2).write.parquet(f"{path}/{part}/documents.parquet")
    return path


@pytest.mark.parametrize("name", TERM_STREAM)
def test_every_shuffle_of_a_term_stream_follows_the_input(spark, stored, name):
    sizes = {}
    setting = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # made for small tables
    try:
        for part in ("small", "large"):
            plan = Q.queries()[name](spark, f"{stored}/{part}")._jdf.queryExecution().executedPlan().toString()
            sizes[part] = [int(n) for n in re.findall(r"hashpartitioning\([^()]*, (\d+)\)", plan)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", setting)
    assert sizes["small"] and min(sizes["small"]) >= 3
    assert [n / m for m, n in zip(sizes["small"], sizes["large"], strict=True)] == pytest.approx([2] * len(sizes["small"]), rel=0.2)
