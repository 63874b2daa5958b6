"""Incremental clean corpus, summary log runs, one file per summary."""

import os

import pytest
from pyspark.sql import functions as F

from precis import config as C
from precis.operators import corpus as R
from precis.operators import log as L
from precis.sources import clean_store as CS
from precis.sources import io as S
from precis.sources import store
from precis.sources import summary_files as SF

SCHEMA = "doc_id long, article string, highlights string"


def article(i, copy=0):
    return " ".join(f"word{i}x{j}" for j in range(35)) + " <b>end</b>" * (copy + 1)


def raw(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def rows_of(df):
    return sorted((r["doc_id"], r["article"], r["highlights"]) for r in df.collect())


def test_first_build_equals_the_cleaning_in_one_plan(spark, tmp_path):
    rows = [(i, article(i % 7), f"one two three {i}") for i in range(40)] + [(100, "short", "a b c"), (101, None, "x y z"), (-5, article(3), "least id")]
    raw(spark, str(tmp_path / "raw"), rows)
    for bound in (10, 1_000_000):  # fetched by a shuffle, and by a broadcast of what goes
        got = CS.build_clean(spark, str(tmp_path / "raw"), str(tmp_path / f"clean{bound}"), broadcast_rows=bound)
        assert rows_of(got) == rows_of(R.clean_corpus(S.read_corpus(spark, str(tmp_path / "raw"))))
        assert len(rows_of(got)) == 7


def test_new_files_are_the_only_ones_read(spark, tmp_path):
    p, c = str(tmp_path / "raw"), str(tmp_path / "clean")
    raw(spark, p, [(i, article(i), f"one two three {i}") for i in range(10)])
    read = []

    def reader(files, known):
        read.append((len(files), known))
        return S.read_corpus(spark, files, first_file=known)

    first = rows_of(CS.build_clean(spark, p, c, read=reader))
    assert rows_of(CS.build_clean(spark, p, c, read=reader)) == first and read == [(1, 0)]
    # a smaller id of a stored article goes; of new copies the smallest id stays
    raw(spark, p, [(-1, article(3), "a copy of stored"), (50, article(20), "later id here"), (40, article(20), "first id here"), (41, article(21), "all new here")])
    second = rows_of(CS.build_clean(spark, p, c, read=reader))
    assert read == [(1, 0), (1, 1)]
    assert [r for r in second if r in first] == first and {r[0] for r in second} - {r[0] for r in first} == {40, 41}
    # a part without a manifest does not count and is written again
    generation = store.Parts(spark, c).committed()[1]["folder"]
    parts = store.Parts(spark, generation)
    spark.createDataFrame([(9, "half", "written")], SCHEMA).write.parquet(parts.data("rows", 3))
    raw(spark, p, [(70, article(30), "third file here")])
    assert {r[0] for r in rows_of(CS.build_clean(spark, p, c, read=reader))} == {r[0] for r in second} | {70}


def test_changed_settings_and_files_build_anew(spark, tmp_path):
    p, c = str(tmp_path / "raw"), str(tmp_path / "clean")
    raw(spark, p, [(1, article(1), "a b c"), (2, article(2), "a b")])
    assert [r[0] for r in rows_of(S.load_or_build_clean(spark, p, c))] == [1]
    loose = C.DEFAULT.with_(min_summary_words=2)
    assert [r[0] for r in rows_of(S.load_or_build_clean(spark, p, c, loose))] == [1, 2]
    (name, _, _), = store.data_files(spark, p)
    spark.createDataFrame([(5, article(5), "a b c d")], SCHEMA).coalesce(1).write.mode("overwrite").parquet(p)  # another file
    assert [r[0] for r in rows_of(S.load_or_build_clean(spark, p, c, loose))] == [5]
    assert name != store.data_files(spark, p)[0][0]


def test_digests_are_aggregated_by_hash_without_texts(spark):
    rows = spark.range(100).select(R.digest_of(F.col("id").cast("string")).alias("digest"), F.col("id").alias("doc_id"), F.col("id").alias("place"))
    plan = R.first_places(rows)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    many = [(b"a", 5, 1), (b"a", 5, 0), (b"a", 6, 2), (b"b", None, 9), (b"b", -(1 << 61), 3), (b"c", (1 << 61), (1 << 61)), (b"c", (1 << 61), 7), (b"d", -3, 2), (b"d", -3, 4)]
    got = R.first_places(spark.createDataFrame(many, "digest binary, doc_id long, place long")).collect()
    assert sorted((bytes(r[0]), r[1], r[2]) for r in got) == [(b"a", 5, 0), (b"b", None, 9), (b"c", 1 << 61, 7), (b"d", -3, 2)]


def entries(spark, ids, tag):
    return spark.createDataFrame([(i, f"p{i}", f"{tag}{i}") for i in ids], "seq long, preview string, summary string").repartition(3)


def test_a_repeated_run_leaves_one_copy_and_the_latest_are_the_last_written(spark, tmp_path):
    p = str(tmp_path / "log")
    with pytest.raises(FileNotFoundError):
        L.read_log(spark, p)
    a = L.append_log(entries(spark, range(100, 130), "a"), p)
    b = L.append_log(entries(spark, range(4), "b"), p, "second")
    assert L.append_log(entries(spark, range(4), "again"), p, "second") == b  # a retry after the commit
    log = L.read_log(spark, p)
    assert log.count() == 34 and a != b
    last = L.recent(log, 5).orderBy("position").collect()
    assert [r["summary"] for r in last] == ["b3", "b2", "b1", "b0", "a129"]
    assert {r["total"] for r in last} == {34} and [r["position"] for r in last] == [1, 2, 3, 4, 5]
    # a run that failed before its commit does not count, and its rows are replaced
    entries(spark, [1], "x").write.parquet(store.Parts(spark, p).data("third", 3))
    assert L.read_log(spark, p).count() == 34
    L.append_log(entries(spark, [9], "c"), p, "third")
    assert [r["summary"] for r in L.recent(L.read_log(spark, p), 2).orderBy("position").collect()] == ["c9", "b3"]
    with pytest.raises(FileExistsError):
        store.Parts(spark, p).commit(3, {})
    assert L.recent(entries(spark, [], "n"), 5).count() == 0


def files(path):
    return {f: open(os.path.join(path, f), encoding="utf-8").read() for f in os.listdir(path)}


def test_one_file_per_summary(spark, tmp_path):
    p = str(tmp_path / "out")
    rows = [(str(i), f"Summary {i}. ü🙂\n") for i in range(40)] + [(None, "no id"), ("a/b", "odd"), ("..", "dots"), ("x", "b"), ("x", "a"), ("e", None), ("", "empty")]
    df = spark.createDataFrame(rows, "doc_id string, summary string").repartition(4)
    SF.write_summary_files(df, p)
    got = files(p)
    assert len(got) == len(rows)
    assert {got[f"{i}.txt"] for i in range(40)} == {f"Summary {i}. ü🙂\n" for i in range(40)}
    assert (got["null.txt"], got["a%2Fb.txt"], got["x.txt"], got["x~2.txt"], got["e.txt"], got["_.txt"], got["...txt"]) == (
        "no id", "odd", "a", "b", "", "empty", "dots")
    SF.write_summary_files(df.limit(3), p)
    assert len(files(p)) == 3
    SF.write_summary_files(df.where("doc_id = '7'"), p, mode="append")
    assert "7.txt" in files(p) and len(files(p)) >= 3


def test_a_failed_and_repeated_task_leaves_each_file_once(spark, tmp_path):
    p = str(tmp_path / "out")
    writer = SF._Writer(p, True)
    os.makedirs(p)

    class Task:
        def __init__(self, attempt):
            self.attempt = attempt

        def partitionId(self):
            return 0

        def taskAttemptId(self):
            return self.attempt

    def broken():
        yield {"name": "1.txt", "text": "one"}
        raise RuntimeError("lost")

    import pyspark

    real = pyspark.TaskContext.get
    try:
        pyspark.TaskContext.get = staticmethod(lambda: Task(1))
        with pytest.raises(RuntimeError):
            writer.write(broken())
        assert [f for f in files_of(p) if not f.startswith("_staged")] == []
        pyspark.TaskContext.get = staticmethod(lambda: Task(2))
        done = writer.write(iter([{"name": "1.txt", "text": "one"}, {"name": "2.txt", "text": "two"}]))
        writer.commit([done])
        assert files(p) == {"1.txt": "one", "2.txt": "two"}
        lost = SF._Writer(p, True)
        message = lost.write(iter([{"name": "3.txt", "text": "three"}]))
        lost.abort([message, None])
        assert files(p) == {"1.txt": "one", "2.txt": "two"}
    finally:
        pyspark.TaskContext.get = real


def files_of(path):
    return os.listdir(path)
