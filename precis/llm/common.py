"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import warnings
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from precis.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Within, the shuffle files of a query go when it has ended, not when the driver next collects its garbage.

    For jobs of many queries whose results are stored (checkpoints): their shuffles would
    add up on the disks.  A file that is needed again after all is made again by Spark.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def held_out(doc_id: Column) -> Column:
    """True for the rows kept out of training: crc32 of the id as text, mod 5, is 0.

    A null id counts as held out.
    """
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int):
    """A bounded training sample: (texts, labels, share of label 1 among all eligible rows).

    Eligible are labelled documents of ``docs`` that are not held out and have at most
    ``max_chars`` characters; of each class the ``per_class`` with the smallest hash of
    the id are drawn.  So at most ``2 * per_class * max_chars`` characters reach the
    driver, and a class is as large as what is there allows: a narrow scan (ids and
    lengths, joined with the labels) finds what is eligible before anything is drawn.
    Repeated labels of an id count once (the largest), repeated documents once.

    A class whose documents are all longer than ``max_chars`` is an error, because the
    model could not know it; one without any document here is only warned of.
    """
    y = F.col(label).cast("int")
    lab = (
        labels.select("doc_id", y.alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    present = (
        docs.select("doc_id", F.length("text").alias("size")).where(F.col("size").isNotNull())
        .groupBy("doc_id").agg(F.min("size").alias("size")).join(lab, "doc_id")
    )
    checkpoint_dir(docs.sparkSession)
    present = present.withColumn("h", F.xxhash64("doc_id")).checkpoint()  # read three times
    fits = F.col("size") <= max_chars
    counts = {r["y"]: (r["n"], r["k"]) for r in present.groupBy("y").agg(
        F.count("*").alias("n"), F.count(F.when(fits, 1)).alias("k")).collect()}
    for cls in (0, 1):
        n, k = counts.get(cls, (0, 0))
        if n and not k:
            raise ValueError(f"all {n} training documents with {label} = {cls} are longer than {max_chars} characters")
        if counts and not n:
            warnings.warn(f"no training document has {label} = {cls}")
    ids = [
        tuple(r) for cls in (0, 1)
        for r in present.where((F.col("y") == cls) & fits).orderBy("h", "doc_id").limit(per_class).select("doc_id", "y").collect()
    ]
    if not ids:
        return [], np.zeros(0), None
    spark = docs.sparkSession
    picked = spark.createDataFrame(ids, lab.select("doc_id", "y").schema)  # at most 2 * per_class rows
    rows = (
        docs.select("doc_id", "text")
        .where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
        .join(F.broadcast(picked), "doc_id")
        .groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
        .select("doc_id", "text", "y").toArrow()
    )
    rows = rows.sort_by("doc_id")  # the same training order however Spark dealt the rows
    eligible = {c: k for c, (_, k) in counts.items()}
    return rows.column("text").to_pylist(), rows.column("y").to_numpy().astype(np.float64), eligible.get(1, 0) / sum(eligible.values())


def free_name(name: str, taken: list[str]) -> str:
    """``name`` with as many underscores before it as make it no column of ``taken``."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def _plain_scan(docs: DataFrame) -> bool:
    """Whether every row is one row of a file: nothing but selections and filters above one scan."""
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    return node.nodeName() == "LogicalRelation" and "_metadata" not in docs.columns


def with_row_key(docs: DataFrame, name: str) -> DataFrame:
    """The rows with a key column, a struct (f, r) of two longs, that is the same whenever a row is read again.

    Rows of Parquet files have their file (its hash) and their place in it, however Spark
    cuts the files into tasks; no row is copied.  Other tables are numbered and stored.
    """
    if _plain_scan(docs):
        try:
            key = F.struct(F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r"))
            return docs.select("*", key.alias(name))
        except AnalysisException:  # files of another format have no places
            pass
    checkpoint_dir(docs.sparkSession)
    key = F.struct(F.lit(0).cast("long").alias("f"), F.monotonically_increasing_id().alias("r"))
    return docs.withColumn(name, key).checkpoint()


def texts_of(array: pa.Array) -> list[str]:
    """Python strings of an Arrow column, nulls as empty texts."""
    return [t or "" for t in array.to_pylist()]


def give_back() -> None:
    """Return free memory to the system: a worker that waits for its next task should hold none of the last one's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def returning(run):
    """The body of a ``mapInArrow`` that gives its memory back when it is through."""
    def wrapped(it):
        yield from run(it)
        give_back()

    return wrapped


def portions(it: Iterator[pa.Array], rows: int = 512) -> Iterator[pa.Array]:
    """The Arrow arrays of an iterator UDF in portions, so that few rows at once become Python objects."""
    for a in it:
        for i in range(0, len(a), rows):
            yield a.slice(i, rows)
        del a
    give_back()


def slices(batch_rows: int, sizes, max_size: int):
    """(start, end) row ranges whose sizes sum to at most ``max_size``; a larger row stands alone."""
    start, total = 0, 0
    for i in range(batch_rows):
        if i > start and total + sizes[i] > max_size:
            yield start, i
            start, total = i, 0
        total += sizes[i]
    if batch_rows > start:
        yield start, batch_rows


def adam(params: dict, grads: dict, state: dict, lr: float, t: int) -> None:
    """One Adam step in place on every array of ``params``."""
    for k, g in grads.items():
        m, v = state.setdefault(k, (np.zeros_like(params[k]), np.zeros_like(params[k])))
        m *= 0.9
        m += 0.1 * g
        v *= 0.999
        v += 0.001 * g * g
        params[k] -= lr * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
