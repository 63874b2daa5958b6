"""Vector tables for the searches: clean rows, shards and query blocks.

A search takes a stated query set against all rows.  Rows are dealt over shards of a
bounded size and queries over blocks of a bounded size; every (shard, block) pair is
one Arrow group, so a task holds one shard and one block whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F


def clean(df: DataFrame, vec_id: str, vector: Column, zeros: bool, more: tuple = ()) -> DataFrame:
    """vec_id, v (array<double>), the columns ``more``, dim: the rows that take part.

    Rows with a null id, a null or empty vector, or a null or non-finite component
    are left out, and zero vectors too unless ``zeros``.
    """
    d = df.select(F.col(vec_id).cast("long").alias("vec_id"), vector.cast("array<double>").alias("v"), *more)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    d = d.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite)
    if not zeros:
        d = d.where(F.exists("v", lambda x: x != 0))
    return d.withColumn("dim", F.size("v"))


def queries_of(rows: DataFrame, every: int) -> DataFrame:
    """query_id, q, dim of the rows whose id is divisible by ``every``; a repeated id asks once, with its smallest vector."""
    d = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    return d.groupBy("query_id").agg(F.min("q").alias("q")).withColumn("dim", F.size("q"))


def even(shards: int) -> Column:
    """A shard number that spreads rows evenly, repeated rows included."""
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int")


def matrix(t: pa.Table, column: str) -> np.ndarray:
    a = t.column(column).combine_chunks()
    flat = a.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(a), -1) if len(a) else np.zeros((0, 0))


def search(rows: DataFrame, queries: DataFrame, blocks: int, shards: DataFrame,
           run: Callable, schema: str) -> DataFrame:
    """Apply ``run(ids, X, query_ids, Q)`` to every pair of a shard and a query block.

    ``rows``: vec_id, v, dim, shard.  ``shards``: the (dim, shard) pairs that tell each
    query where to go; a query only meets vectors of its own dimension.  They are 8
    bytes for every shard, so broadcast: ten billion vectors make some megabytes.  ``run`` returns an Arrow table of ``schema``.
    """
    left = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = (
        queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        .join(F.broadcast(shards.select(F.col("dim").alias("dim"), F.col("shard").alias("shard"))), "dim")
    )
    names = ["query_id", "vec_id", "score"]

    def pair(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, qids = a.column("vec_id").to_numpy(), b.column("query_id").to_numpy()
        if not len(ids) or not len(qids):
            out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        else:
            out = run(ids, matrix(a, "v"), qids, matrix(b, "q"))
        kind = pa.int64() if schema.endswith("score long") else pa.float64()
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], kind)], names)

    keys = ["dim", "shard", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(pair, schema)


def best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each query with their rank; ties to the smaller id."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
