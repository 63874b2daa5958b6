"""Summary log (L1-L2): an append-only table of produced summaries."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from precis import config as C
from precis.functions.text import preview
from precis.sources.store import Parts


def log_entries(summaries: DataFrame, text_col: str, summary_col: str, model: str, k: int,
                id_col: str = "doc_id", seconds: float | None = None,
                preview_chars: int = C.DEFAULT.preview_chars) -> DataFrame:
    """L1: (seq, preview, summary, model, k, seconds) rows for one batch."""
    return summaries.select(
        F.col(id_col).alias("seq"),
        preview(text_col, preview_chars).alias("preview"),
        F.col(summary_col).alias("summary"),
        F.lit(C.MODEL_NAMES.get(model, model)).alias("model"),
        F.lit(int(k)).alias("k"),
        F.lit(seconds).cast("double").alias("seconds"),
    )


def append_log(entries: DataFrame, path: str, run_id: str | None = None) -> str:
    """Append a batch to the log table as one run; a run id that is in the log already changes nothing.

    Entries get (run_no, pos): runs are numbered as they are committed, entries by ``seq``
    within their run.  A run counts once its manifest is written, which is the last step
    and never replaces another: a failed run leaves nothing, a repeated one one copy, and
    of two runs at once the second one fails and may be repeated.
    """
    run_id = run_id or uuid.uuid4().hex
    parts = Parts(entries.sparkSession, path)
    before = parts.committed()
    if any(m["run_id"] == run_id for m in before.values()):
        return run_id
    number = max(before, default=0) + 1
    # sorted by range, so the numbers ascend with seq through all partitions
    ordered = entries.repartitionByRange("seq").sortWithinPartitions("seq")
    ordered.withColumn("pos", F.monotonically_increasing_id()).write.mode("overwrite").parquet(parts.data(run_id, number))
    parts.commit(number, {"run_id": run_id, "time": time.time()})
    return run_id


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Every entry of the committed runs, with run_no, run_id and pos."""
    parts = Parts(spark, path)
    found = None
    for n, m in parts.committed().items():
        run = spark.read.parquet(parts.data(m["run_id"], n)).withColumns({"run_no": F.lit(n), "run_id": F.lit(m["run_id"])})
        found = run if found is None else found.unionByName(run)
    if found is None:
        raise FileNotFoundError(f"no log at {path}")
    return found


def recent(log: DataFrame, n: int = 5) -> DataFrame:
    """L2: the n latest entries and the total count of entries.

    The latest are those written last: by run and place in the run where the log has
    them (``read_log``), by ``seq`` otherwise.  One pass: every partition hands on its n
    latest entries and its count.
    """
    order = ["run_no", "pos"] if {"run_no", "pos"} <= set(log.columns) else ["seq"]

    def latest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, count = None, 0
        for b in it:
            count += b.num_rows
            t = pa.Table.from_batches([b]) if best is None else pa.concat_tables([best, pa.Table.from_batches([b])])
            best = t.sort_by([(f"_o{i}", "descending") for i in range(len(order))]).slice(0, int(n))
        if best is not None:
            yield from best.append_column("count", pa.array([count] + [0] * (best.num_rows - 1), pa.int64())).to_batches()

    keyed = log.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *log.columns)
    few = keyed.mapInArrow(latest, StructType([*keyed.schema.fields, StructField("count", LongType())]))
    # n rows of each partition: one window over them is small
    last = Window.orderBy(*[F.col(f"_o{i}").desc() for i in range(len(order))])
    ranked = few.withColumn("total", F.sum("count").over(last.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ranked = ranked.withColumn("position", F.row_number().over(last)).where(F.col("position") <= int(n))
    return ranked.select(*log.columns, "total", "position")
