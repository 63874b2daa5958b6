"""Summaries of a stream of documents (Structured Streaming).

The original has no stream; documents arriving continuously are summarised
by the same batch plan inside ``foreachBatch`` (every micro-batch is a
DataFrame, and every summary depends on its own document only, so no state
is needed).  Output goes to a Parquet table partitioned by epoch; progress is kept in a
checkpoint folder under the session's ``spark.checkpoint.dir`` (the
cluster's shared folder), which makes the query restartable after a failure.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from precis import config as C
from precis.operators.summarize import summarize
from precis.session import checkpoint_dir


def document_stream(spark: SparkSession, path: str, glob: str | None = None,
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream of (doc_id, text) Parquet rows."""
    r = spark.readStream.schema("doc_id long, text string")
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def summarize_stream(
    stream: DataFrame,
    out_path: str,
    text_col: str = "text",
    method: str = "tfidf",
    k=None,
    id_col: str = "doc_id",
    model=None,
    name: str | None = None,
    available_now: bool = False,
    settings: C.Settings = C.DEFAULT,
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Start the query: each micro-batch is summarised and appended.

    ``checkpoint`` is the stream's own folder; a restart with the same folder goes on
    where the stream stopped.  Without it the folder follows from the name, below the
    shared checkpoint folder; the default name follows from the output path, so streams
    with different outputs never share a folder.
    """
    name = name or "summaries-" + hashlib.sha256(out_path.rstrip("/").encode()).hexdigest()[:16]
    ckpt = checkpoint or os.path.join(checkpoint_dir(stream.sparkSession), "stream-" + name)

    def batch(df: DataFrame, epoch_id: int) -> None:
        # one folder per epoch, overwritten on replay: a re-run micro-batch
        # (after a failure) replaces its own output instead of duplicating it
        summarize(df, text_col, method, k, id_col, model=model, settings=settings) \
            .write.mode("overwrite").parquet(os.path.join(out_path, f"epoch={epoch_id}"))

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", ckpt).queryName(name)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
