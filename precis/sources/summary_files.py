"""One file per summary (S6): a Spark data source that writes every row as a file of its own.

    spark.dataSource.register(SummaryFiles)
    named(df).write.format("summary_files").mode("overwrite").save(path)

Tasks write below ``path/_staged-<job>/<attempt>``; only the commit of the job moves the
files of the attempts that counted to their names, so a failed or repeated task leaves
neither a lost nor a second file, and an aborted job none at all.  ``path`` is a folder
that driver and executors share, or a URI that pyarrow knows (s3, hdfs).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def _file_system(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.staged = f"_staged-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        fs, top = _file_system(self.path)
        t = TaskContext.get()
        folder = f"{top}/{self.staged}/{t.partitionId()}-{t.taskAttemptId()}"
        fs.create_dir(folder, recursive=True)
        names = []
        for row in rows:
            with fs.open_output_stream(f"{folder}/{row['name']}") as out:
                out.write((row["text"] or "").encode("utf-8"))
            names.append(row["name"])
        return Written(folder, names)

    def commit(self, messages: list) -> None:
        fs, top = _file_system(self.path)
        moves = [(f"{m.folder}/{n}", f"{top}/{n}") for m in messages if m is not None for n in m.names]
        if len({b for _, b in moves}) != len(moves):
            self.abort(messages)
            raise ValueError("two summaries have one file name")
        if self.overwrite:  # files of an earlier job that this one does not write
            from pyarrow.fs import FileSelector, FileType

            new = {b.rsplit("/", 1)[1] for _, b in moves}
            for f in fs.get_file_info(FileSelector(top, allow_not_found=True)):
                if f.type == FileType.File and f.base_name not in new:
                    fs.delete_file(f.path)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda m: fs.move(*m), moves))
        fs.delete_dir(f"{top}/{self.staged}")

    def abort(self, messages: list) -> None:
        fs, top = _file_system(self.path)
        from pyarrow.fs import FileType

        if fs.get_file_info(f"{top}/{self.staged}").type == FileType.Directory:
            fs.delete_dir(f"{top}/{self.staged}")


class SummaryFiles(DataSource):
    """Rows (name, text) as files of that name below the path."""

    @classmethod
    def name(cls) -> str:
        return "summary_files"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        path = self.options.get("path")
        if not path:
            raise ValueError("summary files need a path")
        fs, top = _file_system(path)
        fs.create_dir(top, recursive=True)
        return _Writer(path.rstrip("/"), overwrite)


def named(df: DataFrame, id_col: str = "doc_id", summary_col: str = "summary", suffix: str = ".txt") -> DataFrame:
    """(name, text): a file name for every row, from its id.

    Characters that may not stand in a name are percent-encoded; a null id is `null`;
    rows that repeat an id are numbered in the order of their texts.
    """
    raw = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    safe = F.udf(lambda x: quote(x, safe=" ") or "_", "string").asNondeterministic()(raw)
    plain = raw.rlike(r"^[A-Za-z0-9][A-Za-z0-9_-]*$")
    d = df.select(F.when(plain, raw).otherwise(safe).alias("stem"), F.coalesce(F.col(summary_col), F.lit("")).alias("text"))
    n = F.row_number().over(Window.partitionBy("stem").orderBy("text"))
    d = d.withColumn("n", n)
    return d.select(F.when(F.col("n") == 1, F.col("stem")).otherwise(F.concat("stem", F.lit("~"), F.col("n").cast("string"))).alias("base"),
                    "text").select(F.concat("base", F.lit(suffix)).alias("name"), "text")


def write_summary_files(df: DataFrame, path: str, id_col: str = "doc_id", summary_col: str = "summary", mode: str = "overwrite") -> None:
    """One file per row below ``path``, named by the row's id."""
    df.sparkSession.dataSource.register(SummaryFiles)
    named(df, id_col, summary_col).write.format("summary_files").mode(mode).save(path)
