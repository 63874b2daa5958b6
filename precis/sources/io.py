"""Sources and sinks.

Every reader returns a DataFrame with an explicit schema and a ``doc_id``;
every writer is a Spark writer (Parquet by default, CSV/text on request) to a
path on the cluster's shared file system.  Path checks go through the Hadoop
FileSystem of the session, so they work for any scheme (hdfs://, s3a://,
file://).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precis import config as C
from precis.operators.corpus import REQUIRED, require_columns
from precis.sources.store import path_exists  # noqa: F401 - part of this module's functions


def _fmt(path, fmt: str | None) -> str:
    if fmt:
        return fmt
    path = path if isinstance(path, str) else path[0]
    return "csv" if path.rstrip("/").lower().endswith(".csv") else "parquet"


def read_corpus(spark: SparkSession, path, fmt: str | None = None, id_col: str = "doc_id", first_file: int = 0) -> DataFrame:
    """S1 + S2: (doc_id, article, highlights); extra columns are dropped.

    CSV is read with a header, quoted multi-line fields and no schema inference
    (all strings); it needs an id column, because its rows have no place of their
    own once files are split.  Parquet without one is numbered by (file name, row in
    the file), so keep-first de-duplication keeps the first row of the first file
    whatever order Spark reads the files in; ``first_file`` numbers come before them.
    ``path``: one path or a list of them.
    """
    f = _fmt(path, fmt)
    if f == "csv":
        df = (
            spark.read.option("header", True).option("multiLine", True).option("escape", '"')
            .option("inferSchema", False).csv(path)
        )
    else:
        df = spark.read.format(f).load(path)
    require_columns(df, REQUIRED)
    texts = [F.col("article").cast("string"), F.col("highlights").cast("string")]
    if id_col in df.columns:
        return df.select(F.col(id_col).cast("long").alias("doc_id"), *texts)
    if f != "parquet":
        raise ValueError(f"a {f} corpus needs an id column ({id_col!r}) that gives its rows an order")
    rows = df.select(*texts, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row_no"))
    files = sorted(r["file"] for r in rows.select("file").distinct().collect())  # names only, one for each file
    order = spark.createDataFrame([(f, first_file + i) for i, f in enumerate(files)], "file string, file_no long")
    return rows.join(F.broadcast(order), "file").select(
        (F.col("file_no") * F.lit(1 << 40) + F.col("row_no")).alias("doc_id"), "article", "highlights")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write with the Spark writer (CSV gets a header)."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w = w.option("header", True).option("escape", '"')
    w.format(fmt).save(path)


def load_or_build_clean(spark: SparkSession, raw_path: str, clean_path: str,
                        settings: C.Settings = C.DEFAULT) -> DataFrame:
    """The cleaned corpus, of which only what is not stored yet is built.

    New files below ``raw_path`` are cleaned and de-duplicated against the stored rows;
    changed settings or changed files build it anew (:mod:`precis.sources.clean_store`).
    A part counts only once its manifest is written, so a failed run leaves nothing.
    """
    from precis.sources.clean_store import build_clean

    return build_clean(spark, raw_path, clean_path, settings)


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every file under ``path`` is one document (UTF-8, whole text).

    (doc_id = 64-bit hash of the file path, path, text).
    """
    df = spark.read.option("wholetext", True).text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )
    return df.select(F.xxhash64("path").alias("doc_id"), "path", "text")


def write_summaries(df: DataFrame, path: str, fmt: str = "parquet", summary_col: str = "summary",
                    id_col: str = "doc_id") -> None:
    """Summaries to Parquet/JSON (with their id) or to text: one line each, the
    id, a tab and the summary (whitespace-normalised, so a line is a whole summary)."""
    if fmt == "text":
        line = F.concat_ws("\t", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(summary_col), F.lit("")))
        df.select(line.alias("value")).write.mode("overwrite").text(path)
    else:
        write_table(df, path, fmt)


def literal_documents(spark: SparkSession, *texts: str) -> DataFrame:
    """Inline strings as a document table."""
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
