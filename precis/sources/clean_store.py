"""A cleaned corpus that grows with its input.

Each run cleans only the files that are new and stores them as a part: the surviving
rows, and a narrow table of their digests.  Keep-first de-duplication materialises
late: texts are stored once and read by place, while only (digest, id, place) is
aggregated, by a hash aggregate that combines a hot group of copies on the map side;
digests of earlier parts join narrow against narrow.  Changed settings, and input files
that changed or went away, build the corpus anew in a folder of its own.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precis import config as C
from precis.operators.corpus import clean_columns, digest_of, drop_blank, first_places, length_filter
from precis.sources import store


def fingerprint(settings: C.Settings) -> str:
    """Of the settings and the fixed patterns that the cleaning depends on."""
    used = {k: v for k, v in dataclasses.asdict(settings).items() if k in ("min_article_words", "min_summary_words", "max_article_words")}
    fixed = [C.NEWS_PREFIX_PATTERNS, C.URL_PATTERN, C.EDITOR_NOTE_PATTERN, C.COPYRIGHT_PATTERN, C.PROMO_PATTERN, C.PUNCT_SPACING_PATTERN]
    return hashlib.sha256(json.dumps([used, fixed], sort_keys=True).encode()).hexdigest()


def build_clean(spark: SparkSession, raw_path: str, clean_path: str, settings: C.Settings = C.DEFAULT,
                read=None, broadcast_rows: int | None = None) -> DataFrame:
    """The cleaned corpus of all files below ``raw_path``, of which only new ones are read.

    Returns (doc_id, article, highlights).  Rows of earlier runs stay; a new row whose
    article is stored already goes, and of new copies the one with the smallest id
    stays.  ``read(files, known)`` gives the raw rows of files (default: S1, with
    ``known`` files numbered before them).
    """
    from precis.sources.io import read_corpus

    read = read or (lambda files, known: read_corpus(spark, files, first_file=known, fmt="csv" if files[0].lower().endswith(".csv") else None))
    files = {name: [size, time] for name, size, time in store.data_files(spark, raw_path)}
    mark = fingerprint(settings)
    runs = store.Parts(spark, clean_path)
    generations = runs.committed()
    number = max(generations, default=0)
    if not generations or generations[number]["settings"] != mark or not _still_there(spark, generations[number]["folder"], files):
        # another input or other settings: a new generation, built beside the old one
        number += 1
        folder = f"{clean_path.rstrip('/')}/generation-{uuid.uuid4().hex}"
        _add_part(spark, folder, files, settings, read, broadcast_rows)
        runs.commit(number, {"settings": mark, "folder": folder})
    else:
        folder = generations[number]["folder"]
        known = set().union(*[m["files"] for m in store.Parts(spark, folder).committed().values()] or [set()])
        new = {n: v for n, v in files.items() if n not in known}
        if new:
            _add_part(spark, folder, new, settings, read, broadcast_rows)
    parts = store.Parts(spark, folder)
    found = [spark.read.parquet(parts.data("rows", n)) for n in sorted(parts.committed())]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("doc_id", "article", "highlights")


def _still_there(spark: SparkSession, folder: str, files: dict) -> bool:
    """Whether every file that was read is as it was."""
    parts = store.Parts(spark, folder).committed()
    return bool(parts) and all(files.get(n) == v for m in parts.values() for n, v in m["files"].items())


def _add_part(spark: SparkSession, folder: str, files: dict, settings: C.Settings, read, broadcast_rows: int | None) -> None:
    parts = store.Parts(spark, folder)
    before = parts.committed()
    number = max(before, default=0) + 1
    known = sum(len(m["files"]) for m in before.values())
    if not files:
        raise FileNotFoundError("there is no file to read")
    # cleaned texts are written once; from here on rows are known by (file, row) of what was written
    staged = f"{folder}/_staged-{uuid.uuid4().hex}"
    clean = length_filter(drop_blank(clean_columns(read(sorted(files), known), partitioned=True)), settings)
    clean.withColumn("digest", digest_of(F.col("article"))).write.parquet(staged)
    names = [n for n, _, _ in store.data_files(spark, staged)]
    rows = spark.read.parquet(staged)
    order = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "file string, file_no long")  # a row for each written file
    rows = rows.withColumns({"file": F.col("_metadata.file_path"), "row": F.col("_metadata.row_index")})
    rows = rows.join(F.broadcast(order), "file").withColumn("place", F.col("file_no") * F.lit(1 << 40) + F.col("row")).drop("file", "file_no", "row")
    narrow = rows.select("digest", "doc_id", "place")
    first = first_places(narrow)
    for n in before:
        first = first.join(spark.read.parquet(parts.data("digests", n)).select("digest"), "digest", "left_anti")
    first.write.mode("overwrite").parquet(parts.data("digests", number))
    first = spark.read.parquet(parts.data("digests", number))
    gone = narrow.select("place").join(first.select("place"), "place", "left_anti")
    bound = settings.broadcast_max_rows if broadcast_rows is None else broadcast_rows
    few = gone.limit(bound + 1).count() <= bound  # places, eight bytes each
    kept = rows.join(F.broadcast(gone), "place", "left_anti") if few else rows.join(first.select("place"), "place", "left_semi")
    kept.select("doc_id", "article", "highlights").write.mode("overwrite").parquet(parts.data("rows", number))
    parts.commit(number, {"files": files})
    store.delete(spark, staged)
