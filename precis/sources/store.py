"""Small files beside stored tables: listings, manifests that are written once, numbered parts.

Everything goes through the Hadoop file system of the path, so any scheme works.  A part
of a table counts only when its manifest is there; the manifest is written last, and
never over another one, so a run that failed or is repeated leaves no half part, and of
two runs that write the same part one fails.
"""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def data_files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, size, time of change) of every file below ``path`` (or itself), by path; hidden files are left out."""
    fs, p = _fs(spark, path)
    it, out, top = fs.listFiles(p, True), [], fs.makeQualified(p).toString().rstrip("/")
    while it.hasNext():
        f = it.next()
        name = f.getPath().toString()
        if not any(part.startswith(("_", ".")) for part in name[len(top):].split("/")):
            out.append((name, int(f.getLen()), int(f.getModificationTime())))
    return sorted(out)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_once(spark: SparkSession, path: str, text: str) -> None:
    """A new file; an error if there is one already."""
    fs, p = _fs(spark, path)
    try:
        stream = fs.create(p, False)
    except Py4JJavaError as e:
        raise FileExistsError(f"{path} is there already: another run has written it") from e
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


class Parts:
    """The committed parts of a table in ``folder``: manifests in ``folder/_parts``, data in ``folder/<kind>/part=<number>``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def committed(self) -> dict[int, dict]:
        """Number and manifest of every committed part."""
        top = f"{self.folder}/_parts"
        if not path_exists(self.spark, top):
            return {}
        fs, p = _fs(self.spark, top)
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return {int(n[:-5]): json.loads(read_text(self.spark, f"{top}/{n}")) for n in sorted(names) if n.endswith(".json")}

    def data(self, kind: str, number: int) -> str:
        return f"{self.folder}/{kind}/part={number}"

    def commit(self, number: int, manifest: dict) -> None:
        write_once(self.spark, f"{self.folder}/_parts/{number:09d}.json", json.dumps(manifest, sort_keys=True))
