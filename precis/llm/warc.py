"""WARC archives with a two-level capture index.

Writing: every task appends its pages, one gzip member a record, to an archive of its
own in a shared folder.  Of pages with equal payloads the one with the smallest id is
a response record; the others are revisit records without the payload.

Index: the captures' keys (URL with the host reversed) are sorted over the cluster and
written in compressed blocks of a few thousand lines; the sparse directory keeps one
line for each block.  A lookup finds the parts of the index that may hold its key,
binary-searches the part's directory, reads the block by its byte range, searches the
block and reads the record by its byte range.

Archives and blocks are read and written with ``pyarrow.fs`` by URI, so any folder that
all executors share will do.  Their names carry the task attempt: a repeated task
writes new files, and only the files of the finished attempt are ever referred to.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from precis.session import checkpoint_dir


@dataclass(frozen=True)
class WarcConfig:
    min_bytes: int = 0  # shorter payloads are always responses
    block_lines: int = 2_000  # captures of an index block
    part_rows: int = 500_000  # captures of an index part
    date: str = "2024-01-01T00:00:00Z"  # of the records; a fixed date keeps archives reproducible
    broadcast_rows: int = 200_000  # largest list of repeated payloads (about 60 bytes each) that is broadcast
    level: int = 6


DEFAULT = WarcConfig()
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URL = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(:[0-9]*)?)?([^#]*)")
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def url_key(url: str | None) -> str:
    """Reversed host, then port, path and query: ``https://a.b.org/x?y`` is ``org,b,a)/x?y``."""
    m = _URL.match(url or "")
    host, port, path = (m[1] or "").lower(), m[2] or "", m[3]
    name = host if host.startswith("[") else ",".join(reversed(host.split(".")))
    return _CONTROL.sub(lambda c: f"%{ord(c[0]):02X}", f"{name}{port}){path}" if host else path)


def _header(first: str, fields: list[tuple[str, str]]) -> bytes:
    return ("\r\n".join([first, *(f"{k}: {v}" for k, v in fields)]) + "\r\n\r\n").encode("utf-8", "surrogatepass")


def record(page_id, url, payload: bytes, refers_to, cfg: WarcConfig, revisit: bool) -> bytes:
    """One WARC record: a response with the payload, or a revisit without it."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = _header("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))])
    body = http if revisit else http + payload
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", cfg.date),
        ("WARC-Target-URI", _CONTROL.sub(lambda c: f"%{ord(c[0]):02X}", url or "")), ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    return _header("WARC/1.1", fields) + body + b"\r\n\r\n"


def gzip_member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(data: bytes) -> dict:
    """The fields of a record and, for responses, the payload (checked against its digest)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    out = {"type": fields["WARC-Type"], "url": fields.get("WARC-Target-URI"), "payload": None}
    if out["type"] in ("response", "revisit"):
        http, _, payload = block.partition(b"\r\n\r\n")
        out["bytes"] = int(re.search(rb"\r\nContent-Length: ([0-9]+)", http)[1])
        out["digest"] = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        page = lambda v: None if v == "<urn:page:null>" else int(v[len("<urn:page:"):-1])
        out["page_id"] = page(fields["WARC-Record-ID"])
        out["refers_to"] = page(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
        if out["type"] == "response":
            out["payload"] = payload
            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != out["digest"] or len(payload) != out["bytes"]:
                raise ValueError(f"damaged record of page {out['page_id']}")
    return out


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _attempt() -> str:
    from pyspark import TaskContext

    t = TaskContext.get()
    return f"{t.partitionId():06d}-{t.taskAttemptId()}"


@dataclass(frozen=True)
class Capture:
    """Folder of a set of archives and their index."""

    uri: str

    def directory(self, spark: SparkSession) -> DataFrame:
        """One row per index block: part, file, first and last key, byte range, lines."""
        return spark.read.parquet(f"{self.uri}/directory")


def new_folder(spark: SparkSession) -> str:
    """A fresh folder below the checkpoint folder that the cluster shares."""
    return f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"


def write(pages: DataFrame, uri: str, page_id: str = "page_id", url: str = "url", html: str = "html",
          cfg: WarcConfig = DEFAULT) -> Capture:
    """Write every page as a WARC record below ``uri`` and build the index.

    A null html is an empty payload, a null url an empty one.  Rows that repeat the
    smallest id of their payload are responses too; a row without an id revisits the
    smallest id that there is, and is a response where no row has one.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    d = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"),
        F.unhex(F.sha1(payload)).alias("digest"))
    low = (
        d.where(F.octet_length("payload") >= cfg.min_bytes).groupBy("digest")
        .agg(F.min("page_id").alias("low"), F.count("*").alias("n")).where("n > 1 and low is not null").drop("n")
    )
    low.write.parquet(f"{uri}/repeated")
    low = spark.read.parquet(f"{uri}/repeated")
    if low.count() <= cfg.broadcast_rows:
        low = F.broadcast(low)  # else a join whose hot digests Spark can split
    d = d.join(low, "digest", "left")
    revisit = F.col("low").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("low"))
    d = d.select("page_id", "url", "payload", F.when(revisit, F.col("low")).alias("refers_to"))

    def archive(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(uri)
        fs.create_dir(f"{root}/archive", recursive=True)
        name, at, out = f"part-{_attempt()}.warc.gz", 0, None
        try:
            for b in it:
                rows = []
                for i, u, p, r in zip(*(b.column(k).to_pylist() for k in range(4))):
                    if out is None:
                        out = fs.open_output_stream(f"{root}/archive/{name}", compression=None)
                        at += out.write(gzip_member(_header("WARC/1.1", [
                            ("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{name}>"), ("WARC-Date", cfg.date),
                            ("Content-Type", "application/warc-fields"), ("Content-Length", "0")]) + b"\r\n\r\n", cfg.level))
                    data = gzip_member(record(i, u, p, r, cfg, r is not None), cfg.level)
                    out.write(data)
                    rows.append((url_key(u), i, name, at, len(data)))
                    at += len(data)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], t) for k, t in enumerate(
                        (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                    ["key", "page_id", "file", "at", "size"])
        finally:
            if out is not None:
                out.close()

    # stored once: the range partitioning below reads it twice
    d.mapInArrow(archive, "key string, page_id long, file string, at long, size long").write.parquet(f"{uri}/entries")
    return build_index(spark, uri, cfg)


def build_index(spark: SparkSession, uri: str, cfg: WarcConfig = DEFAULT) -> Capture:
    """Sort the captures by key into compressed blocks and write the block directory."""
    entries = spark.read.parquet(f"{uri}/entries")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries.count() // cfg.part_rows))

    def index(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = _fs(uri)
        fs.create_dir(f"{root}/index", recursive=True)
        name, at, out, rows, lines = f"part-{_attempt()}.cdx.gz", 0, None, [], []
        part = TaskContext.get().partitionId()

        def flush():
            nonlocal at, out, lines
            out = out or fs.open_output_stream(f"{root}/index/{name}", compression=None)
            data = gzip_member("\n".join(lines).encode("utf-8", "surrogatepass"), cfg.level)
            out.write(data)
            rows.append((part, name, lines[0].split(" ", 1)[0], lines[-1].split(" ", 1)[0], at, len(data), len(lines)))
            at, lines = at + len(data), []

        try:
            for b in it:
                for key, i, f, a, n in zip(*(b.column(k).to_pylist() for k in range(5))):
                    lines.append(f"{key} {'-' if i is None else i} {f} {a} {n}")
                    if len(lines) == cfg.block_lines:
                        flush()
            if lines:
                flush()
        finally:
            if out is not None:
                out.close()
        kinds = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)],
            ["part", "file", "first", "last", "at", "size", "lines"])

    # the page id and the place split a URL or a host that holds many captures over several parts
    order = ["key", "page_id", "file", "at"]
    entries.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(
        index, "part int, file string, first string, last string, at long, size long, lines long"
    ).write.parquet(f"{uri}/directory")
    return Capture(uri)


class PartReader:
    """Lookups in one part of the index: its directory in memory, blocks and records by byte range."""

    def __init__(self, uri: str, blocks: list[tuple]):
        self.fs, self.root = _fs(uri)
        self.blocks = sorted(blocks, key=lambda b: (b[0], b[3]))  # (first, last, file, at, size), by place within a key
        self.firsts = [b[0] for b in self.blocks]
        self.lasts = [b[1] for b in self.blocks]
        self.files: dict = {}
        self.block: tuple = (None, None, None)

    def read(self, folder: str, file: str, at: int, size: int) -> bytes:
        path = f"{self.root}/{folder}/{file}"
        if path not in self.files:
            if len(self.files) >= 64:
                self.files.pop(next(iter(self.files))).close()
            self.files[path] = self.fs.open_input_file(path)
        return zlib.decompress(self.files[path].read_at(size, at), 31)

    def lines(self, key: str) -> Iterator[str]:
        """Index lines of a key: binary search of the directory, then of each block that may hold it."""
        lo, hi = bisect_left(self.lasts, key), bisect_right(self.firsts, key)
        for b in range(lo, hi):
            if self.block[0] != b:
                _, _, file, at, size = self.blocks[b]
                lines = self.read("index", file, at, size).decode("utf-8", "surrogatepass").split("\n")
                self.block = (b, lines, [x.split(" ", 1)[0] for x in lines])
            _, lines, keys = self.block
            yield from lines[bisect_left(keys, key):bisect_right(keys, key)]

    def close(self):
        for f in self.files.values():
            f.close()


CAPTURES = "key string, page_id long, url string, type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def lookup(spark: SparkSession, capture: Capture, keys: DataFrame, payloads: bool = True) -> DataFrame:
    """All captures of the keys (a table with a column ``key``), read back from the archives.

    The parts' key ranges, one row a part, are the only thing that the driver sees.
    Keys go to the parts that may hold them; repeated keys are asked once and a null
    key finds nothing.
    """
    directory = capture.directory(spark)
    ranges = sorted(
        (r["a"], r["b"], r["part"])
        for r in directory.groupBy("part").agg(F.min("first").alias("a"), F.max("last").alias("b")).collect())
    firsts, lasts, numbers = ([r[i] for r in ranges] for i in range(3))

    @F.arrow_udf("array<int>")
    def parts_of(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in it:
            yield pa.array([
                [] if k is None else numbers[bisect_left(lasts, k):bisect_right(firsts, k)] for k in a.to_pylist()
            ], pa.list_(pa.int32()))

    asked = keys.select("key").distinct().withColumn("part", F.explode(parts_of("key")))
    uri = capture.uri
    names = [c.split()[0] for c in CAPTURES.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    kinds = [kinds[c.split()[1]] for c in CAPTURES.split(", ")]

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sorted by part: first the part's share of the directory, then the wanted keys in order
        part, blocks, reader, rows, size = None, [], None, [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(kinds))], names)

        try:
            for b in it:
                for p, key, first, last, file, at, n in zip(*(b.column(k).to_pylist() for k in range(7))):
                    if p != part:
                        if reader:
                            reader.close()
                        part, blocks, reader = p, [], None
                    if key is None:
                        blocks.append((first, last, file, at, n))
                        continue
                    reader = reader or PartReader(uri, blocks)
                    for line in reader.lines(key):
                        _, _, name, start, length = line.rsplit(" ", 4)
                        r = parse(reader.read("archive", name, int(start), int(length)))
                        body = r["payload"] if payloads else None
                        rows.append((key, r["page_id"], r["url"], r["type"], r["bytes"], r["digest"], r["refers_to"], body))
                        size += len(body or b"") + 200
                        if size > 1 << 23:
                            yield batch()
                            rows, size = [], 0
            if rows:
                yield batch()
        finally:
            if reader:
                reader.close()

    cols = ["part", "key", "first", "last", "file", "at", "size"]
    both = directory.withColumn("key", F.lit(None).cast("string")).select(*cols).unionByName(
        asked.select("part", "key"), allowMissingColumns=True)
    order = ["part", F.col("key").asc_nulls_first(), "first", "at"]
    # a stated number: the rows are small, but each stands for the records that it makes a task read
    return both.repartition(max(1, len(ranges)), "part").sortWithinPartitions(*order).select(*cols).mapInArrow(read, CAPTURES)


def keys_of(url: Column) -> Column:
    """Index key of a column of URLs."""

    @F.arrow_udf("string")
    def key(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in it:
            yield pa.array([url_key(u) for u in a.to_pylist()], pa.string())

    return key(url)
