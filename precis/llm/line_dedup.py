"""Lines that repeat across documents: explode, hash, count documents, drop, reassemble by position.

A line's key is the line without white space at both ends and with A-Z lower-cased.
Keys found in enough documents lose all their lines.  Every row is a document of its
own, so null and repeated ids mix nothing.

Counting needs no row key: a row's distinct hashes are exploded, so a hash's rows are
its documents, and they are pre-aggregated before the shuffle however frequent a line
is.  Texts are hashed once; the hashes are stored.  Only positions of dropped lines travel back to the rows; texts move only where
those positions are too many to broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precis.llm.common import free_name, portions, with_row_key
from precis.session import checkpoint_dir

SPACE = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class LineConfig:
    min_chars: int = 1  # shorter keys are never dropped
    min_docs: int = 10  # documents that a dropped key is found in, at least
    broadcast_mb: int = 24  # larger tables are joined by a shuffle


DEFAULT = LineConfig()


def lines_of(text: Column) -> Column:
    """The lines of a text, split at \\n; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(texts: pa.Array, min_chars: int) -> pa.Array:
    """For every text the 16-byte hashes of its lines' keys, null for keys that are too short.

    Splitting, trimming and lower-casing run on whole Arrow arrays; each distinct key of
    a batch is hashed once.
    """
    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    keys = pc.ascii_lower(pc.ascii_trim(pc.list_flatten(lines), SPACE)).dictionary_encode()
    distinct = [hashlib.blake2b(k.encode(), digest_size=16).digest() if len(k) >= min_chars else None for k in keys.dictionary.to_pylist()]
    return pa.ListArray.from_arrays(lines.offsets, pa.array(distinct, pa.binary()).take(keys.indices))


def _hashes(text: Column, min_chars: int) -> Column:
    @F.arrow_udf("array<binary>")
    def hashes(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in portions(it, 2_000):
            yield line_hashes(a, min_chars)

    return hashes(text)


def _small(df: DataFrame, row_bytes: int, cfg: LineConfig) -> bool:
    return df.count() * row_bytes <= cfg.broadcast_mb << 20


def drop_common(docs: DataFrame, text: str = "text", cfg: LineConfig = DEFAULT) -> DataFrame:
    """Every row of ``docs`` with its columns and a struct column ``lines``: n_lines, n_dropped, kept.

    ``kept`` is the text without the lines whose key, of ``min_chars`` code points or
    more, is found in at least ``min_docs`` rows; the other lines stay as they are,
    joined by \\n ('' if none is left).  A null or empty text is one empty line, whose
    key is too short to go unless ``min_chars`` is 0.  Repeated rows are documents
    each.  An empty table gives no rows.  A column of ``docs`` named ``lines`` is replaced.
    """
    checkpoint_dir(docs.sparkSession)
    row = free_name("row", docs.columns)
    numbered = with_row_key(docs, row)
    # stored: 16 bytes a line, read for the counts and for the positions
    hashed = numbered.select(F.col(row).alias("row"), _hashes(F.col(text), cfg.min_chars).alias("h")).checkpoint()
    common = (
        hashed.select(F.explode(F.array_distinct("h")).alias("k")).where(F.col("k").isNotNull())
        .groupBy("k").count().where(F.col("count") >= cfg.min_docs).select("k").checkpoint()
    )
    # a row's distinct hashes with their positions: one join row for each, however often a line repeats in it
    at = hashed.select("row", F.posexplode("h").alias("pos", "k")).where(F.col("k").isNotNull())
    if _small(common, 64, cfg):
        common = F.broadcast(common)
    gone = at.join(common, "k", "left_semi").groupBy("row").agg(F.collect_list("pos").alias("pos")).checkpoint()
    size = gone.agg(F.sum(F.size("pos") * 4 + 64)).first()[0] or 0
    gone = gone.select(F.col("row").alias(row), F.col("pos").alias(pos := free_name("pos", [*docs.columns, row])))
    joined = numbered.join(F.broadcast(gone) if size <= cfg.broadcast_mb << 20 else gone, row, "left")
    lines = lines_of(F.col(text))
    # dropped positions as a map: a lookup by position for every line, not a search through the list
    dropped = F.coalesce(F.sort_array(pos), F.array().cast("array<int>"))
    kept = F.when(F.size(dropped) == 0, F.coalesce(F.col(text), F.lit(""))).otherwise(_without(lines, dropped))
    result = F.struct(
        F.size(lines).cast("long").alias("n_lines"), F.size(dropped).cast("long").alias("n_dropped"), kept.alias("kept"))
    return joined.withColumn("lines", result).select(*[c for c in docs.columns if c != "lines"], "lines")


def _without(lines: Column, dropped: Column) -> Column:
    """The lines but those at the ascending positions ``dropped``, joined by \\n: slices between them."""
    ends = F.concat(dropped, F.array(F.size(lines)))
    starts = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda p: p + 1))
    runs = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda s: F.slice(lines, s["a"] + 1, s["b"] - s["a"]))
    return F.array_join(F.flatten(runs), "\n")
