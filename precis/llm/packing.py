"""Best-fit packing of documents into training sequences of several permitted lengths.

Documents longer than the longest sequence are cut into pieces; no token is lost.
Pieces are dealt evenly over shards of a bounded number of pieces, and each shard is
packed on its own in a task of its own: pieces by falling length, each into the open
bin that it leaves fullest (best fit).  Where no open bin has room a new one is
opened, of the size of least cost: for each permitted size the lengths still to be
placed are filled in, largest first, and the size whose bin, downsized to that fill,
costs least for each of its tokens is opened.  In the end every bin is downsized to the
smallest permitted length that holds its contents.  The shard is also packed with each
size as the only one to open, and the packing of least total cost stays, so choosing
size by size never costs more than one size for all.

Only ids and lengths are shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precis.session import checkpoint_dir


@dataclass(frozen=True)
class PackConfig:
    sizes: tuple = (512, 1024, 2048, 4096)  # permitted sequence lengths, in tokens
    bin_cost: float = 16.0  # what a sequence costs besides its length, in tokens
    attention: float = 0.0  # and for the square of its length
    shard_pieces: int = 20_000  # pieces that one task packs


    def cost(self, size):
        """What a sequence of a permitted length costs."""
        return size + self.bin_cost + self.attention * size * size


DEFAULT = PackConfig()


class _Left:
    """Lengths in falling order, of which the first are placed already: what a new bin could hold."""

    def __init__(self, falling: list[int], cfg: PackConfig):
        self.neg = [-n for n in falling]
        self.total = [0, *accumulate(falling)]
        self.cfg, self.sizes = cfg, sorted(cfg.sizes)

    def fill(self, at: int, room: int) -> int:
        """Tokens that fit into ``room`` out of the lengths from ``at`` on, the largest that fits first."""
        left = room
        while True:
            at = bisect_left(self.neg, -left, at)  # the first that fits
            if at >= len(self.neg) or left == 0:
                return room - left
            end = bisect_right(self.total, self.total[at] + left) - 1  # and all after it that fit with it
            left -= self.total[end] - self.total[at]
            at = end

    def opening(self, at: int, length: int) -> int:
        """The size to open for the piece before ``at``: least cost for each token; of equal ones the larger."""
        best = None
        for size in self.sizes:
            if size < length:
                continue
            load = length + self.fill(at, size - length)
            cost = self.cfg.cost(self.sizes[bisect_left(self.sizes, load)]) / load
            if best is None or cost <= best[0]:
                best = cost, size
        return best[1]


def best_fit(lengths: np.ndarray, sizes: list[int], opened: int | None = None, cfg: PackConfig = DEFAULT):
    """Best fit by falling length: (bin of each piece, offset in the bin, load of each bin).

    ``opened``: the size of a new bin, or the smallest permitted one that holds the
    piece; None: the size of least cost for each opening.  Ties: equal pieces in input
    order; of bins with equal room the one opened first.
    """
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    load: list[int] = []
    room: list[tuple[int, int]] = []  # open bins as (free tokens, bin), ascending
    order = np.argsort(-lengths, kind="stable").tolist()
    left = _Left([int(lengths[i]) for i in order], cfg) if opened is None else None
    for k, i in enumerate(order):
        n = int(lengths[i])
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            b = len(load)
            free = left.opening(k + 1, n) if left else max(opened, sizes[bisect_left(sizes, n)])
            load.append(0)
        where[i], offset[i] = b, load[b]
        load[b] += n
        if free > n:
            insort(room, (free - n, b))
    return where, offset, np.array(load, np.int64)


def pack(lengths: np.ndarray, cfg: PackConfig = DEFAULT):
    """(bin, offset, capacity of the bin) of each piece, by the packing of least total cost.

    Every length must be from 1 to the largest size.  A piece without tokens would
    fit anywhere; callers give it its end mark, so lengths are at least 1.
    """
    sizes = sorted(cfg.sizes)
    best = None
    for opened in (None, *sizes):
        where, offset, load = best_fit(lengths, sizes, opened, cfg)
        caps = np.array(sizes)[np.searchsorted(sizes, load)]  # downsizing
        cost = cfg.cost(caps.astype(np.float64)).sum()
        if best is None or cost < best[0]:
            best = cost, where, offset, caps
    _, where, offset, caps = best
    return where, offset, caps[where] if len(where) else np.zeros(0, np.int64)


def word_count(text: Column) -> Column:
    """Words of a text (0 for null)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def pieces(docs: DataFrame, doc_id: str, length: Column, cfg: PackConfig = DEFAULT) -> DataFrame:
    """One row per piece: doc_id, piece (from 0), start, n_tokens.

    A document's length is ``length`` plus one end mark, so an empty or null text
    still is one piece of one token and no row is lost.
    """
    top = max(cfg.sizes)
    d = docs.select(F.col(doc_id).alias("doc_id"), (F.coalesce(length, F.lit(0)) + 1).cast("long").alias("n"))
    d = d.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / top))).alias("piece"))
    start = F.col("piece") * top
    return d.select("doc_id", "piece", start.alias("start"), F.least(F.lit(top).cast("long"), F.col("n") - start).alias("n_tokens"))


PACKED = "doc_id {kind}, piece long, start long, n_tokens long, bin_id long, bin_offset long, bin_capacity long"


def pack_documents(docs: DataFrame, doc_id: str, length: Column, cfg: PackConfig = DEFAULT) -> DataFrame:
    """Pack every document; one row per piece with its bin.

    ``bin_id`` is unique over all shards.  Repeated ids are separate documents, a
    null id stays null.  An empty table gives no rows.
    """
    checkpoint_dir(docs.sparkSession)
    table = pieces(docs, doc_id, length, cfg).checkpoint()  # narrow; counted and packed without reading texts again
    shards = max(1, -(-table.count() // cfg.shard_pieces))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        parts = [b for b in it if b.num_rows]
        if not parts:
            return
        rows = pa.Table.from_batches(parts)
        # an order of its own, so that a repeated task packs alike
        rows = rows.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("n_tokens", "ascending")])
        where, offset, cap = pack(rows.column("n_tokens").to_numpy(), cfg)
        for name, x in (("bin_id", where + (shard << 32)), ("bin_offset", offset), ("bin_capacity", cap)):
            rows = rows.append_column(name, pa.array(np.asarray(x, np.int64)))
        yield from rows.to_batches()

    # dealt round robin, so a hot id or length cannot fill one shard
    return table.repartition(shards).mapInArrow(run, PACKED.format(kind=dict(table.dtypes)["doc_id"]))
