"""Merkle dataset manifest: a tree over the rows of each partition, a tree over their roots, a proof for every row.

Rows become leaves where they are read: only ids and digests are shuffled afterwards.
Leaves get their place in their tree by a range-partitioned sort, whose partitions
split a tree however many rows it has.  Blocks of ``2 ** block_levels`` neighbouring
nodes are folded at once, so a tree of ten billion leaves takes four shuffles.

Proofs are found by pointer jumping.  Every node holds the segment of siblings towards
an ancestor, at first its parent; joining the nodes with themselves on that ancestor
doubles the distance and concatenates the segments, until every leaf reaches the root.
Only nodes that a later jump lands on are carried on: after r joins the leaves stand
on level 2 ** r - 1.  Few nodes are left soon (a table of n leaves has n / 2 ** d nodes
d levels up), so late joins, where many leaves share an ancestor, have a small side.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precis.session import checkpoint_dir


@dataclass(frozen=True)
class MerkleConfig:
    block_levels: int = 10  # levels folded at once: 2 ** 10 nodes are one group
    broadcast_mb: int = 16  # larger tables are joined by a shuffle


DEFAULT = MerkleConfig()

LEFT, RIGHT, NONE = "L", "R", "-"  # first character of a proof's step: where the sibling stands
NODE = "tree long, height int, level int, idx long, hash string, step string"


def field(value: Column) -> Column:
    """A value as leaves hold it: `-` if null, else its UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-").cast("binary")).otherwise(
        F.concat(F.octet_length(text).cast("string").cast("binary"), F.lit(":").cast("binary"), text.cast("binary")))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def tampered_row(doc_id: Column) -> Column:
    """True where 7 divides the CRC-32 of the id in decimal; a null id is not tampered with."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, F.lit(False))


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """The rows, stored, with their 0-based rank ``rank`` in ascending order (nulls first).

    The last column should tell equal rows apart, so that no partition has to hold them
    all.  One row for each partition, its size, reaches the driver.
    """
    checkpoint_dir(df.sparkSession)
    d = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("rank", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("rank", 33).cast("int")
    sizes = sorted(tuple(r) for r in d.groupBy(part.alias("p")).count().collect())
    start, offsets = 0, []
    for p, n in sizes:
        offsets.append((p, start - (p << 33)))
        start += n
    table = df.sparkSession.createDataFrame(offsets, "p int, shift long")
    d = d.withColumn("p", part).join(F.broadcast(table), "p")
    return d.withColumn("rank", F.col("rank") + F.col("shift")).drop("p", "shift")


def fold_block(nodes: pa.Table, levels: int) -> pa.Table:
    """All nodes above a block of neighbouring nodes of one level, up to ``levels`` higher, and every lower node's step.

    The block's last node alone becomes its own hash's hash; the tree's top has no step.
    """
    nodes = nodes.sort_by("idx")
    tree, height, level = (nodes.column(c)[0].as_py() for c in ("tree", "height", "level"))
    idx, hashes = nodes.column("idx").to_pylist(), nodes.column("hash").to_pylist()
    out: dict[str, list] = {"level": [], "idx": [], "hash": [], "step": []}

    def put(level, idx, hashes, steps):
        out["level"] += [level] * len(idx)
        out["idx"] += idx
        out["hash"] += hashes
        out["step"] += steps

    for _ in range(levels):
        if level == height:
            break
        steps = [
            LEFT + hashes[k - 1] if i & 1 else RIGHT + hashes[k + 1] if k + 1 < len(idx) else NONE
            for k, i in enumerate(idx)
        ]
        put(level, idx, hashes, steps)
        hashes = [hashlib.sha256("".join(hashes[k:k + 2]).encode()).hexdigest() for k in range(0, len(hashes), 2)]
        idx, level = [i >> 1 for i in idx[::2]], level + 1
    put(level, idx, hashes, [None] * len(idx))
    n = len(out["idx"])
    return pa.table({
        "tree": pa.array([tree] * n, pa.int64()), "height": pa.array([height] * n, pa.int32()),
        "level": pa.array(out["level"], pa.int32()), "idx": pa.array(out["idx"], pa.int64()),
        "hash": pa.array(out["hash"], pa.string()), "step": pa.array(out["step"], pa.string()),
    })


def height_of(n: Column) -> Column:
    """Levels above n leaves: the bits of n - 1."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0).cast("int")


def build(leaves: DataFrame, max_height: int, cfg: MerkleConfig = DEFAULT) -> DataFrame:
    """Every node (tree, height, level, idx, hash, step) over ``leaves`` (tree, height, idx, hash), stored.

    ``height``: levels of the node's tree.  ``step``: where a node's sibling stands and
    its hash, `-` for a node without one, null for the top of a tree.
    """
    checkpoint_dir(leaves.sparkSession)
    up = leaves.select("tree", "height", F.lit(0).alias("level"), "idx", "hash")
    folded, level = [], 0
    while True:
        block = up.withColumn("block", F.shiftright("idx", cfg.block_levels))
        levels = cfg.block_levels

        def run(t: pa.Table) -> pa.Table:
            return fold_block(t, levels)

        nodes = block.groupBy("tree", "block").applyInArrow(run, NODE).checkpoint()
        level += levels
        # a block's top is a leaf of the next blocks, unless it is the tree's top
        folded.append(nodes.where(F.col("step").isNotNull() | (F.col("level") == F.col("height"))))
        if level >= max_height:
            break
        up = nodes.where(F.col("step").isNull() & (F.col("level") < F.col("height"))).select("tree", "height", "level", "idx", "hash")
    found = folded[0]
    for f in folded[1:]:
        found = found.unionByName(f)
    return found


def _key(tree, level, idx) -> Column:
    return F.struct(tree.cast("long").alias("t"), level.cast("int").alias("l"), idx.cast("long").alias("i"))


def _side(df: DataFrame, rows: int, row_bytes: int, cfg: MerkleConfig) -> DataFrame:
    return F.broadcast(df) if rows * row_bytes <= cfg.broadcast_mb << 20 else df


def proofs(leaves: DataFrame, cfg: MerkleConfig = DEFAULT) -> DataFrame:
    """``leaves`` (part, leaf, rank and other columns) with ``subroot``, ``root`` and ``proof``.

    Leaves that have the same ``part`` form a tree in the order of ``rank``, which
    ascends by part; the trees' tops form a tree in the order of the parts (null first,
    bytewise).  ``proof``: the steps from the leaf to the root, array<string>.
    """
    spark = leaves.sparkSession
    parts = leaves.groupBy("part").agg(F.min("rank").alias("first"), F.count("*").alias("n"))
    parts = ranked(parts, "part").select("part", "first", "n", (F.col("rank") + 1).alias("tree")).checkpoint()
    n_parts, most = parts.agg(F.count("*"), F.max("n")).first()
    if not n_parts:
        return leaves.select(
            *[c for c in leaves.columns if c not in ("part", "rank")], F.lit("").alias("subroot"), F.lit("").alias("root"),
            F.array().cast("array<string>").alias("proof"))
    tall, top = max(0, (most - 1).bit_length()), (n_parts - 1).bit_length()
    parts = parts.select(F.col("part").alias("__part"), "first", "tree", height_of(F.col("n")).alias("height"))
    side = _side(parts, n_parts, 200, cfg)
    placed = leaves.join(side, F.col("part").eqNullSafe(F.col("__part"))).withColumn("idx", F.col("rank") - F.col("first"))
    placed = placed.drop("part", "__part", "first", "rank")

    low = build(placed.select("tree", "height", "idx", F.col("leaf").alias("hash")), tall, cfg)
    tops = low.where(F.col("level") == F.col("height")).select("tree", F.col("hash").alias("subroot")).checkpoint()
    high = build(
        tops.select(F.lit(0).cast("long").alias("tree"), F.lit(top).alias("height"), (F.col("tree") - 1).alias("idx"),
                    F.col("subroot").alias("hash")), top, cfg)
    root = high.where((F.col("level") == top) & F.col("step").isNull()).select("hash").first()[0]

    # a tree's top is the same node as its leaf of the tree above
    joins_above = F.col("level") + 1 == F.col("height")
    to = F.when((F.col("tree") > 0) & joins_above, _key(F.lit(0), F.lit(0), F.col("tree") - 1)).otherwise(
        _key(F.col("tree"), F.col("level") + 1, F.shiftright("idx", 1)))
    at_root = _key(F.lit(0), F.lit(top), F.lit(0))
    both = low.where(F.col("step").isNotNull()).unionByName(high)
    nodes = both.select(
        _key(F.col("tree"), F.col("level"), F.col("idx")).alias("node"),
        F.when(F.col("step").isNull(), at_root).otherwise(to).alias("to"),
        F.when(F.col("step").isNull(), F.array().cast("array<string>")).otherwise(F.array("step")).alias("steps"),
    )
    start = F.when(F.col("height") == 0, _key(F.lit(0), F.lit(0), F.col("tree") - 1)).otherwise(
        _key(F.col("tree"), F.lit(0), F.col("idx")))
    moving = placed.select(
        *[c for c in placed.columns if c != "height"], start.alias("__to"), F.array().cast("array<string>").alias("proof"))
    # keys of the rows that have arrived: no node's
    own = _key(-1 - F.col("tree"), F.lit(0), F.col("idx"))
    node = _key(-1 - F.col("node.t"), F.col("node.l"), F.col("node.i"))

    distance = 1
    while True:
        nodes = nodes.checkpoint()
        side = _side(nodes, nodes.count(), 100 + 80 * distance, cfg)
        moving = _jump(moving, side, "__to", "proof", at_root, own)
        if 2 * distance - 1 >= tall + top:
            break
        onward = nodes.where((F.col("node.t") == 0) | ((F.col("node.l") + 1) % (2 * distance) == 0))
        nodes = _jump(onward, side, "to", "steps", at_root, node)
        distance *= 2
    tops = tops.withColumnRenamed("tree", "__tree")
    moving = moving.join(_side(tops, n_parts, 100, cfg), F.col("tree") == F.col("__tree")).drop("tree", "idx", "__tree", "__to")
    return moving.withColumn("root", F.lit(root)).select(*[c for c in moving.columns if c != "proof"], "root", "proof")


def _jump(rows: DataFrame, nodes: DataFrame, to: str, steps: str, at_root: Column, own: Column) -> DataFrame:
    """The rows moved to the ancestor of their ancestor ``to``, their ``steps`` lengthened by its segment.

    Rows that have arrived look for nothing, each under a key of its ``own``: the root,
    which all rows share in the end, is no hot key.
    """
    side = nodes.select(F.col("node").alias("__node"), F.col("to").alias("__next"), F.col("steps").alias("__more"))
    d = rows.withColumn("__wanted", F.when(F.col(to) == at_root, own).otherwise(F.col(to)))
    d = d.join(side, F.col("__wanted") == F.col("__node"), "left")
    return d.select(*[
        F.when(F.col("__next").isNull(), F.col(to)).otherwise(F.col("__next")).alias(c) if c == to
        else F.when(F.col("__more").isNull(), F.col(steps)).otherwise(F.concat(F.col(steps), F.col("__more"))).alias(c) if c == steps
        else F.col(c) for c in rows.columns
    ])


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof's steps give."""
    def up(h, step):
        side, sibling = F.substring(step, 1, 1), F.substring(step, 2, 64)
        return F.sha2(
            F.when(side == LEFT, F.concat(sibling, h)).when(side == RIGHT, F.concat(h, sibling)).otherwise(h).cast("binary"), 256)

    return F.aggregate(proof, leaf, up)


def siblings_hash(proof: Column) -> Column:
    """SHA-256 of the proof's siblings, as hex text one after another."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.substring(s, 2, 64)), "").cast("binary"), 256)


def manifest_proofs(docs: DataFrame, cfg: MerkleConfig = DEFAULT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row.

    Leaves are hashes of doc_id, source, lang, n_chars and text; a tree per ``lang``
    ascends by doc_id.  ``folded_root`` comes from the row as it is found: where
    ``tampered_row`` holds, n_chars is one more, so that ``verified`` is false unless
    n_chars is null.  Null values of any column have a form of their own, null langs
    and ids come first, repeated rows are leaves each (rows with one id are ordered by
    their hash).  Integer overflow of n_chars + 1 gives another type's value.  An empty
    table gives no rows.
    """
    checkpoint_dir(docs.sparkSession)
    cols = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    more = F.col("n_chars").cast("decimal(38,0)") + 1
    leaf, other = leaf_hash(*cols), leaf_hash(*cols[:3], more, cols[4])
    leaves = docs.select(
        "doc_id", F.col("lang").alias("part"), leaf.alias("leaf"),
        F.when(tampered_row(F.col("doc_id")), other).alias("other"), F.monotonically_increasing_id().alias("salt"),
    ).checkpoint()
    leaves = ranked(leaves, "part", "doc_id", "leaf", "salt").drop("salt")
    found = proofs(leaves, cfg).withColumn("folded_root", fold(F.coalesce("other", "leaf"), F.col("proof")))
    return found.select(
        "doc_id", "leaf", "subroot", "root", siblings_hash(F.col("proof")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))
