"""Sharding by a weighted k-d tree (operator 7), in DataFrame operations only.

The corpus is split in two along its widest metadata dimension (all have one scale of 15 bits: a size's
logarithm, a category's place by hash, so categories are told apart before sizes), at the place that divides its bytes
as the two sides' numbers of shards demand; the halves are split in the same way until each leaf
holds its target, one shard's bytes. All nodes of a level are split together.

*Distributed weighted medians.* Along a dimension rows are ordered by a 63-bit key: 15 bits of the
dimension, then a hash of the row, so that rows with equal metadata can still be divided: a source
with a third of all rows spreads over as many shards as its bytes need. The place is found by
refining a histogram of bytes, 4096 bins at a time inside the bin that holds it, until that bin is a
single row or too light to matter. Bins are summed before and after one shuffle of the sums; at most
4096 sums a node reach the driver. Texts are read once; the tree works on thin rows.

Results for odd input: null text has no bytes and checksum 0; null metadata is a value of its own;
rows with a null or repeated doc_id are each placed; equal texts need not share a shard; fewer rows
than shards leave shards empty; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHARDS = 24
OVERHEAD = 8
ROWS_PER_BUCKET = 1 << 14
#: Bits of a key below those that the first histogram bins, and bits of each histogram.
KEY_BITS, BIN_BITS = 63, 12
#: A bin lighter than this part of a shard is not refined.
FINE = 1e-4


@dataclass
class Node:
    """``leaves`` shards, the first of them ``first``; split at ``key`` of dimension ``dim``."""

    first: int
    leaves: int
    dim: int | None = None
    key: int | None = None
    low: Node | None = None
    high: Node | None = None

    def place(self, keys: list[Column]) -> Column:
        """The unsplit node that a row falls in (by its first shard), and the row's key there."""
        if self.low is None or self.high is None:
            return F.struct(F.lit(self.first).alias("node"), (keys[self.dim] if self.dim is not None else F.lit(0).cast("long")).alias("k"))
        return F.when(keys[self.dim] < F.lit(self.key), self.low.place(keys)).otherwise(self.high.place(keys))


def metadata(docs: DataFrame) -> list[Column]:
    """The dimensions, as integers below 2**15: a category by its hash, a size by its logarithm."""
    category = lambda c: F.pmod(F.xxhash64(F.lit(c), F.col(c)), F.lit(1 << 15))
    size = F.least(F.floor(1024 * F.log2(F.col("size").cast("double"))), F.lit((1 << 15) - 1))
    return [size.cast("long"), *[category(c) for c in ("source", "lang") if c in docs.columns]]


def _split_places(rows: DataFrame, active: list[Node], shards: int, totals: dict[int, int], share: float) -> None:
    """Set ``key`` of each active node to divide its bytes. ``rows``: node, k, size."""
    goal = {n.first: totals[n.first] * (n.leaves // 2) / n.leaves for n in active}
    start = {n.first: 0 for n in active}
    before = {n.first: 0 for n in active}
    open_, shift = list(active), KEY_BITS
    while open_:
        width = (1 << shift) - 1
        shift = max(0, shift - BIN_BITS)
        lows: list[int | None] = [None] * shards
        for n in open_:
            lows[n.first] = start[n.first]
        off = F.col("k") - F.get(F.array(*[F.lit(x).cast("long") for x in lows]), F.col("node"))
        sums = rows.where(off.between(0, width)).groupBy("node", F.shiftright("k", shift).alias("bin")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
        found: dict[int, list[tuple[int, int, int]]] = {n.first: [] for n in open_}
        for r in sums.collect():
            found[r["node"]].append((r["bin"], r["bytes"], r["n"]))
        still = []
        for n in open_:
            f = n.first
            bins = sorted(found[f])
            n.key = (bins[-1][0] + 1) << shift if bins else start[f]
            for b, size, count in bins:
                if before[f] + size < goal[f]:
                    before[f] += size
                    continue
                if count > 1 and shift and size > share:
                    start[f] = b << shift
                    still.append(n)
                else:  # the whole bin goes to the nearer side
                    n.key = (b if goal[f] - before[f] < size / 2 else b + 1) << shift
                break
        open_ = still


def tree(thin: DataFrame, keys: list[Column], dims: list[Column], shards: int) -> Node:
    """The tree over ``thin`` rows (size, and what keys and dims use)."""
    root = Node(0, shards)
    leaves, whole = [root], None
    while active := [n for n in leaves if n.leaves > 1]:
        spread = [x for i, d in enumerate(dims) for x in (F.min(d).alias(f"a{i}"), F.max(d).alias(f"b{i}"))]
        stats = {r["node"]: r for r in thin.select("*", root.place(keys).alias("at")).groupBy("at.node").agg(F.sum("size").alias("bytes"), *spread).collect()}
        if whole is None:
            whole = stats[0]["bytes"] if stats else 0
        for n in active:
            r = stats.get(n.first)
            reach = [r[f"b{i}"] - r[f"a{i}"] if r else 0 for i in range(len(dims))]
            n.dim = max(range(len(dims)), key=lambda i: (reach[i], -i))
        totals = {n.first: stats[n.first]["bytes"] if n.first in stats else 0 for n in active}
        _split_places(thin.select(root.place(keys).alias("at"), "size").select("at.*", "size"), active, shards, totals, FINE * whole / shards)
        for n in active:
            k = n.leaves // 2
            n.low, n.high = Node(n.first, k), Node(n.first + k, n.leaves - k)
        leaves = [x for n in leaves for x in ((n.low, n.high) if n.low is not None else (n,))]
    return root


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs`` (doc_id, text, and source and lang where they exist) in ``shards`` shards of nearly
    equal bytes: doc_id, size, text_crc32, law ('bytes'), shard, slot (gapless from 0 in a shard),
    grown_shard (null: the tree is built for one number of shards)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *[F.col(c).cast("string").alias(c) for c in ("source", "lang") if c in docs.columns],
    )
    dims = metadata(base)
    names = [F.col(f"d{i}") for i in range(len(dims))]
    # Only fully repeated rows differ in the last eight bits.
    tie = F.shiftleft(F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32"), 24), 8) + F.pmod(F.monotonically_increasing_id(), F.lit(256))
    thin = common.store(base.select("doc_id", "size", "text_crc32", *[d.alias(f"d{i}") for i, d in enumerate(dims)], tie.alias("tie")), "thin")
    keys = [F.shiftleft(n, 48) + F.col("tie") for n in names]
    placed = thin.withColumn("shard", tree(thin, keys, names, shards).place(keys)["node"].cast("int"))
    out = common.numbered(placed, ["shard"], ["doc_id", "text_crc32", "tie"], ROWS_PER_BUCKET, "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_kdtree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(common.table(spark, sf_dir, "documents"))
