"""Consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``vnodes`` points of a ring; a key belongs to the first point at
or clockwise of its hash. A shard takes no more than its capacity: in rounds, keys
of full shards move on to the next point clockwise, in ring order, until all have
a place. Only the histogram of keys per arc (``shards * vnodes`` numbers, a
parameter) is worked on at the driver; it gives, for every arc, which stretch of
its keys goes to which shard and at which slot that stretch starts. The rows then
find their stretch by their rank within the arc, so no row moves through one task.

Defined results: null doc_ids and null texts are keys like others; rows that tie in
hash and doc_id are ordered by size and text checksum, rows equal in all of these
are interchangeable; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, text_bytes

RING_BITS = 40
SLICE_BITS = 12
PIECE = 4096  # ranks of a repeated row that are written out at once


@dataclass(frozen=True)
class Ring:
    """``slack`` 0 fills all shards alike: counts are at most one apart."""

    shards: int = 24
    vnodes: int = 128
    slack: float = 0.0
    seed: int = 5

    def points(self) -> list[tuple[int, int]]:
        """Sorted (position, shard) of all virtual nodes."""
        return sorted(
            (xxhash.xxh64_intdigest(f"{self.seed}:{s}:{v}".encode()) >> (64 - RING_BITS), s)
            for s in range(self.shards)
            for v in range(self.vnodes)
        )

    def capacities(self, total: int) -> np.ndarray:
        base, more = divmod(total, self.shards)
        level = np.full(self.shards, base, dtype=np.int64)
        level[:more] += 1
        return np.ceil(level * (1.0 + self.slack)).astype(np.int64) if self.slack else level


def assign_arcs(counts: np.ndarray, owners: np.ndarray, capacities: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Stretches (arc, first rank, size, shard) of the bounded-load placement.

    In each round the arcs still holding keys point at one virtual node each, all
    equally far from home; arcs are served in ring order, each gives its foremost
    keys as far as the shard has room, and the rest moves on.
    """
    n = len(counts)
    left, given, room = counts.astype(np.int64).copy(), np.zeros(n, dtype=np.int64), capacities.copy()
    stretches, step = [], 0
    while True:
        active = np.flatnonzero(left)
        if not len(active):
            return stretches
        if step > 0 and room.sum() < left.sum():
            raise ValueError("the shards have less room than there are keys")
        for arc in active:
            shard = owners[(arc + step) % n]
            take = min(left[arc], room[shard])
            if take:
                stretches.append((int(arc), int(given[arc]), int(take), int(shard)))
                left[arc] -= take
                given[arc] += take
                room[shard] -= take
        step += 1


def ring_hash(seed: int, key: Column) -> Column:
    """Ring position of a key; the same for every row of that key."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 64 - RING_BITS)


def _with_arc(rows: DataFrame, positions: np.ndarray) -> DataFrame:
    """``rows`` with ``arc``, the first virtual node at or clockwise of ``at``.

    The ring is cut into 2**``SLICE_BITS`` slices; a row looks only at the nodes of its own.
    """
    slices = np.arange(2**SLICE_BITS + 1, dtype=np.int64) << (RING_BITS - SLICE_BITS)
    starts = np.searchsorted(positions, slices)
    table = [(k, int(a), positions[a:b].tolist()) for k, (a, b) in enumerate(zip(starts[:-1], starts[1:]))]
    nodes = rows.sparkSession.createDataFrame(table, "slice int, start int, nodes array<long>")
    found = rows.withColumn("slice", F.shiftright("at", RING_BITS - SLICE_BITS).cast("int")).join(F.broadcast(nodes), "slice")
    passed = F.size(F.filter("nodes", lambda p: p < F.col("at")))
    return found.withColumn("arc", (F.col("start") + passed) % len(positions)).drop("slice", "start", "nodes")


def shard(docs: DataFrame, ring: Ring = Ring()) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` per row of ``docs``; slots of a shard run from 0 without gaps."""
    points = ring.points()
    positions = np.array([p for p, _ in points], dtype=np.int64)
    owners = np.array([s for _, s in points], dtype=np.int64)
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(
        "doc_id", (text_bytes(F.col("text")) + 8).alias("size"), F.crc32(text).cast("bigint").alias("text_crc32")
    )
    # Rows without an id are spread by their text.
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat_ws(":", F.lit("~"), "text_crc32", "size"))
    rows = rows.withColumn("at", ring_hash(ring.seed, key))
    # Rows that repeat become one row with a count before anything is sorted.
    rows = rows.groupBy("doc_id", "size", "text_crc32", "at").agg(F.count(F.lit(1)).alias("n"))
    rows = materialise(_with_arc(rows, positions), "ring-keys")

    counts = np.zeros(len(points), dtype=np.int64)
    for r in rows.groupBy("arc").agg(F.sum("n").alias("n")).collect():  # one row per virtual node at most
        counts[r["arc"]] = r["n"]
    stretches = assign_arcs(counts, owners, ring.capacities(int(counts.sum())))
    starts = np.zeros(ring.shards, dtype=np.int64)
    placed = []
    for arc, first, size, to in stretches:
        placed.append((arc, first, first + size, to, int(starts[to]) - first))
        starts[to] += size
    # At most one stretch per virtual node and one per shard: bounded by the ring, not by the data.
    stretch = docs.sparkSession.createDataFrame(placed, "arc int, lo long, hi long, shard int, shift long")

    upto = F.sum("n").over(W.partitionBy("arc").orderBy("at", "doc_id", "size", "text_crc32").rowsBetween(W.unboundedPreceding, 0))
    ranked = rows.withColumn("hi_rank", upto).withColumn("lo_rank", F.col("hi_rank") - F.col("n"))
    parts = (
        ranked.join(F.broadcast(stretch), "arc")
        .withColumns({"first": F.greatest("lo_rank", "lo"), "end": F.least("hi_rank", "hi")})
        .where(F.col("first") < F.col("end"))
    )
    # A row that repeats is cut into pieces, which other tasks may write out; a given number of partitions is not coalesced.
    pieces = parts.select(
        "doc_id", "size", "text_crc32", "shard", "shift", "end", F.explode(F.sequence("first", F.col("end") - 1, F.lit(PIECE).cast("bigint"))).alias("first")
    )
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.repartition(tasks, "shard", "first", "doc_id", "text_crc32")
    last = F.least(F.col("end"), F.col("first") + PIECE) - 1
    return pieces.select("doc_id", "size", "text_crc32", "shard", "shift", F.explode(F.sequence("first", last)).alias("rank")).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("rank") + F.col("shift")).alias("slot")
    )
