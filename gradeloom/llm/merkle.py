"""Merkle manifest of a dataset: a content-addressed store of digest-to-children records, and proofs read from it.

Rows are leaves. The leaves of a tree (one per language here) are ranked by their id;
while a tree has several nodes, every run of ``fanout`` consecutive ones becomes the
digest of their digests. The last node of a tree is its subroot; the subroots, ordered
by the key of their tree, form one more tree, whose last node is the root.

The store holds ``block digest -> [(digest, children)]``: the records of ``levels``
levels below one node, so that a tree of n leaves is ``log(n) / levels`` joins deep.
A proof is a descent: requests go from the root to their leaf, one block at a time; in
a block the digits of the rank choose a child at each record and the children not
chosen are collected. The path, reversed, goes from the leaf to the root.

Scale: ranks come from ranges of the order, so a tree that holds a third of all rows is
spread; a group in a task is one block, at most ``fanout ** levels`` nodes. Requests
that share a block travel as one row. Digests are 32 bytes until the last step, and
only the number of trees and the largest size come to the driver.

Defined results: a null field counts as ``-``; null ids come first, equal ids go by
their leaf digest, and whole repeated rows are leaves each; a null key is a tree of its
own, first in order; a lone leaf is its subroot, and a lone subroot is the root; a run
of one node is hashed like any other; an empty table has no root and no row; further
columns, whatever their names, are neither read nor hashed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gradeloom.operators.ordering import global_ordinal

from .common import materialise, whole_groups

STEP = "array<struct<left: string, right: string>>"


@dataclass(frozen=True)
class Shape:
    """Children per node, and levels per block of the store."""

    fanout: int = 2
    levels: int = 10

    @property
    def span(self) -> int:
        return self.fanout**self.levels


@dataclass(frozen=True)
class Manifest:
    """``trees``: key, tree, n, subroot; ``store``: digest, records; ``leaves``: tree, rank, digest and further columns."""

    root: str | None
    trees: DataFrame
    store: DataFrame
    leaves: DataFrame
    largest: int
    n_trees: int
    shape: Shape


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256))


def _hexes(column: pa.Array) -> list[str]:
    return [v.hex() for v in column.to_pylist()]


def _digests(hexes: list[str]) -> pa.Array:
    return pa.array([bytes.fromhex(h) for h in hexes], pa.binary())


def _builder(shape: Shape):
    """Blocks of nodes sorted by tree, block and rank: the digest above each and the records between."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, cuts in whole_groups(batches, ["tree", "block"]):
            nodes, tree, block, n = (part.column(c) for c in ("digest", "tree", "block", "n"))
            tops, owner, child, run = [], [], [], []
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                level = _hexes(nodes.slice(a, z - a))
                lone, done, records = n[a].as_py() <= shape.span, 0, 0
                while len(level) > 1 if lone else done < shape.levels:
                    runs = [level[i : i + shape.fanout] for i in range(0, len(level), shape.fanout)]
                    level = [hashlib.sha256("".join(r).encode()).hexdigest() for r in runs]
                    owner += level
                    for r in runs:
                        child += r
                        run.append(len(r))
                    done, records = done + 1, records + len(runs)
                tops.append((level[0], records))
            children = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(run)]).astype(np.int32), _digests(child))
            record = pa.StructArray.from_arrays([_digests(owner), children], names=["node", "children"])
            bounds = np.concatenate([[0], np.cumsum([r for _, r in tops])]).astype(np.int32)
            first = pa.array(cuts[:-1])
            size = np.asarray(n.take(first))
            yield pa.RecordBatch.from_arrays(
                [
                    tree.take(first).combine_chunks(),
                    block.take(first).combine_chunks(),
                    pa.array(-(-size // shape.span)),
                    _digests([t for t, _ in tops]),
                    pa.ListArray.from_arrays(bounds, record),
                ],
                names=["tree", "rank", "n", "digest", "records"],
            )

    return build


BLOCKS = "tree long, rank long, n long, digest binary, records array<struct<node: binary, children: array<binary>>>"


def _climb(nodes: DataFrame, largest: int, shape: Shape) -> tuple[DataFrame, list[DataFrame]]:
    """Top digest of every tree of ``tree, rank, n, digest``, and the blocks of its levels."""
    tops, packs = [], []
    while True:
        blocks = nodes.select("tree", F.expr(f"rank div {shape.span}").alias("block"), "rank", "n", "digest")
        grouped = blocks.repartition("tree", "block").sortWithinPartitions("tree", "block", "rank")
        built = materialise(grouped.mapInArrow(_builder(shape), BLOCKS), "merkle-blocks")
        packs.append(built.select("digest", "records"))
        tops.append(built.where("n = 1").select("tree", "digest"))
        if largest <= shape.span:
            return reduce(DataFrame.unionByName, tops), packs
        nodes, largest = built.where("n > 1"), -(-largest // shape.span)


def _ranked(leaves: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """``leaves`` with ``tree, rank, n``; and the trees as ``key, tree, n``."""
    spread = leaves.withColumn("__spread", F.monotonically_increasing_id())
    ranges = spread.repartitionByRange(key, order, "digest", "__spread").sortWithinPartitions(key, order, "digest")
    staged = materialise(ranges.withColumn("__row", F.monotonically_increasing_id()).drop("__spread"), "merkle-ranges")
    part = F.shiftright("__row", 33)
    counts = staged.groupBy(F.col(key).alias("__key"), part.alias("__part")).agg(
        F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__first")
    )
    totals = counts.groupBy("__key").agg(F.sum("__n").alias("n"))
    trees = global_ordinal(totals, ["__key"], "tree").select(F.col("__key").alias(key), (F.col("tree") - 1).alias("tree"), "n")
    trees = materialise(trees, "merkle-trees")
    earlier = W.partitionBy("__key").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    offsets = before.join(trees, F.col("__key").eqNullSafe(trees[key])).select("__key", "__part", "__first", "__before", "tree", "n")
    placed = staged.join(offsets, F.col(key).eqNullSafe(F.col("__key")) & (part == F.col("__part"))).withColumn(
        "rank", F.col("__row") - F.col("__first") + F.col("__before")
    )
    return materialise(placed.drop("__row", "__key", "__part", "__first", "__before"), "merkle-leaves"), trees


def build(leaves: DataFrame, key: str, order: str, shape: Shape = Shape()) -> Manifest:
    """Manifest of ``leaves``: ``digest`` (32 bytes), the column ``key`` of its tree, the column ``order`` and others."""
    placed, trees = _ranked(materialise(leaves, "merkle-digests"), key, order)
    found = trees.agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("trees")).first()
    largest, n_trees = found["n"] or 0, found["trees"]
    tops, packs = _climb(placed.select("tree", "rank", "n", "digest"), largest, shape)
    over = tops.select(F.lit(-1).cast("bigint").alias("tree"), F.col("tree").alias("rank"), F.lit(n_trees).cast("bigint").alias("n"), "digest")
    last, more = _climb(over, n_trees, shape)
    root = last.first()
    records = reduce(DataFrame.unionByName, packs + more).where("size(records) > 0")
    store = materialise(records.groupBy("digest").agg(F.first("records").alias("records")), "merkle-store")
    return Manifest(
        root["digest"].hex() if root else None, trees.join(tops.withColumnRenamed("digest", "subroot"), "tree"), store, placed.drop("n"), largest, n_trees, shape
    )


def _walker(shape: Shape, item: list[str]):
    """From a block's digest to every child asked for, by the digits of its rank."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column("items")
            ends, lefts, rights, found = [0], [], [], []
            rows = zip(*(batch.column(c).to_pylist() for c in ("digest", "block", "nodes", "path")), batch.column("records"), items, strict=True)
            for digest, block, nodes, path, records, wanted in rows:
                record = {}
                for r in records.as_py() or ():
                    record[r["node"]] = r["children"]
                height = shape.levels if nodes is None else sum(shape.fanout**h < nodes for h in range(64))
                before_left, before_right = [s["left"] for s in path], [s["right"] for s in path]
                seen = {(): (digest, (), ())}  # shared beginnings of paths are walked once
                for child in wanted.values.field("child").to_pylist():
                    place, node, left, right = child - block * shape.span, digest, (), ()
                    for h in range(height - 1, -1, -1):
                        prefix = (h, place // shape.fanout**h)
                        if prefix not in seen:
                            digit, run = prefix[1] % shape.fanout, record[node]
                            step = ("".join(c.hex() for c in run[:digit]), "".join(c.hex() for c in run[digit + 1 :]))
                            seen[prefix] = (run[digit], (*left, step[0]), (*right, step[1]))
                        node, left, right = seen[prefix]
                    found.append(node)
                    lefts += before_left
                    lefts += left
                    rights += before_right
                    rights += right
                    ends.append(len(lefts))
            steps = pa.StructArray.from_arrays([pa.array(lefts, pa.string()), pa.array(rights, pa.string())], names=["left", "right"])
            flat = items.flatten()
            owner = pa.array(np.repeat(np.arange(batch.num_rows), items.value_lengths().to_numpy()))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(owner) for c in ("tree", "subroot")),
                    *(flat.field(c) for c in item),
                    pa.array(found, pa.binary()),
                    pa.ListArray.from_arrays(np.array(ends, dtype=np.int32), steps),
                ],
                names=["tree", "subroot", *item, "digest", "path"],
            )

    return walk


def _descend(tops: DataFrame, requests: DataFrame, store: DataFrame, largest: int, shape: Shape) -> DataFrame:
    """``requests`` (``tree, child`` and others) with ``subroot``, the ``digest`` found and the ``path`` from the root."""
    groups = next(g for g in range(1, 64) if largest <= shape.span**g)
    item = [c for c in requests.columns if c != "tree"]
    size = lambda g: shape.span**g
    frontier = None
    for g in range(groups - 1, -1, -1):
        mine = F.col("n") <= size(g + 1)
        start = tops.where(mine if g == 0 else mine & (F.col("n") > size(g))).select(
            "tree",
            F.lit(0).cast("bigint").alias("block"),
            "subroot",
            F.col("subroot").alias("digest"),
            "path",
            F.ceil(F.expr(f"(n + {size(g) - 1}) div {size(g)}")).cast("bigint").alias("nodes"),
        )
        frontier = start if frontier is None else frontier.unionByName(start)
        asked = requests if g == 0 else requests.select("tree", F.expr(f"child div {size(g)}").alias("child")).distinct()
        kept = item if g == 0 else ["child"]
        wanted = asked.groupBy("tree", F.expr(f"child div {shape.span}").alias("block")).agg(F.collect_list(F.struct(*kept)).alias("items"))
        joined = frontier.join(wanted, ["tree", "block"]).join(store, "digest", "left")
        kinds = ", ".join(f"`{c}` {asked.schema[c].dataType.simpleString()}" for c in kept)
        walked = joined.mapInArrow(_walker(shape, kept), f"tree long, subroot binary, {kinds}, digest binary, path {STEP}")
        frontier = walked.select("tree", F.col("child").alias("block"), "subroot", "digest", "path", F.lit(None).cast("bigint").alias("nodes"))
    return walked


def prove(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """Different leaves ``tree, rank`` with further columns; adds ``subroot, digest`` (bytes) and ``proof``.

    ``proof`` has a step for every level from the leaf up: the digests, as text, that
    stand to the left and to the right of the node within its run.
    """
    if manifest.root is None:
        return requests.select("*", F.lit(None).cast("binary").alias("subroot"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast(STEP).alias("proof")).where("false")
    spark = requests.sparkSession
    over = spark.createDataFrame([(-1, bytes.fromhex(manifest.root), [], manifest.n_trees)], f"tree long, subroot binary, path {STEP}, n long")
    wanted = requests.select(F.lit(-1).cast("bigint").alias("tree"), F.col("tree").alias("child")).distinct()
    tops = _descend(over, wanted, manifest.store, manifest.n_trees, manifest.shape).select(F.col("child").alias("tree"), F.col("digest").alias("subroot"), "path")
    tops = tops.join(manifest.trees.select("tree", "n"), "tree")
    found = _descend(tops, requests.withColumnRenamed("rank", "child"), manifest.store, manifest.largest, manifest.shape)
    return found.withColumn("proof", F.reverse("path")).withColumnRenamed("child", "rank").drop("path")


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf, as text, and a proof lead to."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]).cast("binary"), 256))


def audit(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """Every row proved, and one row in seven tried with ``n_chars`` raised by one.

    Columns ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    raised = [*fields[:3], F.col("n_chars").cast("decimal(20,0)") + 1, fields[4]]
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    leaves = docs.select("doc_id", "lang", leaf_digest(*fields).alias("digest"), F.when(hit, leaf_digest(*raised)).alias("changed"))
    manifest = build(leaves, "lang", "doc_id", shape)
    proved = prove(manifest, manifest.leaves.select("tree", "rank", "doc_id", "changed"))
    text = lambda c: F.lower(F.hex(c))
    folded = proved.select(
        "doc_id",
        text("digest").alias("leaf"),
        text("subroot").alias("subroot"),
        F.lit(manifest.root).cast("string").alias("root"),
        proof_digest(F.col("proof")).alias("proof_sha256"),
        fold(text(F.coalesce("changed", "digest")), F.col("proof")).alias("folded_root"),
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
