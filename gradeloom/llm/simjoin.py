"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles; a link is a Jaccard similarity of 0.8 or
more. Texts with equal words are one node. MinHash bands propose candidates; inside
a bucket, pairs compare their MinHash values in steps, and a pair is dropped as
soon as the posterior probability that its similarity reaches the threshold falls
below the tolerance. What is left only joins nodes to families. Inside a family
every pair is verified exactly on the whole shingle sets.

No pair is ever a row: buckets and families larger than a block are cut into chunks
and worked on as pairs of chunks, each task gives per node its number of links and
an edge to the root of its block. So the rows grow with members times chunks.

A pair at similarity 0.8 shares none of 20 bands of 4 values with a probability of
2.6e-5, at 0.85 of 4e-7; the ten steps of pruning together drop 8.6e-5 at 0.8 and
2.4e-6 at 0.85. So about 1.1e-4 of the pairs at 0.8 are lost, unless other pairs join
their texts to one family.

Defined results: a text of one to four words has one shingle, its word sequence; null
and blank texts are classes of their own without links; repeated rows are copies of
each other and link; a null doc_id is a document like others (class ids are the
smallest doc_id that is not null); an empty table gives no rows; other columns are
not read. Nodes are 64-bit hashes of the word sequence.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, whole_groups, whole_row
from .components import connected_components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 4
HASHES = BANDS * ROWS
STEP = 8
TOLERANCE = 1e-5
BLOCK = 256  # nodes of one chunk of a bucket
FAMILY_BLOCK = 128  # nodes of one chunk of a family
BLOCK_SHINGLES = 200_000  # shingles of one chunk of a family, on average
COLUMNS = 4096  # shingles counted at once
PAIRS = 200_000  # pairs compared at once

_U = np.uint64
_rng = np.random.default_rng(20)
_MULTIPLY = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * _U(2) + _U(1)
_ADD = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
_PLACE = _rng.integers(0, 2**63, SHINGLE, dtype=np.uint64) * _U(2) + _U(1)
_BAND = _rng.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * _U(2) + _U(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of five words."""
    n = len(words)
    if n == 0:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=n)
    width = min(n, SHINGLE)
    s = np.full(n - width + 1, width, dtype=np.uint64)
    for k in range(width):
        s += h[k : n - width + 1 + k] * _PLACE[k]
    return np.unique(_mix(s))


def min_hashes(s: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(s), 2048):
        part = s[None, at : at + 2048] * _MULTIPLY[:, None]
        part += _ADD[:, None]
        np.minimum(out, part.min(axis=1), out=out)
    return out


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, hashes: int = HASHES) -> np.ndarray:
    """For every n, the fewest equal values among n at which P(similarity >= threshold) is at least ``tolerance``.

    The prior is uniform, the posterior after m equal values is Beta(m + 1, n - m + 1);
    with whole parameters its upper tail is a sum of binomial terms.
    """
    out = np.zeros(hashes + 1, dtype=np.int64)
    for n in range(1, hashes + 1):
        tail, m = 0.0, -1
        for m in range(n + 1):
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
        out[n] = m
    return out


_LEAST = least_matches()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        n = len(texts)
        node, check = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
        size = np.zeros(n, dtype=np.int32)
        bands = np.zeros((n, BANDS), dtype=np.uint64)
        marks = np.zeros((n, HASHES), dtype=np.uint16)
        long = np.zeros(n, dtype=bool)
        for i in range(n):
            words = (texts[i].as_py() or b"").split()
            if not words:
                continue
            whole = xxhash.xxh128_intdigest(b" ".join(words))
            node[i], check[i] = whole >> 64, whole & (2**64 - 1)
            s = shingles(words)
            size[i] = len(s)
            if len(words) < SHINGLE:
                continue
            long[i] = True
            low = min_hashes(s)
            bands[i] = _mix((low.reshape(BANDS, ROWS) * _BAND).sum(axis=1))
            marks[i] = _mix(low) >> _U(48)
        offsets = np.concatenate([[0], np.cumsum(np.where(long, BANDS, 0))]).astype(np.int32)
        keys = bands[long].ravel().view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("k1"),
                batch.column("k2"),
                pa.array(node.view(np.int64), mask=size == 0),
                pa.array(check.view(np.int64)),
                pa.array(size),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys)),
                pa.array([m.tobytes() for m in marks], pa.binary()),
            ],
            names=["doc_id", "k1", "k2", "node", "check", "size", "bands", "marks"],
        )


def _shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        nodes, sets = [], []
        for i in range(len(texts)):
            words = (texts[i].as_py() or b"").split()
            nodes.append((xxhash.xxh128_intdigest(b" ".join(words)) >> 64) if words else 0)
            sets.append(shingles(words).tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)), pa.array(sets, pa.binary())], names=["node", "shingles"]
        )


def _pairs(low: int, high: int, chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if low == high:
        return np.triu_indices(len(chunk), 1)
    a, b = np.flatnonzero(chunk == low), np.flatnonzero(chunk == high)
    return np.repeat(a, len(b)), np.tile(b, len(a))


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row of the component of each row."""
    label = np.arange(n)
    while True:
        old = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if np.array_equal(old, label):
            return label


def surviving(marks: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that no step of the comparison drops."""
    keep_i, keep_j = [], []
    for at in range(0, len(i), PAIRS):
        a, b = i[at : at + PAIRS], j[at : at + PAIRS]
        equal = np.zeros(len(a), dtype=np.int64)
        for n in range(STEP, HASHES + 1, STEP):
            equal += (marks[a, n - STEP : n] == marks[b, n - STEP : n]).sum(axis=1)
            good = equal >= _LEAST[n]
            a, b, equal = a[good], b[good], equal[good]
            if not len(a):
                break
        keep_i.append(a)
        keep_j.append(b)
    return np.concatenate(keep_i or [i]), np.concatenate(keep_j or [j])


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, cuts in whole_groups(batches, ["bucket", "low", "high"]):
        node = part.column("node").to_numpy()
        low, high, chunk = (part.column(c).to_numpy() for c in ("low", "high", "chunk"))
        marks = np.frombuffer(b"".join(part.column("marks").to_pylist()), dtype=np.uint16).reshape(-1, HASHES)
        found = []
        waiting_i, waiting_j, waiting = [], [], 0
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if z - a < 2:
                continue
            i, j = (np.array([0]), np.array([1])) if z - a == 2 and low[a] == high[a] else _pairs(low[a], high[a], chunk[a:z])
            waiting_i.append(i + a)
            waiting_j.append(j + a)
            waiting += len(i)
            if waiting >= PAIRS:
                found.append(surviving(marks, np.concatenate(waiting_i), np.concatenate(waiting_j)))
                waiting_i, waiting_j, waiting = [], [], 0
        if waiting:
            found.append(surviving(marks, np.concatenate(waiting_i), np.concatenate(waiting_j)))
        if not found:
            continue
        # Groups never share rows, so the components of all groups of the part are found at once.
        root = _roots(len(node), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
        child = np.flatnonzero(root != np.arange(len(node)))
        yield pa.RecordBatch.from_arrays([pa.array(node[child]), pa.array(node[root[child]])], names=["a", "b"])


def common_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of all sets ``left`` with all sets ``right``."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1  # others meet nothing
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), dtype=np.float64)
    for start in range(0, int(shared.sum()), COLUMNS):
        a, z = np.searchsorted(column, [start, start + COLUMNS])
        grid = np.zeros((len(sets), min(COLUMNS, int(shared.sum()) - start)), dtype=np.float32)
        grid[owner[a:z], column[a:z] - start] = 1.0
        out += grid[left] @ grid[right].T
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, cuts in whole_groups(batches, ["family", "low", "high"]):
        node, docs = part.column("node").to_numpy(), part.column("n_docs").to_numpy()
        low, high, chunk = (part.column(c).to_numpy() for c in ("low", "high", "chunk"))
        column = part.column("shingles")
        nodes, roots, links = [], [], []
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            sets = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in column[a:z]]
            left = np.arange(z - a) if low[a] == high[a] else np.flatnonzero(chunk[a:z] == low[a])
            right = left if low[a] == high[a] else np.flatnonzero(chunk[a:z] == high[a])
            if not len(left) or not len(right):
                continue
            common = common_counts(sets, left, right)
            sizes = np.array([len(s) for s in sets])
            linked = common >= THRESHOLD * (sizes[left][:, None] + sizes[right][None, :] - common) - 1e-6
            if low[a] == high[a]:
                np.fill_diagonal(linked, False)
            count = np.zeros(z - a, dtype=np.int64)
            count[left] = linked @ docs[a:z][right]
            if low[a] != high[a]:
                count[right] = linked.T @ docs[a:z][left]
            i, j = np.nonzero(linked)
            root = _roots(z - a, left[i], right[j])
            nodes.append(node[a:z])
            roots.append(node[a:z][root])
            links.append(count)
        if nodes:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in (nodes, roots, links)], names=["node", "root", "links"]
            )


def _chunked(members: DataFrame, group: str, chunks: Column) -> DataFrame:
    """Every member once for each pair of chunks its own chunk is part of."""
    with_chunk = members.withColumn("__of", chunks).withColumn(
        "chunk", F.pmod(F.xxhash64("node", group), F.col("__of")).cast("int")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("__of").cast("int") - 1)).alias("__other")
    rows = with_chunk.select(*members.columns, "chunk", other)
    return rows.withColumns({"low": F.least("chunk", "__other"), "high": F.greatest("chunk", "__other")}).drop("__other")


def _by_block(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def row_keys(docs: DataFrame) -> DataFrame:
    """``docs`` with two hashes over doc_id and text, never null: together the key of a row."""
    return docs.withColumns(
        {"k1": F.xxhash64(F.lit(1), F.col("doc_id"), F.col("text")), "k2": F.xxhash64(F.lit(2), F.col("text"), F.col("doc_id"))}
    )


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, k1, k2, class, class_id, n_links, n_copies`` per row of ``docs``.

    ``class`` names the class, ``class_id`` is its smallest doc_id; ``n_links`` counts
    all other documents with a similarity of 0.8 or more, ``n_copies`` the documents of
    equal words, itself included.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    signed = materialise(
        row_keys(docs.select("doc_id", "text")).mapInArrow(
            _sign,
            f"doc_id {id_type}, k1 long, k2 long, node long, check long, size int, bands array<long>, marks binary",
        ),
        "join-signatures",
    )
    named = signed.where("node is not null")
    copies = named.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_docs"), F.max("size").alias("size"))
    copies = materialise(copies, "join-nodes")
    nodes = named.where(F.size("bands") > 0).select("node", "bands", "marks").dropDuplicates(["node"])
    nodes = materialise(nodes, "join-texts")

    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    crowded = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = buckets.join(materialise(crowded, "join-buckets"), "bucket")
    rows = _chunked(members, "bucket", F.ceil(F.col("m") / BLOCK)).join(nodes.select("node", "marks"), "node")
    keys = ["bucket", "low", "high"]
    edges = _by_block(rows.select(*keys, "chunk", "node", "marks"), keys).mapInArrow(_prune, "a long, b long")
    families = connected_components(edges, "join-families").withColumnRenamed("component", "family")

    member = materialise(families.join(copies, "node"), "join-members")
    sizes = member.groupBy("family").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("mass"))
    member = member.join(materialise(sizes, "join-family-sizes"), "family")
    cut = F.greatest(F.ceil(F.col("m") / FAMILY_BLOCK), F.ceil(F.col("mass") / BLOCK_SHINGLES))
    wanted = member.select(F.col("rep").alias("__rep")).distinct()
    texts = docs.select("doc_id", "text").join(wanted, docs["doc_id"].eqNullSafe(wanted["__rep"]), "left_semi")
    sets = materialise(
        texts.select("text").mapInArrow(_shingle, "node long, shingles binary"), "join-shingles"
    )
    repeated = sets.groupBy("node").agg(F.first("shingles").alias("shingles"))
    rows = _chunked(member.select("family", "node", "n_docs", "m", "mass"), "family", cut).join(repeated, "node")
    keys = ["family", "low", "high"]
    verified = materialise(
        _by_block(rows.select(*keys, "chunk", "node", "n_docs", "shingles"), keys).mapInArrow(
            _verify, "node long, root long, links long"
        ),
        "join-verified",
    )
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    found = connected_components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")), "join-classes")
    facts = (
        copies.join(found, "node", "left")
        .join(links, "node", "left")
        .select(
            "node",
            "rep",
            F.coalesce("component", "node").alias("class"),
            (F.coalesce("links", F.lit(0)) + F.col("n_docs") - 1).alias("n_links"),
            F.col("n_docs").alias("n_copies"),
        )
    )
    facts = materialise(facts, "join-facts")
    least = materialise(facts.groupBy("class").agg(F.min("rep").alias("class_id")), "join-class-ids")
    facts = materialise(facts.join(least, "class"), "join-node-classes").withColumnRenamed("node", "__node").drop("rep")
    return (
        signed.select("doc_id", "k1", "k2", "node")
        .join(facts, F.col("node") == F.col("__node"), "left")
        .select(
            "doc_id",
            "k1",
            "k2",
            F.coalesce("class", "k1").alias("class"),
            F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
            F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
            F.coalesce("n_copies", F.lit(1)).cast("bigint").alias("n_copies"),
        )
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, that of the smallest doc_id, with its own columns; blank texts all stay."""
    rows = classes(docs)
    blank = F.col("text").isNull() | ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    first = rows.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "k1", "k2")).alias("f"))
    first = materialise(first.select(F.col("f.k1").alias("__k1"), F.col("f.k2").alias("__k2")), "join-kept")
    keyed = docs.select(whole_row(docs), "doc_id", "text")
    keyed = row_keys(keyed).withColumn("__blank", blank).select("__row", "k1", "k2", "__blank")
    kept = keyed.join(first, (F.col("k1") == F.col("__k1")) & (F.col("k2") == F.col("__k2")))
    nth = F.row_number().over(W.partitionBy("k1", "k2").orderBy("k1"))
    return kept.withColumn("__nth", nth).where("__nth = 1 or __blank").select("__row.*")
