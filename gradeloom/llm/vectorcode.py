"""Product codes of vectors, with exact integer arithmetic on floating-point matrix products.

Components become integers ``floor(SCALE * x)``. A vector is cut into ``parts`` equal
consecutive parts; every part position has a codebook of ``entries`` integer entries,
started with the parts of the vectors with the smallest ids and refined for ``rounds``
rounds of nearest-entry assignment and componentwise ``floor(sum / count)``.

Distances need dot products without rounding. :func:`exact_products` splits integers
into limbs so short that a float64 matrix product of two limbs stays below 2 ** 53,
and puts the limb products together in int64. ``argmin`` takes the first least entry.

A round is one scan: each task adds up the parts it assigns, and ``entries * width``
sums, whatever the number of rows, come to the driver. No row is shuffled and no task
holds more than one batch, so a vector or label that holds a third of all rows does
no harm.

Defined results: rows whose vector is null, or holds a null, a NaN or an infinity, are
dropped; repeated rows are coded each; ids that tie for the start go by their vectors,
null ids last; with fewer than ``entries`` rows the codebooks have as many entries as
rows; a vector shorter than the longest, or of a length that ``parts`` does not divide,
counts as extended by zeros; empty vectors are such; an empty table gives no row; null
labels are one label; further columns are kept only if named. Components so large that
a distance may leave 64 bits are refused with ``ValueError``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

SCALE = 4096
BLOCK = 1 << 20  # components worked on at once


@dataclass(frozen=True)
class Coder:
    parts: int = 8
    entries: int = 16
    rounds: int = 6


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` of stacks of int64 matrices, exact while the true result fits 64 bits."""
    inner = a.shape[-1]
    bits = (53 - max(inner - 1, 0).bit_length()) // 2

    def limbs(x: np.ndarray) -> list[np.ndarray]:
        out = []
        while x.size and (x.min() < -(1 << bits) or x.max() > 1 << bits):
            out.append((x & ((1 << bits) - 1)).astype(np.float64))
            x = x >> bits
        return [*out, x.astype(np.float64)]

    total = np.zeros((*a.shape[:-1], b.shape[-1]), dtype=np.int64)
    right = limbs(b)
    for i, x in enumerate(limbs(a)):
        for j, y in enumerate(right):
            if bits * (i + j) < 64:
                total += (x @ y).astype(np.int64) << (bits * (i + j))
    return total


def nearest(parts: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first nearest entry and its squared distance, for ``parts[p, row]`` and ``codebooks[p, entry]``."""
    cross = exact_products(parts, codebooks.swapaxes(1, 2))
    distance = (codebooks**2).sum(axis=2)[:, None, :] - 2 * cross
    code = distance.argmin(axis=2)
    return code, np.take_along_axis(distance, code[:, :, None], axis=2)[:, :, 0] + (parts**2).sum(axis=2)


def _integers(column: pa.Array, width: int) -> np.ndarray:
    """Rows of ``width`` integers of a column of lists without nulls, extended by zeros."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    whole = np.floor(column.values.to_numpy()[offsets[0] : offsets[-1]] * SCALE).astype(np.int64)
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == width).all():
        return whole.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(whole)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = whole
    return out


def _blocks(batch: pa.RecordBatch, width: int, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(first row, parts[p, row, component])`` of pieces of a batch."""
    step = max(1, BLOCK // max(width, 1))
    for at in range(0, batch.num_rows, step):
        rows = _integers(batch.column("__v").slice(at, step), width)
        yield at, np.ascontiguousarray(rows.reshape(len(rows), parts, -1).swapaxes(0, 1))


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has finite components only, as doubles in ``__v``."""
    v = F.col(f"`{vector}`").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(v.isNotNull() & fine).withColumn("__v", v)


def _sums(codebooks: np.ndarray, width: int):
    """Per task: sums of the parts of every entry, then their counts, as ``(slot, total)``."""
    parts, entries, part_width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros_like(codebooks)
        counts = np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            for _, x in _blocks(batch, width, parts):
                code, _ = nearest(x, codebooks)
                for p in range(parts):
                    order = np.argsort(code[p], kind="stable")
                    seen, first = np.unique(code[p][order], return_index=True)
                    sums[p, seen] += np.add.reduceat(x[p][order], first, axis=0)
                    counts[p] += np.bincount(code[p], minlength=entries)
        flat = np.concatenate([sums.ravel(), counts.ravel()])
        used = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(flat[used])], names=["slot", "total"])

    return run


def train(vectors: DataFrame, coder: Coder, vec_id: str = "vec_id", vector: str = "embedding") -> np.ndarray | None:
    """Codebooks as an integer array ``[part, entry, component]``; None if no row is usable."""
    rows = usable(vectors, vector)
    about = rows.agg(
        F.max(F.size("__v")).alias("size"), F.max(F.array_max(F.transform("__v", F.abs))).alias("most")
    ).first()
    if about["size"] is None:
        return None
    part_width = -(-about["size"] // coder.parts)
    width = part_width * coder.parts
    most = int((about["most"] or 0.0) * SCALE) + 1
    if max(width, 1) * (2 * most) ** 2 >= 2**63:
        raise ValueError(f"components up to {about['most']} are too large for exact 64-bit distances")
    first = rows.orderBy(F.col(f"`{vec_id}`").asc_nulls_last(), "__v").select("__v").limit(coder.entries).collect()
    start = _integers(pa.array([r["__v"] for r in first], pa.list_(pa.float64())), width)
    codebooks = np.ascontiguousarray(start.reshape(len(start), coder.parts, part_width).swapaxes(0, 1))
    for _ in range(coder.rounds):
        found = rows.select("__v").mapInArrow(_sums(codebooks, width), "slot long, total long")
        flat = np.zeros(codebooks.size + codebooks.shape[0] * codebooks.shape[1], dtype=np.int64)
        for r in found.groupBy("slot").agg(F.sum("total").alias("total")).collect():
            flat[r["slot"]] = r["total"]
        sums, counts = flat[: codebooks.size].reshape(codebooks.shape), flat[codebooks.size :].reshape(codebooks.shape[:2])
        codebooks = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], codebooks)
    return codebooks


def digest(codebooks: np.ndarray | None) -> str:
    """SHA-256 of all entries' components in decimal, joined by commas."""
    values = [] if codebooks is None else codebooks.ravel().tolist()
    return hashlib.sha256(",".join(map(str, values)).encode()).hexdigest()


def encode(vectors: DataFrame, codebooks: np.ndarray | None, keep: list[str], vector: str = "embedding") -> DataFrame:
    """The columns ``keep`` of all usable rows with ``code`` (two hex digits a part) and ``error`` (squared distance)."""
    rows = usable(vectors, vector).select(*[F.col(f"`{c}`") for c in keep], "__v")
    kinds = ", ".join([*[f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in keep], "code string, error bigint"])
    if codebooks is None:
        return rows.where("false").select(*keep, F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"))
    parts, entries, part_width = codebooks.shape
    digits = np.array([f"{e:02x}" for e in range(entries)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = [], [np.empty(0, dtype=np.int64)]
            for _, x in _blocks(batch, parts * part_width, parts):
                code, distance = nearest(x, codebooks)
                codes += map("".join, digits[code.T].tolist())
                errors.append(distance.sum(axis=0))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(codes, pa.string()), pa.array(np.concatenate(errors))],
                names=[*keep, "code", "error"],
            )

    return rows.mapInArrow(run, kinds)


def decode(codes: DataFrame, codebooks: np.ndarray, code: str = "code") -> DataFrame:
    """The vector that a code stands for, in ``decoded``."""
    entries = F.array(
        *[F.array(*[F.array(*[F.lit(v / SCALE) for v in entry]) for entry in part]) for part in codebooks.tolist()]
    )
    index = lambda p: F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("decoded", F.concat(*[F.get(F.get(entries, p), index(p)) for p in range(len(codebooks))]))


def label_errors(coded: DataFrame, label: str = "label") -> DataFrame:
    """``coded`` with ``label_error``: the error summed over its label, nulls together."""
    coded = materialise(coded, "vector-codes")
    sums = coded.groupBy(F.col(f"`{label}`").alias("__label")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col(f"`{label}`").eqNullSafe(F.col("__label")), "left").drop("__label")


def compress(vectors: DataFrame, coder: Coder = Coder(), vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256`` of every usable row."""
    codebooks = train(vectors, coder, vec_id, vector)
    coded = encode(vectors, codebooks, [vec_id, label], vector)
    return label_errors(coded, label).withColumn("codebooks_sha256", F.lit(digest(codebooks)))
