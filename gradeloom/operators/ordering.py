"""Exact ranks and exact-k picks that never sort one group in one task.

A group (a source file, a pool, a folder) may hold a third of all rows. Both
helpers cut each group into order-preserving blocks, count the blocks with a
map-side-combined aggregation and only sort inside a block.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import scratch_path

# 3 hex digits: up to 4096 blocks per group.
HASH_BLOCK_DIGITS = 3


def seeded_hash(seed: int | str, *parts: Column) -> Column:
    """Hex digest that replaces a seeded random draw; the order is uniform."""
    return F.sha2(F.concat_ws("::", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def hash_block(digest: Column) -> Column:
    return F.left(digest, F.lit(HASH_BLOCK_DIGITS))


def block_offsets(df: DataFrame, keys: Sequence[str], levels: Sequence[str], weight: Column | None = None) -> DataFrame:
    """Per block: ``__n`` rows, ``__before`` rows of earlier blocks of its key.

    ``levels`` are nested: level i only orders blocks inside the levels before
    it, so each window sees the distinct values of one level only.
    """
    weight = F.lit(1) if weight is None else weight
    keys, levels = list(keys), list(levels)
    blocks = df.groupBy(*keys, *levels).agg(F.sum(weight.cast("bigint")).alias("__n"))
    inner = W.partitionBy(*keys, *levels[:-1]).orderBy(levels[-1])
    before = F.coalesce(F.sum("__n").over(inner.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = blocks.withColumn("__before", before)
    if len(levels) > 1:
        outer = block_offsets(blocks, keys, levels[:-1], F.col("__n")).select(
            *keys, *levels[:-1], F.col("__before").alias("__outer")
        )
        out = out.join(outer, [*keys, *levels[:-1]]).withColumn("__before", F.col("__before") + F.col("__outer")).drop("__outer")
    return out


def refuse_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df``; a null in one of ``columns`` fails the job, for a join on it would lose the row."""
    return df.withColumns(
        {
            c: F.coalesce(F.col(c), F.raise_error(F.lit(f"{c} must not be null")).cast(df.schema[c].dataType))
            for c in columns
        }
    )


def global_ordinal(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Add the 1-based position of every row of ``df`` in the order of the columns ``order``.

    Rows are cut into ranges of the order, written below the shared folder and
    numbered inside their range; only one count per range meets at the driver.
    ``order`` should tell rows apart, so that ranges can be even; nulls come first.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "ranges")
    ranged = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    ranged.write.parquet(path)
    staged = spark.read.schema(ranged.schema).parquet(path)
    counts = sorted((r["__part"], r["n"]) for r in staged.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())
    before = itertools.accumulate((n for _, n in counts), initial=0)
    offsets = spark.createDataFrame([(p, b) for (p, _), b in zip(counts, before)], "__part int, __before bigint")
    local = W.partitionBy("__part").orderBy(*order)
    return (
        staged.withColumn("__local", F.row_number().over(local))
        .join(F.broadcast(offsets), "__part")
        .withColumn(out, F.col("__local") + F.col("__before"))
        .drop("__part", "__local", "__before")
    )


def with_ordinal(
    df: DataFrame,
    keys: Sequence[str],
    levels: Sequence[str],
    order: Sequence[Column | str],
    out: str,
    hot: Column | None = None,
) -> DataFrame:
    """Add the 1-based row number within ``keys`` ordered by ``levels + order``.

    A null in ``keys`` or ``levels`` is an error. ``hot`` tells which rows belong to
    groups large enough to be cut; other groups stay one block each, so the
    table of block counts only holds the few large groups.
    """
    df = refuse_nulls(df, [*keys, *levels])
    if hot is None:
        cut, staged = list(levels), df
        offsets = block_offsets(df, keys, cut)
    else:
        cut = [f"__level{i}" for i in range(len(levels))]
        staged = df.withColumns({c: F.when(hot, F.col(name)) for c, name in zip(cut, levels)})
        offsets = block_offsets(staged.where(hot), keys, cut)
    offsets = offsets.select(*keys, *cut, "__before")
    local = W.partitionBy(*keys, *cut).orderBy(*(levels if hot is not None else []), *order)
    return (
        staged.withColumn("__local", F.row_number().over(local))
        .join(offsets, [*keys, *cut], "inner" if hot is None else "left")
        .withColumn(out, (F.col("__local") + F.coalesce(F.col("__before"), F.lit(0))).cast("bigint"))
        .drop("__local", "__before", *(cut if hot is not None else []))
    )


def exact_k(
    df: DataFrame, keys: Sequence[str], digest: str, k: Callable[[Column], Column]
) -> DataFrame:
    """Keep the ``k(n)`` rows with the smallest digest in each group of n rows.

    Blocks wholly beyond k are cut off before the sort; only what is left is
    ranked inside its block.
    """
    keys = list(keys)
    df = refuse_nulls(df, [*keys, digest])
    blocked = df.withColumn("__blk", hash_block(F.col(digest)))
    offsets = block_offsets(blocked, keys, ["__blk"])
    total = F.sum("__n").over(W.partitionBy(*keys))
    limits = (
        offsets.withColumn("__k", k(total))
        .where(F.col("__before") < F.col("__k"))
        .select(*keys, "__blk", "__before", "__k")
    )
    local = W.partitionBy(*keys, "__blk").orderBy(digest)
    return (
        blocked.join(limits, [*keys, "__blk"])
        .withColumn("__rn", F.row_number().over(local) + F.col("__before"))
        .where(F.col("__rn") <= F.col("__k"))
        .drop("__rn", "__before", "__k", "__blk")
    )
