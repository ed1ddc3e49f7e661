"""What the operators share: words, let bindings inside expressions, tables written to the shared folder."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.session import scratch_path

# A word is a maximal run of other characters than these six.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
INK = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def whole_row(df: DataFrame, name: str = "__row") -> Column:
    """All columns as one struct, out of the way of the names that an operator uses."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body mentions it."""
    return F.transform(F.array(value), body)[0]


def split_words(text: Column) -> Column:
    """Array of the words of a text that is not null."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def count_words(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    n = F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, BLANK_RUN)))
    return F.coalesce(n, F.lit(0)).cast("bigint")


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes as a long; 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def unit_hash(*parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of an MD5; other engines can compute the same."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    bits = F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("bigint")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of an input sorted by ``keys``, with the bounds of the groups; a group must be bounded."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        part = part if held is None else pa.concat_tables([held, part])
        change = np.zeros(part.num_rows - 1, dtype=bool)
        for k in keys:
            col = part.column(k).to_numpy()
            change |= col[1:] != col[:-1]
        cuts = np.flatnonzero(change) + 1
        if not len(cuts):
            held = part
            continue
        yield part.slice(0, cuts[-1]), np.concatenate([[0], cuts])
        held = part.slice(cuts[-1])
    if held is not None:
        yield held, np.array([0, held.num_rows])
