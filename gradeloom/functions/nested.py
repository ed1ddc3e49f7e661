"""Rewriting and collecting paths inside nested values.

With a declared schema the walk becomes one column expression. Documents
without a schema go through a per-document helper inside an Arrow-batched map.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .paths import clean_prefix, has_path_prefix, rewrite_path_prefix

PATH_ENTRY = "array<struct<json_key:string,path:string>>"


def rewrite_paths(c: Column, dtype: T.DataType, old: str, new: str) -> Column:
    """The same value with the prefix swapped in every string, never in keys."""
    if isinstance(dtype, T.StringType):
        return rewrite_path_prefix(c, old, new)
    if isinstance(dtype, T.StructType):
        fields = [rewrite_paths(c[f.name], f.dataType, old, new).alias(f.name) for f in dtype.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: rewrite_paths(x, dtype.elementType, old, new))
    if isinstance(dtype, T.MapType):
        return F.transform_values(c, lambda _, x: rewrite_paths(x, dtype.valueType, old, new))
    return c


def count_rewrites(c: Column, dtype: T.DataType, old: str) -> Column:
    zero = F.lit(0).cast("bigint")
    if isinstance(dtype, T.StringType):
        return has_path_prefix(c, old).cast("bigint")
    if isinstance(dtype, T.StructType):
        total = zero
        for f in dtype.fields:
            total = total + count_rewrites(c[f.name], f.dataType, old)
        return total
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        values, inner = (c, dtype.elementType) if isinstance(dtype, T.ArrayType) else (F.map_values(c), dtype.valueType)
        summed = F.aggregate(values, zero, lambda acc, x: acc + count_rewrites(x, inner, old))
        return F.coalesce(summed, zero)
    return zero


def collect_paths(c: Column, dtype: T.DataType, key: Column | None = None) -> Column:
    """Every string starting with ``/`` and its key path, in document order."""
    key = F.lit("") if key is None else key
    none = F.array().cast(PATH_ENTRY)

    def child(name: Column) -> Column:
        return F.when(key == "", name).otherwise(F.concat(key, F.lit("."), name))

    if isinstance(dtype, T.StringType):
        hit = F.array(F.struct(key.alias("json_key"), c.alias("path")))
        return F.when(c.startswith("/"), hit).otherwise(none)
    if isinstance(dtype, T.StructType):
        found = [collect_paths(c[f.name], f.dataType, child(F.lit(f.name))) for f in dtype.fields]
        return F.concat(*found) if found else none
    if isinstance(dtype, T.ArrayType):
        at = lambda i: F.concat(key, F.lit("["), i.cast("string"), F.lit("]"))
        each = F.transform(c, lambda x, i: collect_paths(x, dtype.elementType, at(i)))
        return F.coalesce(F.flatten(each), none)
    if isinstance(dtype, T.MapType):
        each = F.transform(F.map_entries(c), lambda e: collect_paths(e["value"], dtype.valueType, child(e["key"])))
        return F.coalesce(F.flatten(each), none)
    return none


def _leaves(value, key=""):
    """String leaves of parsed JSON with the container that holds them."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _leaves_of(value, k, v, f"{key}.{k}" if key else k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from _leaves_of(value, i, v, f"{key}[{i}]")


def _leaves_of(holder, slot, value, key):
    if isinstance(value, str):
        yield holder, slot, value, key
    else:
        yield from _leaves(value, key)


def _parsed(txt: str | None) -> dict | None:
    """The document below one key, so that its root can be replaced; None if it is not JSON."""
    try:
        return {"": json.loads(txt)} if txt is not None else None
    except ValueError:
        return None


def unreadable_documents(docs: DataFrame) -> DataFrame:
    """``json_file`` of the documents whose text is not JSON."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bad = [p for p, t in zip(batch["path"], batch["txt"]) if _parsed(t) is None]
            yield pd.DataFrame({"json_file": pd.Series(bad, dtype=object)})

    return docs.select("path", "txt").mapInPandas(run, "json_file string")


def rewrite_documents(docs: DataFrame, old: str, new: str) -> DataFrame:
    """``(path, txt, changed)`` for documents without a declared schema.

    Unchanged documents keep their text as it is, and so do texts that are not
    JSON: ``json_files.quarantine_bad_files`` names those.
    """
    old, new = clean_prefix(old), new.strip().rstrip("/")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, counts = [], []
            for txt in batch["txt"]:
                root, changed = _parsed(txt) or {}, 0
                for holder, slot, value, _ in list(_leaves(root)):
                    if value == old or value.startswith(old + "/"):
                        holder[slot] = new + value[len(old) :]
                        changed += 1
                texts.append(json.dumps(root[""], ensure_ascii=False, indent=2) if changed else txt)
                counts.append(changed)
            yield pd.DataFrame({"path": batch["path"], "txt": texts, "changed": counts})

    return docs.select("path", "txt").mapInPandas(run, "path string, txt string, changed bigint")


def collect_document_paths(docs: DataFrame) -> DataFrame:
    """``(json_file, pos, json_key, path)`` for documents without a schema; none for a text that is not JSON."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (file, pos, key, value)
                for file, txt in zip(batch["path"], batch["txt"])
                for pos, (key, value) in enumerate(
                    (k, v) for _, _, v, k in _leaves(_parsed(txt) or {}) if v.startswith("/")
                )
            ]
            if rows:
                yield pd.DataFrame(rows, columns=["json_file", "pos", "json_key", "path"])

    return docs.select("path", "txt").mapInPandas(run, "json_file string, pos bigint, json_key string, path string")
