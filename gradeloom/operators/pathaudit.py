"""Path status, path audit and prefix migration summaries."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nested
from ..functions.paths import resolve_relative_path
from ..sources.json_files import READ_KEY, UNREADABLE

PATH_FIELDS = ("rgb_path", "thermal_path")


def path_status(paths: DataFrame, inventory: DataFrame) -> DataFrame:
    """``(path, reason)`` of distinct paths against a listing.

    ``inventory``: path and optionally ``is_dir`` and ``readable``. The reason
    is null for a usable file.
    """
    known, reason = _listing(inventory)
    distinct = paths.select("path").where(F.col("path").isNotNull()).distinct()
    return distinct.join(known, "path", "left").select("path", reason.alias("reason"))


def _listing(inventory: DataFrame) -> tuple[DataFrame, Column]:
    """The listing with status flags, and the reason they spell after a left join."""
    has = inventory.columns
    # a listing may repeat a path: a file wins over a folder, readable over not
    known = inventory.groupBy("path").agg(
        F.min(F.col("is_dir") if "is_dir" in has else F.lit(False)).alias("__dir"),
        F.max(F.col("readable") if "readable" in has else F.lit(True)).alias("__ok"),
        F.lit(True).alias("__hit"),
    )
    reason = (
        F.when(F.col("__hit").isNull(), "missing")
        .when(F.col("__dir"), "not_a_file")
        .when(~F.col("__ok"), "not_readable")
    )
    return known, reason


# Status words of the audit and of the migration report.
MISSING = ("missing", "missing (path does not exist)")
DIRECTORY = ("not_a_file", "is a directory (expected a file)")
NOT_REGULAR = ("not_a_file", "not a regular file")
NOT_READABLE = ("not_readable", "permission denied (not readable)")


def _probe(path: str) -> tuple[str | None, str | None]:
    try:
        mode = os.stat(path).st_mode
    except (OSError, ValueError):
        return MISSING
    if stat.S_ISDIR(mode):
        return DIRECTORY
    if not stat.S_ISREG(mode):
        return NOT_REGULAR
    if not os.access(path, os.R_OK):
        return NOT_READABLE
    try:
        with open(path, "rb") as handle:
            handle.read(1)
    except OSError as exc:
        return "not_readable", f"os error: {exc}"
    return None, None


def probe_path_status(paths: DataFrame) -> DataFrame:
    """``(path, reason, detail)`` by opening each distinct path once, where the
    files are on a file system that every executor mounts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            status = [_probe(p) for p in batch["path"]]
            yield pd.DataFrame(
                {"path": batch["path"], "reason": [r for r, _ in status], "detail": [d for _, d in status]}
            )

    distinct = paths.select("path").where(F.col("path").isNotNull()).distinct()
    return distinct.mapInPandas(run, "path string, reason string, detail string")


def resolved_paths(records: DataFrame) -> DataFrame:
    """Unpivot both path fields: ``(json_file, record, field, raw, resolved)``."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("raw")) for f in PATH_FIELDS])
    return records.select("json_file", "record", F.explode(pairs).alias("p")).select(
        "json_file", "record", "p.field", "p.raw",
        resolve_relative_path(F.col("p.raw"), F.col("json_file")).alias("resolved"),
    )


# Blank paths are spread over this many join keys that match nothing.
NULL_SPREAD = 1024


def audit_paths(records: DataFrame, inventory: DataFrame) -> DataFrame:
    """One row per bad (file, record, field), judged by a listing.

    One pass over the records and one join; a blank path gets a key of its own.
    """
    wide = resolved_paths(records)
    spread = F.concat(F.lit("\x00"), F.pmod(F.hash("record"), F.lit(NULL_SPREAD)).cast("string"))
    keyed = wide.withColumn("__path", F.coalesce("resolved", spread))
    listed, reason = _listing(inventory)
    joined = keyed.join(listed.withColumnRenamed("path", "__path"), "__path", "left")
    why = F.when(F.col("resolved").isNull(), "empty_path").otherwise(reason)
    return joined.withColumn("reason", why).where(F.col("reason").isNotNull()).select(*wide.columns, "reason")


def audit_paths_by_probe(records: DataFrame) -> DataFrame:
    """The same by opening files; each distinct path is probed once."""
    wide = resolved_paths(records)
    blank = wide.where(F.col("resolved").isNull()).withColumn("reason", F.lit("empty_path"))
    status = probe_path_status(wide.select(F.col("resolved").alias("path"))).where(F.col("reason").isNotNull())
    bad = wide.join(status.select(F.col("path").alias("resolved"), "reason"), "resolved")
    return bad.select(*wide.columns, "reason").unionByName(blank)


def path_audit_summary(files: DataFrame, records: DataFrame, issues: DataFrame) -> DataFrame:
    """Files, records, issues and an overall verdict in one row."""
    count: Column = F.count(F.lit(1))
    found = issues.agg(count.alias("n")).scalar()
    seen = records.agg(count.alias("n")).scalar()
    return files.agg(count.alias("json_files")).select(
        "json_files", seen.alias("records_checked"), found.alias("issues_found"), (found == 0).alias("ok")
    )


def path_update_summary(changes: DataFrame) -> DataFrame:
    return changes.agg(
        F.count_if(F.col("changed") > 0).alias("files_changed"),
        F.coalesce(F.sum("changed"), F.lit(0)).cast("bigint").alias("replacements"),
    )


def validate_document_paths(docs: DataFrame, inventory: DataFrame | None = None) -> DataFrame:
    """``(json_file, json_key, path, reason)`` of all paths in documents that cannot be used.

    Each path counts once per file, under the first key that holds it. A text that
    is not JSON gives one row of its own and stops nothing. Without an
    ``inventory`` the paths are probed.
    """
    found = first_path_occurrence(nested.collect_document_paths(docs))
    if inventory is None:
        status = probe_path_status(found).select("path", F.col("detail").alias("reason"))
    else:
        status = path_status(found, inventory)
    bad = found.join(status.where(F.col("reason").isNotNull()), "path").select("json_file", "json_key", "path", "reason")
    unread = nested.unreadable_documents(docs).select(
        "json_file", F.lit(READ_KEY).alias("json_key"), F.lit("<n/a>").alias("path"), F.lit(UNREADABLE).alias("reason")
    )
    return bad.unionByName(unread)


def first_path_occurrence(found: DataFrame) -> DataFrame:
    """Each path once per file with the first key that holds it."""
    return found.groupBy("json_file", "path").agg(F.min_by("json_key", "pos").alias("json_key"))
