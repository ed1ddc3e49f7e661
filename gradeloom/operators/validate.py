"""Which rows an evaluation run may use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank

MISSING_FIELDS = "missing_fields"
MISSING_FILES = "missing_files"
# Rows without a path are spread over this many join keys.
NULL_SPREAD = 1024
# Listings of more files are hashed by partition; up to it Spark may broadcast them.
HASHED_FILES = 1_000_000


def required_fields(mode: str) -> Column:
    ok = (
        ~is_blank(F.col("question"))
        & (F.coalesce(F.size("options"), F.lit(0)) > 0)
        & ~is_blank(F.col("gt_answer"))
    )
    if mode in ("rgb", "rgb_thermal"):
        ok = ok & ~is_blank(F.col("rgb_path"))
    if mode in ("thermal", "rgb_thermal"):
        ok = ok & ~is_blank(F.col("thermal_path"))
    return ok


def required_fields_filter(rows: DataFrame, mode: str) -> DataFrame:
    """Add ``skip_reason = missing_fields`` where a needed field is absent."""
    return rows.withColumn("skip_reason", F.when(~required_fields(mode), MISSING_FIELDS))


def drop_temp_summary(rows: DataFrame, no_temp: Column) -> DataFrame:
    return rows.withColumn("temp_summary", F.when(~no_temp, F.col("temp_summary")))


def _with_exists(rows: DataFrame, path: str, inventory: DataFrame, out: str, hashed: bool) -> DataFrame:
    """Left join on a path; absent paths get spread keys that match nothing."""
    spread = F.concat(F.lit("\x00"), F.pmod(F.xxhash64("source_input", "row_idx"), F.lit(NULL_SPREAD)).cast("string"))
    keyed = rows.withColumn("__path", F.when(is_blank(F.col(path)), spread).otherwise(F.col(path)))
    # a listing may repeat a path; the distinct shuffles by the key of the join
    known = inventory.select(F.col("path").alias("__path"), F.lit(True).alias(out)).distinct()
    # a hashed listing: rows of any width are neither sorted nor spilled to meet it
    known = known.hint("shuffle_hash") if hashed else known
    return keyed.join(known, "__path", "left").withColumn(out, F.coalesce(F.col(out), F.lit(False))).drop("__path")


def join_file_inventory(rows: DataFrame, inventory: DataFrame, mode: str) -> DataFrame:
    """Fields first, then files: ``skip_reason`` is null for eligible rows.

    ``inventory`` lists the existing paths. Only the columns a mode needs are
    joined. Counts the listing up to ``HASHED_FILES`` first, to choose the join.
    """
    out = required_fields_filter(rows, mode)
    found, hashed = F.lit(True), inventory.limit(HASHED_FILES + 1).count() > HASHED_FILES
    if mode in ("rgb", "rgb_thermal"):
        out, found = _with_exists(out, "rgb_path", inventory, "rgb_exists", hashed), F.col("rgb_exists")
    else:
        out = out.withColumn("rgb_exists", F.lit(True))
    if mode in ("thermal", "rgb_thermal"):
        out = _with_exists(out, "thermal_path", inventory, "thermal_exists", hashed)
        found = found & F.col("thermal_exists")
    else:
        out = out.withColumn("thermal_exists", F.lit(True))
    return out.withColumn(
        "skip_reason", F.coalesce(F.col("skip_reason"), F.when(~found, MISSING_FILES))
    )


def eligible(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("skip_reason").isNull())


def first_missing_paths(checked: DataFrame, n: int = 5) -> DataFrame:
    """The first n rows skipped for missing files, in queue order."""
    return (
        checked.where(F.col("skip_reason") == MISSING_FILES)
        .orderBy("source_input", "row_idx")
        .select("source_input", "row_idx", "rgb_path", "thermal_path")
        .limit(n)
    )


def first_exceptions(scored: DataFrame, n: int = 3) -> DataFrame:
    return (
        scored.where(F.col("error").isNotNull())
        .orderBy("source_input", "row_idx")
        .select("source_input", "row_idx", "image_id", "question_id", "error")
        .limit(n)
    )


def eligibility_summary(checked: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row of dry-run counters, also for an empty queue.

    ``files`` has the ``path`` of every file found, so that empty, malformed and
    unsampled files count as discovered; without it the files of the queue count.
    """
    reason = F.col("skip_reason")
    counted = checked.agg(
        F.count_distinct("source_input").alias("json_files_discovered"),
        F.count(F.lit(1)).alias("total_sampled_questions"),
        F.count_if(reason.isNull()).alias("eligible_for_eval"),
        F.count_if(reason == MISSING_FIELDS).alias("skipped_missing_fields"),
        F.count_if(reason == MISSING_FILES).alias("skipped_missing_files"),
    )
    if files is None:
        return counted
    found = files.agg(F.count_distinct("path").alias("n")).scalar()
    return counted.withColumn("json_files_discovered", found)
