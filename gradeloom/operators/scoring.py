"""Parsed answers, correctness and accuracy at every level."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import runs as run_settings
from ..functions.choice import parse_choice
from ..functions.text import fill_unknown, norm_answer

INVALID_OPTIONS = "invalid_options"
LEVELS = (("category", "category"), ("question", "question_id"), ("image", "image_id"))


def score_predictions(preds: DataFrame) -> DataFrame:
    """Turn ``raw_output``/``error`` into one scored row per request.

    Error rows keep a null prediction, are wrong, and count as evaluated.
    """
    parsed = parse_choice(preds, "raw_output", "options", "pred_answer", "__invalid")
    error = F.coalesce(F.col("error"), F.when(F.col("__invalid"), INVALID_OPTIONS))
    good = F.col("error").isNull()
    return (
        parsed.withColumn("error", error)
        .withColumn("pred_answer", F.when(good, F.col("pred_answer")))
        .withColumn(
            "correct",
            F.coalesce(
                good & F.col("pred_answer").isNotNull()
                & (norm_answer(F.col("pred_answer")) == norm_answer(F.col("gt_answer"))),
                F.lit(False),
            ),
        )
        .withColumn("raw_model_output", F.when(good, F.coalesce(F.col("raw_output"), F.lit(""))))
        .drop("__invalid", "raw_output")
    )


def fill_unknown_ids(rows: DataFrame) -> DataFrame:
    return rows.withColumns({name: fill_unknown(F.col(name)) for name in ("image_id", "question_id", "category")})


def accuracy(correct: Column, total: Column) -> Column:
    return F.when(total > 0, correct / total).otherwise(F.lit(0.0))


def _totals() -> tuple[Column, Column]:
    return (
        F.coalesce(F.count("correct"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.col("correct").cast("bigint")), F.lit(0)).cast("bigint").alias("correct"),
    )


def _with_accuracy(df: DataFrame) -> DataFrame:
    return df.withColumn("accuracy", accuracy(F.col("correct"), F.col("total")))


def accuracy_overall(scored: DataFrame) -> DataFrame:
    """Exactly one row, zeros for an empty input."""
    return _with_accuracy(scored.agg(*_totals()))


def accuracy_by(scored: DataFrame, key: str) -> DataFrame:
    return _with_accuracy(
        scored.select(fill_unknown(F.col(key)).alias(key), "correct").groupBy(key).agg(*_totals())
    )


def accuracy_all_levels(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Long form ``(level, key, total, correct, accuracy)`` in one pass.

    Grouping sets give no grand total on empty input, so one weightless row
    joins the input; it only survives in the overall row.
    """
    spark = scored.sparkSession
    by = list(by)
    narrow = scored.select(*by, *[fill_unknown(F.col(c)).alias(c) for _, c in LEVELS], "correct")
    if not by:
        narrow = narrow.unionByName(spark.range(1).select(F.lit(None).cast("boolean").alias("correct")), True)
    keys = [c for _, c in LEVELS]
    sets = [[F.col(b) for b in by]] + [[*map(F.col, by), F.col(k)] for k in keys]
    grouped = narrow.groupingSets(sets, *by, *keys).agg(*_totals(), F.grouping_id(*by, *keys).alias("__gid"))
    codes = {7: ("overall", None), **{7 - (1 << (2 - i)): LEVELS[i] for i in range(3)}}
    level, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for code, (name, column) in codes.items():
        level = F.when(F.col("__gid") == code, name).otherwise(level)
        if column:
            key = F.when(F.col("__gid") == code, F.col(column)).otherwise(key)
    out = grouped.select(*by, level.alias("level"), key.alias("key"), "total", "correct")
    return _with_accuracy(out.where(F.col("key").isNotNull() | (F.col("level") == "overall")))


def run_counters(
    checked: DataFrame, scored: DataFrame, by: Sequence[str] = (), files: DataFrame | None = None
) -> DataFrame:
    """Queue, skip and exception counters of a run in one row (per ``by`` key).

    Both inputs are reduced before they meet. ``files`` has the ``path`` of every
    file found, so that files without a queued row count as discovered too.
    """
    by = list(by)
    reason = F.col("skip_reason")
    queue = (checked.groupBy(*by) if by else checked).agg(
        F.count(F.lit(1)).alias("queued"),
        F.count(F.lit(1)).alias("total_sampled_questions"),
        F.count_if(reason == "missing_fields").alias("skipped_missing_fields"),
        F.count_if(reason == "missing_files").alias("skipped_missing_files"),
        F.count_distinct("source_input").alias("json_files_discovered"),
    )
    done = (scored.groupBy(*by) if by else scored).agg(
        F.count(F.lit(1)).alias("evaluated"),
        F.count_if(F.col("error").isNotNull()).alias("exceptions"),
    )
    if files is not None:
        queue = queue.withColumn("json_files_discovered", files.agg(F.count_distinct("path").alias("n")).scalar())
    if not by:
        return queue.select("*", done.select(F.struct("*")).scalar().alias("__done")).select(*queue.columns, "__done.*")
    return queue.join(done, by, "left").fillna(0, ["evaluated", "exceptions"])


def compare_runs(metrics: DataFrame, runs: Sequence[str], baseline: str) -> DataFrame:
    """Accuracy of several runs side by side and their distance to a baseline.

    ``metrics`` is the long form with ``run_name``.
    """
    wide = (
        metrics.groupBy("level", F.coalesce("key", F.lit("")).alias("key"))
        .pivot("run_name", list(runs))
        .agg(F.first("accuracy"))
    )
    deltas = [
        (F.col(f"`{r}`") - F.col(f"`{baseline}`")).alias(f"{r}_delta") for r in runs if r != baseline
    ]
    return wide.select("*", *deltas)


# The value of each ablation axis that the others are compared with.
AXES = {"input_mode": run_settings.SWEEP_MODES[0], "repeat_prompt": False, "no_temp_summary": False}


def one_axis_pairs(runs: DataFrame, axes: Mapping[str, object] = AXES) -> DataFrame:
    """``run_name, axis, value, baseline_run``: runs of one model that differ in one axis only."""
    pairs = None
    for axis, base in axes.items():
        same = ["family", "model_id", *[a for a in axes if a != axis]]
        at_base = F.col(axis) == F.lit(base)
        baseline = runs.where(at_base).select(*same, F.col("run_name").alias("baseline_run"))
        found = runs.where(~at_base).join(baseline, same).select(
            "run_name", F.lit(axis).alias("axis"), F.col(axis).cast("string").alias("value"), "baseline_run"
        )
        pairs = found if pairs is None else pairs.unionAll(found)
    return pairs


def compare_axes(metrics: DataFrame, runs: DataFrame, axes: Mapping[str, object] = AXES) -> DataFrame:
    """Per run, axis, level and key the distance to the run that only differs in that axis.

    ``metrics`` is the long form with ``run_name``, ``runs`` the table of runs. A
    key that the baseline lacks has a null distance.
    """
    known = metrics.select("run_name", "level", F.coalesce("key", F.lit("")).alias("key"), "accuracy")
    # All runs of a key in one row, which is shuffled once: bounded by the number of runs, as are the pairs.
    per_key = known.groupBy("level", "key").agg(F.collect_list(F.struct("run_name", "accuracy")).alias("__scores"))
    pairs = one_axis_pairs(runs, axes).agg(F.collect_list(F.struct("run_name", "axis", "value", "baseline_run"))).scalar()
    paired = per_key.withColumn("__pairs", pairs).select("level", "key", "__scores", F.inline("__pairs"))

    def of(run: str) -> Column:
        return F.filter("__scores", lambda s: s["run_name"] == F.col(run))

    own = paired.select("*", F.explode(of("run_name")).alias("__own"))
    joined = own.select(
        "run_name", "axis", "value", "baseline_run", "level", "key", F.col("__own.accuracy").alias("accuracy"),
        F.explode_outer(F.when(F.col("level").isNotNull(), of("baseline_run"))).alias("__base"),
    ).withColumn("baseline_accuracy", F.col("__base.accuracy"))
    return joined.select(
        "run_name", "axis", "value", "baseline_run", "level", "key", "accuracy", "baseline_accuracy",
        (F.col("accuracy") - F.col("baseline_accuracy")).alias("delta"),
    )


def dataset_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_distinct("source_input").alias("source_files"),
        F.count_distinct(F.struct("image_id", "rgb_path", "thermal_path")).alias("unique_images"),
    )
