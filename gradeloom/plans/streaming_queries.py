"""Queries: streams over the logged actions and predictions, run to the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import review, scoring, validate
from ..session import scratch_path
from ..streaming import jobs
from . import adapters
from .evaluation_queries import _level
from .registry import register
from .review_queries import _PROPAGATED_COLUMNS, PROPAGATED

FILES_PER_BATCH = 4
# Lines of a logged file. Every batch costs the driver a result of each state partition, so files are not small.
LINES_PER_FILE = 4_000_000


def _written(spark, df, label, compression="none"):
    path = scratch_path(spark, label)
    df.write.option("maxRecordsPerFile", LINES_PER_FILE).option("compression", compression).json(path)
    return path


def _action_stream(spark, sf_dir):
    """The log written as JSON files and read back as a stream."""
    log = adapters.actions(spark, sf_dir).select(
        "seq", "type", "timestamp", "qa_key", "label", "human_answer", "option_index", "auto_propagated"
    )
    # several files even for a small log, so that several batches run
    path = _written(spark, log.repartition(12, "seq"), "actions")
    return jobs.read_action_stream(spark, path, log.schema, FILES_PER_BATCH)


def _prediction_stream(spark, sf_dir):
    scored = scoring.score_predictions(adapters.preds_raw(spark, sf_dir))
    path = _written(spark, scored.select(jobs.PREDICTION.names).repartition(12, "row_idx"), "preds")
    return jobs.read_prediction_stream(spark, path, FILES_PER_BATCH)


def _finish(query):
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def _places(spark, label):
    return scratch_path(spark, label), scratch_path(spark, f"{label}-checkpoint")


@register("stream_latest_decision", "select qa_key, seq, label, option_index, human_answer from latest", ["latest"])
def stream_latest_decision(spark, sf_dir):
    out, checkpoint = _places(spark, "latest")
    _finish(jobs.stream_latest_decision(_action_stream(spark, sf_dir), out, checkpoint))
    return jobs.latest_decisions(spark, out).select("qa_key", "seq", "label", "option_index", "human_answer")


@register(
    "stream_running_accuracy",
    f"""select 'overall' as level, '' as key, count(*) as total, count(*) filter (correct) as correct,
  round(count(*) filter (correct) / count(*), 6) as accuracy from scored
union all {_level('category', 'category')} union all {_level('question', 'question_id')} union all {_level('image', 'image_id')}""",
    ["scored"],
)
def stream_running_accuracy(spark, sf_dir):
    out, checkpoint = _places(spark, "accuracy")
    _finish(jobs.stream_running_accuracy(_prediction_stream(spark, sf_dir), out, checkpoint))
    return jobs.running_accuracy(spark, out).select(
        "level", "key", "total", "correct", F.round("accuracy", 6).alias("accuracy")
    )


@register("stream_propagate_labels", PROPAGATED, ["review_items", "group_map", "actions"])
def stream_propagate_labels(spark, sf_dir):
    items, mapping = adapters.review_items(spark, sf_dir), adapters.group_map(spark, sf_dir)
    out, checkpoint = _places(spark, "seeds")
    _finish(jobs.stream_propagate_labels(_action_stream(spark, sf_dir), items, mapping, out, checkpoint))
    decided = review.latest_decision(adapters.actions(spark, sf_dir))
    return jobs.propagated_labels(spark, out, items, mapping, decided).select(*_PROPAGATED_COLUMNS)


@register(
    "progress_metrics",
    "select count(*) as processed, count(*) filter (correct) as correct, count(error) as exceptions, true as several_batches from scored",
    ["scored"],
)
def progress_metrics(spark, sf_dir):
    """Counters per micro-batch, summed up over the batches."""
    out, checkpoint = _places(spark, "progress")
    _finish(jobs.progress_metrics(_prediction_stream(spark, sf_dir), out, checkpoint))
    per_batch = spark.read.parquet(out)
    return per_batch.agg(
        F.sum("processed").alias("processed"), F.sum("correct").alias("correct"),
        F.sum("exceptions").alias("exceptions"), (F.count_distinct("epoch") > 1).alias("several_batches"),
    )


@register(
    "observed_progress",
    """select count(*) filter (c.skip_reason is null) as processed, count(*) filter (c.skip_reason is null and s.correct) as correct,
  count(*) filter (c.skip_reason is null and s.error is not null) as exceptions, count(*) filter (c.skip_reason is not null) as skipped,
  0 as left_at_end, true as fell from checked c join scored s using (source_input, row_idx)""",
    ["checked", "scored"],
)
def observed_progress(spark, sf_dir):
    """Counters that the batches observed while they wrote; ``fell`` says that what is left fell with every batch."""
    # scored first: answers need not move to meet the files; the join keeps every row, so what is expected is counted without it
    rows = scoring.score_predictions(adapters.preds_raw(spark, sf_dir))
    queue = validate.join_file_inventory(rows, adapters.files(spark, sf_dir), "rgb_thermal")
    outcomes = queue.select(jobs.OUTCOME.names).repartition(12, "row_idx")
    stream = jobs.read_action_stream(spark, _written(spark, outcomes, "outcomes", "gzip"), jobs.OUTCOME, FILES_PER_BATCH)
    out, checkpoint = _places(spark, "observed")
    jobs.stream_progress(stream, out, checkpoint).finish()
    batches = jobs.observed_progress(spark, out, rows.count())
    return batches.agg(
        *[F.sum(c).alias(c) for c in ("processed", "correct", "exceptions", "skipped")], F.min("left").alias("left_at_end"),
        ((F.count_distinct("left") == F.count(F.lit(1))) & (F.count(F.lit(1)) > 1)).alias("fell"),
    )
