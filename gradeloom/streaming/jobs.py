"""Continuously maintained decisions, accuracy and propagated labels.

Every job is a streaming aggregation in update mode: partial aggregates are
combined on the map side before the shuffle, so one busy key does not overload
a task. Each micro-batch writes its changed rows into ``epoch=<id>`` (replaced if
the batch is retried after a failure); the current state of a key is its row of
the highest epoch. Checkpoints live next to the output, in a folder that all
executors share. :func:`compact` folds the log so far into one table, and readers
then only read the epochs after it. State is kept in RocksDB.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators import review, scoring
from ..schema import ACTION
from ..session import ROCKSDB, materialise

PREDICTION = T.StructType(
    [
        T.StructField("source_input", T.StringType()),
        T.StructField("row_idx", T.LongType()),
        T.StructField("image_id", T.StringType()),
        T.StructField("question_id", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("correct", T.BooleanType()),
        T.StructField("error", T.StringType()),
    ]
)


def read_action_stream(
    spark: SparkSession, path: str, schema: T.StructType = ACTION, files_per_batch: int | None = None
) -> DataFrame:
    """The append-only log as a stream. ``seq`` travels in each row because the
    order of files promises nothing."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def read_prediction_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    return read_action_stream(spark, path, PREDICTION, files_per_batch)


def _sink(out: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return write


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _start(changes: DataFrame, out: str, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "update") -> StreamingQuery:
    conf = changes.sparkSession.conf
    # A query takes its settings when it starts; one restarted from a checkpoint keeps those it began with.
    before = conf.get(_PROVIDER)
    conf.set(_PROVIDER, ROCKSDB)
    try:
        return (
            changes.writeStream.outputMode(mode)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(write)
            .start()
        )
    finally:
        conf.set(_PROVIDER, before)


def _compacted(out: str) -> str:
    return f"{out.rstrip('/')}-compacted"


def _newest(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    """Newest row per key, with its epoch: the last compaction and the epochs after it."""
    log = spark.read.parquet(out)
    try:
        folded = spark.read.parquet(_compacted(out))
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        upto = folded.agg(F.max("upto")).first()[0]
        kept = folded.where(F.col("upto") == upto).drop("upto")
        # both are partitions, so neither old tables nor old epochs are read
        log = log.where(F.col("epoch") > upto).unionByName(kept)
    fields = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*fields), "epoch").alias("s")).select(*keys, "s.*")


def compact(spark: SparkSession, out: str, keys: Sequence[str]) -> None:
    """Fold the log up to its last epoch into one table next to it.

    Run it between runs of the stream. Epochs it covers are not read again and may be
    deleted, all but the last one.
    """
    last = spark.read.parquet(out).agg(F.max("epoch")).first()[0]
    if last is not None:
        _newest(spark, out, keys).write.mode("overwrite").parquet(f"{_compacted(out)}/upto={last}")


def current_state(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    """Newest row per key of an update log."""
    return _newest(spark, out, keys).drop("epoch")


def _last(fields: Sequence[str], order: str) -> Column:
    return F.max_by(F.struct(*fields), order)


def stream_latest_decision(actions: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep the last decision per item; read it with :func:`latest_decisions`."""
    fields = [c for c in actions.columns if c not in ("qa_key", "type")]
    changes = (
        actions.where(F.col("type") == "action").groupBy("qa_key").agg(_last(fields, "seq").alias("d")).select("qa_key", "d.*")
    )
    return _start(changes, out, checkpoint, _sink(out))


def latest_decisions(spark: SparkSession, out: str) -> DataFrame:
    return current_state(spark, out, ["qa_key"])


def stream_running_accuracy(predictions: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Totals per overall/category/question/image as predictions arrive."""
    filled = scoring.fill_unknown_ids(predictions)
    cells = [F.struct(F.lit("overall").alias("level"), F.lit("").alias("key"))] + [
        F.struct(F.lit(level).alias("level"), F.col(column).alias("key")) for level, column in scoring.LEVELS
    ]
    changes = (
        filled.select(F.explode(F.array(*cells)).alias("c"), "correct", "error")
        .groupBy("c.level", "c.key")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if("correct").alias("correct"),
            F.count_if(F.col("error").isNotNull()).alias("exceptions"),
        )
    )
    return _start(changes, out, checkpoint, _sink(out))


def running_accuracy(spark: SparkSession, out: str) -> DataFrame:
    state = current_state(spark, out, ["level", "key"])
    return state.withColumn("accuracy", scoring.accuracy(F.col("correct"), F.col("total")))


def stream_propagate_labels(
    actions: DataFrame, items: DataFrame, group_map: DataFrame, out: str, checkpoint: str
) -> StreamingQuery:
    """Keep the earliest explicit decision of each (keyframe, question) group.

    The stream joins the static item and group tables on the item key, then
    aggregates; :func:`propagated_labels` hands the seeds to the members.
    """
    grouped = review.attach_keyframe(items, group_map).where(F.col("keyframe").isNotNull())
    # Written once, in the order of the join: a batch does not join items and groups again.
    seeds_of = materialise(
        grouped.select("qa_key", "keyframe", "question_id", "rgb_path", "model_answer").repartitionByRange("qa_key"), "seed-items"
    )
    explicit = actions.where(
        (F.col("type") == "action") & ~F.coalesce(F.col("auto_propagated"), F.lit(False))
    ).select("seq", "qa_key", "label", "option_index")
    seed = F.struct("seq", "label", "option_index", "rgb_path", "model_answer")
    changes = (
        explicit.join(seeds_of, "qa_key").groupBy("keyframe", "question_id").agg(F.min_by(seed, "seq").alias("seed"))
    )
    return _start(changes, out, checkpoint, _sink(out))


def propagated_labels(
    spark: SparkSession, out: str, items: DataFrame, group_map: DataFrame, explicit: DataFrame
) -> DataFrame:
    """Members labelled by the current seeds; ``explicit`` are decided keys."""
    grouped = review.attach_keyframe(items, group_map).where(F.col("keyframe").isNotNull())
    seeds = current_state(spark, out, ["keyframe", "question_id"])
    return review.inherit(grouped, seeds, explicit)


def progress_metrics(predictions: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """One row of counters per micro-batch, written as it completes."""

    def write(batch: DataFrame, epoch: int) -> None:
        counters = batch.agg(
            F.count(F.lit(1)).alias("processed"),
            F.count_if("correct").alias("correct"),
            F.count_if(F.col("error").isNotNull()).alias("exceptions"),
        )
        counters.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return _start(predictions, out, checkpoint, write, mode="append")


OUTCOME = T.StructType([*PREDICTION.fields, T.StructField("skip_reason", T.StringType())])
_COUNTED = "epoch long, processed long, correct long, exceptions long, skipped long"


def _counters() -> list[Column]:
    """Counters of rows that carry ``skip_reason``, null for those that were processed."""
    done = F.col("skip_reason").isNull()
    return [
        F.count_if(done).alias("processed"),
        F.count_if(done & F.col("correct")).alias("correct"),
        F.count_if(done & F.col("error").isNotNull()).alias("exceptions"),
        F.count_if(~done).alias("skipped"),
    ]


class BatchCounters(StreamingQueryListener):
    """Keeps the metrics observed under one name, by micro-batch: a few numbers each."""

    def __init__(self, name: str):
        self.name, self.batches, self.ended = name, {}, {}

    def onQueryStarted(self, event):  # noqa: N802
        pass

    def onQueryProgress(self, event):  # noqa: N802
        row = event.progress.observedMetrics.get(self.name)
        if row is not None and event.progress.numInputRows:
            self.batches[event.progress.batchId] = row.asDict()

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        self.ended.setdefault(str(event.runId), threading.Event()).set()

    def wait(self, run: str, seconds: float) -> None:
        self.ended.setdefault(run, threading.Event()).wait(seconds)


class ObservedRun:
    """A started stream of outcomes and the counters of its batches."""

    def __init__(self, query: StreamingQuery, counters: BatchCounters, spark: SparkSession, out: str):
        self.query, self.counters, self.spark, self.out = query, counters, spark, out

    def finish(self, patience: float = 60.0) -> None:
        """Wait for the end of the stream and write the counters of its batches, also after a failure."""
        try:
            self.query.awaitTermination()
        finally:
            # events come behind the batches; what has not come in time is counted from the sink
            self.counters.wait(str(self.query.runId), patience)
            self.spark.streams.removeListener(self.counters)
            rows = [(e, *(c[k] for k in ("processed", "correct", "exceptions", "skipped"))) for e, c in sorted(self.counters.batches.items())]
            self.spark.createDataFrame(rows, _COUNTED).coalesce(1).write.mode("append").json(f"{self.out.rstrip('/')}-progress")


def stream_progress(outcomes: DataFrame, out: str, checkpoint: str) -> ObservedRun:
    """Write the outcomes of an evaluation as they arrive, and count them in the same pass.

    ``outcomes`` are rows of :data:`OUTCOME`. The counters are observed metrics of the
    batch that writes the rows, so no second job reads them.
    """
    spark, name = outcomes.sparkSession, f"progress-{uuid.uuid4().hex}"
    counters = BatchCounters(name)
    spark.streams.addListener(counters)
    query = _start(outcomes.observe(name, *_counters()), out, checkpoint, _sink(out), mode="append")
    return ObservedRun(query, counters, spark, out)


def observed_progress(spark: SparkSession, out: str, expected: int) -> DataFrame:
    """``epoch, processed, correct, exceptions, skipped, left``: per batch, and what was then still to come of ``expected``.

    Batches whose counters were lost with their driver are counted from the rows they
    wrote; a batch that ran twice counts once.
    """
    told = spark.read.schema(_COUNTED).json(f"{out.rstrip('/')}-progress").dropDuplicates(["epoch"])
    log = spark.read.parquet(out).withColumn("epoch", F.col("epoch").cast("bigint"))
    lost = log.select("epoch").distinct().join(told.select("epoch"), "epoch", "left_anti")
    if not lost.isEmpty():
        told = told.unionByName(log.join(lost, "epoch").groupBy("epoch").agg(*_counters()))
    seen = F.sum(F.col("processed") + F.col("skipped")).over(W.orderBy("epoch"))  # one row per batch
    return told.withColumn("left", F.lit(expected) - seen)
