"""Sweeps, run documents, snapshot versions and restarted streams."""

import json

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import infer, scoring
from gradeloom.sources import sinks
from gradeloom.streaming import jobs


def test_axes_compare_runs_that_differ_in_one_axis(spark):
    runs = spark.createDataFrame(
        [("a", "f", "m", "rgb_thermal", False, False), ("b", "f", "m", "rgb", False, False), ("c", "f", "m", "rgb", True, False),
         ("d", "g", "n", "rgb", False, False)],
        "run_name string, family string, model_id string, input_mode string, repeat_prompt boolean, no_temp_summary boolean",
    )
    metrics = spark.createDataFrame(
        [("a", "overall", None, 0.5), ("b", "overall", None, 0.75), ("c", "overall", None, 0.25), ("b", "category", "x", 1.0), ("d", "overall", None, 1.0)],
        "run_name string, level string, key string, accuracy double",
    )
    got = {(r["run_name"], r["axis"], r["key"]): (r["baseline_run"], r["delta"]) for r in scoring.compare_axes(metrics, runs).collect()}
    assert got == {
        ("b", "input_mode", ""): ("a", 0.25),
        ("b", "input_mode", "x"): ("a", None),
        ("c", "repeat_prompt", ""): ("b", -0.5),
    }
    assert scoring.compare_axes(metrics.limit(0), runs).count() == 0


def test_batches_hold_one_run_and_a_failing_run_fails_alone(spark):
    class Seen:
        """Answers with the runs of its batch; one run always fails."""

        def run_batch(self, requests):
            if any(r["run"] == "bad" for r in requests):
                raise RuntimeError("down")
            return [",".join(sorted({r["run"] for r in requests}))] * len(requests)

        def run_one(self, request):
            raise RuntimeError("down")

    rows = spark.range(60).select("id", F.element_at(F.array(F.lit("x"), F.lit("bad"), F.lit("y")), (F.col("id") % 3 + 1).cast("int")).alias("run"))
    got = infer.batch_inference(rows, Seen, batch_size=7, batch_by="run").collect()
    assert len(got) == 60
    for r in got:
        assert (r["raw_output"], r["error"] is None) == ((None, False) if r["run"] == "bad" else (r["run"], True))


def test_named_runs_without_rows_lose_their_output(spark, tmp_path):
    rows = spark.createDataFrame([("r1", 1), ("r2", 2)], "run_name string, n int")
    path = str(tmp_path / "out")
    sinks.write_predictions(rows, path)
    sinks.write_predictions(rows.where("n = 1"), path, runs=["r1", "r2"])
    assert [tuple(r) for r in spark.read.schema("n int, run_name string").json(path).select("run_name", "n").collect()] == [("r1", 1)]
    with pytest.raises(ValueError):
        sinks.write_predictions(rows, path, runs=["a/b"])


def test_readers_follow_the_newest_snapshot(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    for n in (1, 2, 3):
        sinks.write_review_snapshot(spark.createDataFrame([(n,)], "n int"), path)
    # a version that was never finished is not on the list
    spark.createDataFrame([(9,)], "n int").write.parquet(f"{path}/version=half")
    assert [r["n"] for r in sinks.read_review_snapshot(spark, path).collect()] == [3]
    with pytest.raises(Exception, match="no snapshot|PATH_NOT_FOUND"):
        sinks.current_version(spark, str(tmp_path / "nothing"))


def test_dry_run_counts_all_files_and_keeps_settings(spark):
    checked = spark.createDataFrame(
        [("f1", 0, "a", "b", None), ("f1", 1, "a", "c", "missing_files")],
        "source_input string, row_idx long, rgb_path string, thermal_path string, skip_reason string",
    )
    files = spark.createDataFrame([("f1",), ("empty",)], "path string")
    supports = spark.createDataFrame([(["s"],), ([],)], "supports array<string>")
    doc = json.loads(sinks.dry_run_report(checked, files=files, config='{"seed": 7}', supports=supports, shots=1).first()["doc"])
    assert doc["run_config"] == {"seed": 7} and doc["summary"]["json_files_discovered"] == 2
    assert doc["summary"]["icl_queries_with_full_requested_shots"] == doc["summary"]["icl_queries_with_zero_support_examples"] == 1
    assert doc["sample_missing_paths"] == [{"rgb_path": "a", "thermal_path": "c"}]


def test_restarted_stream_with_compaction_equals_batch(spark, tmp_path):
    log, out, checkpoint = (str(tmp_path / n) for n in ("log", "out", "checkpoint"))
    schema = "seq long, type string, qa_key string, label string"
    before = spark.conf.get(jobs._PROVIDER)
    for start in (0, 20, 40):
        rows = spark.range(start, start + 20).select(
            F.col("id").alias("seq"), F.lit("action").alias("type"), F.concat(F.lit("k"), F.col("id") % 7).alias("qa_key"), F.concat(F.lit("l"), "id").alias("label")
        )
        rows.write.mode("append").json(log)
        stream = jobs.read_action_stream(spark, log, spark.createDataFrame([], schema).schema)
        jobs.stream_latest_decision(stream, out, checkpoint).awaitTermination()
        if start < 40:
            jobs.compact(spark, out, ["qa_key"])
    state = {r["qa_key"]: r["label"] for r in jobs.latest_decisions(spark, out).collect()}
    assert state == {f"k{i % 7}": f"l{i}" for i in range(60)}
    assert spark.conf.get(jobs._PROVIDER) == before
    folded = spark.read.parquet(f"{out}-compacted")
    assert folded.select("upto").distinct().count() == 2
