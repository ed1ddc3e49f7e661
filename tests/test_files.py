"""JSON shapes, sinks, path audit, images and streams on real files."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from gradeloom.functions import nested
from gradeloom.operators import infer, pathaudit, scoring, sweep
from gradeloom.plans.evaluate import evaluate_run
from gradeloom.sources import images, json_files, sinks
from gradeloom.streaming import jobs

ROW = {"question_id": "Q1", "question": "?", "options": ["Yes", "No"], "image_id": 7, "category": "c", "rgb_path": "/r", "thermal_path": "/t"}


@pytest.fixture
def folder(tmp_path):
    entry = {"label": "corrected", "human_answer": "No", "option_index": 1, "timestamp": "2024-01-01 00:00:00", "meta": {**ROW, "source_json": "s", "row_idx": 3, "model_answer": "Yes"}}
    docs = {
        "a_list.json": [{**ROW, "answer": "Yes"}, 5, {**ROW, "gt_answer": None, "answer": "x"}, {**ROW, "question_id": ""}, {**ROW, "question_id": None}, {"question": "no id"}],
        "b_check.JSON": {"type": "checkpoint", "items": {"z": entry, "y": 3, "x": {"human_answer": None}, "w": {"meta": 5}, "a": {**entry, "human_answer": "Yes"}}},
        "c_results.json": {"results": [{**ROW, "answer": " Yes ", "options": "none", "applicability_score": 2, "temp_summary": {"min": 1.5}}, "skip", {}]},
        "d_scalar.json": 12,
        "sub/e_nested.json": [],
    }
    for name, doc in docs.items():
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(doc, indent=1))
    (tmp_path / "in" / "f_bad.json").write_text('{"a": ')
    (tmp_path / "in" / "note.txt").write_text("[]")
    return str(tmp_path / "in")


def docs_of(spark, folder, **kw):
    return json_files.parse_documents(json_files.scan_json_files(spark, folder, **kw))


def test_scan_and_quarantine(spark, folder):
    flat = docs_of(spark, folder)
    shapes = {r["name"]: r["shape"] for r in flat.collect()}
    assert shapes == {"a_list.json": "list", "b_check.JSON": "checkpoint", "c_results.json": "results", "d_scalar.json": "other", "f_bad.json": "malformed"}
    assert docs_of(spark, folder, recursive=True).count() == 6
    bad = {(r["json_file"].rsplit("/", 1)[1], r["reason"]) for r in json_files.quarantine_bad_files(flat).collect()}
    assert bad == {("d_scalar.json", "bad_shape"), ("f_bad.json", "failed to parse/read json")}


def test_read_shapes(spark, folder):
    docs = docs_of(spark, folder)
    listed = json_files.read_qa_list(docs).orderBy("row_idx").collect()
    assert [(r["row_idx"], r["gt_answer"], r["image_id"]) for r in listed] == [(0, "Yes", "7"), (2, None, "7")]
    kept = json_files.read_checkpoint(docs).orderBy("row_idx").collect()
    assert [(r["checkpoint_key"], r["gt_answer"], r["question_id"]) for r in kept] == [("z", "No", "Q1"), ("x", None, None), ("a", "Yes", "Q1")]
    items = json_files.read_review_items(docs).where("source_json = 'c_results.json'").orderBy("row_idx").collect()
    assert [(r["row_idx"], r["model_answer"], r["options"], r["applicability_score"]) for r in items] == [(0, "Yes", [], 2.0), (2, "", [], None)]
    assert items[0]["temp_summary"]["min"] == 1.5 and items[0]["temp_summary"]["max"] is None and items[1]["temp_summary"] is None
    records = json_files.read_path_records(docs)
    assert sorted(r["record"] for r in records.collect()) == ["", "Q1", "Q1", "a", "row_4", "row_5", "x", "z"]
    assert json_files.read_eval_rows(docs).count() == 5


def test_repeated_keys_keep_the_last(spark):
    txt = '{"type":"checkpoint","items":{"k":{"human_answer":"a","meta":{}},"k":{"human_answer":"b","meta":{}}}}'
    docs = json_files.parse_documents(spark.createDataFrame([("p", "n", txt)], "path string, name string, txt string"))
    assert [(r["checkpoint_key"], r["gt_answer"]) for r in json_files.read_checkpoint(docs).collect()] == [("k", "b")]


def test_maps_and_lists(spark, tmp_path):
    (tmp_path / "map.json").write_text(json.dumps({"/a": "/a", "/b": "/a"}))
    (tmp_path / "rest.json").write_text(json.dumps([" /b", "/b", "/c"]))
    got = json_files.load_group_map(spark, str(tmp_path / "map.json")).collect()
    assert {(r["path"], r["keyframe"]) for r in got} == {("/a", "/a"), ("/b", "/a")}
    with pytest.warns(UserWarning):
        assert json_files.load_group_map(spark, str(tmp_path / "none.json")).count() == 0
    assert {r["path"] for r in json_files.load_path_list(spark, str(tmp_path / "rest.json")).collect()} == {"/b", "/c"}
    with pytest.raises(FileNotFoundError):
        json_files.load_path_list(spark, str(tmp_path / "none.json"))


def test_jsonl_sorting(spark, tmp_path):
    lines = [{"image_id": "frame_10"}, {"image_id": "2"}, {"prompt_template": "p"}, {"image_id": "abc"}, {"image_id": "0002", "n": 2}]
    (tmp_path / "x.jsonl").write_text("\n\n".join(json.dumps(x) for x in lines) + "\n  \n")
    read = json_files.read_jsonl(spark, str(tmp_path / "x.jsonl")).select(
        "line", F.variant_get("v", "$.image_id", "string").alias("image_id"), F.col("pos.id").alias("pos"),
        F.variant_get("v", "$.prompt_template", "string").isNotNull().alias("head"),
    )
    header = F.col("head") & F.col("image_id").isNull()
    ordered = sinks.frame_order(read, "image_id", header, "pos").orderBy("ordinal").collect()
    assert [json.loads(r["line"]) for r in ordered] == [lines[2], lines[1], lines[4], lines[0], lines[3]]
    assert [r["ordinal"] for r in ordered] == [1, 2, 3, 4, 5]
    (tmp_path / "bad.jsonl").write_text("{}\n{x\n")
    with pytest.raises(Exception):
        json_files.read_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()


def test_snapshot_round_trip(spark, folder, tmp_path):
    decisions = json_files.read_decisions(docs_of(spark, folder)).where("label is not null")
    out = str(tmp_path / "snap")
    sinks.export_checkpoint_json(decisions, out, "run", "now", entries=1)
    again = json_files.read_decisions(docs_of(spark, out, recursive=True))
    key = ["qa_key", "label", "human_answer", "option_index", "question_id", "model_answer", "row_idx", "image_id"]
    assert {tuple(r) for r in again.select(key).collect()} == {tuple(r) for r in decisions.select(key).collect()}
    version = sinks.write_review_snapshot(decisions, str(tmp_path / "versions"), 1)
    assert spark.read.parquet(version).count() == decisions.count()


def test_metrics_document_of_an_empty_run(spark):
    metrics = spark.createDataFrame([], "run_name string, level string, key string, total bigint, correct bigint, accuracy double")
    counters = spark.createDataFrame([("r", 0)], "run_name string, queued int")
    config = spark.createDataFrame([("r", '{"seed":1}')], "run_name string, run_config string")
    doc = json.loads(sinks.metrics_documents(metrics, counters, config).first()["doc"])
    assert doc["overall"] == {"total": 0, "correct": 0, "accuracy": 0.0}
    assert doc["by_category"] == {} and doc["more_info"] == {"queued": 0} and doc["run_config"] == {"seed": 1}


def test_probe_and_audit(spark, tmp_path):
    (tmp_path / "ok.jpg").write_bytes(b"x")
    (tmp_path / "dir").mkdir()
    base = str(tmp_path)
    records = spark.createDataFrame(
        [(f"{base}/in/f.json", "1", "../ok.jpg", f"{base}/gone.jpg"), (f"{base}/in/f.json", "2", f"{base}/dir", " "), (f"{base}/in/f.json", "3", f"{base}/ok.jpg", None)],
        "json_file string, record string, rgb_path string, thermal_path string",
    )
    want = {("1", "thermal_path", "missing"), ("2", "rgb_path", "not_a_file"), ("2", "thermal_path", "empty_path"), ("3", "thermal_path", "empty_path")}
    issues = pathaudit.audit_paths_by_probe(records)
    assert {(r["record"], r["field"], r["reason"]) for r in issues.collect()} == want
    listing = spark.createDataFrame([(f"{base}/ok.jpg", False), (f"{base}/dir", True)], "path string, is_dir boolean")
    assert {(r["record"], r["field"], r["reason"]) for r in pathaudit.audit_paths(records, listing).collect()} == want
    summary = pathaudit.path_audit_summary(records.select("json_file").distinct(), records, issues).first()
    assert tuple(summary) == (1, 3, 4, False)
    detail = {r["path"]: r["detail"] for r in pathaudit.probe_path_status(spark.createDataFrame([(f"{base}/dir",), (f"{base}/ok.jpg",)], "path string")).collect()}
    assert detail == {f"{base}/dir": "is a directory (expected a file)", f"{base}/ok.jpg": None}


def test_deep_documents(spark):
    doc = {"/a/k": "/a", "x": [{"y": "/a/b", "n": 1}, ["/a/c", "/abc", None]], "z": "a /a"}
    docs = spark.createDataFrame([("f", json.dumps(doc)), ("g", '"/a/top"'), ("h", "[1]")], "path string, txt string")
    out = {r["path"]: (json.loads(r["txt"]), r["changed"]) for r in nested.rewrite_documents(docs, "/a/", "/n").collect()}
    assert out["f"] == ({"/a/k": "/n", "x": [{"y": "/n/b", "n": 1}, ["/n/c", "/abc", None]], "z": "a /a"}, 3)
    assert out["g"] == ("/n/top", 1) and out["h"] == ([1], 0)
    found = nested.collect_document_paths(docs).where("json_file = 'f'").orderBy("pos").collect()
    assert [(r["json_key"], r["path"]) for r in found] == [("/a/k", "/a"), ("x[0].y", "/a/b"), ("x[1][0]", "/a/c"), ("x[1][1]", "/abc")]
    summary = pathaudit.path_update_summary(nested.rewrite_documents(docs, "/a", "/n")).first()
    assert (summary["files_changed"], summary["replacements"]) == (2, 4)


def test_nested_columns_with_maps(spark):
    df = spark.sql("select named_struct('m', map('/a', '/a/x', 'k', 'no'), 'l', array(array('/a'), null)) as d")
    dtype = df.schema["d"].dataType
    got = df.select(nested.rewrite_paths(F.col("d"), dtype, "/a", "/b").alias("d"), nested.count_rewrites(F.col("d"), dtype, "/a").alias("n")).first()
    assert got["d"]["m"] == {"/a": "/b/x", "k": "no"} and got["d"]["l"] == [["/b"], None] and got["n"] == 2


def bmp(width, height):
    row = b"\x00\x00\xff" * width + b"\x00" * ((4 - 3 * width % 4) % 4)
    body = row * height
    head = struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(body), 0, 0, 0, 0) + body


def test_images(spark, tmp_path):
    (tmp_path / "a.bmp").write_bytes(bmp(5, 3))
    (tmp_path / "b.bmp").write_bytes(b"broken")
    sizes = images.image_sizes(spark, str(tmp_path)).collect()
    assert [(r["path"].rsplit("/", 1)[1], r["width"], r["height"]) for r in sizes] == [("a.bmp", 5, 3)]
    assert images.scan_images(spark, str(tmp_path)).count() == 2
    assert {r["length"] for r in images.list_files(spark, str(tmp_path)).collect()} == {len(bmp(5, 3)), 6}


def test_inference_fallback(spark):
    class Flaky:
        def run_batch(self, requests):
            raise ValueError("batch")

        def run_one(self, request):
            if request["row_idx"] == 2:
                raise KeyError("row")
            return request["question"]

    rows = spark.createDataFrame([(i, f"q{i}", ["a"]) for i in range(5)], "row_idx int, question string, options array<string>")
    out = infer.batch_inference(rows.coalesce(1), Flaky, batch_size=2).orderBy("row_idx").collect()
    assert [(r["raw_output"], r["error"]) for r in out] == [("q0", None), ("q1", None), (None, "KeyError('row')"), ("q3", None), ("q4", None)]
    assert infer.batch_inference(rows.limit(0), Flaky).count() == 0


def test_run_of_one_file(spark, folder):
    rows = json_files.read_eval_rows(docs_of(spark, folder))
    files = spark.createDataFrame([("/r", 1), ("/t", 1)], "path string, length int")
    scored = evaluate_run(rows, files, infer.EchoRunner)
    assert scored.count() == 3
    assert evaluate_run(rows, files.where("path = '/r'"), infer.EchoRunner).count() == 0
    assert evaluate_run(rows, files.where("path = '/r'"), infer.EchoRunner, mode="rgb").count() == 3


def test_grid():
    with pytest.raises(ValueError):
        sweep.literal_grid(["qwen", "nobody"])


def test_grid_order(spark):
    names = [r["run_name"] for r in spark.range(1).select(F.explode(sweep.literal_grid(["QWEN ", "llama3.2", "qwen"]))).select("col.run_name").collect()]
    assert len(names) == 24 and len(set(names)) == 24
    assert names[0] == "eval_qwen_Qwen_Qwen3-VL-8B-Instruct_backend-vllm_mode-rgb_thermal_maxside-768_maxtok-32_repeatprompt-0_notempsummary-0_p100_seed123"
    assert "backend-transformers" in names[12]


def test_stream_resumes_and_takes_the_last_line(spark, tmp_path):
    schema = "seq bigint, type string, qa_key string, label string"
    log, out, checkpoint = (str(tmp_path / n) for n in ("log", "out", "checkpoint"))

    def step(rows):
        sinks.append_action_log(spark.createDataFrame(rows, schema), log)
        stream = jobs.read_action_stream(spark, log, spark.createDataFrame([], schema).schema)
        jobs.stream_latest_decision(stream, out, checkpoint).awaitTermination()
        return {r["qa_key"]: r["label"] for r in jobs.latest_decisions(spark, out).collect()}

    assert step([(5, "action", "a", "late"), (1, "header", "a", None)]) == {"a": "late"}
    # a file that arrives later holds an earlier line
    assert step([(2, "action", "a", "early"), (3, "action", "b", "x")]) == {"a": "late", "b": "x"}
    assert step([(9, "action", "b", "y")]) == {"a": "late", "b": "y"}


def test_counters_add_up(spark):
    queue = spark.createDataFrame([("f", None), ("f", "missing_fields"), ("g", "missing_files"), ("g", None)], "source_input string, skip_reason string")
    done = spark.createDataFrame([(None,), ("E",)], "error string")
    row = scoring.run_counters(queue, done).first()
    assert row["queued"] == row["evaluated"] + row["skipped_missing_fields"] + row["skipped_missing_files"]
    assert (row["exceptions"], row["json_files_discovered"]) == (1, 2)
    empty = scoring.run_counters(queue.limit(0), done.limit(0)).first()
    assert (empty["queued"], empty["evaluated"]) == (0, 0)
