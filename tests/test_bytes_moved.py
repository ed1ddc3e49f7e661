"""Work that has to grow no faster than its input: what joins sort, what sinks write."""

from pathlib import Path

from pyspark.sql import functions as F

from gradeloom.operators import fewshot, validate
from gradeloom.plans import fewshot_queries, source_queries, streaming_queries
from gradeloom.sources import json_files, sinks

ROW = "source_input string, row_idx long, question string, options array<string>, gt_answer string, rgb_path string, thermal_path string"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(spark, n):
    rows = [("f", i, "q?" * 40, ["a", "b"], "a", f"/r/{i % 7}", None if i % 5 == 0 else f"/t/{i % 9}") for i in range(n)]
    return spark.createDataFrame([*rows, rows[0], ("f", None, "q", ["a"], "a", None, "/t/1")], ROW)


def test_rows_are_not_sorted_to_meet_a_large_file_listing(spark, monkeypatch):
    monkeypatch.setattr(validate, "HASHED_FILES", 10)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        listing = spark.createDataFrame([(f"/r/{i}",) for i in range(6)] * 2 + [(f"/t/{i}",) for i in range(8)], "path string")
        checked = validate.join_file_inventory(_rows(spark, 90), listing, "rgb_thermal")
        plan = _plan(checked)
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
        got = checked.groupBy(F.coalesce("skip_reason", F.lit("ok")).alias("r")).count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    fields = sum(i % 5 == 0 for i in range(90)) + 2
    files = sum(i % 5 != 0 and (i % 7 == 6 or i % 9 == 8) for i in range(90))
    assert dict(got) == {"missing_fields": fields, "missing_files": files, "ok": 92 - fields - files}


def test_predictions_are_written_compressed_and_read_back(spark, tmp_path):
    scored = spark.createDataFrame([("a", i, None, f"answer {i % 3}") for i in range(50)] + [("b", 1, "E", None)], "run_name string, row_idx long, error string, raw string")
    sinks.write_predictions(scored, str(tmp_path / "p"))
    sinks.write_predictions(scored.where("run_name = 'a' and row_idx < 9"), str(tmp_path / "p"), runs=["a"])
    files = [f.name for f in Path(tmp_path / "p").rglob("part-*")]
    assert files and all(f.endswith(".json.gz") for f in files)
    back = spark.read.schema(scored.schema).json(str(tmp_path / "p"))
    assert sorted(map(tuple, back.select(scored.columns).collect()), key=str) == sorted(
        map(tuple, scored.where("run_name = 'b' or row_idx < 9").collect()), key=str
    )


def test_logged_files_are_not_cut_small(spark):
    """A stream takes a fixed number of files a batch; small ones made the batches, and what they send to the driver, grow with the rows."""
    path = Path(streaming_queries._written(spark, spark.range(600_000).coalesce(1), "logged").removeprefix("file:"))
    assert len(list(path.glob("part-*"))) == 1
    assert spark.read.schema("id long").json(str(path)).agg(F.count("id"), F.count_distinct("id")).first()[:] == (600_000, 600_000)


def _whole_texts(spark):
    entry = '{"human_answer":"%s","meta":{"question_id":"Q1","rgb_path":"/r/%s"}}'
    texts = {
        "c": '{"type":"checkpoint","items":{"a":' + entry % ("x", 1) + ',"b":"broken","a":' + entry % ("y", 2) + ',"n":{"human_answer":"z"},"m":{"meta":3}}}',
        "l": '[{"question_id":"Q2","answer":"p","rgb_path":"/r/3"},{"question_id":"","answer":"q"},{"question_id":"Q3","gt_answer":null,"answer":"s"},7]',
        "o": "{}", "bad": '[{"question_id":"Q4"}', "empty": "[]", "none": None,
    }
    return spark.createDataFrame([(k, k, t) for k, t in texts.items()], "path string, name string, txt string")


def test_documents_are_parsed_once_and_both_shapes_are_read_in_one_pass(spark):
    docs = json_files.parse_documents(_whole_texts(spark))
    for read in (json_files.read_checkpoint, json_files.read_qa_list, json_files.read_eval_rows, json_files.read_path_records):
        plan = read(docs)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(StructField(type") <= 1 and plan.count("from_json(ArrayType(VariantType") <= 1


def test_both_shapes_in_one_pass_are_what_their_readers_give(spark):
    docs = json_files.parse_documents(_whole_texts(spark))
    rows = lambda df: sorted(map(str, df.collect()))
    apart = json_files.read_checkpoint(docs).unionByName(json_files.read_qa_list(docs))
    assert rows(json_files.read_eval_rows(docs)) == rows(apart) and json_files.read_eval_rows(docs).schema.names == apart.schema.names
    found = [(r.source_input, r.checkpoint_key, r.row_idx, r.question_id, r.gt_answer) for r in apart.collect()]
    assert sorted(found, key=str) == sorted(
        [("c", "a", 0, "Q1", "y"), ("c", "n", 2, None, "z"), ("l", None, 0, "Q2", "p"), ("l", None, 2, "Q3", None)], key=str
    )
    records = [tuple(r) for r in json_files.read_path_records(docs).collect()]
    assert sorted(records, key=str) == sorted(
        [("c", "a", "/r/2", None), ("c", "n", None, None), ("l", "Q2", "/r/3", None), ("l", "", None, None), ("l", "Q3", None, None)], key=str
    )


def test_result_documents_are_written_compressed_and_found_with_plain_ones(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([("/sets/a.json", "a.json", [("i", 1.5)]), ("/sets/b.json", "b.json", [])], "path string, name string, results array<struct<image_id:string,s:double>>")
    monkeypatch.setattr(source_queries, "_results_docs", lambda spark, sf_dir: docs)
    folder = Path(source_queries._written_results(spark, "").removeprefix("file:"))
    files = [f.name for f in folder.rglob("part-*")]
    assert len(files) == 2 and all(f.endswith(".json.gz") for f in files)
    (folder / "plain.JSON").write_text('{"results":[{"image_id":"p"}]}')
    (folder / "other.txt").write_text("no document")
    found = json_files.scan_json_files(spark, str(folder), recursive=True, glob=json_files.PACKED_GLOB)
    items = json_files.read_review_items(json_files.parse_documents(found))
    assert found.count() == 3 and sorted(r.image_id for r in items.collect()) == ["i", "p"]
    assert [r.name for r in json_files.scan_json_files(spark, str(folder), recursive=True).collect()] == ["plain.JSON"]


def test_files_behind_a_fewshot_queue_are_joined_once(spark):
    tried = spark.sparkContext.accumulator(0)
    rows = [("f", i, None, f"img{i}", "Q1", "What?", ["a", "b"], "a", f"/r/{i}", f"/t/{i}", (1.0, 2.0, 3.0, None)) for i in range(20)]
    shape = (
        "source_input string, row_idx long, checkpoint_key string, image_id string, question_id string, question string, options array<string>, "
        "gt_answer string, rgb_path string, thermal_path string, temp_summary struct<min:double,max:double,mean:double,top3_mean:double>"
    )

    @F.udf("string")
    def counted(i):
        tried.add(1)
        return "missing_files" if i % 4 == 0 else None

    queue = spark.createDataFrame(rows, shape).withColumn("skip_reason", counted.asNondeterministic()("row_idx"))
    out = fewshot.fewshot_requests(queue, 2, "qwen", "rgb_thermal")
    assert sorted(r.row_idx for r in out.select("row_idx", "messages").collect()) == [i for i in range(20) if i % 4]
    assert tried.value == 20
    ranked = fewshot.icl_candidate_rank(queue, payload=("question",))
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(15)) and tried.value == 40


def test_files_behind_a_dry_run_report_are_joined_once(spark, monkeypatch):
    tried = spark.sparkContext.accumulator(0)
    rows = [("f", i, f"img{i}", "Q1", "What?", ["a", "b"], "a", f"/r/{i}", f"/t/{i}") for i in range(20)]
    shape = (
        "source_input string, row_idx long, image_id string, question_id string, question string, options array<string>, "
        "gt_answer string, rgb_path string, thermal_path string"
    )

    @F.udf("string")
    def counted(i):
        tried.add(1)
        return "missing_files" if i % 4 == 0 else None

    queue = spark.createDataFrame(rows, shape).withColumn("skip_reason", counted.asNondeterministic()("row_idx"))
    monkeypatch.setattr(source_queries, "checked", lambda spark, sf_dir: queue)
    told = source_queries.write_dry_run_report(spark, "").first()
    assert tried.value == 20
    assert (told["total_sampled_questions"], told["eligible_for_eval"], told["skipped_missing_files"], told["json_files_discovered"]) == (20, 15, 5, 2)
    assert told["icl_queries_with_full_requested_shots"] == 15 and told["missing"] == ";".join(f"/r/{i} /t/{i}" for i in range(0, 20, 4))


def test_supports_without_what_they_tell_are_the_same_rows(spark):
    rows = [("f", i, f"img{i % 9}", "Q1", "What?", ["a", "b"], "a", f"/r/{i}", f"/t/{i}", None) for i in range(30)]
    queue = spark.createDataFrame(rows, "source_input string, row_idx long, image_id string, question_id string, question string, options array<string>, gt_answer string, rgb_path string, thermal_path string, skip_reason string")
    picked = lambda **kw: {r["row_idx"]: [s["row_idx"] for s in r["supports"]] for r in fewshot.icl_select_supports(queue, 3, **kw).collect()}
    assert picked(meta=()) == picked() and len(picked()) == 30
    one = fewshot.icl_select_supports(queue, 3, meta=()).first()["supports"][0]
    assert one.asDict().keys() == {"source_input", "row_idx"}


def test_counted_supports_tell_their_row_key_alone(spark, monkeypatch):
    rows = [("f", i, f"img{i}", "Q1", "What?" if i < 5 else "Alone?", ["a", "b"], "a", f"/r/{i}", f"/t/{i}", None) for i in range(6)]
    queue = spark.createDataFrame(rows, "source_input string, row_idx long, image_id string, question_id string, question string, options array<string>, gt_answer string, rgb_path string, thermal_path string, skip_reason string")
    told, select = [], fewshot.icl_select_supports

    def selected(*args, **kw):
        found = select(*args, **kw)
        told.append(found.schema["supports"].dataType.elementType.names)
        return found

    monkeypatch.setattr(fewshot, "icl_select_supports", selected)
    monkeypatch.setattr(fewshot_queries, "checked", lambda spark, sf_dir: queue)
    assert sorted(map(tuple, fewshot_queries.icl_require_full(spark, "").collect())) == [("f", i, 2) for i in range(5)]
    assert tuple(fewshot_queries.icl_support_stats(spark, "").first()) == (6, 5, 1, 10, 1.666667, 1)
    assert told == [["source_input", "row_idx"]] * 2


def test_observed_outcomes_are_packed_and_meet_the_files_once(spark, monkeypatch):
    tried = spark.sparkContext.accumulator(0)
    rows = [("f", i, f"img{i}", "Q1", "C", "q?", ["a", "b"], "a", f"/r/{i}", f"/t/{i}", "a" if i % 3 else "b", None) for i in range(40)]
    preds = spark.createDataFrame(rows, "source_input string, row_idx long, image_id string, question_id string, category string, question string, options array<string>, gt_answer string, rgb_path string, thermal_path string, raw_output string, error string")
    joined, written = streaming_queries.validate.join_file_inventory, []

    @F.udf("string")
    def counted(reason):
        tried.add(1)
        return reason

    monkeypatch.setattr(streaming_queries.adapters, "preds_raw", lambda spark, sf_dir: preds)
    monkeypatch.setattr(streaming_queries.adapters, "files", lambda spark, sf_dir: preds.where("row_idx < 30").selectExpr("explode(array(rgb_path, thermal_path)) as path"))
    monkeypatch.setattr(streaming_queries.validate, "join_file_inventory", lambda *a: joined(*a).withColumn("skip_reason", counted.asNondeterministic()("skip_reason")))
    write = streaming_queries._written
    monkeypatch.setattr(streaming_queries, "_written", lambda *a, **k: written.append(write(*a, **k)) or written[-1])
    told = streaming_queries.observed_progress(spark, "").first()
    assert (told["processed"], told["correct"], told["skipped"], told["left_at_end"]) == (30, 20, 10, 0)
    files = list(Path(written[0].removeprefix("file:")).glob("part-*"))
    assert tried.value == 40 and files and all(f.name.endswith(".json.gz") for f in files)


def test_conversations_alone_ask_supports_for_nothing_else(spark):
    rows = [("f", i, f"img{i}", "Q1", "What?", ["a", "b"], "ab"[i % 2], f"/r/{i}", f"/t/{i}", (1.0, 2.0, 3.0, None), None) for i in range(6)]
    shape = (
        "source_input string, row_idx long, image_id string, question_id string, question string, options array<string>, gt_answer string, "
        "rgb_path string, thermal_path string, temp_summary struct<min:double,max:double,mean:double,top3_mean:double>, skip_reason string"
    )
    queue = spark.createDataFrame(rows, shape)
    told = lambda **kw: fewshot.fewshot_requests(queue, 2, "qwen", "rgb_thermal", **kw)
    short = told(meta=())
    assert set(short.schema["supports"].dataType.elementType.names) == {"source_input", "row_idx", *fewshot.SOLVED, *fewshot.PAYLOAD}
    talks = lambda df: sorted(map(str, df.select("row_idx", "messages", "all_images").collect()))
    assert talks(short) == talks(told()) and set(fewshot.META) <= set(told().schema["supports"].dataType.elementType.names)
