"""Inputs beyond earlier limits: large documents, long numbers, big grids, null keys, repeated listings."""

import pytest
from pyspark.sql import functions as F

from gradeloom.functions import frames, nested, prompts
from gradeloom.operators import ordering, pathaudit, review, sweep, validate
from gradeloom.sources import json_files, sinks

RECORDS = 800_000


def _large(spark, head, record, tail):
    body = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(RECORDS)), record), ",")
    return spark.range(1).select(
        F.lit("p").alias("path"), F.lit("n").alias("name"), F.concat(F.lit(head), body, F.lit(tail)).alias("txt")
    )


def test_documents_beyond_the_size_of_one_value(spark):
    pad = "x" * 230
    docs = _large(spark, "[", lambda i: F.concat(F.lit('{"question_id":"q","answer":"'), i.cast("string"), F.lit(pad + '"}')), "]")
    assert docs.select(F.length("txt")).first()[0] > 200 * 2**20
    assert json_files.read_qa_list(json_files.parse_documents(docs)).count() == RECORDS


def test_unreadable_files_have_a_row(spark):
    texts = ["[1", "", "nope", '{"a":1}', "5", '{"type":"checkpoint","items":{"k":', None, '{"type":"checkpoint","items":{}}', "[]"]
    docs = spark.createDataFrame([(str(i), "n", t) for i, t in enumerate(texts)], "path string, name string, txt string")
    bad = {r["json_file"] for r in json_files.quarantine_bad_files(json_files.parse_documents(docs)).collect()}
    assert bad == {"0", "1", "2", "3", "4", "5", "6"}


def test_repeated_keys_in_any_session(spark):
    plain = spark.newSession()
    plain.conf.set("spark.sql.mapKeyDedupPolicy", "EXCEPTION")
    txt = '{"type":"checkpoint","items":{"k":{"human_answer":"x"},"m":{"human_answer":"y","human_answer":"w"},"k":{"human_answer":"z"}}}'
    docs = plain.createDataFrame([("p", "n", txt)], "path string, name string, txt string")
    got = json_files.read_checkpoint(json_files.parse_documents(docs)).orderBy("row_idx").collect()
    assert [(r["checkpoint_key"], r["row_idx"], r["gt_answer"]) for r in got] == [("k", 0, "z"), ("m", 1, "w")]


def test_frame_numbers_of_any_length(spark):
    ids = ["1" * 39, "5", "7", "-" + "2" * 50, "-" + "1" * 50, "-3", "0", "000", "9" * 38, "x", None, "1" * 39 + "0"]
    df = spark.createDataFrame(list(enumerate(ids)), "pos bigint, image_id string")
    out = sinks.frame_order(df, "image_id", F.lit(False), "pos").orderBy("ordinal").collect()
    want = sorted(range(len(ids)), key=lambda i: (0, int(ids[i]), i) if ids[i] and ids[i] != "x" else (1, 0, i))
    assert [r["pos"] for r in out] == want
    assert df.select(frames.frame_sort_key(F.col("image_id"), F.lit(False))["frame"]).first()[0] == "1" * 39


def test_positions_without_one_task(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.when(F.col("id") % 9 > 0, F.col("id") % 9).alias("g"))
    got = ordering.global_ordinal(df, ["g", "k"], "n").orderBy("n").collect()
    rows = sorted(((r["g"] is not None, r["g"] or 0, r["k"]) for r in got))
    assert [(r["g"] is not None, r["g"] or 0, r["k"]) for r in got] == rows and [r["n"] for r in got] == list(range(1, 5001))
    items = spark.createDataFrame([("s", 1, "a"), ("s", 2, "b")], "source_json string, row_idx bigint, image_key string")
    for frame in (review.image_order(items), sinks.frame_order(items, "image_key", F.lit(False), "row_idx")):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan


def test_null_keys_are_refused(spark):
    df = spark.createDataFrame([("a", 1, "x"), (None, 2, "y")], "k string, b int, h string")
    with pytest.raises(Exception, match="must not be null"):
        ordering.with_ordinal(df, ["k"], ["b"], ["h"], "n").collect()
    with pytest.raises(Exception, match="must not be null"):
        ordering.exact_k(df, ["k"], "h", lambda n: n).collect()


def test_large_grids(spark):
    runs = spark.range(5000).select(
        F.lit("f").alias("family"), F.lit("m").alias("model_id"), F.lit("rgb").alias("input_mode"), F.lit(False).alias("repeat_prompt"),
        F.lit(False).alias("no_temp_summary"), F.concat(F.lit("run"), F.col("id").cast("string")).alias("run_name"),
    )
    got = spark.range(3).select(F.explode(sweep.grid_of(runs)).alias("r")).select("r.*")
    assert got.count() == 15000 and got.select("run_name").distinct().count() == 5000
    with pytest.raises(ValueError):
        sweep.literal_grid(models=[_aliases()[0]], max_runs=2)


def _aliases():
    from gradeloom.functions import runs

    return [a for _, (_, aliases) in runs.MODELS.items() for a in aliases]


def test_numbers_in_prompts(spark):
    values = [0.0005, 12345678.0, 1e-4, 0.00012345678901234567, 1e16, 1.5e-5, 1e-5, 2.5e20, 0.0, -0.00025, 37.25, 123456789012345.6, -1e15, 1e100, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(prompts.number_text(F.col("v"))).collect()]
    assert got == ["N/A" if v is None else repr(v) for v in values]


def test_repeated_listings_change_nothing(spark):
    rows = spark.createDataFrame(
        [("s", 1, "q", ["x"], "g", "/a", "/b"), ("s", 2, "q", ["x"], "g", "/a", None)],
        "source_input string, row_idx bigint, question string, options array<string>, gt_answer string, rgb_path string, thermal_path string",
    )
    once = spark.createDataFrame([("/a",), ("/b",)], "path string")
    many = once.unionAll(once).unionAll(once)
    assert validate.join_file_inventory(rows, many, "rgb_thermal").count() == 2
    assert sorted(map(str, pathaudit.path_status(many, many).collect())) == sorted(map(str, pathaudit.path_status(once, once).collect()))


def test_malformed_documents_do_not_stop_the_others(spark):
    docs = spark.createDataFrame([("a", '{"p":"/old/x"}'), ("b", '{"p":'), ("c", None)], "path string, txt string")
    out = {r["path"]: (r["txt"], r["changed"]) for r in nested.rewrite_documents(docs, "/old", "/new").collect()}
    assert out["b"] == ('{"p":', 0) and out["c"] == (None, 0) and out["a"][1] == 1
    empty = spark.createDataFrame([], "path string")
    got = {(r["json_file"], r["json_key"], r["reason"]) for r in pathaudit.validate_document_paths(docs, empty).collect()}
    bad = (json_files.READ_KEY, json_files.UNREADABLE)
    assert got == {("a", "p", "missing"), ("b", *bad), ("c", *bad)}


def test_files_without_rows_are_discovered(spark):
    checked = spark.createDataFrame([("s", None)], "source_input string, skip_reason string")
    files = spark.createDataFrame([("s",), ("empty",), ("broken",)], "path string")
    assert validate.eligibility_summary(checked, files).first()["json_files_discovered"] == 3
    assert validate.eligibility_summary(checked).first()["json_files_discovered"] == 1
