"""Queries: JSON documents derived from the tables, read back by the readers,
and the sinks written to the shared folder and read again."""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark import StorageLevel
from pyspark.sql import functions as F

from ..operators import fewshot, scoring, sweep
from ..session import scratch_path
from ..sources import images, json_files, json_records, sinks
from . import adapters
from .evaluation_queries import RUNS, checked, run_metrics
from .fewshot_queries import _SELECTED, SHOTS
from .path_queries import _FRAME_ORDER, frame_order
from .registry import register
from .review_queries import latest

_FIELDS = ("image_id", "rgb_path", "thermal_path", "category", "question_id", "question", "options", "temp_summary")


def _documents(rows, body):
    """One document per source file; files hold a fixed block of order keys."""
    listed = rows.groupBy("source_input").agg(F.array_sort(F.collect_list(F.struct("row_idx", *body))).alias("rows"))
    return listed.select(
        F.concat(F.lit("/sets/"), F.col("source_input")).alias("path"),
        F.col("source_input").alias("name"),
        F.transform("rows", lambda r: r.dropFields("row_idx")).alias("rows"),
    )


def _list_docs(spark, sf_dir):
    """List documents; the truth is missing, null or present by category."""
    rows = adapters.qa(spark, sf_dir)
    gt = (
        F.when(F.col("category") == "CAT1", F.lit(None))
        .when(F.col("category") == "CAT2", F.lit("null"))
        .otherwise(F.to_json(F.struct(F.col("gt_answer").alias("a"))))
    )
    body = F.to_json(F.struct(*_FIELDS, F.col("model_answer").alias("answer")))
    # a present null must survive, so the field is spliced into the text
    value = F.when(gt == "null", "null").otherwise(F.regexp_extract(gt, r'^\{"a":(.*)\}$', 1))
    spliced = F.when(gt.isNull(), body).otherwise(
        F.concat(F.lit('{"gt_answer":'), value, F.lit(","), F.substring(body, F.lit(2), F.length(body)))
    )
    docs = _documents(rows, [spliced.alias("r")])
    text = F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r["r"]), ","), F.lit("]"))
    return docs.select("path", "name", text.alias("txt"))


def _results_docs(spark, sf_dir):
    rows = adapters.qa(spark, sf_dir).withColumn("score", F.col("temp_summary.max") / 2)
    docs = _documents(rows, [*_FIELDS, F.col("model_answer").alias("answer"), F.col("score").alias("applicability_score")])
    return docs.select("path", "name", F.col("rows").alias("results"))


def _checkpoint_docs(spark, sf_dir):
    """Checkpoint documents; entries of one category are not objects."""
    meta = F.struct(*_FIELDS, "model_answer", F.col("source_input").alias("source_json"), "row_idx")
    entry = F.to_json(F.struct(F.lit("corrected").alias("label"), F.col("gt_answer").alias("human_answer"), meta.alias("meta")))
    key = F.concat(F.lit("k"), F.col("row_idx").cast("string"))
    value = F.when(F.col("category") == "CAT5", F.lit('"broken"')).otherwise(entry)
    pair = F.concat(F.lit('"'), key, F.lit('":'), value)
    docs = _documents(adapters.qa(spark, sf_dir), [pair.alias("p")])
    text = F.concat(
        F.lit('{"type":"checkpoint","items":{'), F.array_join(F.transform("rows", lambda r: r["p"]), ","), F.lit("}}")
    )
    return docs.select("path", "name", text.alias("txt"))


def _written_results(spark, sf_dir):
    """Result documents on disk, one ``.json.gz`` file per source file."""
    path = scratch_path(spark, "results")
    docs = _results_docs(spark, sf_dir).select(F.col("name").alias("doc"), "results")
    docs.repartition("doc").write.option("compression", "gzip").partitionBy("doc").json(path)
    return path


@register(
    "scan_json_files",
    "select source_input as doc, count(*) as records, count(distinct rgb_path) as images from qa group by all",
    ["qa"],
)
def scan_json_files(spark, sf_dir):
    """Written as files below nested folders and found by a recursive scan."""
    found = json_files.scan_json_files(spark, _written_results(spark, sf_dir), recursive=True, glob=json_files.PACKED_GLOB)
    docs = json_files.parse_documents(found)
    items = json_files.read_review_items(docs.withColumn("name", F.regexp_extract("path", "doc=([^/]+)/", 1)))
    return items.groupBy(F.col("source_json").alias("doc")).agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("rgb_path").alias("images")
    )


@register(
    "quarantine_bad_files",
    """select '/sets/' || source_input as json_file, '<json_read>' as json_key, '<n/a>' as path,
  case when source_input like '%1.json' then 'failed to parse/read json' else 'bad_shape' end as reason
from (select distinct source_input from qa) where source_input like '%1.json' or source_input like '%2.json'""",
    ["qa"],
)
def quarantine_bad_files(spark, sf_dir):
    """Some documents lose their last character, some become a bare number."""
    docs = _list_docs(spark, sf_dir)
    txt = (
        F.when(F.col("name").endswith("1.json"), F.left("txt", F.length("txt") - 1))
        .when(F.col("name").endswith("2.json"), F.length("txt").cast("string"))
        .otherwise(F.col("txt"))
    )
    return json_files.quarantine_bad_files(json_files.parse_documents(docs.withColumn("txt", txt)))


@register(
    "read_checkpoint",
    """select '/sets/' || source_input as source_input, 'k' || row_idx as checkpoint_key, image_id, question_id, gt_answer, t_max,
  array_to_string(options, '|') as options from qa where coalesce(category, '') <> 'CAT5'""",
    ["qa"],
)
def read_checkpoint(spark, sf_dir):
    rows = json_files.read_checkpoint(json_files.parse_documents(_checkpoint_docs(spark, sf_dir)))
    return rows.select(
        "source_input", "checkpoint_key", "image_id", "question_id", "gt_answer",
        F.col("temp_summary.max").alias("t_max"), F.array_join("options", "|").alias("options"),
    )


@register(
    "read_qa_list",
    """select '/sets/' || source_input as source_input,
  row_number() over (partition by source_input order by row_idx) - 1 as row_idx, image_id, question_id, rgb_path,
  case category when 'CAT1' then model_answer when 'CAT2' then null else gt_answer end as gt_answer, t_top from qa""",
    ["qa"],
)
def read_qa_list(spark, sf_dir):
    rows = json_files.read_qa_list(json_files.parse_documents(_list_docs(spark, sf_dir)))
    return rows.select(
        "source_input", "row_idx", "image_id", "question_id", "rgb_path", "gt_answer",
        F.col("temp_summary.top3_mean").alias("t_top"),
    )


@register(
    "read_review_items",
    """select source_input as source_json, row_number() over (partition by source_input order by row_idx) - 1 as row_idx,
  coalesce(image_id, '') as image_id, coalesce(thermal_path, '') as thermal_path, coalesce(category, '') as category,
  model_answer, round(t_max / 2, 6) as applicability_score from qa""",
    ["qa"],
)
def read_review_items(spark, sf_dir):
    docs = _results_docs(spark, sf_dir).select("path", "name", F.to_json(F.struct("results")).alias("txt"))
    items = json_files.read_review_items(json_files.parse_documents(docs))
    return items.select(
        "source_json", "row_idx", "image_id", "thermal_path", "category", "model_answer",
        F.round("applicability_score", 6).alias("applicability_score"),
    )


def _split_documents(spark, docs):
    """Documents written as one file each and read back in byte ranges; ``path`` as in the table they come from."""
    path = scratch_path(spark, "documents")
    docs.select(F.col("name").alias("doc"), F.col("txt").alias("value")).repartition("doc").write.partitionBy("doc").text(path)
    found = json_records.split_documents(spark, path, recursive=True, glob="*.txt")
    named = F.regexp_replace("path", "^.*/doc=([^/]+)/[^/]+$", "/sets/$1")
    return json_records.SplitDocuments(*(part.withColumn("path", named) for part in (found.files, found.records, found.entries)))


@register(
    "split_read_checkpoint",
    """select '/sets/' || source_input as source_input, 'k' || row_idx as checkpoint_key,
  row_number() over (partition by source_input order by row_idx) - 1 as row_idx, image_id, gt_answer, t_max from qa
qualify coalesce(category, '') <> 'CAT5'""",
    ["qa"],
)
def split_read_checkpoint(spark, sf_dir):
    rows = json_files.read_checkpoint(_split_documents(spark, _checkpoint_docs(spark, sf_dir)))
    return rows.select("source_input", "checkpoint_key", "row_idx", "image_id", "gt_answer", F.col("temp_summary.max").alias("t_max"))


@register(
    "split_read_qa_list",
    """select '/sets/' || source_input as source_input,
  row_number() over (partition by source_input order by row_idx) - 1 as row_idx, image_id, question_id, question,
  case category when 'CAT1' then model_answer when 'CAT2' then null else gt_answer end as gt_answer from qa""",
    ["qa"],
)
def split_read_qa_list(spark, sf_dir):
    rows = json_files.read_qa_list(_split_documents(spark, _list_docs(spark, sf_dir)))
    return rows.select("source_input", "row_idx", "image_id", "question_id", "question", "gt_answer")


@register(
    "split_quarantine",
    """select '/sets/' || source_input as json_file, '<json_read>' as json_key, '<n/a>' as path,
  'failed to parse/read json' as reason
from (select distinct source_input from qa) where source_input like '%1.json' or source_input like '%2.json'""",
    ["qa"],
)
def split_quarantine(spark, sf_dir):
    """Some documents lose their last character, some gain text after their end."""
    docs = _list_docs(spark, sf_dir)
    txt = (
        F.when(F.col("name").endswith("1.json"), F.left("txt", F.length("txt") - 1))
        .when(F.col("name").endswith("2.json"), F.concat("txt", F.lit(" 1")))
        .otherwise(F.col("txt"))
    )
    return json_files.quarantine_bad_files(_split_documents(spark, docs.withColumn("txt", txt)))


_RECORDS = """select '/sets/' || source_input as json_file, {label} as record, rgb_path, thermal_path from qa"""


@register(
    "read_path_records",
    _RECORDS.format(label="question_id") + " union all "
    + _RECORDS.format(label="'k' || row_idx") + " where coalesce(category, '') <> 'CAT5'",
    ["qa"],
)
def read_path_records(spark, sf_dir):
    docs = _list_docs(spark, sf_dir).unionByName(_checkpoint_docs(spark, sf_dir))
    return json_files.read_path_records(json_files.parse_documents(docs))


@register(
    "union_sources",
    """select shape, count(*) as n_rows, count(gt_answer) as with_truth from (
  select 'list' as shape, case category when 'CAT1' then model_answer when 'CAT2' then null else gt_answer end as gt_answer from qa
  union all select 'checkpoint', gt_answer from qa where coalesce(category, '') <> 'CAT5') group by shape""",
    ["qa"],
)
def union_sources(spark, sf_dir):
    docs = _list_docs(spark, sf_dir).unionByName(_checkpoint_docs(spark, sf_dir))
    rows = json_files.read_eval_rows(json_files.parse_documents(docs))
    shape = F.when(F.col("checkpoint_key").isNull(), "list").otherwise("checkpoint")
    return rows.groupBy(shape.alias("shape")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("gt_answer").alias("with_truth")
    )


@register("read_jsonl", "select doc_id, image_id from frame_ids", ["frame_ids"])
def read_jsonl(spark, sf_dir):
    path = scratch_path(spark, "lines")
    adapters.frame_ids(spark, sf_dir).select("doc_id", "image_id").write.json(path)
    lines = json_files.read_jsonl(spark, path)
    return lines.select(
        F.variant_get("v", "$.doc_id", "bigint").alias("doc_id"), F.variant_get("v", "$.image_id", "string").alias("image_id")
    )


def _per_user(rows, path="path"):
    return rows.withColumn("user", F.regexp_extract(path, "^/data/u/([0-9]+)/", 1))


@register("read_group_map", "select path, keyframe from group_map", ["group_map"])
def read_group_map(spark, sf_dir):
    """One map document per user."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "keyframe"))))
    docs = _per_user(adapters.group_map(spark, sf_dir)).groupBy("user").agg(F.to_json(pairs).alias("txt"))
    return json_files.read_group_map(docs)


@register("read_path_list", "select distinct rgb_path as path from review_items", ["review_items"])
def read_path_list(spark, sf_dir):
    """One list document per user, with repeated and padded entries."""
    padded = F.concat(F.lit(" "), F.col("rgb_path"), F.lit("\t"))
    docs = _per_user(adapters.review_items(spark, sf_dir), "rgb_path").groupBy("user").agg(
        F.to_json(F.collect_list(padded)).alias("txt")
    )
    return json_files.read_path_list(docs)


@register("scan_images", "select count(distinct source_input) as files, true as all_sized from qa", ["qa"])
def scan_images(spark, sf_dir):
    """Binary listing of the written documents; contents are not read."""
    listed = images.list_files(spark, _written_results(spark, sf_dir)).where(F.col("path").endswith(".json.gz"))
    return listed.agg(F.count(F.lit(1)).alias("files"), F.min(F.col("length") > 0).alias("all_sized"))


def _picture(image: int, width: int, height: int) -> bytes:
    """A whole PNG of one bit a pixel; every seventh a JPEG up to its frame header; every eleventh no image."""
    if image % 11 == 0:
        return b"not an image"[: 1 + image % 12]
    if image % 7 == 0:
        notes = b"\xff\xe1\xff\xff" + bytes(65533)  # a segment of full length before the header
        return b"\xff\xd8" + notes * 2 + b"\xff\xc0\x00\x11\x08" + struct.pack(">HHB", height, width, 3) + bytes(9)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = zlib.compress(bytes((1 + -(-width // 8)) * height), 1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 1, 0, 0, 0, 0)) + chunk(b"IDAT", rows) + chunk(b"IEND", b"")


# A folder of all pictures would be listed by the driver alone.
FOLDERS = 256


def _write_pictures(sizes, folder):
    def write(batches):
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for image, width, height in zip(*(batch.column(c).to_pylist() for c in ("image", "width", "height")), strict=True):
                with store.open_output_stream(f"{root}/{image % FOLDERS}/{image}.img") as out:
                    out.write(_picture(image, width, height))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    store, root = fs.FileSystem.from_uri(folder)
    for i in range(FOLDERS):
        store.create_dir(f"{root}/{i}")
    sizes.select("image", "width", "height").mapInArrow(write, "n long").agg(F.sum("n")).collect()


@register(
    "image_headers",
    """select image, case when image % 11 = 0 then null when image % 7 = 0 then 'jpeg' else 'png' end as format,
  case when image % 11 <> 0 then width end as width, case when image % 11 <> 0 then height end as height,
  case when image % 11 = 0 then null when image % 7 = 0 then 3 else 1 end as n_channels,
  case when image % 11 = 0 then 'ValueError: not a PNG, JPEG or GIF' end as error
from image_sizes""",
    ["image_sizes"],
)
def image_headers(spark, sf_dir):
    """Sizes of written pictures, read from their first bytes."""
    folder = scratch_path(spark, "pictures")
    _write_pictures(adapters.image_sizes(spark, sf_dir).repartition(64, "image"), folder)
    found = images.image_headers(images.list_files(spark, folder).repartition(64, "path"))
    image = F.regexp_extract("path", "([0-9]+)\\.img$", 1).cast("bigint").alias("image")
    return found.select(image, "format", "width", "height", "n_channels", "error")


def _run_scored(spark, sf_dir):
    return scoring.score_predictions(adapters.run_preds(spark, sf_dir))


@register(
    "write_predictions",
    """select run_name, count(*) as n, count(*) filter (correct) as correct, count(error) as errors, count(pred_answer) as answered
from run_scored where run_name <> 'thermal' group by run_name""",
    ["run_scored"],
)
def write_predictions(spark, sf_dir):
    """The second write replaces one run and clears another that has no rows any more."""
    path = scratch_path(spark, "predictions")
    columns = ["run_name", "source_input", "row_idx", "question_id", "pred_answer", "correct", "raw_model_output", "error"]
    scored = _run_scored(spark, sf_dir).select(*columns)
    sinks.write_predictions(scored, path)
    sinks.write_predictions(scored.where(F.col("run_name") == RUNS[0]), path, runs=RUNS[:2])
    schema = scored.drop("run_name").schema.add("run_name", "string")
    return spark.read.schema(schema).json(path).groupBy("run_name").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("correct"),
        F.count("error").alias("errors"), F.count("pred_answer").alias("answered"),
    )


def _found_files(spark, sf_dir, rows):
    """The files of the rows and one that holds no row."""
    return rows.select(F.col("source_input").alias("path")).distinct().unionAll(spark.range(1).select(F.lit("empty.json").alias("path")))


# The three stand-in runs as runs of one model.
_RUN_SETTINGS = [(name, "qwen", "Qwen/Qwen3-VL-8B-Instruct", name, i == 1) for i, name in enumerate(RUNS)]


def _run_settings(spark):
    rows = spark.createDataFrame(
        [(*r, "/in", False) for r in _RUN_SETTINGS],
        "run_name string, family string, model_id string, input_mode string, repeat_prompt boolean, input string, dry_run boolean",
    )
    named = rows.withColumns({"no_temp_summary": F.lit(False), "requested_backend": F.lit("vllm"), "backend": F.lit("vllm")})
    return sweep.run_config_json(named)


@register(
    "write_metrics_json",
    """with c as (select run_name, coalesce(category, 'UNKNOWN') as key, count(*) as n, count(*) filter (correct) as good from run_scored group by all)
select r.run_name, count(*) as total, count(*) filter (correct) as correct, round(count(*) filter (correct) / count(*), 6) as accuracy,
  count(r.error) as exceptions, count(*) as total_sampled_questions, count(*) as queued, count(*) as evaluated,
  0::bigint as skipped_missing_fields, 0::bigint as skipped_missing_files,
  (select count(distinct source_input) + 1 from run_scored) as json_files_discovered,
  'qwen' as model_family, 'Qwen/Qwen3-VL-8B-Instruct' as model_id, r.run_name as input_mode, r.run_name = 'thermal' as repeat_prompt,
  123::bigint as seed, '/in' as input, false as dry_run, true as has_revision, 768::bigint as max_side,
  (select string_agg(key || ':' || n || ':' || good, ',' order by key) from c where c.run_name = r.run_name) as categories
from run_scored r group by r.run_name""",
    ["run_scored"],
)
def write_metrics_json(spark, sf_dir):
    """Metrics documents read back field by field; a file without rows counts as found."""
    path = scratch_path(spark, "metrics")
    scored = _run_scored(spark, sf_dir)
    queue = adapters.run_preds(spark, sf_dir).withColumn("skip_reason", F.lit(None).cast("string"))
    counters = scoring.run_counters(queue, scored, by=["run_name"], files=_found_files(spark, sf_dir, queue))
    sinks.write_documents(sinks.metrics_documents(run_metrics(spark, sf_dir), counters, _run_settings(spark)), path)
    stats = "total bigint, correct bigint, accuracy double"
    counts = (
        "exceptions", "total_sampled_questions", "queued", "evaluated", "skipped_missing_fields", "skipped_missing_files",
        "json_files_discovered",
    )
    shape = (
        f"model_family string, model_id string, input_mode string, overall struct<{stats}>, by_category map<string, struct<{stats}>>, "
        "run_config struct<repeat_prompt: boolean, seed: bigint, input: string, dry_run: boolean, max_side: bigint>, "
        f"more_info struct<{', '.join(c + ': bigint' for c in counts)}>"
    )
    d = spark.read.text(path).withColumn("d", F.from_json("value", shape))
    cats = F.array_join(
        F.transform(F.map_entries("d.by_category"), lambda e: F.concat_ws(":", e["key"], e["value"]["total"], e["value"]["correct"])), ","
    )
    return d.select(
        "run_name", "d.overall.total", "d.overall.correct", F.round("d.overall.accuracy", 6).alias("accuracy"),
        *[f"d.more_info.{c}" for c in counts], "d.model_family", "d.model_id", "d.input_mode",
        *[f"d.run_config.{c}" for c in ("repeat_prompt", "seed", "input", "dry_run", "max_side")],
        F.col("value").contains('"model_revision":null').alias("has_revision"), cats.alias("categories"),
    )


_QUEUED = ("source_input", "row_idx", "image_id", "question_id", "question", "options", "gt_answer", "rgb_path", "thermal_path", "skip_reason")
_ICL = ("icl_queries_with_full_requested_shots", "icl_queries_with_zero_support_examples")


@register(
    "write_dry_run_report",
    f"""{_SELECTED}, m as (select rgb_path || ' ' || thermal_path as pair, source_input, row_idx from checked where skip_reason = 'missing_files'
  order by source_input, row_idx limit 5),
per as (select t.source_input, t.row_idx, count(s.pos) as used from t left join selected s using (source_input, row_idx) group by all)
select 'dry_run_only' as status, count(*) as total_sampled_questions, count(*) filter (skip_reason is null) as eligible_for_eval,
  count(*) filter (skip_reason = 'missing_fields') as skipped_missing_fields, count(*) filter (skip_reason = 'missing_files') as skipped_missing_files,
  count(distinct source_input) + 1 as json_files_discovered, 'rgb' as run_name, 'qwen' as model_family,
  (select count(*) from per where used >= {SHOTS}) as {_ICL[0]}, (select count(*) from per where used = 0) as {_ICL[1]},
  (select string_agg(pair, ';' order by source_input, row_idx) from m) as missing from checked""",
    ["checked"],
)
def write_dry_run_report(spark, sf_dir):
    """The report of a run with solved examples, read back field by field."""
    path = scratch_path(spark, "dryrun")
    # counted, listed and drawn from; the joins of files behind it are done once, and rows of equal keys keep their order
    queue = checked(spark, sf_dir).select(*_QUEUED).persist(StorageLevel.DISK_ONLY)
    config = _run_settings(spark).where("run_name = 'rgb'").first()["run_config"]
    supports = fewshot.icl_select_supports(queue, SHOTS, meta=())
    sinks.dry_run_report(queue, 5, _found_files(spark, sf_dir, queue), config, supports, SHOTS).write.text(path)
    queue.unpersist()
    counts = (
        "total_sampled_questions", "eligible_for_eval", "skipped_missing_fields", "skipped_missing_files", "json_files_discovered", *_ICL,
    )
    shape = (
        f"status string, run_config struct<run_name: string, model_family: string>, summary struct<{', '.join(c + ': bigint' for c in counts)}>, "
        "sample_missing_paths array<struct<rgb_path: string, thermal_path: string>>"
    )
    d = spark.read.text(path).select(F.from_json("value", shape).alias("d"))
    pairs = F.transform("d.sample_missing_paths", lambda p: F.concat_ws(" ", p["rgb_path"], p["thermal_path"]))
    return d.select("d.status", "d.run_config.*", "d.summary.*", F.array_join(pairs, ";").alias("missing"))


@register(
    "review_snapshot_version",
    "select qa_key, label, human_answer, option_index from latest",
    ["latest"],
)
def review_snapshot_version(spark, sf_dir):
    """Two versions of a snapshot; the reader follows to the newer one."""
    path = scratch_path(spark, "versions")
    decided = latest(spark, sf_dir)
    sinks.write_review_snapshot(decided.withColumn("label", F.lit("old")), path)
    sinks.write_review_snapshot(decided, path)
    return sinks.read_review_snapshot(spark, path).select("qa_key", "label", "human_answer", "option_index")


@register("write_review_snapshot", "select qa_key, label, human_answer, option_index, question_id, model_answer from latest", ["latest"])
def write_review_snapshot(spark, sf_dir):
    """Checkpoint documents, written and resumed from."""
    path = scratch_path(spark, "snapshot")
    sinks.export_checkpoint_json(latest(spark, sf_dir), path, "manual_eval", "2024-01-31 00:00:00", entries=1000)
    docs = json_files.parse_documents(json_files.scan_json_files(spark, path, recursive=True))
    return json_files.read_decisions(docs).select(
        "qa_key", "label", "human_answer", "option_index", "question_id", "model_answer"
    )


@register(
    "append_action_log",
    "select type, coalesce(label, 'none') as label, count(*) as n, cast(sum(seq) as bigint) as seq_sum from actions group by all",
    ["actions"],
)
def append_action_log(spark, sf_dir):
    """Appended in two halves by event type and read back as one log."""
    path = scratch_path(spark, "log")
    log = adapters.actions(spark, sf_dir).select("seq", "type", "timestamp", "qa_key", "label", "human_answer", "option_index")
    sinks.append_action_log(log.where("type = 'header'"), path)
    sinks.append_action_log(log.where("type <> 'header'"), path)
    back = spark.read.schema(log.schema).json(path)
    return back.groupBy("type", F.coalesce("label", F.lit("none")).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seq_sum")
    )


@register("write_frame_sorted", _FRAME_ORDER, ["frame_ids"])
def write_frame_sorted(spark, sf_dir):
    path = scratch_path(spark, "frames")
    ordered = frame_order(spark, sf_dir)
    sinks.write_frame_sorted(ordered, path)
    return spark.read.schema(ordered.schema).json(path)


