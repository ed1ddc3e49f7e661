"""JSON documents -> typed rows.

A source is a table ``(path, name, txt)`` with one document per row, from disk
or from another table; or what :func:`json_records.split_documents` makes of large
files, which the readers below take as well. ``VARIANT`` is only used here, at the ingest boundary.
Three shapes exist: ``checkpoint`` (an object of keyed entries), ``list`` and
``results`` (an object holding a list). Each reader takes the shapes it accepts.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank, strip
from ..schema import TEMP_SUMMARY

JSON_GLOB = "*.[jJ][sS][oO][nN]"
# Compressed files too; Spark's reader of whole texts opens them by their ending.
PACKED_GLOB = "*.{[jJ][sS][oO][nN],[jJ][sS][oO][nN].[gG][zZ]}"
READ_KEY = "<json_read>"
UNREADABLE = "failed to parse/read json"
BAD_SHAPE = "bad_shape"


def path_exists(spark: SparkSession, path: str) -> bool:
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(sc._jsc.hadoopConfiguration()).exists(target)


def plain_path(c: Column) -> Column:
    """Local file URIs as plain paths; other schemes stay."""
    return F.regexp_replace(c, "^file:/+", "/")


def scan_json_files(spark: SparkSession, path: str, recursive: bool = False, single: bool = False, glob: str = JSON_GLOB) -> DataFrame:
    """One row per ``.json`` file: path, name, text. ``single`` reads one file of any name; ``PACKED_GLOB`` finds gzip files as well."""
    limits = {} if single else {"pathGlobFilter": glob, "recursiveFileLookup": recursive}
    return spark.read.text(path, wholetext=True, **limits).select(
        plain_path(F.col("_metadata.file_path")).alias("path"),
        F.col("_metadata.file_name").alias("name"),
        F.col("value").alias("txt"),
    )


def _get(v: Column | str, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


ROOT = "type string, items map<string,variant>, results array<variant>, __bad string"


def _last_of_each_key(items: Column) -> Column:
    """Entries of a map that may repeat keys: the last value at the place of the first, as in a dict."""

    def of(entries: Column) -> Column:
        def ends(order: Column) -> Column:
            firsts = F.filter(order, lambda x, i: F.coalesce(F.get(order, i - 1)["k"] != x["k"], F.lit(True)))
            lasts = F.filter(order, lambda x, i: F.coalesce(F.get(order, i + 1)["k"] != x["k"], F.lit(True)))
            return F.sort_array(F.zip_with(firsts, lasts, lambda a, z: F.struct(a["i"].alias("a"), z["i"].alias("z"))))

        keys = F.transform(entries, lambda e, i: F.struct(e["key"].alias("k"), i.alias("i")))
        places = F.transform(F.array(F.sort_array(keys)), ends)[0]
        again = F.transform(places, lambda p: F.get(entries, p["z"]))
        names = F.transform(entries, lambda e: e["key"])
        return F.when(F.size(F.array_distinct(names)) < F.size(entries), again).otherwise(entries)

    return F.transform(F.array(F.map_entries(items)), of)[0]


def parse_documents(files: DataFrame) -> DataFrame:
    """Add ``doc`` and ``shape``; one pass over the text.

    Only the top level is typed, every record is a ``VARIANT`` of its own, so the
    size limit of one value holds per record and not per document. What can't be read is
    ``malformed``, and ``quarantine_bad_files`` has a row for it. Repeated keys: the last one
    counts; for keys inside a record the session is told so here.
    """
    # Exploding an array of one keeps the text and its parse from being computed anew for every use of ``shape`` and ``doc``.
    files.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    opener = F.left(F.ltrim(F.col("txt"), F.lit(" \t\r\n\ufeff")), F.lit(1))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}
    doc = F.struct(
        opener.alias("opener"),
        F.when(opener == "[", F.from_json("txt", "array<variant>")).alias("list"),
        F.when(opener == "{", F.from_json("txt", ROOT, options)).alias("root"),
    )
    files = files.drop("doc").select("*", F.explode(F.array(doc)).alias("doc"))
    d, root = F.col("doc"), F.col("doc.root")
    shape = (
        F.when(d["opener"] == "[", F.when(d["list"].isNotNull(), "list").otherwise("malformed"))
        .when(d["opener"] == "{", F.when((root["type"] == "checkpoint") & root["items"].isNotNull(), "checkpoint")
            .when(root["results"].isNotNull(), "results")
            .when(root["__bad"].isNotNull() & F.json_object_keys("txt").isNull(), "malformed")
            .otherwise("other"))
        .when(F.try_parse_json("txt").isNull(), "malformed")
        .otherwise("other")
    )
    return files.withColumn("shape", shape)


def quarantine_bad_files(docs: DataFrame, accepted: tuple[str, ...] = ("checkpoint", "list", "results")) -> DataFrame:
    """``(file, json_key, path, reason)`` for documents that no reader takes."""
    docs = getattr(docs, "files", docs)
    reason = F.when(F.col("shape") == "malformed", UNREADABLE).when(
        ~F.col("shape").isin(*accepted), BAD_SHAPE
    )
    return docs.select(
        F.col("path").alias("json_file"),
        F.lit(READ_KEY).alias("json_key"),
        F.lit("<n/a>").alias("path"),
        reason.alias("reason"),
    ).where(F.col("reason").isNotNull())


def _is_object(v: str) -> Column:
    """Only objects cast to a struct; one absent field keeps the test cheap."""
    return _get(v, "$", "struct<__none:variant>").isNotNull()


def _text(v: str, field: str) -> Column:
    return _get(v, f"$.{field}", "string")


def _temp(v: str) -> Column:
    fields = [_get(v, f"$.temp_summary.{f.name}", "double").alias(f.name) for f in TEMP_SUMMARY.fields]
    whole = _get(v, "$.temp_summary", "map<string,variant>")
    return F.when(F.size(whole) > 0, F.struct(*fields))


def _row_fields(v: str) -> list[Column]:
    names = ("image_id", "rgb_path", "thermal_path", "category", "question_id", "question")
    return [_text(v, n).alias(n) for n in names] + [
        _get(v, "$.options", "array<string>").alias("options"),
        _temp(v).alias("temp_summary"),
    ]


def _entries(docs: DataFrame) -> DataFrame:
    """Checkpoint entries in document order."""
    if hasattr(docs, "entries"):
        found = docs.entries
    else:
        entries = _last_of_each_key(F.col("doc.root.items"))
        found = (
            docs.where(F.col("shape") == "checkpoint")
            .select("path", "name", F.posexplode(entries).alias("pos", "e"))
            .select("path", "name", F.col("pos").cast("bigint").alias("row_idx"), F.col("e.key").alias("checkpoint_key"), F.col("e.value").alias("entry"))
        )
    return (
        found.where(_is_object("entry"))
        .withColumn("meta", _get("entry", "$.meta", "variant"))
        .where(F.col("meta").isNull() | _is_object("meta"))
    )


def read_checkpoint(docs: DataFrame) -> DataFrame:
    """Evaluation rows of decision checkpoints; the human answer is the truth."""
    return _entries(docs).select(
        F.col("path").alias("source_input"),
        "checkpoint_key",
        "row_idx",
        *_row_fields("meta"),
        _text("entry", "human_answer").alias("gt_answer"),
    )


def read_decisions(docs: DataFrame) -> DataFrame:
    """The decisions themselves, to resume a review."""
    return _entries(docs).select(
        F.col("checkpoint_key").alias("qa_key"),
        _text("entry", "label").alias("label"),
        _text("entry", "human_answer").alias("human_answer"),
        _get("entry", "$.option_index", "int").alias("option_index"),
        _text("entry", "timestamp").alias("timestamp"),
        F.coalesce(_get("entry", "$.auto_propagated", "boolean"), F.lit(False)).alias("auto_propagated"),
        _text("entry", "propagated_from").alias("propagated_from"),
        _text("meta", "source_json").alias("source_json"),
        _get("meta", "$.row_idx", "bigint").alias("row_idx"),
        *_row_fields("meta"),
        _text("meta", "model_answer").alias("model_answer"),
    ).drop("temp_summary")


def _records(docs: DataFrame, *shapes: str) -> DataFrame:
    if hasattr(docs, "records"):
        return docs.records.where(F.col("shape").isin(*shapes)).drop("shape").where(_is_object("r"))
    rows = F.when(F.col("shape") == "list", F.col("doc.list")).otherwise(F.col("doc.root.results"))
    return (
        docs.where(F.col("shape").isin(*shapes))
        .select("path", "name", F.posexplode(rows).alias("pos", "r"))
        .select("path", "name", F.col("pos").cast("bigint").alias("row_idx"), "r")
        .where(_is_object("r"))
    )


def _listed_truth(r: str) -> Column:
    given = _get(r, "$.gt_answer", "variant")
    return F.when(given.isNull(), _text(r, "answer")).otherwise(_text(r, "gt_answer"))


def read_qa_list(docs: DataFrame) -> DataFrame:
    """Evaluation rows of list documents. Only a missing ``gt_answer`` is filled
    from ``answer``; a present null stays null."""
    return (
        _records(docs, "list")
        .select(
            F.col("path").alias("source_input"),
            F.lit(None).cast("string").alias("checkpoint_key"),
            "row_idx",
            *_row_fields("r"),
            _listed_truth("r").alias("gt_answer"),
        )
        .where(~is_blank(F.col("question_id")))
    )


def _either(docs: DataFrame) -> DataFrame:
    """``path, row_idx, keyed, checkpoint_key, v, meta``: entries of checkpoints and records of lists, in one pass over the documents."""
    entries = F.transform(_last_of_each_key(F.col("doc.root.items")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    records = F.transform("doc.list", lambda r: F.struct(F.lit(None).cast("string").alias("key"), r.alias("value")))
    keyed = (F.col("shape") == "checkpoint").alias("keyed")
    return (
        docs.where(F.col("shape").isin("checkpoint", "list"))
        .select("path", keyed, F.when(F.col("shape") == "checkpoint", entries).otherwise(records).alias("all"))
        .select("path", "keyed", F.posexplode("all").alias("pos", "e"))
        .select("path", F.col("pos").cast("bigint").alias("row_idx"), "keyed", F.col("e.key").alias("checkpoint_key"), F.col("e.value").alias("v"))
        .where(_is_object("v"))
        .withColumn("meta", F.when(F.col("keyed"), _get("v", "$.meta", "variant")).otherwise(F.col("v")))
        .where(F.col("meta").isNull() | _is_object("meta"))
    )


def read_eval_rows(docs: DataFrame) -> DataFrame:
    """All rows an evaluation can queue, from either accepted shape."""
    if not isinstance(docs, DataFrame):
        return read_checkpoint(docs).unionByName(read_qa_list(docs))
    return (
        _either(docs)
        .select(
            F.col("path").alias("source_input"),
            "checkpoint_key",
            "row_idx",
            *_row_fields("meta"),
            F.when(F.col("keyed"), _text("v", "human_answer")).otherwise(_listed_truth("v")).alias("gt_answer"),
            "keyed",
        )
        .where(F.col("keyed") | ~is_blank(F.col("question_id")))
        .drop("keyed")
    )


def read_review_items(docs: DataFrame) -> DataFrame:
    """Typed review items; ``row_idx`` counts all records of the file."""
    names = ("image_id", "rgb_path", "thermal_path", "category", "question_id", "question")
    return _records(docs, "list", "results").select(
        *[strip(F.coalesce(_text("r", n), F.lit(""))).alias(n) for n in names],
        F.coalesce(_get("r", "$.options", "array<string>"), F.array().cast("array<string>")).alias("options"),
        strip(F.coalesce(_text("r", "answer"), F.lit(""))).alias("model_answer"),
        _get("r", "$.applicability_score", "double").alias("applicability_score"),
        _temp("r").alias("temp_summary"),
        F.col("name").alias("source_json"),
        "row_idx",
    )


def read_path_records(docs: DataFrame) -> DataFrame:
    """``(json_file, record, rgb_path, thermal_path)`` for the path audit."""
    paths = lambda v: [_text(v, "rgb_path").alias("rgb_path"), _text(v, "thermal_path").alias("thermal_path")]
    if isinstance(docs, DataFrame):
        named = F.coalesce(_text("v", "question_id"), F.concat(F.lit("row_"), F.col("row_idx").cast("string")))
        record = F.when(F.col("keyed"), F.col("checkpoint_key")).otherwise(named).alias("record")
        return _either(docs).select(F.col("path").alias("json_file"), record, *paths("meta"))
    keyed = _entries(docs).select(F.col("path").alias("json_file"), F.col("checkpoint_key").alias("record"), *paths("meta"))
    label = F.coalesce(_text("r", "question_id"), F.concat(F.lit("row_"), F.col("row_idx").cast("string")))
    listed = _records(docs, "list").select(F.col("path").alias("json_file"), label.alias("record"), *paths("r"))
    return keyed.unionByName(listed)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """``(path, pos, line, v)`` per non-blank line; a malformed line fails the job.

    ``pos`` grows with the line order of a file.
    """
    lines = spark.read.text(path).select(
        plain_path(F.col("_metadata.file_path")).alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"),
        strip(F.col("value")).alias("line"),
    )
    return lines.where(F.col("line") != "").select(
        "path", F.struct("start", "id").alias("pos"), "line", F.parse_json("line").alias("v")
    )


def read_group_map(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(F.from_json("txt", "map<string,string>")).alias("path", "keyframe"))


def load_group_map(spark: SparkSession, path: str) -> DataFrame:
    """The map of a file; a missing file gives an empty map and a warning."""
    if not path_exists(spark, path):
        warnings.warn(f"group map not found: {path}", stacklevel=2)
        return spark.createDataFrame([], "path string, keyframe string")
    return read_group_map(scan_json_files(spark, path, single=True))


def read_path_list(docs: DataFrame) -> DataFrame:
    listed = docs.select(F.explode(F.from_json("txt", "array<string>")).alias("path"))
    return listed.select(strip(F.col("path")).alias("path")).distinct()


def load_path_list(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    return read_path_list(scan_json_files(spark, path, single=True))
