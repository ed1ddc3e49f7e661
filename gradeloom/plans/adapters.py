"""The given tables seen as evaluation and review data.

Each adapter is a narrow projection (or one aggregation) of a table, so its
work and its output grow with the table. ``oracle.py`` states the same views
for the SQL check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.choice import LABEL_CORRECT, decided_answer, pick_is_valid, pick_label

OPTIONS = "array('Returned', 'Not returned', 'Accepted')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hand an input with fewer splits than cores to all cores by hashing ``keys``.

    A large table has splits enough and is left alone: no shuffle is added.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey")


def _pick(index: str) -> str:
    return f"element_at({OPTIONS}, cast(({index}) as int) + 1)"


GT = "case l_returnflag when 'R' then 'Returned' when 'N' then 'Not returned' when 'A' then 'Accepted' end"


def _qa_columns() -> list[str]:
    stem = "concat('/data/loc_', l_orderkey % 20, '/{kind}/', lpad(cast(l_orderkey as string), 8, '0'), '.jpg')"
    return [
        "concat('file_', l_orderkey div 1000, '.json') as source_input",
        # position key: order in the block, line, part, supplier, quantity
        "((l_orderkey % 1000) * 10 + l_linenumber) * 100000000000000 + (l_partkey % 1000000) * 100000000 + (l_suppkey % 1000000) * 100 + cast(l_quantity as bigint) as row_idx",
        "case when l_orderkey % 97 = 0 then null else cast(l_orderkey as string) end as image_id",
        "concat('Q', l_linenumber) as question_id",
        "case when l_partkey % 101 = 0 then null else concat('CAT', l_partkey % 8) end as category",
        "case when l_quantity = 13 then '' else concat('What is the state of line ', l_linenumber, '?') end as question",
        f"{OPTIONS} as options",
        f"{GT} as gt_answer",
        f"{_pick('l_partkey % 3')} as model_answer",
        f"{stem.format(kind='rgb')} as rgb_path",
        f"case when l_quantity = 7 then null else {stem.format(kind='thr')} end as thermal_path",
        "named_struct('min', round(l_discount * 100, 2), 'max', l_quantity, 'mean', round(l_tax * 100, 2), "
        "'top3_mean', case when l_linenumber = 7 then null else l_quantity end) as temp_summary",
    ]


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem(spark, sf_dir).selectExpr(*_qa_columns())


def preds_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = "(l_partkey + l_suppkey) % 6"
    raw = (
        f"case {kind} when 0 then concat('  ', upper({GT}), ' ') "
        f"when 1 then concat('The state is ', lower({GT}), '.') when 2 then 'Returned' "
        "when 3 then 'unknown' when 4 then 'accepted or not returned' end as raw_output"
    )
    error = f"case when {kind} = 5 then 'RuntimeError' end as error"
    return lineitem(spark, sf_dir).selectExpr(*_qa_columns(), raw, error)


def run_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of three runs, one per input mode."""
    return preds_raw(spark, sf_dir).select(
        "*",
        F.explode(
            F.array(
                F.struct(F.lit("rgb").alias("run_name"), F.col("raw_output").alias("raw")),
                F.struct(F.lit("thermal").alias("run_name"), F.col("model_answer").alias("raw")),
                F.struct(
                    F.lit("rgb_thermal").alias("run_name"),
                    F.when(F.col("category") == "CAT3", "unknown").otherwise(F.upper("gt_answer")).alias("raw"),
                ),
            )
        ).alias("__run"),
    ).select(
        "*",
        F.col("__run.run_name").alias("run_name"),
        F.col("__run.raw").alias("run_output"),
        F.when(F.col("__run.raw").isNull(), "RuntimeError").alias("run_error"),
    ).drop("__run", "raw_output", "error").withColumnsRenamed({"run_output": "raw_output", "run_error": "error"})


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory of existing files: pending orders lack the first image, low
    priority orders the second."""
    stem = "concat('/data/loc_', o_orderkey % 20, '/{kind}/', lpad(cast(o_orderkey as string), 8, '0'), '.jpg')"
    return (
        table(spark, sf_dir, "orders")
        .selectExpr(
            f"case when o_orderstatus <> 'P' then {stem.format(kind='rgb')} end as rgb",
            f"case when o_orderpriority <> '5-LOW' then {stem.format(kind='thr')} end as thr",
            "cast(o_totalprice as bigint) as length",
        )
        .select(F.explode(F.array("rgb", "thr")).alias("path"), "length")
        .where(F.col("path").isNotNull())
    )


def _event_keys() -> list[str]:
    return ["user_id", "cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k"]


def _review_columns() -> list[str]:
    image = "concat('u', user_id, '_f', lpad(cast(k div 4 as string), 2, '0'))"
    return [
        "concat('review_', user_id div 50, '.json') as source_json",
        "user_id * 100 + k as row_idx",
        f"case when k div 4 = 24 then '' else {image} end as image_id",
        "concat('/data/u/', user_id, '/', lpad(cast(k div 4 as string), 2, '0'), '.jpg') as rgb_path",
        "concat('/data/t/', user_id, '/', lpad(cast(k div 4 as string), 2, '0'), '.jpg') as thermal_path",
        "case when k % 20 = 19 then '' else concat('CAT', (user_id + k) % 6) end as category",
        "case when k % 25 = 24 then '' else concat('Q', k % 4) end as question_id",
        "concat('What is the delivery state shown for the item with the number ', k, ' in the frame of user ', "
        "user_id, ', judged from both images?') as question",
        f"{OPTIONS} as options",
        f"{_pick('user_id % 3')} as model_answer",
    ]


def _with_keys(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumn("image_key", text.image_key(c("image_id"), c("rgb_path"), c("thermal_path"))).withColumn(
        "qa_key", text.qa_key(c("source_json"), c("row_idx"), c("image_key"), c("question_id"), c("question"))
    )


def review_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item per (user, k) seen in the events."""
    seen = table(spark, sf_dir, "events").selectExpr(*_event_keys()).distinct()
    return _with_keys(seen.selectExpr(*_review_columns()))


def group_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five consecutive frames of a user share the first one as keyframe."""
    path = "concat('/data/u/', user_id, '/', lpad(cast({f} as string), 2, '0'), '.jpg')"
    frame, key = "k div 4", "k div 4 - (k div 4) % 5"
    return (
        table(spark, sf_dir, "events")
        .selectExpr(*_event_keys())
        .selectExpr(
            f"array({path.format(f=frame)}, {path.format(f=key)}) as both", f"{path.format(f=key)} as keyframe"
        )
        .select(F.explode("both").alias("path"), "keyframe")
        .distinct()
    )


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision log: views confirm, clicks and errors pick an option, the
    rest are header rows. A pick beyond the last option is no decision."""
    c = F.col
    base = table(spark, sf_dir, "events").selectExpr(
        "event_id as seq", "date_format(ts, 'yyyy-MM-dd HH:mm:ss') as timestamp", "event_type",
        "case event_type when 'click' then event_id % 4 when 'error' then 0 end as pick", *_event_keys(),
    )
    items = _with_keys(base.selectExpr("seq", "timestamp", "event_type", "cast(pick as int) as pick", *_review_columns()))
    label = F.when(c("event_type") == "view", LABEL_CORRECT).otherwise(
        pick_label(c("options"), c("pick"), c("model_answer"))
    )
    decided = (c("event_type") == "view") | F.coalesce(pick_is_valid(c("options"), c("pick")), F.lit(False))
    return (
        items.withColumn("type", F.when(decided, "action").otherwise("header"))
        .withColumn("label", F.when(decided, label))
        .withColumn("option_index", F.when(c("label") == "corrected", c("pick")))
        .withColumn("human_answer", decided_answer(c("label"), c("options"), c("pick"), c("model_answer")))
        .withColumn("auto_propagated", F.lit(False))
        .drop("event_type", "pick")
    )


def prior_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of an earlier session: purchases settle on the last option."""
    seen = (
        table(spark, sf_dir, "events").where("event_type = 'purchase'").selectExpr(*_event_keys()).distinct()
    )
    return (
        _with_keys(seen.selectExpr(*_review_columns()))
        .withColumn("label", F.lit("corrected"))
        .withColumn("option_index", F.lit(2))
        .withColumn("human_answer", F.element_at("options", 3))
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two feature vectors per frame, one per modality."""
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("loc_"), F.col("label").cast("string")).alias("folder"),
        F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("path"),
        F.col("vec_id"),
        F.slice("embedding", 1, 32).alias("rgb_vec"),
        F.slice("embedding", 33, 32).alias("thr_vec"),
    )


def path_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested documents holding rooted paths and plain URLs."""
    rooted = F.regexp_replace("url", "^https?://", "/web/")
    home = F.concat(F.lit("/web/"), F.regexp_extract("url", "^https?://([^/]+)", 1))
    return table(spark, sf_dir, "pages").select(
        F.col("page_id"),
        F.struct(
            F.col("page_id").cast("string").alias("id"),
            F.array(
                F.struct(rooted.alias("path"), F.col("url").alias("url")),
                F.struct(F.concat(home, F.lit("/index.html")).alias("path"), F.lit("/web").alias("url")),
            ).alias("assets"),
            F.struct(home.alias("home")).alias("meta"),
        ).alias("doc"),
    )


def frame_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image ids in the shapes that the frame order has to read."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        "case doc_id % 5 when 0 then cast(doc_id as string) when 1 then lpad(cast(doc_id as string), 8, '0') "
        "when 2 then concat(source, '_frame_', doc_id % 100) when 3 then lang "
        "else case when doc_id % 3 = 0 then concat(repeat('7', cast(36 + doc_id % 9 as int)), doc_id) else '' end end as image_id",
        "n_chars % 50 = 0 as is_header",
    )


def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey as image", "cast(p_size * 40 + 1 as bigint) as width", "p_partkey % 900 + 1 as height"
    )


def run_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One evaluation request per customer, with the model named by an alias."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as request_id",
        "element_at(array(' LLaVA', 'qwen3-vl', 'Llama3.2 ', 'internvl', 'minicpm-v', 'PIXTRAL', 'gpt-none'), "
        "cast(c_custkey % 7 as int) + 1) as model",
        "element_at(array('rgb_thermal', 'rgb', 'thermal'), cast(c_nationkey % 3 as int) + 1) as input_mode",
        "c_acctbal > 3000 as repeat_prompt",
        "c_acctbal < 6000 as no_temp_summary",
        "cast(c_nationkey % 8 as double) / 8 + 0.005 as percent",
        "c_custkey as seed",
        "c_mktsegment",
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
