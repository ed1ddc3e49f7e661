"""Queries: answer parsing, scoring, validation, sampling and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.choice import parse_choice as parse
from ..operators import sampling, scoring, validate
from . import adapters
from .oracle import norm, review_norm
from .registry import register


def scored(spark, sf_dir):
    return scoring.score_predictions(adapters.preds_raw(spark, sf_dir))


def checked(spark, sf_dir, mode="rgb_thermal"):
    return validate.join_file_inventory(adapters.qa(spark, sf_dir), adapters.files(spark, sf_dir), mode)


def _rounded(df):
    return df.withColumn("accuracy", F.round("accuracy", 6))


@register(
    "norm_answer",
    f"select source_input, row_idx, {norm('raw_output')} as raw_norm, {norm('gt_answer')} as gt_norm from preds_raw",
    ["preds_raw"],
)
def norm_answer(spark, sf_dir):
    return adapters.preds_raw(spark, sf_dir).select(
        "source_input",
        "row_idx",
        text.norm_answer(F.col("raw_output")).alias("raw_norm"),
        text.norm_answer(F.col("gt_answer")).alias("gt_norm"),
    )


@register(
    "norm_review_text",
    f"""select conv_id, turn, md5({review_norm('text')}) as text_md5, length({review_norm('text')}) as n_chars
from messages""",
    ["messages"],
)
def norm_review_text(spark, sf_dir):
    clean = text.norm_review_text(F.col("text"))
    return (
        adapters.messages(spark, sf_dir)
        .withColumn("clean", clean)
        .select("conv_id", "turn", F.md5("clean").alias("text_md5"), F.length("clean").cast("bigint").alias("n_chars"))
    )


@register(
    "required_fields_filter",
    """select source_input, row_idx,
  case when coalesce(question, '') = '' or coalesce(gt_answer, '') = '' or coalesce(rgb_path, '') = ''
    or coalesce(thermal_path, '') = '' then 'missing_fields' end as both_reason,
  case when coalesce(question, '') = '' or coalesce(gt_answer, '') = '' or coalesce(rgb_path, '') = ''
    then 'missing_fields' end as rgb_reason,
  case when coalesce(question, '') = '' or coalesce(gt_answer, '') = '' or coalesce(thermal_path, '') = ''
    then 'missing_fields' end as thermal_reason
from qa""",
    ["qa"],
)
def required_fields_filter(spark, sf_dir):
    rows = adapters.qa(spark, sf_dir)
    for mode, out in (("rgb_thermal", "both_reason"), ("rgb", "rgb_reason"), ("thermal", "thermal_reason")):
        rows = validate.required_fields_filter(rows, mode).withColumnRenamed("skip_reason", out)
    return rows.select("source_input", "row_idx", "both_reason", "rgb_reason", "thermal_reason")


@register(
    "drop_temp_summary",
    """select source_input, row_idx, category = 'CAT1' as no_temp,
  case when category = 'CAT1' then null else t_min end as t_min,
  case when category = 'CAT1' then null else t_top end as t_top, coalesce(category = 'CAT1', false) as dropped
from qa""",
    ["qa"],
)
def drop_temp_summary(spark, sf_dir):
    no_temp = F.col("category") == "CAT1"
    rows = validate.drop_temp_summary(adapters.qa(spark, sf_dir), F.coalesce(no_temp, F.lit(False)))
    return rows.select(
        "source_input",
        "row_idx",
        no_temp.alias("no_temp"),
        F.col("temp_summary.min").alias("t_min"),
        F.col("temp_summary.top3_mean").alias("t_top"),
        F.col("temp_summary").isNull().alias("dropped"),
    )


@register(
    "fill_unknown_ids",
    """select source_input, row_idx, coalesce(image_id, 'UNKNOWN') as image_id,
  coalesce(question_id, 'UNKNOWN') as question_id, coalesce(category, 'UNKNOWN') as category from qa""",
    ["qa"],
)
def fill_unknown_ids(spark, sf_dir):
    return scoring.fill_unknown_ids(adapters.qa(spark, sf_dir)).select(
        "source_input", "row_idx", "image_id", "question_id", "category"
    )


@register(
    "parse_choice",
    "select source_input, row_idx, pred_answer from scored where error is null",
    ["scored"],
)
def parse_choice(spark, sf_dir):
    answered = adapters.preds_raw(spark, sf_dir).where(F.col("error").isNull())
    return parse(answered, "raw_output", "options").select("source_input", "row_idx", "pred_answer")


@register(
    "score_predictions",
    "select source_input, row_idx, pred_answer, correct, raw_model_output, error from scored",
    ["scored"],
)
def score_predictions(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "source_input", "row_idx", "pred_answer", "correct", "raw_model_output", "error"
    )


_SAMPLED = """
with ids as (select distinct source_input, image_id from qa where image_id is not null),
ranked as (select *, row_number() over (partition by source_input order by sha256('123::' || image_id)) as rn,
    greatest(1, cast(round_even({p} * count(*) over (partition by source_input), 0) as bigint)) as k from ids)
"""


@register(
    "sample_images_expand",
    _SAMPLED.format(p="0.2")
    + """select source_input, row_idx, image_id from qa
where exists (select 1 from ranked r where r.rn <= r.k and r.source_input = qa.source_input and r.image_id = qa.image_id)""",
    ["qa"],
)
def sample_images_expand(spark, sf_dir):
    return sampling.sample_images_expand(adapters.qa(spark, sf_dir), 0.2).select("source_input", "row_idx", "image_id")


@register(
    "sample_rows_fallback",
    """
with half as (select source_input, row_idx, case when category = 'CAT0' then null else image_id end as image_id,
    'cat_' || coalesce(category, 'none') as cat_file from qa),
idless as (select cat_file from half group by cat_file having count(image_id) = 0),
cand as (select h.cat_file, h.source_input || '/' || h.row_idx as row_key from half h join idless using (cat_file)),
ranked as (select *, row_number() over (partition by cat_file order by sha256('123::' || row_key)) as rn,
    greatest(1, cast(round_even(0.1 * count(*) over (partition by cat_file), 0) as bigint)) as k from cand)
select cat_file as source_input, row_key from ranked where rn <= k""",
    ["qa"],
)
def sample_rows_fallback(spark, sf_dir):
    """Files by category; the file of one category has no image ids."""
    rows = adapters.qa(spark, sf_dir).select(
        F.concat(F.lit("cat_"), F.coalesce("category", F.lit("none"))).alias("source_input"),
        F.concat("source_input", F.lit("/"), F.col("row_idx").cast("string")).alias("row_idx"),
        F.when(F.col("category") == "CAT0", None).otherwise(F.col("image_id")).alias("image_id"),
    )
    return sampling.sample_rows_fallback(rows, 0.1).select("source_input", F.col("row_idx").alias("row_key"))


@register(
    "join_file_inventory",
    "select source_input, row_idx, rgb_exists, thermal_exists, skip_reason from checked",
    ["checked"],
)
def join_file_inventory(spark, sf_dir):
    return checked(spark, sf_dir).select("source_input", "row_idx", "rgb_exists", "thermal_exists", "skip_reason")


_ACC = "round(case when {t} > 0 then {c} / {t} else 0.0 end, 6)"


def _level(name: str, key: str, source: str = "scored") -> str:
    keyed = f"coalesce({key}, 'UNKNOWN')"
    return f"""select '{name}' as level, {keyed} as key, count(*) as total, count(*) filter (correct) as correct,
  {_ACC.format(c='count(*) filter (correct)', t='count(*)')} as accuracy from {source} group by {keyed}"""


@register(
    "accuracy_overall",
    f"""select count(*) as total, count(*) filter (correct) as correct,
  {_ACC.format(c='count(*) filter (correct)', t='count(*)')} as accuracy from scored""",
    ["scored"],
)
def accuracy_overall(spark, sf_dir):
    return _rounded(scoring.accuracy_overall(scored(spark, sf_dir)))


def _register_level(name: str, key: str) -> None:
    sql = f"select key as {key}, total, correct, accuracy from ({_level(name, key)})"

    @register(f"accuracy_by_{name}", sql, ["scored"])
    def run(spark, sf_dir):
        return _rounded(scoring.accuracy_by(scored(spark, sf_dir), key))


for _name, _key in scoring.LEVELS:
    _register_level(_name, _key)


@register(
    "accuracy_all_levels",
    f"""select 'overall' as level, cast(null as varchar) as key, count(*) as total, count(*) filter (correct) as correct,
  {_ACC.format(c='count(*) filter (correct)', t='count(*)')} as accuracy from scored
union all {_level('category', 'category')} union all {_level('question', 'question_id')}
union all {_level('image', 'image_id')}""",
    ["scored"],
)
def accuracy_all_levels(spark, sf_dir):
    return _rounded(scoring.accuracy_all_levels(scored(spark, sf_dir)))


@register(
    "run_counters",
    """select (select count(*) from checked) as queued, (select count(*) from checked) as total_sampled_questions,
  (select count(*) from checked where skip_reason = 'missing_fields') as skipped_missing_fields,
  (select count(*) from checked where skip_reason = 'missing_files') as skipped_missing_files,
  (select count(distinct source_input) from checked) as json_files_discovered,
  count(*) as evaluated, count(*) filter (s.error is not null) as exceptions
from scored s join checked c using (source_input, row_idx) where c.skip_reason is null""",
    ["scored", "checked"],
)
def run_counters(spark, sf_dir):
    queue = validate.join_file_inventory(
        adapters.preds_raw(spark, sf_dir), adapters.files(spark, sf_dir), "rgb_thermal"
    )
    done = scoring.score_predictions(validate.eligible(queue))
    return scoring.run_counters(queue, done)


@register(
    "dry_run_summary",
    """select count(distinct source_input) as json_files_discovered, count(*) as total_sampled_questions,
  count(*) filter (skip_reason is null) as eligible_for_eval,
  count(*) filter (skip_reason = 'missing_fields') as skipped_missing_fields,
  count(*) filter (skip_reason = 'missing_files') as skipped_missing_files from checked""",
    ["checked"],
)
def dry_run_summary(spark, sf_dir):
    return validate.eligibility_summary(checked(spark, sf_dir))


@register(
    "sample_issue_examples",
    """select * from (select 'missing_files' as kind, source_input, row_idx, rgb_path as detail from checked
  where skip_reason = 'missing_files' order by source_input, row_idx limit 5)
union all
select * from (select 'exception' as kind, source_input, row_idx, error as detail from scored
  where error is not null order by source_input, row_idx limit 3)""",
    ["checked", "scored"],
)
def sample_issue_examples(spark, sf_dir):
    missing = validate.first_missing_paths(checked(spark, sf_dir)).select(
        F.lit("missing_files").alias("kind"), "source_input", "row_idx", F.col("rgb_path").alias("detail")
    )
    failed = validate.first_exceptions(scored(spark, sf_dir)).select(
        F.lit("exception").alias("kind"), "source_input", "row_idx", F.col("error").alias("detail")
    )
    return missing.unionByName(failed)


@register(
    "dataset_stats",
    """select count(*) as total_rows, count(distinct source_input) as source_files,
  count(distinct (image_id, rgb_path, thermal_path)) as unique_images from qa""",
    ["qa"],
)
def dataset_stats(spark, sf_dir):
    return scoring.dataset_stats(adapters.qa(spark, sf_dir))


RUNS = ("rgb", "thermal", "rgb_thermal")


def run_metrics(spark, sf_dir):
    done = scoring.score_predictions(adapters.run_preds(spark, sf_dir))
    return scoring.accuracy_all_levels(done, by=["run_name"])


_RUN_LEVELS = "\nunion all\n".join(
    f"""select run_name, '{name}' as level, {key} as key, count(*) filter (correct) / count(*) as accuracy
from run_scored group by run_name, {key}"""
    for name, key in [
        ("overall", "''"),
        ("category", "coalesce(category, 'UNKNOWN')"),
        ("question", "coalesce(question_id, 'UNKNOWN')"),
        ("image", "coalesce(image_id, 'UNKNOWN')"),
    ]
)


@register(
    "compare_runs",
    f"""with m as ({_RUN_LEVELS}),
wide as (select level, key, max(accuracy) filter (run_name = 'rgb') as rgb,
  max(accuracy) filter (run_name = 'thermal') as thermal,
  max(accuracy) filter (run_name = 'rgb_thermal') as rgb_thermal from m group by level, key)
select level, key, round(rgb, 6) as rgb, round(thermal, 6) as thermal, round(rgb_thermal, 6) as rgb_thermal,
  round(thermal - rgb, 6) as thermal_delta, round(rgb_thermal - rgb, 6) as rgb_thermal_delta from wide""",
    ["run_scored"],
)
def compare_runs(spark, sf_dir):
    wide = scoring.compare_runs(run_metrics(spark, sf_dir), RUNS, "rgb")
    return wide.select(
        "level", "key", *[F.round(c, 6).alias(c) for c in wide.columns if c not in ("level", "key")]
    )
