"""Queries: prompts, image planning, run names, sweeps and inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import frames as geometry
from ..functions import prompts, text
from ..operators import infer, ledger, scoring, sweep
from ..session import scratch_path
from . import adapters
from .evaluate import evaluate_run as run_evaluation
from .evaluate import sweep_evaluate as run_sweep
from .evaluation_queries import checked
from .oracle import norm
from .registry import register

# The oracle states the texts on its own; a changed wording must fail the check.
_CONTEXT = """trim(case {mode} when 'rgb' then 'You are provided with an RGB visual image of a scene.' || chr(10)
  when 'thermal' then 'You are provided with a radiometric thermal image rendered with an inferno colormap.' || chr(10)
  else 'You are provided with two separate images of the same scene:' || chr(10)
    || '1. The first image is a standard RGB visual aerial image.' || chr(10)
    || '2. The second image is a radiometric thermal image rendered with an inferno colormap.' || chr(10)
    || 'Use BOTH images together to understand the scene.' || chr(10) end
  || chr(10) || case when {shown} then 'Temperature Summary for the Thermal Image (in Celsius):' || chr(10)
    || '- Minimum Temp: ' || coalesce(cast(t_min as varchar), 'N/A') || chr(10)
    || '- Maximum Temp: ' || coalesce(cast(t_max as varchar), 'N/A') || chr(10)
    || '- Mean Temp: ' || coalesce(cast(t_mean as varchar), 'N/A') || chr(10)
    || '- Top 3% Mean: ' || coalesce(cast(t_top as varchar), 'N/A') || chr(10)
    || 'Use these anchor points to map the observed thermal colors to approximate real temperatures.' || chr(10)
  else '' end, ' ' || chr(10))"""
_TASK = """('Question: ' || question || chr(10) || chr(10) || 'Options:' || chr(10)
  || '- ' || options[1] || chr(10) || '- ' || options[2] || chr(10) || '- ' || options[3] || chr(10) || chr(10)
  || {note} || 'Answer with exactly ONE option text (copy it verbatim).')"""
_NOTE = """case when {no_temp} and {mode} <> 'rgb' then
  'No numeric temperature summary is provided in this run; rely on visible thermal patterns only.' || chr(10) || chr(10)
  else '' end"""


def _context(mode: str, has_temp: str) -> str:
    return _CONTEXT.format(mode=mode, shown=f"{has_temp} and {mode} <> 'rgb'")


def _task(note: str = "''") -> str:
    return _TASK.format(note=note)


def _again(mode: str, has_temp: str) -> str:
    return _task(_NOTE.format(mode=mode, no_temp=f"not ({has_temp})"))


def _prompt(mode: str, has_temp: str, repeat: str) -> str:
    return (
        f"{_context(mode, has_temp)} || chr(10) || chr(10) || {_task()}"
        f" || case when {repeat} then chr(10) || chr(10) || {_again(mode, has_temp)} else '' end"
    )


# Every row is prompted under a mode, family and flags taken from its category.
MODE_SQL = "case category when 'CAT1' then 'rgb' when 'CAT2' then 'thermal' else 'rgb_thermal' end"
FAMILY_SQL = "case category when 'CAT2' then 'pixtral' when 'CAT3' then 'minicpm' when 'CAT4' then 'llama' else 'qwen' end"
REPEAT_SQL = "question_id in ('Q1', 'Q2', 'Q3')"
TEMP_SQL = "question_id not in ('Q3', 'Q4')"


def _varied(spark, sf_dir):
    return (
        adapters.qa(spark, sf_dir)
        .withColumn("mode", F.expr(MODE_SQL))
        .withColumn("family", F.expr(FAMILY_SQL))
        .withColumn("repeat", F.expr(REPEAT_SQL))
        .withColumn("temp_summary", F.when(F.expr(TEMP_SQL), F.col("temp_summary")))
    )


def _prompted(spark, sf_dir):
    return prompts.with_prompt_parts(
        _varied(spark, sf_dir), F.col("mode"), F.col("repeat"), F.col("temp_summary")
    ).withColumn("refs", prompts.image_refs(F.col("family"), F.col("mode"), F.col("rgb_path"), F.col("thermal_path")))


_IDS = ("source_input", "row_idx")


@register(
    "build_system_context",
    f"select source_input, row_idx, md5({_context(MODE_SQL, TEMP_SQL)}) as context_md5, length({_context(MODE_SQL, TEMP_SQL)}) as n from qa",
    ["qa"],
)
def build_system_context(spark, sf_dir):
    return _prompted(spark, sf_dir).select(
        *_IDS, F.md5("context").alias("context_md5"), F.length("context").cast("bigint").alias("n")
    )


@register(
    "build_task_instruction",
    f"""select source_input, row_idx, md5({_task()}) as task_md5, md5({_again(MODE_SQL, TEMP_SQL)}) as again_md5 from qa""",
    ["qa"],
)
def build_task_instruction(spark, sf_dir):
    return _prompted(spark, sf_dir).select(*_IDS, F.md5("task").alias("task_md5"), F.md5("task_again").alias("again_md5"))


@register(
    "build_text_prompt",
    f"select source_input, row_idx, md5({_prompt(MODE_SQL, TEMP_SQL, REPEAT_SQL)}) as prompt_md5 from qa",
    ["qa"],
)
def build_text_prompt(spark, sf_dir):
    return _prompted(spark, sf_dir).select(*_IDS, F.md5("prompt").alias("prompt_md5"))


_REFS = f"""case {MODE_SQL} when 'rgb' then rgb_path when 'thermal' then coalesce(thermal_path, '')
  else rgb_path || case when {FAMILY_SQL} = 'llama' then coalesce('|' || thermal_path, '') else chr(9) || coalesce(thermal_path, '') end end"""


@register(
    "build_content_blocks",
    f"""select source_input, row_idx, 3::bigint + (case when {MODE_SQL} = 'rgb_thermal' and {FAMILY_SQL} <> 'llama' then 1 else 0 end)
    + (case when {REPEAT_SQL} then 1 else 0 end) as n_blocks,
  md5({_context(MODE_SQL, TEMP_SQL)} || chr(9) || {_task()} || chr(9) || {_REFS}
    || case when {REPEAT_SQL} then chr(9) || {_again(MODE_SQL, TEMP_SQL)} else '' end) as blocks_md5 from qa""",
    ["qa"],
)
def build_content_blocks(spark, sf_dir):
    blocks = prompts.build_content_blocks(
        F.col("context"), F.col("task"), F.col("refs"), F.col("task_again"), F.col("repeat")
    )
    flat = F.array_join(
        F.transform("blocks", lambda b: F.coalesce(b["text"], b["image_ref"], F.lit(""))), "\t"
    )
    return (
        _prompted(spark, sf_dir)
        .withColumn("blocks", blocks)
        .select(*_IDS, F.size("blocks").cast("bigint").alias("n_blocks"), F.md5(flat).alias("blocks_md5"))
    )


_N_IMAGES = f"(case when {MODE_SQL} = 'rgb_thermal' and {FAMILY_SQL} <> 'llama' then 2 else 1 end)"
# Questions that already carry a token keep it.
_TEXT = "(case when question_id = 'Q5' then 'see [IMG] ' else '' end || question)"


@register(
    "inject_image_placeholders",
    f"""with t as (select source_input, row_idx, {FAMILY_SQL} as family, {_N_IMAGES} as n, {_TEXT} as p from qa),
u as (select *, case family when 'pixtral' then '[IMG]' when 'minicpm' then '<image>./</image>' else '<image>' end as token,
  case family when 'minicpm' then contains(p, '<image>./</image>') else contains(p, '[IMG]') end as present from t)
select source_input, row_idx, case when present then p else
  token || case when n = 2 then chr(10) || token else '' end || case when p <> '' then chr(10) || p else '' end end as prompt
from u""",
    ["qa"],
)
def inject_image_placeholders(spark, sf_dir):
    rows = _varied(spark, sf_dir).withColumn("p", F.expr("concat(case when question_id = 'Q5' then 'see [IMG] ' else '' end, question)"))
    injected = prompts.inject_image_placeholders(
        F.col("p"), F.col("family"), prompts.image_count(F.col("family"), F.col("mode"))
    )
    return rows.select(*_IDS, injected.alias("prompt"))


@register(
    "plan_resize",
    """select image, max_side, case when greatest(width, height) <= max_side then width
    else greatest(1, cast(round_even(width * (max_side / greatest(width, height)), 0) as bigint)) end as new_w,
  case when greatest(width, height) <= max_side then height
    else greatest(1, cast(round_even(height * (max_side / greatest(width, height)), 0) as bigint)) end as new_h
from (select *, unnest([768, 100, 1]) as max_side from image_sizes)""",
    ["image_sizes"],
)
def plan_resize(spark, sf_dir):
    sizes = adapters.image_sizes(spark, sf_dir).withColumn("max_side", F.explode(F.array(F.lit(768), F.lit(100), F.lit(1))))
    return sizes.withColumn("plan", geometry.plan_resize(F.col("width"), F.col("height"), F.col("max_side"))).select(
        "image", "max_side", F.col("plan.w").alias("new_w"), F.col("plan.h").alias("new_h")
    )


@register(
    "plan_side_by_side",
    """select image, width + h2 as canvas_w, greatest(height, width) as canvas_h,
  (greatest(height, width) - height) // 2 as left_y, width as right_x, (greatest(height, width) - width) // 2 as right_y
from (select *, height as h2 from image_sizes)""",
    ["image_sizes"],
)
def plan_side_by_side(spark, sf_dir):
    """Each image next to its transposed self."""
    w, h = F.col("width"), F.col("height")
    return (
        adapters.image_sizes(spark, sf_dir)
        .withColumn("plan", geometry.plan_side_by_side(w, h, h, w))
        .select("image", "plan.*")
    )


_RESOLVE = """lower(trim(model, ' ' || chr(9) || chr(10)))"""
_FAMILY = f"""case {_RESOLVE} when 'llava' then 'llava' when 'qwen3-vl' then 'qwen' when 'llama3.2' then 'llama'
  when 'internvl' then 'internvl' when 'minicpm-v' then 'minicpm' when 'pixtral' then 'pixtral' end"""
_MODEL_ID = f"""case {_FAMILY} when 'llava' then 'llava-hf/llava-v1.6-mistral-7b-hf' when 'qwen' then 'Qwen/Qwen3-VL-8B-Instruct'
  when 'llama' then 'meta-llama/Llama-3.2-11B-Vision-Instruct' when 'internvl' then 'OpenGVLab/InternVL2-8B'
  when 'minicpm' then 'openbmb/MiniCPM-V-2_6' when 'pixtral' then 'mistralai/Pixtral-12B-2409' end"""


@register(
    "resolve_model_alias",
    f"select request_id, model, {_FAMILY} as family, {_MODEL_ID} as model_id, {_FAMILY} is null as rejected from run_requests",
    ["run_requests"],
)
def resolve_model_alias(spark, sf_dir):
    return sweep.resolve_model_alias(adapters.run_requests(spark, sf_dir)).select(
        "request_id", "model", "family", "model_id", F.col("family").isNull().alias("rejected")
    )


_BACKEND = "case family when 'llama' then 'transformers' else 'vllm' end"
_RUN_NAME = f"""'eval_' || family || '_' || replace(model_id, '/', '_') || '_backend-' || {_BACKEND} || '_mode-' || input_mode
  || '_maxside-768_maxtok-32_repeatprompt-' || cast(repeat_prompt as int) || '_notempsummary-' || cast(no_temp_summary as int)"""
_RUN_TAIL = "'_p' || cast(round_even(percent * 100, 0) as bigint) || '_seed' || seed"


@register(
    "run_name",
    f"""with known as (select *, {_FAMILY} as family, {_MODEL_ID} as model_id from run_requests where {_FAMILY} is not null)
select request_id, {_RUN_NAME} || {_RUN_TAIL} as run_name,
  {_RUN_NAME} || '_iclshots-2_iclseed-123_iclrequirefull-1' || {_RUN_TAIL} as fewshot_name from known""",
    ["run_requests"],
)
def run_name(spark, sf_dir):
    known = sweep.resolve_model_alias(adapters.run_requests(spark, sf_dir)).where(F.col("family").isNotNull())
    named = sweep.name_runs(known).withColumnRenamed("run_name", "zero_shot_name").drop("backend", "requested_backend")
    shots = named.withColumns(
        {"icl_shots": F.lit(2), "icl_seed": F.lit(123), "icl_require_full_shots": F.lit(True)}
    )
    return sweep.name_runs(shots, fewshot=True).select(
        "request_id", F.col("zero_shot_name").alias("run_name"), F.col("run_name").alias("fewshot_name")
    )


@register(
    "run_config",
    f"""with known as (select *, {_FAMILY} as family, {_MODEL_ID} as model_id from run_requests where {_FAMILY} is not null)
select request_id, family as model_family, model_id, {_BACKEND} as backend, repeat_prompt,
  family = 'llama' and input_mode = 'rgb_thermal' as concat_images, seed, round(percent, 6) as percent from known""",
    ["run_requests"],
)
def run_config(spark, sf_dir):
    """Settings documents, read back field by field."""
    known = sweep.resolve_model_alias(adapters.run_requests(spark, sf_dir)).where(F.col("family").isNotNull())
    docs = sweep.run_config_json(sweep.name_runs(known))
    schema = (
        "model_family string, model_id string, backend string, repeat_prompt boolean, "
        "llama_rgb_thermal_concat boolean, seed bigint, percent double"
    )
    parsed = docs.withColumn("c", F.from_json("run_config", schema))
    return parsed.select(
        "request_id", "c.model_family", "c.model_id", "c.backend", "c.repeat_prompt",
        F.col("c.llama_rgb_thermal_concat").alias("concat_images"), "c.seed", F.round("c.percent", 6).alias("percent"),
    )


@register(
    "ablation_grid",
    f"""with known as (select {_FAMILY} as family, {_MODEL_ID} as model_id, min(request_id) as first_request
  from run_requests where {_FAMILY} is not null group by all),
axes as (select known.*, m.mode as input_mode, m.i as mi, r.rep as repeat_prompt, t.nt as no_temp_summary
  from known, (values (0, 'rgb_thermal'), (1, 'rgb'), (2, 'thermal')) m(i, mode), (values (false), (true)) r(rep),
    (values (false), (true)) t(nt))
select row_number() over (order by first_request, mi, repeat_prompt, no_temp_summary) as run_number,
  count(*) over () as total_runs, family, model_id, input_mode, repeat_prompt, no_temp_summary from axes""",
    ["run_requests"],
)
def ablation_grid(spark, sf_dir):
    models = sweep.requested_models(adapters.run_requests(spark, sf_dir), "request_id")
    grid = sweep.ablation_grid(models, "first_request")
    return grid.withColumn("run_number", F.col("run_number").cast("bigint")).withColumn(
        "total_runs", F.col("total_runs").cast("bigint")
    )


_SWEEP_MODELS = ("qwen", "pixtral")


_SWEEP = f"""with rows as (select qa.*, r.path is not null as rgb_ok, t.path is not null as thr_ok from qa
  left join files r on r.path = qa.rgb_path left join files t on t.path = qa.thermal_path
  where question <> '' and gt_answer <> ''),
expanded as (select rows.*, f.family, f.model_id, m.mode, b.rep, n.nt from rows,
  (values ('qwen', 'Qwen_Qwen3-VL-8B-Instruct'), ('pixtral', 'mistralai_Pixtral-12B-2409')) f(family, model_id),
  (values ('rgb_thermal'), ('rgb'), ('thermal')) m(mode), (values (false), (true)) b(rep), (values (false), (true)) n(nt)
  where (m.mode = 'thermal' or rgb_ok) and (m.mode = 'rgb' or thr_ok)),
prompted as (select *, {_prompt('mode', '(not nt)', 'rep')} as p from expanded),
named as (select *, 'eval_' || family || '_' || model_id || '_backend-vllm_mode-' || mode || '_maxside-768_maxtok-32_repeatprompt-'
    || cast(rep as int) || '_notempsummary-' || cast(nt as int) || '_p100_seed123' as run_name,
  case family when 'pixtral' then case mode when 'rgb_thermal' then '[IMG]' || chr(10) || '[IMG]' else '[IMG]' end || chr(10) || p
    else p end as q from prompted)"""


@register(
    "sweep_requests",
    f"""{_SWEEP}
select run_name, count(*) as requests, cast(sum(length(q)) as bigint) as prompt_chars,
  cast(sum(('0x' || substr(md5(q), 1, 8))::bigint) as bigint) as checksum from named group by run_name""",
    ["qa", "files"],
)
def sweep_requests(spark, sf_dir):
    """All prompts of a 24-run sweep, summed up per run."""
    requests = sweep.sweep_requests(checked(spark, sf_dir), sweep.literal_grid(_SWEEP_MODELS))
    return requests.groupBy("run_name").agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum(F.length("prompt")).alias("prompt_chars"),
        F.sum(F.conv(F.left(F.md5("prompt"), F.lit(8)), 16, 10).cast("bigint")).alias("checksum"),
    )


BROKEN = "What is the state of line 4?"
_ECHO = "'I think it is ' || upper(options[(length({p}) % 3) + 1]) || '.'"


@register(
    "batch_inference",
    f"""with p as (select *, {_prompt("'rgb'", "true", "false")} as p from qa where coalesce(question, '') <> '')
select source_input, row_idx, case when question = '{BROKEN}' then null else {_ECHO.format(p='p')} end as raw_output,
  case when question = '{BROKEN}' then 'RuntimeError(''cannot answer'')' end as error from p""",
    ["qa"],
)
def batch_inference(spark, sf_dir):
    """A runner that fails on one question: those rows become error rows."""
    rows = adapters.qa(spark, sf_dir).where(~text.is_blank(F.col("question")))
    staged = prompts.with_prompt_parts(rows, F.lit("rgb"), F.lit(False), F.col("temp_summary"))
    answered = infer.batch_inference(
        staged.select(*_IDS, "question", "options", "prompt"), lambda: infer.EchoRunner(BROKEN)
    )
    return answered.select(*_IDS, "raw_output", "error")


class ShortBatchRunner(infer.EchoRunner):
    """Returns one output too few per batch, so every row is asked again alone."""

    def run_batch(self, requests):
        return super().run_batch(requests)[1:]


@register(
    "runner_protocol",
    f"""with p as (select *, {_prompt("'thermal'", "true", "true")} as p from qa where coalesce(question, '') <> '')
select source_input, row_idx, {_ECHO.format(p='p')} as raw_output, cast(null as varchar) as error from p""",
    ["qa"],
)
def runner_protocol(spark, sf_dir):
    """A runner that breaks the batch contract still gets one answer per row."""
    rows = adapters.qa(spark, sf_dir).where(~text.is_blank(F.col("question")))
    staged = prompts.with_prompt_parts(rows, F.lit("thermal"), F.lit(True), F.col("temp_summary"))
    return infer.batch_inference(staged.select(*_IDS, "question", "options", "prompt"), ShortBatchRunner).select(
        *_IDS, "raw_output", "error"
    )


def _load(refs):
    """Stand-in decoder: images of one location cannot be decoded."""
    if any("/loc_7/" in r for r in refs):
        raise OSError("cannot decode")
    return [r.encode() for r in refs]


@register(
    "resume_inference",
    f"""with p as (select *, {_prompt("'rgb'", "true", "false")} as p from qa where coalesce(question, '') <> '')
select source_input, row_idx, {_ECHO.format(p='p')} as raw_output, cast(null as varchar) as error, true as asked_once from p""",
    ["qa"],
)
def resume_inference(spark, sf_dir):
    """A job that ends after two of five groups, and a second one that asks the rest."""
    rows = adapters.qa(spark, sf_dir).where(~text.is_blank(F.col("question")))
    staged = prompts.with_prompt_parts(rows, F.lit("rgb"), F.lit(False), F.col("temp_summary"))
    requests, path = staged.select(*_IDS, "question", "options", "prompt"), scratch_path(spark, "ledger")
    ask = lambda part: infer.batch_inference(part, infer.EchoRunner)
    ledger.resume_inference(requests, path, ask, groups=5, stop_after=2)
    answered = ledger.resume_inference(requests, path, ask, groups=5)
    once = ledger.answers(spark, path).agg((F.max("times_asked") == 1).alias("b")).scalar()
    return answered.select(*_IDS, "raw_output", "error", once.alias("asked_once"))


@register(
    "image_load_errors",
    f"""with p as (select *, {_prompt("'rgb'", "true", "false")} as p from qa where coalesce(question, '') <> '')
select source_input, row_idx, case when rgb_path like '%/loc_7/%' then null else {_ECHO.format(p='p')} end as raw_output,
  case when rgb_path like '%/loc_7/%' then 'OSError(''cannot decode'')' end as error from p""",
    ["qa"],
)
def image_load_errors(spark, sf_dir):
    """Rows with an undecodable image become error rows without a model call."""
    rows = adapters.qa(spark, sf_dir).where(~text.is_blank(F.col("question")))
    staged = prompts.with_prompt_parts(rows, F.lit("rgb"), F.lit(False), F.col("temp_summary")).withColumn(
        "image_refs", F.array("rgb_path")
    )
    asked = staged.select(*_IDS, "question", "options", "prompt", "image_refs")
    answered = infer.batch_inference(asked, infer.EchoRunner, load_images=_load, cluster_by="image_refs")
    return answered.select(*_IDS, "raw_output", "error")


@register(
    "evaluate_run",
    f"""with ids as (select distinct source_input, image_id from qa where image_id is not null),
ranked as (select *, row_number() over (partition by source_input order by sha256('123::' || image_id)) as rn,
    greatest(1, cast(round_even(0.5 * count(*) over (partition by source_input), 0) as bigint)) as k from ids),
picked as (select checked.* from checked join ranked using (source_input, image_id) where rn <= k and skip_reason is null),
answered as (select *, case when question = '{BROKEN}' then null else {_ECHO.format(p=_prompt("'rgb_thermal'", 'true', 'true'))} end as raw from picked),
pred as (select *, case when raw is null then null else (select o from (select unnest(options) as o, unnest([1, 2, 3]) as i)
  where contains({norm('raw')}, {norm('o')}) order by length(o) desc, i limit 1) end as pred_answer from answered)
select source_input, row_idx, pred_answer, coalesce({norm('pred_answer')} = {norm('gt_answer')} and pred_answer is not null, false) as correct,
  raw as raw_model_output, case when raw is null then 'RuntimeError(''cannot answer'')' end as error from pred""",
    ["checked"],
)
def evaluate_run(spark, sf_dir):
    scored = run_evaluation(
        adapters.qa(spark, sf_dir), adapters.files(spark, sf_dir), lambda: infer.EchoRunner(BROKEN),
        percent=0.5, repeat_prompt=True,
    )
    return scored.select(*_IDS, "pred_answer", "correct", "raw_model_output", "error")


_IMAGE_RUN = """case when rgb_path like '%/loc_7/%' or thermal_path like '%/loc_7/%' then 'OSError(''cannot decode'')'
  when question = '{broken}' then 'RuntimeError(''cannot answer'')' end"""


@register(
    "evaluate_run_images",
    f"""with picked as (select * from checked where skip_reason is null),
answered as (select *, {_IMAGE_RUN.format(broken=BROKEN)} as error,
  {_ECHO.format(p=_prompt("'rgb_thermal'", 'true', 'false'))} as echo from picked)
select source_input, row_idx, 'qwen' as model_family, 'rgb_thermal' as input_mode, rgb_path, thermal_path, question,
  case when error is null then echo end as raw_model_output, error from answered""",
    ["checked"],
)
def evaluate_run_images(spark, sf_dir):
    """A run that loads both images of every question; those of one location cannot be decoded."""
    scored = run_evaluation(
        adapters.qa(spark, sf_dir), adapters.files(spark, sf_dir), lambda: infer.EchoRunner(BROKEN), load_images=_load
    )
    return scored.select(
        *_IDS, "model_family", "input_mode", "rgb_path", "thermal_path", "question", "raw_model_output", "error"
    )


# The run that the stand-in runner cannot serve.
_DOWN = ("qwen", "thermal", True)


class OneRunDown(infer.EchoRunner):
    """Fails for every request of two runs of the sweep."""

    def run_one(self, request):
        if (request["family"], request["input_mode"], request["repeat_prompt"]) == _DOWN:
            raise RuntimeError("out of memory")
        return super().run_one(request)


def swept(spark, sf_dir):
    return run_sweep(
        adapters.qa(spark, sf_dir), adapters.files(spark, sf_dir), OneRunDown, sweep.literal_grid(_SWEEP_MODELS),
        keep=("image_id", "question_id", "category", "question"), returned=("image_id", "question_id", "category"),
    )


_SWEPT = f"""{_SWEEP},
swept as (select run_name, family, mode, rep, nt, category, question_id, image_id, family = 'qwen' and mode = 'thermal' and rep as down,
  family <> 'qwen' or mode <> 'thermal' or not rep as up, {norm('options[(length(q) % 3) + 1]')} = {norm('gt_answer')} as hit from named)"""


@register(
    "sweep_evaluate",
    f"""{_SWEPT}
select run_name, coalesce(category, 'UNKNOWN') as category, count(*) as total, count(*) filter (up and hit) as correct,
  count(*) filter (down) as exceptions from swept group by all""",
    ["qa", "files"],
)
def sweep_evaluate(spark, sf_dir):
    """24 runs inferred and scored in one job; two of them fail and give error rows."""
    scored = scoring.fill_unknown_ids(swept(spark, sf_dir))
    return scored.groupBy("run_name", "category").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("correct").alias("correct"),
        F.count_if(F.col("error").isNotNull()).alias("exceptions"),
    )


_AXIS = """select a.run_name, '{axis}' as axis, cast(a.{col} as varchar) as value, r.run_name as baseline_run, a.level, a.key,
  round(a.accuracy, 6) as accuracy, round(b.accuracy, 6) as baseline_accuracy, round(a.accuracy - b.accuracy, 6) as delta
from m a join (select distinct run_name, family, mode, rep, nt from swept) r on a.family = r.family and r.{base} and {same}
left join m b on b.run_name = r.run_name and a.level = b.level and a.key = b.key where not (a.{base})"""
_AXIS_LEVELS = "\nunion all\n".join(
    f"""select run_name, family, mode, rep, nt, '{name}' as level, {key} as key, count(*) filter (up and hit) / count(*) as accuracy
from swept group by all"""
    for name, key in (("overall", "''"), ("category", "coalesce(category, 'UNKNOWN')"), ("question", "coalesce(question_id, 'UNKNOWN')"), ("image", "coalesce(image_id, 'UNKNOWN')"))
)


@register(
    "compare_axes",
    f"""{_SWEPT},
m as ({_AXIS_LEVELS})
{_AXIS.format(axis='input_mode', col='mode', base="mode = 'rgb_thermal'", same='a.rep = r.rep and a.nt = r.nt')}
union all
{_AXIS.format(axis='repeat_prompt', col='rep', base='rep = false', same='a.mode = r.mode and a.nt = r.nt')}
union all
{_AXIS.format(axis='no_temp_summary', col='nt', base='nt = false', same='a.mode = r.mode and a.rep = r.rep')}""",
    ["qa", "files"],
)
def compare_axes(spark, sf_dir):
    """Every run of the sweep next to those that differ in mode, repetition or temperature only."""
    metrics = scoring.accuracy_all_levels(swept(spark, sf_dir), by=["run_name"])
    table = sweep.runs_of(spark, sweep.literal_grid(_SWEEP_MODELS))
    compared = scoring.compare_axes(metrics, table)
    return compared.withColumns({c: F.round(c, 6) for c in ("accuracy", "baseline_accuracy", "delta")})
