"""The adapter views in plain SQL, for the independent check of each query."""

from __future__ import annotations

OPTIONS = "['Returned', 'Not returned', 'Accepted']"
GT = "case l_returnflag when 'R' then 'Returned' when 'N' then 'Not returned' when 'A' then 'Accepted' end"
STEM = "'/data/loc_' || {key} % 20 || '/{kind}/' || lpad(cast({key} as varchar), 8, '0') || '.jpg'"
RGB = STEM.format(key="l_orderkey", kind="rgb")
THR = STEM.format(key="l_orderkey", kind="thr")

QA_COLUMNS = f"""
  'file_' || (l_orderkey // 1000) || '.json' as source_input,
  ((l_orderkey % 1000) * 10 + l_linenumber) * 100000000000000 + (l_partkey % 1000000) * 100000000 + (l_suppkey % 1000000) * 100 + cast(l_quantity as bigint) as row_idx,
  case when l_orderkey % 97 = 0 then null else cast(l_orderkey as varchar) end as image_id,
  'Q' || l_linenumber as question_id,
  case when l_partkey % 101 = 0 then null else 'CAT' || (l_partkey % 8) end as category,
  case when l_quantity = 13 then '' else 'What is the state of line ' || l_linenumber || '?' end as question,
  {OPTIONS} as options,
  {GT} as gt_answer,
  {OPTIONS}[(l_partkey % 3) + 1] as model_answer,
  {RGB} as rgb_path,
  case when l_quantity = 7 then null else {THR} end as thermal_path,
  round(l_discount * 100, 2) as t_min, l_quantity as t_max, round(l_tax * 100, 2) as t_mean,
  case when l_linenumber = 7 then null else l_quantity end as t_top"""

# White space trimmed from answers (ASCII part).
WS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || ' '"


def norm(x: str) -> str:
    return f"lower(trim(coalesce({x}, ''), {WS}))"


def review_norm(x: str) -> str:
    edge = "' ' || chr(9) || chr(13) || chr(10) || '.;:!?,\"''()[]{}'"
    return f"trim(regexp_replace({norm(x)}, '\\s+', ' ', 'g'), {edge})"


KIND = "((l_partkey + l_suppkey) % 6)"
REVIEW_IMAGE = "'u' || user_id || '_f' || lpad(cast(k // 4 as varchar), 2, '0')"
EVENT_KEYS = "user_id, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k"
REVIEW_COLUMNS = f"""
  'review_' || (user_id // 50) || '.json' as source_json,
  user_id * 100 + k as row_idx,
  case when k // 4 = 24 then '' else {REVIEW_IMAGE} end as image_id,
  '/data/u/' || user_id || '/' || lpad(cast(k // 4 as varchar), 2, '0') || '.jpg' as rgb_path,
  '/data/t/' || user_id || '/' || lpad(cast(k // 4 as varchar), 2, '0') || '.jpg' as thermal_path,
  case when k % 20 = 19 then '' else 'CAT' || ((user_id + k) % 6) end as category,
  case when k % 25 = 24 then '' else 'Q' || (k % 4) end as question_id,
  'What is the delivery state shown for the item with the number ' || k || ' in the frame of user '
    || user_id || ', judged from both images?' as question,
  {OPTIONS} as options,
  {OPTIONS}[(user_id % 3) + 1] as model_answer"""
IMAGE_KEY = """case when image_id = '' then '' else 'image_id:' || image_id || '|' end
  || 'rgb:' || rgb_path || '|thr:' || thermal_path"""
QA_KEY = """source_json || '|row:' || row_idx || '|' || image_key || '|qid:'
  || case when question_id = '' then left(question, 80) else question_id end"""


def keyed(source: str) -> str:
    return f"""select *, {QA_KEY} as qa_key from (
    select *, {IMAGE_KEY} as image_key from ({source}))"""


VIEWS = {
    "qa": ((), f"select {QA_COLUMNS} from lineitem"),
    "preds_raw": (
        (),
        f"""select {QA_COLUMNS},
  case {KIND} when 0 then '  ' || upper({GT}) || ' ' when 1 then 'The state is ' || lower({GT}) || '.'
    when 2 then 'Returned' when 3 then 'unknown' when 4 then 'accepted or not returned' end as raw_output,
  case {KIND} when 5 then 'RuntimeError' end as error
from lineitem""",
    ),
    "run_preds": (
        ("preds_raw",),
        """select *, case when raw_output is null then 'RuntimeError' end as error
from (
  select * exclude (raw_output, error), 'rgb' as run_name, raw_output from preds_raw
  union all by name
  select * exclude (raw_output, error), 'thermal' as run_name, model_answer as raw_output from preds_raw
  union all by name
  select * exclude (raw_output, error), 'rgb_thermal' as run_name,
    case when category = 'CAT3' then 'unknown' else upper(gt_answer) end as raw_output from preds_raw)""",
    ),
    # parsed and scored predictions of any view shaped like preds_raw
    "scored": (("preds_raw",), "{score:preds_raw}"),
    "run_scored": (("run_preds",), "{score:run_preds}"),
    "files": (
        (),
        f"""select {STEM.format(key='o_orderkey', kind='rgb')} as path, cast(o_totalprice as bigint) as length
from orders where o_orderstatus <> 'P'
union all
select {STEM.format(key='o_orderkey', kind='thr')}, cast(o_totalprice as bigint)
from orders where o_orderpriority <> '5-LOW'""",
    ),
    "checked": (
        ("qa", "files"),
        """select qa.*, r.path is not null as rgb_exists, t.path is not null as thermal_exists,
  case when coalesce(question, '') = '' or len(options) = 0 or coalesce(gt_answer, '') = ''
      or coalesce(rgb_path, '') = '' or coalesce(thermal_path, '') = '' then 'missing_fields'
    when r.path is null or t.path is null then 'missing_files' end as skip_reason
from qa left join files r on r.path = qa.rgb_path left join files t on t.path = qa.thermal_path""",
    ),
    "review_items": (
        (),
        keyed(f"select {REVIEW_COLUMNS} from (select distinct {EVENT_KEYS} from events)"),
    ),
    "group_map": (
        (),
        f"""select distinct '/data/u/' || user_id || '/' || lpad(cast(unnest([k // 4, k // 4 - (k // 4) % 5]) as varchar), 2, '0')
    || '.jpg' as path,
  '/data/u/' || user_id || '/' || lpad(cast(k // 4 - (k // 4) % 5 as varchar), 2, '0') || '.jpg' as keyframe
from (select {EVENT_KEYS} from events)""",
    ),
    "actions": (
        (),
        f"""select * exclude (event_type, pick, picked, ok),
  case when ok then 'action' else 'header' end as type,
  case when ok and event_type = 'view' then 'correct'
    when ok and {review_norm('picked')} = {review_norm('model_answer')} then 'correct'
    when ok then 'corrected' end as label,
  case when ok and event_type <> 'view' and {review_norm('picked')} <> {review_norm('model_answer')}
    then pick end as option_index,
  case when not ok then null when event_type = 'view' or {review_norm('picked')} = {review_norm('model_answer')}
    then model_answer else picked end as human_answer,
  false as auto_propagated
from (
  select *, options[pick + 1] as picked, event_type = 'view' or coalesce(pick < len(options), false) as ok
  from ({keyed(f'''select seq, timestamp, event_type, pick, {REVIEW_COLUMNS} from (
    select event_id as seq, strftime(ts, '%Y-%m-%d %H:%M:%S') as timestamp, event_type,
      cast(case event_type when 'click' then event_id % 4 when 'error' then 0 end as int) as pick, {EVENT_KEYS} from events)''')}))""",
    ),
    "prior": (
        (),
        f"""select *, 'corrected' as label, 2 as option_index, options[3] as human_answer from (
{keyed(f"select {REVIEW_COLUMNS} from (select distinct {EVENT_KEYS} from events where event_type = 'purchase')")})""",
    ),
    "latest": (
        ("actions",),
        """select * from actions where type = 'action'
qualify row_number() over (partition by qa_key order by seq desc) = 1""",
    ),
    "image_order": (
        ("review_items",),
        """select *, row_number() over (order by first_source, first_row) as image_ord from (
  select image_key, source_json as first_source, row_idx as first_row from review_items
  qualify row_number() over (partition by image_key order by source_json, row_idx) = 1)""",
    ),
    "slots": (
        ("review_items", "image_order"),
        """select i.*, o.image_ord, row_number() over (partition by i.image_key
    order by category, question_id, row_idx, source_json) - 1 as slot
from review_items i join image_order o using (image_key)""",
    ),
    "frames": (
        (),
        """select 'loc_' || label as folder, lpad(cast(vec_id as varchar), 12, '0') as path, vec_id,
  embedding[1:32]::double[] as rgb_vec, embedding[33:64]::double[] as thr_vec from embeddings""",
    ),
    "frame_ids": (
        (),
        """select doc_id, case doc_id % 5 when 0 then cast(doc_id as varchar) when 1 then lpad(cast(doc_id as varchar), 8, '0')
    when 2 then source || '_frame_' || (doc_id % 100) when 3 then lang
    else case when doc_id % 3 = 0 then repeat('7', (36 + doc_id % 9)::int) || doc_id else '' end end as image_id,
  n_chars % 50 = 0 as is_header from documents""",
    ),
    "image_sizes": (
        (),
        "select p_partkey as image, cast(p_size * 40 + 1 as bigint) as width, p_partkey % 900 + 1 as height from part",
    ),
    "run_requests": (
        (),
        """select c_custkey as request_id,
  [' LLaVA', 'qwen3-vl', 'Llama3.2 ', 'internvl', 'minicpm-v', 'PIXTRAL', 'gpt-none'][(c_custkey % 7) + 1] as model,
  ['rgb_thermal', 'rgb', 'thermal'][(c_nationkey % 3) + 1] as input_mode,
  c_acctbal > 3000 as repeat_prompt, c_acctbal < 6000 as no_temp_summary,
  cast(c_nationkey % 8 as double) / 8 + 0.005 as percent, c_custkey as seed, c_mktsegment from customer""",
    ),
    "messages": ((), "select conv_id, turn, role, text from conversations"),
    "path_docs": (
        (),
        """select page_id, url, regexp_replace(url, '^https?://', '/web/') as rooted,
  '/web/' || regexp_extract(url, '^https?://([^/]+)', 1) as home from pages""",
    ),
}


def _score(source: str) -> str:
    """Longest contained option after an exact match, written as plain cases."""
    n = norm("raw_output")
    pred = f"""case when error is not null then null
    when {n} = {norm('options[1]')} then options[1] when {n} = {norm('options[2]')} then options[2]
    when {n} = {norm('options[3]')} then options[3]
    else (select o from (select unnest(options) as o, unnest([1, 2, 3]) as i)
          where contains({n}, {norm('o')}) order by length(o) desc, i limit 1) end"""
    return f"""select *, coalesce({norm('pred_answer')} = {norm('gt_answer')} and pred_answer is not null, false) as correct,
  case when error is null then coalesce(raw_output, '') end as raw_model_output
from (select *, {pred} as pred_answer from {source})"""


def with_views(names, body: str) -> str:
    """Prefix a query with the views it needs, dependencies first."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in VIEWS[name][0]:
            visit(dep)
        ordered.append(name)

    for name in names:
        visit(name)
    parts = []
    for name in ordered:
        sql = VIEWS[name][1]
        if sql.startswith("{score:"):
            sql = _score(sql[len("{score:"):-1])
        parts.append(f"{name} as (\n{sql})")
    body = body.strip()
    if not parts:
        return body
    if body.startswith("with recursive"):
        return "with recursive " + ",\n".join(parts) + "," + body[len("with recursive"):]
    if body.startswith("with "):
        return "with " + ",\n".join(parts) + "," + body[len("with"):]
    return "with " + ",\n".join(parts) + "\n" + body
