"""Queries: review worklists, decisions, propagation and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import choice, text
from ..operators import review, sampling
from ..operators.dedup import remaining_images
from . import adapters
from .oracle import review_norm
from .registry import register


def latest(spark, sf_dir):
    return review.latest_decision(adapters.actions(spark, sf_dir))


def grouped(spark, sf_dir):
    return review.group_by_image(adapters.review_items(spark, sf_dir))


def _round(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@register("image_key", "select qa_key, image_key from review_items", ["review_items"])
def image_key(spark, sf_dir):
    return review.with_keys(adapters.review_items(spark, sf_dir).drop("image_key", "qa_key")).select("qa_key", "image_key")


@register("qa_key", "select source_json, row_idx, qa_key from review_items", ["review_items"])
def qa_key(spark, sf_dir):
    items = adapters.review_items(spark, sf_dir).drop("image_key", "qa_key")
    return review.with_keys(items).select("source_json", "row_idx", "qa_key")


@register(
    "label_decision",
    f"""with picks as (select *, unnest([0, 1, 2, 3]) as pick from review_items)
select qa_key, pick, case when pick >= 3 then null when {review_norm('options[pick + 1]')} = {review_norm('model_answer')}
    then 'correct' else 'corrected' end as label,
  case when pick >= 3 then null when {review_norm('options[pick + 1]')} = {review_norm('model_answer')} then model_answer
    else options[pick + 1] end as human_answer from picks""",
    ["review_items"],
)
def label_decision(spark, sf_dir):
    """Every pick, also one beyond the last option, on every item."""
    c = F.col
    picks = adapters.review_items(spark, sf_dir).withColumn("pick", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    return picks.withColumn("label", choice.pick_label(c("options"), c("pick"), c("model_answer"))).select(
        "qa_key", "pick", "label",
        choice.decided_answer(c("label"), c("options"), c("pick"), c("model_answer")).alias("human_answer"),
    )


@register(
    "sample_pct_normalize",
    """select event_id, case when value <= 1.0 then greatest(0.0, value * 100.0) else least(100.0, value) end as pct from events"""
)
def sample_pct_normalize(spark, sf_dir):
    return adapters.table(spark, sf_dir, "events").select("event_id", text.review_pct(F.col("value")).alias("pct"))


@register(
    "sample_review_images",
    """with n as (select count(*) as n from image_order),
s as (select *, row_number() over (order by sha256('45::' || image_key)) as rn from image_order)
select image_key, image_ord from s, n where rn <= greatest(1, cast(ceil(0.125 * n) as bigint))""",
    ["image_order"],
)
def sample_review_images(spark, sf_dir):
    images = review.image_order(adapters.review_items(spark, sf_dir))
    return sampling.sample_review_images(images, 12.5).select("image_key", "image_ord").orderBy("image_ord")


@register("attach_keyframe", "select qa_key, keyframe from review_items left join group_map on path = rgb_path", ["review_items", "group_map"])
def attach_keyframe(spark, sf_dir):
    return review.attach_keyframe(adapters.review_items(spark, sf_dir), adapters.group_map(spark, sf_dir)).select("qa_key", "keyframe")


PROPAGATED = """
with grouped as (select i.*, m.keyframe from review_items i join group_map m on m.path = i.rgb_path),
explicit as (select * from actions where type = 'action'),
seeds as (select g.keyframe, g.question_id, a.seq, a.label, a.option_index, g.rgb_path as seed_path, g.model_answer as seed_answer
  from grouped g join explicit a using (qa_key)
  qualify row_number() over (partition by g.keyframe, g.question_id order by a.seq) = 1)
select g.qa_key, s.label, case when s.label = 'corrected' then s.option_index end as option_index,
  case when s.label = 'correct' then g.model_answer else coalesce(g.options[s.option_index + 1], '') end as human_answer,
  'Source: ' || s.seed_path || ' (Keyframe: ' || g.keyframe || ')' as propagated_from
from grouped g join seeds s using (keyframe, question_id)
where g.qa_key not in (select qa_key from explicit)"""
_PROPAGATED_COLUMNS = ("qa_key", "label", "option_index", "human_answer", "propagated_from")


def _propagate(spark, sf_dir, **options):
    return review.propagate_labels(
        adapters.review_items(spark, sf_dir), adapters.group_map(spark, sf_dir), adapters.actions(spark, sf_dir), **options
    )


@register("propagate_labels", PROPAGATED, ["review_items", "group_map", "actions"])
def propagate_labels(spark, sf_dir):
    return _propagate(spark, sf_dir).select(*_PROPAGATED_COLUMNS)


@register(
    "propagate_labels_resumed_safe",
    PROPAGATED + f""" and g.qa_key not in (select qa_key from prior)
  and (s.label = 'corrected' or {review_norm('g.model_answer')} = {review_norm('s.seed_answer')})""",
    ["review_items", "group_map", "actions", "prior"],
)
def propagate_labels_resumed_safe(spark, sf_dir):
    prior = adapters.prior_decisions(spark, sf_dir)
    return _propagate(spark, sf_dir, checkpoint=prior, safe=True).select(*_PROPAGATED_COLUMNS)


@register(
    "pending_items",
    "select qa_key, image_key from review_items where qa_key not in (select qa_key from latest)",
    ["review_items", "latest"],
)
def pending_items(spark, sf_dir):
    return review.pending_items(adapters.review_items(spark, sf_dir), latest(spark, sf_dir)).select("qa_key", "image_key")


@register(
    "restrict_to_remaining",
    """select qa_key from review_items where rgb_path in
  (select path from group_map where path not in (select keyframe from group_map))""",
    ["review_items", "group_map"],
)
def restrict_to_remaining(spark, sf_dir):
    rest = remaining_images(adapters.group_map(spark, sf_dir))
    return review.restrict_to_remaining(adapters.review_items(spark, sf_dir), rest).select("qa_key")


@register(
    "restrict_to_checkpoint_questions",
    """select qa_key, question_id from review_items where question_id in
  (select question_id from prior where category in ('CAT1', '') and question_id <> 'Q1')""",
    ["review_items", "prior"],
)
def restrict_to_checkpoint_questions(spark, sf_dir):
    prior = adapters.prior_decisions(spark, sf_dir).where("category in ('CAT1', '') and question_id <> 'Q1'")
    return review.restrict_to_checkpoint_questions(adapters.review_items(spark, sf_dir), prior).select("qa_key", "question_id")


@register("distinct_question_ids", "select distinct question_id from prior", ["prior"])
def distinct_question_ids(spark, sf_dir):
    return review.distinct_question_ids(adapters.prior_decisions(spark, sf_dir))


@register(
    "review_progress",
    """with n as (select count(*) as n from image_order),
s as (select *, row_number() over (order by sha256('45::' || image_key)) as rn from image_order),
picked as (select image_key from s, n where rn <= greatest(1, cast(ceil(0.125 * n) as bigint))),
j as (select i.qa_key, l.qa_key is not null as done from review_items i join picked using (image_key) left join latest l using (qa_key))
select count(*) filter (done) as reviewed, count(*) as total, round(100.0 * count(*) filter (done) / count(*), 6) as pct from j""",
    ["review_items", "image_order", "latest"],
)
def review_progress(spark, sf_dir):
    items = adapters.review_items(spark, sf_dir)
    picked = sampling.sample_review_images(review.image_order(items), 12.5)
    in_sample = items.join(picked.select("image_key"), "image_key", "left_semi")
    return _round(review.review_progress(in_sample, latest(spark, sf_dir)), "pct")


@register(
    "review_overall",
    """select count(*) as evaluated, count(*) filter (label = 'corrected') as wrong, count(*) filter (label = 'correct') as correct,
  (select count(*) from review_items) as total_rows, round(100.0 * count(*) filter (label = 'corrected') / count(*), 6) as wrong_pct,
  round(100.0 * count(*) filter (label = 'correct') / count(*), 6) as correct_pct,
  round(100.0 * count(*) / (select count(*) from review_items), 6) as evaluated_pct from latest""",
    ["review_items", "latest"],
)
def review_overall(spark, sf_dir):
    report = review.review_overall(latest(spark, sf_dir), adapters.review_items(spark, sf_dir))
    return _round(report, "wrong_pct", "correct_pct", "evaluated_pct")


_BY_QUESTION = """select case when question_id = '' then '(missing_question_id)' else question_id end as question_id,
  count(*) as evaluated, count(*) filter (label = 'corrected') as wrong, count(*) filter (label = 'correct') as correct,
  round(100.0 * count(*) filter (label = 'corrected') / count(*), 6) as wrong_pct,
  round(100.0 * count(*) filter (label = 'correct') / count(*), 6) as correct_pct from latest group by 1"""


@register("review_by_question", _BY_QUESTION, ["latest"])
def review_by_question(spark, sf_dir):
    return _round(review.review_by_question(latest(spark, sf_dir)), "wrong_pct", "correct_pct")


@register(
    "review_by_category",
    _BY_QUESTION.replace("(missing_question_id)", "(missing_category)").replace("question_id", "category"),
    ["latest"],
)
def review_by_category(spark, sf_dir):
    return _round(review.review_by_category(latest(spark, sf_dir)), "wrong_pct", "correct_pct")


_HISTOGRAM = """select case when question_id = '' then '(missing_question_id)' else question_id end as question_id,
  model_answer || '  ->  ' || human_answer as mapping, count(*) as n from latest where label = 'corrected' group by all"""


@register("corrections_histogram", _HISTOGRAM, ["latest"])
def corrections_histogram(spark, sf_dir):
    return review.corrections_histogram(latest(spark, sf_dir))


@register(
    "top_wrong_questions",
    f"select * from ({_BY_QUESTION}) order by wrong_pct desc, evaluated desc, question_id limit 30",
    ["latest"],
)
def top_wrong_questions(spark, sf_dir):
    return _round(review.top_wrong_questions(latest(spark, sf_dir)), "wrong_pct", "correct_pct")


@register(
    "top_corrections",
    f"""with worst as (select question_id from ({_BY_QUESTION}) order by wrong_pct desc, evaluated desc, question_id limit 20)
select h.question_id, mapping, n, cast(row_number() over (partition by h.question_id order by n desc, mapping) as int) as place
from ({_HISTOGRAM}) h join worst using (question_id)
qualify row_number() over (partition by h.question_id order by n desc, mapping) <= 5""",
    ["latest"],
)
def top_corrections(spark, sf_dir):
    return review.top_corrections(latest(spark, sf_dir))


@register("group_by_image", "select qa_key, image_ord, slot from slots", ["slots"])
def group_by_image(spark, sf_dir):
    return grouped(spark, sf_dir).select("qa_key", "image_ord", "slot")


@register(
    "next_pending_per_question_slot",
    """with f as (select s.*, l.qa_key is null as open from slots s left join latest l using (qa_key))
select slot, coalesce(min(image_ord) filter (open), min(image_ord)) as image_ord, count(*) filter (open) > 0 as has_work,
  count(*) filter (open) as pending from f group by slot""",
    ["slots", "latest"],
)
def next_pending_per_question_slot(spark, sf_dir):
    return review.next_pending_per_question_slot(grouped(spark, sf_dir), latest(spark, sf_dir))


@register(
    "align_question_across_images",
    """with first_place as (select image_ord, question_id, min(slot) as place from slots where question_id <> '' group by all),
lengths as (select image_ord, max(slot) as last from slots group by all)
select s.qa_key, s.image_ord, s.slot,
  case when ln.last is null then null else coalesce(pn.place, greatest(0, least(s.slot, ln.last))) end as next_slot,
  case when lp.last is null then null else coalesce(pp.place, greatest(0, least(s.slot, lp.last))) end as prev_slot
from slots s left join lengths ln on ln.image_ord = s.image_ord + 1 left join lengths lp on lp.image_ord = s.image_ord - 1
left join first_place pn on pn.image_ord = s.image_ord + 1 and pn.question_id = s.question_id
left join first_place pp on pp.image_ord = s.image_ord - 1 and pp.question_id = s.question_id""",
    ["slots"],
)
def align_question_across_images(spark, sf_dir):
    return review.align_question_across_images(grouped(spark, sf_dir))


@register(
    "review_worklist",
    """with n as (select count(*) as n from image_order),
s as (select *, row_number() over (order by sha256('45::' || image_key)) as rn from image_order),
picked as (select image_key from s, n where rn <= greatest(1, cast(ceil(0.125 * n) as bigint)))
select qa_key, image_ord, slot from slots join picked using (image_key) where qa_key not in (select qa_key from latest)""",
    ["slots", "latest", "image_order"],
)
def review_worklist(spark, sf_dir):
    items = adapters.review_items(spark, sf_dir)
    picked = sampling.sample_review_images(review.image_order(items), 12.5)
    return review.review_worklist(review.group_by_image(items), latest(spark, sf_dir), picked).select("qa_key", "image_ord", "slot")


@register("latest_decision", "select qa_key, seq, label, option_index, human_answer from latest", ["latest"])
def latest_decision(spark, sf_dir):
    return latest(spark, sf_dir).select("qa_key", "seq", "label", "option_index", "human_answer")


@register(
    "resume_merge",
    """select coalesce(l.qa_key, p.qa_key) as qa_key, coalesce(l.label, p.label) as label,
  coalesce(l.human_answer, p.human_answer) as human_answer, l.qa_key is null as resumed
from latest l full join prior p on p.qa_key = l.qa_key""",
    ["latest", "prior"],
)
def resume_merge(spark, sf_dir):
    merged = review.resume_merge(adapters.prior_decisions(spark, sf_dir), latest(spark, sf_dir))
    return merged.select("qa_key", "label", "human_answer", "resumed")
