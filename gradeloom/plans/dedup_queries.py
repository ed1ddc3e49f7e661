"""Queries: image dedupe, keyframe grouping and the sets that follow."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup
from . import adapters
from .registry import register

THRESHOLD = 0.2
_COS = "list_cosine_similarity({a}, {b}) >= 0.2"
_MATCH = f"({_COS.format(a='{a}.rgb_vec', b='{b}.rgb_vec')} or {_COS.format(a='{a}.thr_vec', b='{b}.thr_vec')})"

_GROUPED = f"""
with recursive seq as (select *, row_number() over (partition by folder order by path) as pos from frames),
walk as (
  select folder, pos, path, path as keyframe, rgb_vec as krgb, thr_vec as kthr from seq where pos = 1
  union all
  select s.folder, s.pos, s.path, case when hit then w.keyframe else s.path end, case when hit then w.krgb else s.rgb_vec end,
    case when hit then w.kthr else s.thr_vec end
  from (select w.*, s.path as npath, {_COS.format(a='w.krgb', b='s.rgb_vec')} or {_COS.format(a='w.kthr', b='s.thr_vec')} as hit
    from walk w join seq s on s.folder = w.folder and s.pos = w.pos + 1) w
  join seq s on s.folder = w.folder and s.pos = w.pos + 1)
"""


@register(
    "dedupe_images_first_seen",
    """select rgb_path as path, coalesce(thermal_path, '') as thermal_path, regexp_extract(rgb_path, '^(.*)/[^/]*$', 1) as folder
from qa qualify row_number() over (partition by rgb_path order by source_input, row_idx) = 1""",
    ["qa"],
)
def dedupe_images_first_seen(spark, sf_dir):
    return dedup.dedupe_images_first_seen(adapters.qa(spark, sf_dir).withColumnRenamed("source_input", "source_json"))


@register("keyframe_grouping", f"{_GROUPED} select folder, path, keyframe from walk", ["frames"])
def keyframe_grouping(spark, sf_dir):
    return dedup.keyframe_grouping(adapters.frames(spark, sf_dir), dedup.CosineMatch(THRESHOLD))


def _consecutive(frames):
    a = frames.select("vec_id", F.col("path").alias("a_path"), F.col("rgb_vec").alias("a_rgb"), F.col("thr_vec").alias("a_thr"))
    b = frames.select(
        (F.col("vec_id") - 1).alias("vec_id"), F.col("path").alias("b_path"), F.col("rgb_vec").alias("b_rgb"), F.col("thr_vec").alias("b_thr")
    )
    return a.join(b, "vec_id")


@register(
    "pair_similarity",
    f"select a.path as a_path, b.path as b_path, {_MATCH.format(a='a', b='b')} as matched from frames a join frames b on b.vec_id = a.vec_id + 1",
    ["frames"],
)
def pair_similarity(spark, sf_dir):
    """Each frame against the one captured after it."""
    pairs = _consecutive(adapters.frames(spark, sf_dir))
    return dedup.pair_similarity(pairs, dedup.CosineMatch(THRESHOLD)).select("a_path", "b_path", "matched")


_BITS = "list_sum(list_transform(list_zip(a.{v}, b.{v}), lambda z: cast((z[1] > 0) <> (z[2] > 0) as int))) <= 12"


@register(
    "match_predicate",
    f"""select a.path as a_path, b.path as b_path, {_BITS.format(v='rgb_vec')} or {_BITS.format(v='thr_vec')} as matched
from frames a join frames b on b.vec_id = a.vec_id + 1""",
    ["frames"],
)
def match_predicate(spark, sf_dir):
    """Consecutive frames compared by the sign bits of their features."""
    bits = lambda c: F.transform(c, lambda x: (x > 0).cast("int"))
    frames = adapters.frames(spark, sf_dir).withColumn("rgb_vec", bits("rgb_vec")).withColumn("thr_vec", bits("thr_vec"))
    return dedup.pair_similarity(_consecutive(frames), dedup.HammingMatch(12)).select("a_path", "b_path", "matched")


@register(
    "keyframe_summary",
    f"""{_GROUPED} select count(*) as images, count(distinct keyframe) as keyframes, count(*) filter (path <> keyframe) as duplicates,
  round(100.0 * count(*) filter (path <> keyframe) / count(*), 6) as reduction_pct from walk""",
    ["frames"],
)
def keyframe_summary(spark, sf_dir):
    return dedup.keyframe_summary(keyframe_grouping(spark, sf_dir)).withColumn("reduction_pct", F.round("reduction_pct", 6))


@register(
    "remaining_images",
    "select path from group_map where path not in (select keyframe from group_map)",
    ["group_map"],
)
def remaining_images(spark, sf_dir):
    return dedup.remaining_images(adapters.group_map(spark, sf_dir))


@register("evaluated_images", "select distinct keyframe as path from group_map", ["group_map"])
def evaluated_images(spark, sf_dir):
    return dedup.evaluated_images(adapters.group_map(spark, sf_dir))
