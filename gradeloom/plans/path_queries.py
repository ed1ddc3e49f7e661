"""Queries: path arithmetic, audit and prefix migration, frame order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nested, paths
from ..functions.frames import frame_sort_key as sort_key
from ..operators import pathaudit
from ..sources import sinks
from . import adapters
from .registry import register

OLD, NEW = "/web/blog.tionsh.example.net/", " /mnt/archive/blog/"
_OLD, _NEW = "/web/blog.tionsh.example.net", "/mnt/archive/blog"


def _rewritten(x: str) -> str:
    return f"case when {x} = '{_OLD}' or starts_with({x}, '{_OLD}/') then '{_NEW}' || substr({x}, {len(_OLD) + 1}) else {x} end"


def _changed(x: str) -> str:
    return f"cast({x} = '{_OLD}' or starts_with({x}, '{_OLD}/') as bigint)"


@register(
    "rewrite_path_prefix",
    f"select page_id, {_rewritten('rooted')} as path, {_changed('rooted')} = 1 as changed from path_docs",
    ["path_docs"],
)
def rewrite_path_prefix(spark, sf_dir):
    p = F.col("doc.assets")[0]["path"]
    return adapters.path_docs(spark, sf_dir).select(
        "page_id", paths.rewrite_path_prefix(p, OLD, NEW).alias("path"), paths.has_path_prefix(p, OLD).alias("changed")
    )


def _rewrite_documents(spark, sf_dir):
    docs = adapters.path_docs(spark, sf_dir)
    dtype = docs.schema["doc"].dataType
    return docs.withColumn("changed", nested.count_rewrites(F.col("doc"), dtype, OLD)).withColumn(
        "doc", nested.rewrite_paths(F.col("doc"), dtype, OLD, NEW)
    )


_CHANGES = f"select page_id, {_changed('rooted')} + {_changed('''(home || '/index.html')''')} + {_changed('home')} as changed from path_docs"


@register(
    "rewrite_paths_nested",
    f"""select page_id, {_rewritten('rooted')} as first_path, {_rewritten('''(home || '/index.html')''')} as second_path,
  url, {_rewritten('home')} as home, c.changed from path_docs join ({_CHANGES}) c using (page_id)""",
    ["path_docs"],
)
def rewrite_paths_nested(spark, sf_dir):
    return _rewrite_documents(spark, sf_dir).select(
        "page_id",
        F.col("doc.assets")[0]["path"].alias("first_path"),
        F.col("doc.assets")[1]["path"].alias("second_path"),
        F.col("doc.assets")[0]["url"].alias("url"),
        F.col("doc.meta.home").alias("home"),
        "changed",
    )


@register(
    "rewrite_documents",
    f"""select page_id, {_rewritten('rooted')} as first_path, {_rewritten('home')} as home, c.changed
from path_docs join ({_CHANGES}) c using (page_id)""",
    ["path_docs"],
)
def rewrite_documents(spark, sf_dir):
    """The same migration on documents whose schema is not declared."""
    docs = adapters.path_docs(spark, sf_dir).select(
        F.col("page_id").cast("string").alias("path"), F.to_json("doc").alias("txt")
    )
    out = nested.rewrite_documents(docs, OLD, NEW)
    return out.select(
        F.col("path").cast("bigint").alias("page_id"),
        F.get_json_object("txt", "$.assets[0].path").alias("first_path"),
        F.get_json_object("txt", "$.meta.home").alias("home"),
        "changed",
    )


def _collected(spark, sf_dir):
    docs = adapters.path_docs(spark, sf_dir)
    found = nested.collect_paths(F.col("doc"), docs.schema["doc"].dataType)
    return docs.select(F.col("page_id").cast("string").alias("json_file"), F.posexplode(found).alias("pos", "f")).select(
        "json_file", F.col("pos").cast("bigint").alias("pos"), "f.json_key", "f.path"
    )


_COLLECTED = """select cast(page_id as varchar) as json_file, unnest([0, 1, 2, 3]::bigint[]) as pos,
  unnest(['assets[0].path', 'assets[1].path', 'assets[1].url', 'meta.home']) as json_key,
  unnest([rooted, home || '/index.html', '/web', home]) as path from path_docs"""


@register("collect_paths_nested", _COLLECTED, ["path_docs"])
def collect_paths_nested(spark, sf_dir):
    return _collected(spark, sf_dir)


@register("collect_document_paths", _COLLECTED, ["path_docs"])
def collect_document_paths(spark, sf_dir):
    docs = adapters.path_docs(spark, sf_dir).select(
        F.col("page_id").cast("string").alias("path"), F.to_json("doc").alias("txt")
    )
    return nested.collect_document_paths(docs)


@register(
    "validate_document_paths",
    f"""with good as (select * from ({_COLLECTED}) where cast(json_file as bigint) % 7 <> 3),
known as (select distinct home as path from path_docs where page_id % 3 = 0 union select '/web')
select json_file, min_by(json_key, pos) as json_key, path, 'missing' as reason from good
where path not in (select path from known) group by json_file, path
union all
select cast(page_id as varchar), '<json_read>', '<n/a>', 'failed to parse/read json' from path_docs where page_id % 7 = 3""",
    ["path_docs"],
)
def validate_document_paths(spark, sf_dir):
    """Some documents lose their last character; the listing holds a part of the paths, some of them twice."""
    pages = adapters.path_docs(spark, sf_dir)
    txt = F.to_json("doc")
    docs = pages.select(
        F.col("page_id").cast("string").alias("path"),
        F.when(F.col("page_id") % 7 == 3, F.left(txt, F.length(txt) - 1)).otherwise(txt).alias("txt"),
    )
    homes = pages.where("page_id % 3 = 0").select(F.col("doc.meta.home").alias("path"))
    return pathaudit.validate_document_paths(docs, homes.unionAll(pages.select(F.lit("/web").alias("path"))))


@register(
    "first_path_occurrence",
    f"select json_file, path, min_by(json_key, pos) as json_key from ({_COLLECTED}) group by all",
    ["path_docs"],
)
def first_path_occurrence(spark, sf_dir):
    return pathaudit.first_path_occurrence(_collected(spark, sf_dir))


@register(
    "path_update_summary",
    f"select count(*) filter (changed > 0) as files_changed, cast(sum(changed) as bigint) as replacements from ({_CHANGES})",
    ["path_docs"],
)
def path_update_summary(spark, sf_dir):
    return pathaudit.path_update_summary(_rewrite_documents(spark, sf_dir))


# Relative spellings of the stored paths, resolved against a JSON file's folder.
_RAW = """case question_id when 'Q1' then '../data' || substr(rgb_path, 6) when 'Q2' then './rgb//' || row_idx || '.jpg'
  when 'Q3' then '  ' || rgb_path || ' ' when 'Q4' then '   ' when 'Q5' then null when 'Q6' then 'a/../../x/./y.jpg' else rgb_path end"""
_RESOLVED = """case question_id when 'Q1' then '/sets/data' || substr(rgb_path, 6) when 'Q2' then '/sets/v1/rgb/' || row_idx || '.jpg'
  when 'Q3' then rgb_path when 'Q4' then null when 'Q5' then null when 'Q6' then '/sets/x/y.jpg' else rgb_path end"""


def _relative(spark, sf_dir):
    return adapters.qa(spark, sf_dir).withColumn("raw", F.expr(_RAW)).withColumn(
        "json_file", F.concat(F.lit("/sets/v1/"), F.col("source_input"))
    )


@register("resolve_relative_path", f"select source_input, row_idx, {_RESOLVED} as resolved from qa", ["qa"])
def resolve_relative_path(spark, sf_dir):
    return _relative(spark, sf_dir).select(
        "source_input", "row_idx", paths.resolve_relative_path(F.col("raw"), F.col("json_file")).alias("resolved")
    )


@register(
    "parent_folder",
    """select source_input, row_idx, '/data/loc_' || split_part(split_part(rgb_path, '/', 3), '_', 2) || '/rgb' as folder,
  '/base/sets' as relative_folder from qa""",
    ["qa"],
)
def parent_folder(spark, sf_dir):
    return adapters.qa(spark, sf_dir).select(
        "source_input", "row_idx", paths.parent_folder(F.col("rgb_path")).alias("folder"),
        paths.parent_folder(F.concat(F.lit("sets/"), F.col("source_input")), "/base").alias("relative_folder"),
    )


@register(
    "path_status",
    """with p as (select rgb_path as path from qa union select thermal_path from qa where thermal_path is not null)
select p.path, case when f.path is null then 'missing' when f.length < 50000 then 'not_a_file' when f.length > 450000 then 'not_readable' end as reason
from p left join files f using (path)""",
    ["qa", "files"],
)
def path_status(spark, sf_dir):
    rows = adapters.qa(spark, sf_dir)
    listing = adapters.files(spark, sf_dir).select(
        "path", (F.col("length") < 50000).alias("is_dir"), (F.col("length") <= 450000).alias("readable")
    )
    both = rows.select(F.explode(F.array("rgb_path", "thermal_path")).alias("path"))
    return pathaudit.path_status(both, listing)


_ISSUES = f"""with records as (select '/sets/v1/' || source_input as json_file, source_input || ':' || row_idx as record,
    {_RAW} as rgb_raw, {_RESOLVED} as rgb, thermal_path as thr from qa),
wide as (select json_file, record, 'rgb_path' as field, rgb_raw as raw, rgb as resolved from records
  union all select json_file, record, 'thermal_path', thr, thr from records),
issues as (select wide.*, case when resolved is null then 'empty_path' when f.path is null then 'missing' end as reason
  from wide left join files f on f.path = resolved)"""


def _audit(spark, sf_dir):
    records = _relative(spark, sf_dir).select(
        "json_file", F.concat_ws(":", "source_input", F.col("row_idx").cast("string")).alias("record"),
        F.col("raw").alias("rgb_path"), "thermal_path",
    )
    return records, pathaudit.audit_paths(records, adapters.files(spark, sf_dir))


@register(
    "audit_paths",
    f"{_ISSUES} select json_file, record, field, raw, resolved, reason from issues where reason is not null",
    ["qa", "files"],
)
def audit_paths(spark, sf_dir):
    return _audit(spark, sf_dir)[1]


@register(
    "path_audit_summary",
    f"""{_ISSUES} select (select count(distinct json_file) from records) as json_files, (select count(*) from records) as records_checked,
  count(*) as issues_found, count(*) = 0 as ok from issues where reason is not null""",
    ["qa", "files"],
)
def path_audit_summary(spark, sf_dir):
    records, issues = _audit(spark, sf_dir)
    return pathaudit.path_audit_summary(records.select("json_file").distinct(), records, issues)


_KEY = """case when is_header and image_id = '' then -1 when regexp_matches(image_id, '[0-9]') then 0 else 1 end as key_rank,
  case when is_header and image_id = '' then '-1' when regexp_matches(image_id, '[0-9]')
    then coalesce(nullif(ltrim(regexp_extract(image_id, '([0-9]+)[^0-9]*$', 1), '0'), ''), '0') end as key_frame"""


def _header():
    return F.col("is_header") & (F.col("image_id") == "")


@register("frame_sort_key", f"select doc_id, {_KEY} from frame_ids", ["frame_ids"])
def frame_sort_key(spark, sf_dir):
    key = sort_key(F.col("image_id"), _header())
    return adapters.frame_ids(spark, sf_dir).withColumn("key", key).select(
        "doc_id", F.col("key.rank").alias("key_rank"), F.col("key.frame").alias("key_frame")
    )


_FRAME_ORDER = f"""select doc_id, image_id, row_number() over (order by key_rank, length(coalesce(key_frame, '')), coalesce(key_frame, ''), doc_id) as ordinal
from (select *, {_KEY} from frame_ids)"""


@register("frame_order", _FRAME_ORDER, ["frame_ids"])
def frame_order(spark, sf_dir):
    rows = adapters.frame_ids(spark, sf_dir)
    return sinks.frame_order(rows, "image_id", _header(), "doc_id").select("doc_id", "image_id", "ordinal")
