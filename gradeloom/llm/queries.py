"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, htmltext, kneserney, langid, merkle, mixing, pii, quality, sharding, simjoin, urlfilter, vectorcode, warc
from .common import BLANK_RUN, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


JOIN_SQL = rf"""
with recursive w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
),
s as (
  select distinct doc_id, unnest(case when len(words) = 0 then [] when len(words) < {simjoin.SHINGLE} then [words]
    else list_transform(range(1, len(words) - {simjoin.SHINGLE - 2}), lambda p: list_slice(words, p, p + {simjoin.SHINGLE - 1})) end) as g
  from w
),
n as (select doc_id, count(*) as n from s group by doc_id),
common as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as (
  select x, y from common join n a on a.doc_id = x join n b on b.doc_id = y where c >= {simjoin.THRESHOLD} * (a.n + b.n - c) - 1e-6
),
reach(doc_id, node) as (select doc_id, doc_id from documents union select r.doc_id, l.y from reach r join links l on r.node = l.x)
select d.doc_id, (select min(node) from reach r where r.doc_id = d.doc_id) as class_id,
  (select count(*) from links l where l.x = d.doc_id) as n_links,
  (select count(*) from w a where len(a.words) > 0 and a.words = v.words) + case when len(v.words) = 0 then 1 else 0 end as n_copies
from documents d join w v on v.doc_id = d.doc_id
"""


@register("op1_ngram_jaccard_join", JOIN_SQL)
def op1_ngram_jaccard_join(spark, sf_dir):
    return simjoin.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


# Words, windows and lines restated in SQL; r'' patterns hold for both engines.
RULE_SQL = " + ".join(f"case when {r.fails} then {quality.BIT[r.name]} else 0 end" for r in quality.RULES)

QUALITY_SQL = rf"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from t),
windows as (
  select doc_id, p, list_slice(words, p, p + {quality.WINDOW - 1}) as win
  from (select doc_id, words, unnest(range(1, len(words) - {quality.WINDOW - 2})) as p from w)
),
twice as (select doc_id, p from (select doc_id, p, count(*) over (partition by doc_id, win) as n from windows) where n > 1),
covered as (
  select doc_id, count(distinct pos) as n
  from (select doc_id, unnest(range(p, p + {quality.WINDOW})) as pos from twice) group by doc_id
),
m as (
  select w.doc_id, len(words)::bigint as n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
    length(regexp_replace(text, '[^{quality.SYMBOLS}]+', '', 'g'))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(c.n, 0)::bigint as n_repeat_words,
    len(lines)::bigint as n_lines,
    length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g'))::bigint as n_capitals,
    length(regexp_replace(text, '[^!]+', '', 'g'))::bigint as n_marks
  from (
    select *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from w
  ) w left join covered c on w.doc_id = c.doc_id
),
b as (select *, ({RULE_SQL})::bigint as fail_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (fail_bits & {quality.BASE.mask}) != 0 as base_failed, (fail_bits & {quality.DEFAULT.mask}) = 0 as kept, fail_bits
from b
"""


@register("op2_quality_rules", QUALITY_SQL)
def op2_quality_rules(spark, sf_dir):
    judged = quality.verdicts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits"
    )


@register("op3_consistent_hash_sharding")
def op3_consistent_hash_sharding(spark, sf_dir):
    placed = sharding.shard(table(spark, sf_dir, "documents"), sharding.Ring(shards=24))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


MIXING_SQL = rf"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    greatest({mixing.LEAST_QUALITY}, 1.0::double - 8.0::double
      * length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>{{}}\[\]\\^~=+_]+', '', 'g'))
      / greatest(length(coalesce(text, '')), 1)) as quality,
    (('0x' || substr(md5('17|' || coalesce(doc_id::varchar, '~') || '|' || coalesce(text, '~')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u
  from documents
),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (
  select *, case (row_number() over (order by source is null, source) - 1) % 3 when 0 then 5.0::double when 1 then 2.0 else 1.0 end as weight,
    3 * source_size::double as cap, sum(source_size) over ()::double as total
  from s
),
r as (
  select *, (total - coalesce(sum(cap) over before, 0)) / (sum(weight) over () - coalesce(sum(weight) over before, 0)) as level
  from w window before as (order by cap / weight, source is null, source rows between unbounded preceding and 1 preceding)
),
free as (select arg_min(level, cap / weight) as level from r where level <= cap / weight),
t as (
  select r.source, source_size, case when cap <= 0 then 0 else least(cap, coalesce((select level from free), 'infinity'::double) * weight) end as target
  from r
),
e as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from t
),
k as (
  select d.doc_id, d.source, d.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size::double as rest,
    row_number() over keys as nth, sum(d.size) over keys as upto
  from d join e on d.source is not distinct from e.source
  window keys as (partition by d.source order by -ln(u) / quality, d.doc_id, d.size rows unbounded preceding)
),
gap as (select source, any_value(rest) - coalesce(max(upto) filter (upto <= rest), 0) as gap from k group by source),
last as (
  select k.source, arg_min(nth, (abs(gap - size), nth)) as nth from k join gap on k.source is not distinct from gap.source
  where upto > rest and size > 0 and abs(gap - size) < gap group by k.source
)
select doc_id, size, source_size, round(target, 4) as target,
  (size * (epochs + case when upto <= rest or k.nth = last.nth then 1 else 0 end))::bigint as taken
from k left join last on k.source is not distinct from last.source
"""


@register("op4_weighted_mixing", MIXING_SQL)
def op4_weighted_mixing(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken")


_URL = r"""
with u as (select page_id, url, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (
  select page_id, url, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from u
),
"""
_PREFIX = ", ".join(f"('{r.verdict}', '{r.pattern}')" for r in urlfilter.PREFIX_RULES)
_BLOCKED = " or ".join(f"regexp_matches(host || path, '{r.regex()}')" for r in urlfilter.PATTERN_RULES)
URL_SQL = rf"""{_URL}
p(verdict, rule) as (values {_PREFIX}),
f as (
  select h.page_id, h.url, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict
  from (select distinct page_id, url, host, path from h) h join p
    on (host = split_part(rule, '/', 1) or ends_with(host, '.' || split_part(rule, '/', 1)))
    and starts_with(path, substr(rule, strpos(rule, '/')))
  group by h.page_id, h.url
)
select h.page_id, host, path, f.rule, coalesce(f.verdict, case when {_BLOCKED} then 'block' else 'allow' end) as verdict
from h left join f on h.page_id is not distinct from f.page_id and h.url is not distinct from f.url
"""


@register("op7_url_pattern_rules", URL_SQL)
def op7_url_pattern_rules(spark, sf_dir):
    return urlfilter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _canonical(text: str) -> str:
    """The canonical text of ``decontam`` in SQL."""

    def sub(inner: str, pattern: str, to: str) -> str:
        return f"regexp_replace({inner}, '{pattern}', '{to}', 'g')"

    numbers = sub(sub(sub(text, BLANK_RUN, " "), decontam.NUMBER, "0"), decontam.UNIT_AFTER, r"\11")
    named = sub(numbers, decontam.OPENING, r"\12")
    named = sub(sub(named, decontam.MID_NAME, r"\12"), decontam.MID_NAME, r"\12")
    return _surface(named)


def _surface(text: str) -> str:
    return rf"lower(regexp_replace({text}, '[^\p{{L}}\p{{N}}\x20\x09-\x0D]+', '', 'g'))"


def _readings() -> str:
    """``c``: the tokens of all three forms, the last of them as they stand."""
    text = "coalesce(text, '')"
    typed = _surface(f"regexp_replace({text}, '{decontam.NUMBER}', '0', 'g')")
    return ", ".join(rf"regexp_extract_all({t}, '[^\x20\x09-\x0D]+')" for t in (_canonical(text), typed, _surface(text)))


_LITERALS = "len(list_filter(list_slice({}, p + 1, p + width), lambda t: not regexp_matches(t, '^[012]+$')))"
DECONTAM_SQL = rf"""
with b as (select item_id, [{_readings()}] as cs from benchmark),
d as (select doc_id, [{_readings()}] as cs from documents),
bp as (
  select item_id, cs, form, width, len(cs[1]) - width + 1 as n_windows, p, list_slice(cs[form + 1], p + 1, p + width) as win
  from (select *, unnest(range(0, len(cs[1]) - width + 1)) as p from (
    select *, unnest([0, 1, 2]) as form, least(len(cs[1]), {decontam.WINDOW}) as width from b where len(cs[1]) >= {decontam.MIN_LITERALS}))
),
bw as (
  select item_id, form, width, n_windows, p, win from bp where case when form < 2
    then {_LITERALS.format("cs[form + 1]")} >= {decontam.MIN_LITERALS} else {_LITERALS.format("cs[2]")} < {decontam.MIN_LITERALS} end
),
dw as (
  select doc_id, form, width, p, list_slice(cs[form + 1], p + 1, p + width) as win from (
    select doc_id, cs, v.form, v.width, unnest(range(0, len(cs[1]) - v.width + 1)) as p
    from d, (select distinct form, width from bw) v where len(cs[1]) >= v.width)
),
hits as (
  select doc_id, item_id, form, n_windows, dw.p - bw.p as diagonal, bw.p as p, 0 as more from dw join bw using (form, width, win)
),
runs as (select distinct doc_id, item_id, form, n_windows, diagonal from hits),
whole as (
  select doc_id, item_id, form, n_windows, diagonal, p, 1 as more
  from (select runs.*, width, p, win, d.cs as dcs from runs join bp using (item_id, form, n_windows) join d using (doc_id))
  where p + diagonal >= 0 and list_slice(dcs[form + 1], p + diagonal + 1, p + diagonal + width) = win
),
places as (from hits union all from whole),
slots as (
  select distinct doc_id, item_id, form, diagonal, more, t
  from (select *, unnest(range(p, p + {decontam.WINDOW})) as t from places)
),
pairs as (
  select s.*, b.cs[3][t + 1] as a, d.cs[3][t + diagonal + 1] as v from slots s join b using (item_id) join d using (doc_id)
  where t < len(b.cs[1]) and regexp_matches(b.cs[form + 1][t + 1], '^[012]+$')
),
tried as (
  select r.*, coalesce(n, 0) as n from (select distinct doc_id, item_id, form, n_windows, diagonal, more from places) r left join (
    select doc_id, item_id, form, diagonal, more, count(*) as n, count(distinct a) as x, count(distinct a || ' ' || v) as y from pairs group by all
  ) q using (doc_id, item_id, form, diagonal, more)
  where coalesce(x, 0) = coalesce(y, 0)
),
kept as (select doc_id, item_id, form, n_windows, diagonal, max(more) as more, arg_max(n, more) as n from tried group by all),
total as (
  select doc_id, item_id, n_windows, count(distinct p) as n_matched
  from kept join places using (doc_id, item_id, form, n_windows, diagonal, more) group by all
)
select doc_id, item_id, n_windows, n_matched, sum(n)::bigint as n_slots
from total join kept using (doc_id, item_id, n_windows) group by all
having n_matched >= least({decontam.NEEDED}, ceil(n_windows / 2.0))
"""


@register("op10_benchmark_decontamination", DECONTAM_SQL)
def op10_benchmark_decontamination(spark, sf_dir):
    return decontam.findings(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op5_html_block_labeller")
def op5_html_block_labeller(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    main = htmltext.extract(pages, htmltext.train(pages), ["page_id", "url"])
    return main.withColumn("n_chars", F.length("text").cast("bigint"))


# Five bits of the digest at a time, out of two hex digits each.
WARC_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as h from pages),
n as (select page_id, payload_bytes, h, list_transform(range(1, 41), lambda i: strpos('0123456789abcdef', h[i]) - 1) as x from p),
f as (select h, min(page_id) as first from p group by h)
select page_id, payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(((x[5 * i // 4 + 1] * 16 + x[5 * i // 4 + 2]) >> (3 - 5 * i % 4)) & 31) + 1]), 'string_agg', '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id = first then null else first end as refers_to
from n join f using (h)
"""


@register("op6_warc_index_first", WARC_SQL)
def op6_warc_index_first(spark, sf_dir):
    folder, index = warc.write_archives(table(spark, sf_dir, "pages"), min_bytes=0)
    read = warc.read_records(folder, index, payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op8_hyperdimensional_langid")
def op8_hyperdimensional_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out(F.col("doc_id")))
    prototypes = langid.train(docs.where(~F.col("held_out")))
    return langid.predict(docs, prototypes, ["doc_id", "held_out"])


@register("op9_weak_supervision_pii")
def op9_weak_supervision_pii(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"), ["doc_id"])


# CRC-32 (reflected polynomial 0xEDB88320) of a short ASCII string, byte by byte.
_CRC_TABLE = """crc as (
  select list(v order by n) as crc_table from (
    select n, list_reduce(list_prepend(n, range(8)), lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as v
    from range(256) r(n)
  )
)"""
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split({}::varchar, ''), lambda c: ord(c)::bigint)),
    lambda a, b: xor(a >> 8, crc_table[(xor(a, b) & 255) + 1])), 4294967295)"""


def _merkle_sql(depth: int = 24) -> str:
    """Trees of up to 2 ** depth leaves, level by level."""
    field = "coalesce(octet_length(encode({0}::varchar))::varchar || ':' || {0}::varchar, '-')"
    leaf = lambda n: "sha256(" + " || ".join(field.format(c) for c in ("doc_id", "source", "lang", n, "text")) + ")"

    def levels(name: str, key: str) -> str:
        climb = [
            f"{name}{k + 1} as (select {key}, i // 2 as i, case when n = 1 then any_value(h) else sha256(string_agg(h, '' order by i)) end as h,"
            f" (n + 1) // 2 as n from {name}{k} group by {key}, i // 2, n)"
            for k in range(depth)
        ]
        every = " union all ".join(f"select {k} as k, {key}, i, h from {name}{k} where n > 1" for k in range(depth))
        return ",\n".join([*climb, f"{name} as ({every})"])

    return f"""
with {_CRC_TABLE},
d as (
  select doc_id, lang, {leaf("n_chars")} as leaf, case when {_CRC.format("doc_id")} % 7 = 0 then {leaf("(n_chars + 1)")} else {leaf("n_chars")} end as tried
  from documents, crc
),
r as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as r, count(*) over (partition by lang) as n from d),
a0 as (select lang, r as i, leaf as h, n from r),
{levels("a", "lang")},
top as (select lang, h as subroot, row_number() over (order by lang nulls first) - 1 as i, count(*) over () as n from a{depth}),
b0 as (select 0 as one, i, subroot as h, n from top),
{levels("b", "one")},
steps as (
  select doc_id, a.k, case when z.i > a.i then 'R' || z.h else coalesce('L' || z.h, 'L') end as step
  from r join a on a.lang is not distinct from r.lang and a.i = r.r >> a.k
  left join a z on z.lang is not distinct from a.lang and z.k = a.k and z.i = xor(a.i, 1)
  union all
  select doc_id, {depth} + b.k, case when z.i > b.i then 'R' || z.h else coalesce('L' || z.h, 'L') end
  from r join top on top.lang is not distinct from r.lang join b on b.i = top.i >> b.k left join b z on z.k = b.k and z.i = xor(b.i, 1)
),
proofs as (select doc_id, list(step order by k) as steps from steps group by doc_id),
f as (
  select r.doc_id, leaf, subroot, (select h from b{depth}) as root, sha256(coalesce(list_aggregate(list_transform(steps, lambda s: s[2:]), 'string_agg', ''), '')) as proof_sha256,
    list_reduce(list_prepend(tried, coalesce(steps, [])), lambda x, s: sha256(case when s[1] = 'L' then s[2:] || x else x || s[2:] end)) as folded_root
  from r join top on top.lang is not distinct from r.lang left join proofs using (doc_id)
)
select *, folded_root = root as verified from f
"""


@register("op11_merkle_manifest", _merkle_sql())
def op11_merkle_manifest(spark, sf_dir):
    return merkle.audit(table(spark, sf_dir, "documents"))


def _discounts(name: str, source: str) -> str:
    """The three discounts of a level from its counts ``a``."""
    of = lambda i, low, high: f"{i} - {i + 1} * y * {high} / {low}"
    pick = lambda i, low, high, other: (
        f"coalesce(case when n1 > 0 and n2 > 0 and {low} > 0 and {high} > 0 and {of(i, low, high)} > 0 and {of(i, low, high)} < {i} then {of(i, low, high)} end, {other}::double)"
    )
    return f"""{name} as (
  select {pick(1, "n1", "n2", 0.5)} as d1, {pick(2, "n2", "n3", 1.0)} as d2, {pick(3, "n3", "n4", 1.5)} as d3
  from (select *, n1::double / (n1 + 2 * n2) as y from (
    select count(*) filter (a = 1) as n1, count(*) filter (a = 2) as n2, count(*) filter (a = 3) as n3, count(*) filter (a = 4) as n4 from {source}))
)"""


KNESER_NEY_SQL = rf"""
with {_CRC_TABLE},
d as (
  select doc_id, coalesce({_CRC.format("doc_id")} % 10 = 0, false) as held_out,
    list_concat([' start'], list_append(regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+'), ' end')) as t
  from documents, crc
),
p as (select doc_id, held_out, t[i] as u, t[i + 1] as w from (select *, unnest(range(1, len(t))) as i from d)),
uni as (select w, count(*) as c from p where not held_out group by w),
corpus as (select coalesce(sum(c), 0)::bigint as n, count(*) as v from uni),
bi as (select u, w, count(*) as a from p where not held_out group by u, w),
cont as (select w, count(*) as a from bi group by w),
ctx as (select u, sum(a) as s, count(*) filter (a = 1) as n1, count(*) filter (a = 2) as n2, count(*) filter (a > 2) as n3 from bi group by u),
{_discounts("k2", "bi")},
{_discounts("k1", "cont")},
short as (
  select coalesce(sum(a), 0) as s, d1 * count(*) filter (a = 1) + d2 * count(*) filter (a = 2) + d3 * count(*) filter (a > 2) as mass
  from k1 left join cont on true group by d1, d2, d3
),
lower1 as (
  select p.*, n, v, coalesce(uni.c, 0) as c,
    case when short.s > 0 then greatest(coalesce(cont.a, 0) - case coalesce(cont.a, 0) when 0 then 0 when 1 then k1.d1 when 2 then k1.d2 else k1.d3 end, 0) / short.s
      + mass / short.s / (v + 1) else 1.0::double / (v + 1) end as p1
  from p cross join corpus cross join short cross join k1 left join uni using (w) left join cont using (w)
),
full2 as (
  select l.*, case when ctx.s > 0 then greatest(coalesce(bi.a, 0) - case coalesce(bi.a, 0) when 0 then 0 when 1 then k2.d1 when 2 then k2.d2 else k2.d3 end, 0) / ctx.s
      + (k2.d1 * n1 + k2.d2 * n2 + k2.d3 * n3) / ctx.s * p1 else p1 end as p2
  from lower1 l cross join k2 left join ctx on ctx.u = l.u left join bi on bi.u = l.u and bi.w = l.w
)
select doc_id, held_out, count(*)::bigint as n_tokens, count(*) filter (c > 0)::bigint as n_known, n as train_tokens,
  round(sum(log10((c + {kneserney.ALPHA}::double) / (n + {kneserney.ALPHA}::double * (v + 1)))), 6) as base_score, round(sum(log10(p2)), 6) as score
from full2 group by doc_id, held_out, n
"""


@register("op12_kneser_ney_scoring", KNESER_NEY_SQL)
def op12_kneser_ney_scoring(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", kneserney.held_out(F.col("doc_id")))
    model, scored = kneserney.train_and_score(docs, ~F.col("held_out"), ["doc_id", "held_out"])
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(model.levels[1].raw_total).cast("bigint").alias("train_tokens"),
        F.round("base_score", 6).alias("base_score"),
        F.round("score", 6).alias("score"),
    )


def _codes_sql(coder: vectorcode.Coder) -> str:
    def assign(k: int) -> str:
        return f"""n{k} as (
  select vec_id, label, p, v, arg_min(e, dist * {coder.entries} + e) as e, min(dist) as dist
  from (select x.*, c.e, list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::hugeint as dist from parts x join c{k} c using (p))
  group by vec_id, label, p, v
)"""

    def refine(k: int) -> str:
        return f"""s{k} as (select p, e, i, sum(v[i])::bigint as t, count(*) as n from (select *, unnest(range(1, len(v) + 1)) as i from n{k}) group by p, e, i),
c{k + 1} as (
  select p, e, coalesce(m.v, c.v) as v
  from c{k} c left join (select p, e, list((t - (t % n + n) % n) // n order by i) as v from s{k} group by p, e) m using (p, e)
)"""

    rounds = ",\n".join(f"{assign(k)},\n{refine(k)}" for k in range(coder.rounds))
    return f"""
with x as (
  select vec_id, label, list_transform(embedding, lambda x: floor({vectorcode.SCALE} * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
parts as (
  select vec_id, label, p, v[p * len(v) // {coder.parts} + 1 : (p + 1) * len(v) // {coder.parts}] as v from x, range({coder.parts}) r(p)
),
c0 as (select p, row_number() over (partition by p order by vec_id) - 1 as e, v from parts where vec_id in (select vec_id from x order by vec_id limit {coder.entries})),
{rounds},
{assign(coder.rounds)},
coded as (
  select vec_id, label, string_agg(printf('%02x', e), '' order by p) as code, sum(dist)::bigint as error from n{coder.rounds} group by vec_id, label
)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
  (select sha256(string_agg(list_aggregate(v, 'string_agg', ','), ',' order by p, e)) from c{coder.rounds}) as codebooks_sha256
from coded
"""


@register("op13_limb_split_codes", _codes_sql(vectorcode.Coder()))
def op13_limb_split_codes(spark, sf_dir):
    coded = vectorcode.compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")
