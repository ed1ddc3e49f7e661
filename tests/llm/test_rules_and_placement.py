"""Quality ledger, mixing, sharding and URL rules against plain specifications."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import mixing, quality, sharding, urlfilter

DOCS = "doc_id long, text string, source string, n_words string, size int, fail_bits string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", 1, "x") for i, t, s in rows], DOCS)


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _repeat_words(words):
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    return len({p + k for places in at.values() if len(places) > 1 for p in places for k in range(8)})


def test_measurements_equal_a_plain_count(spark):
    r = random.Random(3)
    texts = [None, "", " \n\t", "a", "x " * 9000, "one two\none two\n\n \nend"]
    for _ in range(40):
        part = [r.choice("the of and in to é Ünit a|b #x $5% !! WORD".split()) for _ in range(r.randrange(1, 60))]
        texts.append(r.choice(["\n", " ", "\t "]).join(part * r.randrange(1, 4)))
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(0, None, "s")]
    led = quality.verdicts(_docs(spark, rows)).collect()
    assert len(led) == len(rows)
    for row in led:
        t = texts[row["doc_id"]] or ""
        w = _words(t)
        lines = [x for x in t.split("\n") if _words(x)]
        assert row["n_words"] == len(w)
        assert row["word_chars"] == sum(map(len, w))
        assert row["n_symbols"] == sum(c in "#*$%&|<>" for c in t)
        assert row["n_dup_lines"] == len(lines) - len(set(lines))
        assert row["n_repeat_words"] == _repeat_words(w)
        assert row["base_failed"] == (len(w) < 20 or 100 * _repeat_words(w) > 30 * len(w))
        assert not (row["base_failed"] and row["kept"])


def test_policies_and_ablations_come_from_the_bits(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(1, good, "s"), (2, "too few", "s"), (3, " ".join(f"w{i}%%" for i in range(40)), "s"), (4, "## $$", "s"), (4, "## $$", "s")]
    led = quality.ledger(_docs(spark, rows))
    both = quality.apply_policies(led, [quality.BASE, quality.DEFAULT]).collect()
    assert {r["doc_id"]: (r["kept_base_v1"], r["kept_default_v2"]) for r in both} == {
        1: (True, True), 2: (False, False), 3: (True, False), 4: (False, False)
    }
    out = {r["rule"]: (r["n_failed"], r["n_only"], r["n_kept_without"]) for r in quality.ablations(led, quality.DEFAULT).collect()}
    assert out["too_few_words"] == (3, 1, 2) and out["symbols"] == (3, 1, 2) and out["capitals"] == (0, 0, 1)
    assert quality.ledger(_docs(spark, []).where("false")).count() == 0


def test_keep_returns_the_given_columns(spark):
    good = " ".join(f"word{i}" for i in range(40))
    df = _docs(spark, [(1, good, "s"), (2, None, None), (1, good, "s")])
    kept = quality.keep(df)
    assert kept.columns == df.columns and [r["doc_id"] for r in kept.collect()] == [1, 1]


def _targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    target, left, free = {}, float(sum(sizes.values())), set(order)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.discard(s)
    return target


def test_targets_are_met(spark):
    r = random.Random(8)
    rows = []
    for i in range(600):
        source = r.choice(["big"] * 12 + ["a", "b", "B", "é", None])
        rows.append((i, " ".join(["w"] * r.randrange(0, 50)), source))
    rows += [(1000, None, "empty"), (1001, "", "empty"), (None, "w w w", "a"), (5, rows[5][1], rows[5][2])]
    df = _docs(spark, rows)
    mixed = mixing.mix(df).collect()
    assert len(mixed) == len(rows)
    sizes, taken, most = Counter(), Counter(), {}
    for i, t, s in rows:
        sizes[s] += len(_words(t))
    for m in mixed:
        taken[m["source"]] += m["taken"]
        most[m["source"]] = max(most.get(m["source"], 0), m["size"])
        assert m["taken"] <= 3 * m["size"] and m["source_size"] == sizes[m["source"]]
        assert m["size"] == 0 or m["taken"] % m["size"] == 0
    for s, t in _targets(sizes).items():
        assert math.isclose(next(m["target"] for m in mixed if m["source"] == s), t, rel_tol=1e-9, abs_tol=1e-6)
        assert abs(taken[s] - t) <= most[s] / 2 + 1e-6
    again = mixing.mix(df.repartition(7)).collect()
    key = lambda m: tuple(map(str, (m["doc_id"], m["source"], m["size"], m["taken"])))
    assert sorted(map(key, again)) == sorted(map(key, mixed))


def test_mix_equals_a_plain_draw(spark):
    """Row by row in key order, over null ids, repeated rows and equal ids with other texts."""
    r = random.Random(8)
    rows = [(r.choice([None, i % 9, i]), "w%d " % (i % 50) * r.choice([1, 2, 5, 40]), "abc"[min(2, i % 5)]) for i in range(300)]
    rows += [(7, "same text here", "a")] * 90 + [(None, None, "a"), (None, "", None)]
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(_words(t))
    want = Counter()
    for s, target in _targets(sizes).items():
        mine = []
        for i, t, x in rows:
            if x == s:
                text = "~" if t is None else t
                u = (int(hashlib.md5(f"17|{'~' if i is None else i}|{text}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                mine.append((-math.log(u), i is not None, i or 0, len(_words(t)), i, t))
        mine.sort(key=lambda k: k[:4])
        epochs = int(target // sizes[s]) if sizes[s] else 0
        gap, cut, counts = target - epochs * sizes[s], 0, [epochs] * len(mine)
        while cut < len(mine) and mine[cut][3] <= gap:
            gap -= mine[cut][3]
            counts[cut] += 1
            cut += 1
        later = [(abs(gap - mine[k][3]), k) for k in range(cut, len(mine)) if mine[k][3]]
        if later and min(later)[0] < gap:
            counts[min(later)[1]] += 1
        for k, n in zip(mine, counts, strict=True):
            want[(k[4], s, k[3], n * k[3])] += 1
    df = _docs(spark, rows)
    got = mixing.mix(df).collect()
    assert Counter((m["doc_id"], m["source"], m["size"], m["taken"]) for m in got) == want
    written = Counter((x["doc_id"], x["source"], len(_words(x["text"]))) for x in mixing.apply_mix(df).where("size is not null").collect())
    plan = Counter()
    for (i, s, z, taken), n in want.items():
        if z:
            plan[(i, s, z)] += n * taken // z
    assert {k: v for k, v in written.items() if k[2]} == {k: v for k, v in plan.items() if v}


def test_rows_without_ids_are_drawn_one_by_one(spark):
    texts = [f"t{i} " * (6 + i % 7) for i in range(4000)]
    df = _docs(spark, [(None, t, "a" if i < 3900 else "b") for i, t in enumerate(texts)])
    mixed = mixing._mixed(df, 17).where("source = 'a'").collect()
    assert len({m["tie"] for m in mixed}) == 3900
    taken = {z: np.mean([m["copies"] for m in mixed if m["size"] == z]) for z in range(6, 13)}
    assert max(taken.values()) - min(taken.values()) < 0.1


def test_mixed_rows_and_empty_mixes(spark):
    rows = [(i, "w " * (i % 7), "ab"[i % 2]) for i in range(200)] + [(3, "w w w", "b")] * 2
    df = _docs(spark, rows)
    out = mixing.apply_mix(df)
    assert out.columns == df.columns
    words = Counter()
    for row in out.collect():
        words[row["doc_id"]] += len(_words(row["text"]))
    taken = Counter()
    for m in mixing.mix(df).collect():
        taken[m["doc_id"]] += m["taken"]
    assert words == taken
    assert mixing.mix(df.where("false")).count() == 0 and mixing.apply_mix(df.where("false")).count() == 0


def test_heavier_quality_is_drawn_first(spark):
    rows = [(i, "w " * 10, "ab"[i % 2]) for i in range(4000)]
    df = _docs(spark, rows)
    quality_weight = F.when(F.col("doc_id") % 4 < 2, 1.0).otherwise(0.2)
    got = mixing.mix(df, quality=quality_weight).where("taken < source_size").select(
        (F.col("doc_id") % 4 < 2).alias("good"), F.col("source"), (F.col("taken") / F.col("size")).alias("n")
    ).groupBy("source", "good").agg(F.avg("n").alias("n"))
    mean = {(r["source"], r["good"]): r["n"] for r in got.collect()}
    assert all(mean[(s, True)] > mean[(s, False)] for s in "ab")


def _by_hand(arcs, owners, capacities):
    """Key by key: all keys try their home, then those left move on one point at a time."""
    room, place, waiting, step = list(capacities), {}, list(enumerate(arcs)), 0
    while waiting:
        still = []
        for k, arc in waiting:
            s = owners[(arc + step) % len(owners)]
            if room[s]:
                room[s] -= 1
                place[k] = s
            else:
                still.append((k, arc))
        waiting, step = still, step + 1
    return place


@pytest.mark.parametrize("slack", [0.0, 0.25])
def test_bounded_loads_equal_key_by_key_placement(slack):
    r = np.random.default_rng(4)
    ring = sharding.Ring(shards=5, vnodes=6, slack=slack)
    owners = np.array([s for _, s in ring.points()])
    arcs = np.sort(r.choice(len(owners), 211, p=(lambda p: p / p.sum())(r.random(len(owners)) ** 3)))
    counts = np.bincount(arcs, minlength=len(owners))
    place = _by_hand(arcs, owners, ring.capacities(211))
    rank = {k: k - int(counts[: arcs[k]].sum()) for k in range(211)}
    stretches = sharding.assign_arcs(counts, owners, ring.capacities(211))
    for k in range(211):
        assert [s for a, first, n, s in stretches if a == arcs[k] and first <= rank[k] < first + n] == [place[k]]
    assert len(stretches) <= len(owners) + ring.shards


def test_shards_are_even_and_slots_gapless(spark):
    rows = [(i, "é" * (i % 5), "s") for i in range(500)] + [(None, None, None)] * 40 + [(7, "éé", "s")] * 30
    df = _docs(spark, rows)
    out = sharding.shard(df, sharding.Ring(shards=24)).collect()
    assert len(out) == len(rows)
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert set(map(len, slots.values())) <= {len(rows) // 24, len(rows) // 24 + 1} and len(slots) == 24
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert Counter(r["size"] for r in out) == Counter(8 + len((t or "").encode()) for _, t, _ in rows)
    again = sharding.shard(df.repartition(5), sharding.Ring(shards=24)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    assert sharding.shard(df.where("false")).count() == 0


def test_a_repeated_row_is_written_by_many_tasks(spark):
    one = spark.range(100_000).select(F.lit(7).alias("doc_id"), F.lit("t").alias("text"))
    out = sharding.shard(one.unionAll(spark.range(50).select("id", F.lit("u"))), sharding.Ring(shards=3))
    rows = out.withColumn("task", F.spark_partition_id()).collect()
    assert max(Counter(r["task"] for r in rows).values()) < 80_000
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert sorted(map(len, slots.values())) == [33_350] * 3
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_more_shards_move_few_rows(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    a = sharding.shard(df, sharding.Ring(shards=24, slack=0.25)).select("doc_id", F.col("shard").alias("a"))
    b = sharding.shard(df, sharding.Ring(shards=25, slack=0.25)).select("doc_id", F.col("shard").alias("b"))
    assert a.join(b, "doc_id").where("a <> b").count() < 4000 * 0.15


URLS = [
    "http://www.Example.com/en/1", "http://example.com/en/1?x=/fr/", "http://example.com/EN/", "https://a.b.net/es/2", "https://net/fr/", "https://net/fr",
    "http://x.org/a/ads/b", "http://x.org/ADS/b", "http://spam-farm.example.org/en/", "http://notspam-farm.x.org/", "example.com/en/", None, "", "http://",
    "http://com", "http://com/", "ftp://user@telecom/x", "http://x.org/track12.gif?a", "http://x.org?ads/ads/", "http://spam-farm.example.com/de/",
]


def _verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for rule in urlfilter.PREFIX_RULES:
        h, _, p = rule.pattern.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule.pattern) > len(best.pattern)):
            best = rule
    other = any(re.search(r.regex(), host + path) for r in urlfilter.PATTERN_RULES)
    return host, path, best and best.pattern, best.verdict if best else "block" if other else "allow"


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)] + [(0, URLS[0], "x", "y")], "page_id long, url string, host string, token string")
    got = urlfilter.judge(df).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == _verdict(r["url"]), r["url"]
    assert urlfilter.judge(df.where("false")).count() == 0


def test_rules_are_indexed_by_whole_tokens():
    assert urlfilter.UrlRule("block", "example.com/en", True).tokens() == ["example", "com"]
    assert urlfilter.UrlRule("block", "||free-bets.").tokens() == ["free", "bets"]
    assert urlfilter.UrlRule("block", "ads*track/x").tokens() == []


def test_arcs_are_found_without_python(spark):
    positions = np.array([0, 1, 5, 2**28, 2**28 + 1, 2**39, 2**40 - 1], dtype=np.int64)
    at = sorted({max(0, min(2**40 - 1, int(p) + d)) for p in [*positions, 3 * 2**28, 2**40 - 2**28] for d in (-1, 0, 1)})
    found = sharding._with_arc(spark.createDataFrame([(a,) for a in at], "at long"), positions)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r["at"]: r["arc"] for r in found.collect()} == {a: int(np.searchsorted(positions, a)) % len(positions) for a in at}
