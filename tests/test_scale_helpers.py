"""Skew-safe ranks, samples, keyframes and few-shot draws against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.operators import dedup, fewshot, ordering, review, sampling


def digest(seed, key):
    return hashlib.sha256(f"{seed}::{key}".encode()).hexdigest()


def test_ordinal_with_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(5)}", rng.randrange(4), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, lvl int, pos int").withColumn("blk", F.floor(F.col("pos") / 16))
    want = {}
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    for g in groups.values():
        for i, r in enumerate(sorted(g, key=lambda r: (r[1], r[2]))):
            want[r[2]] = i + 1
    plain = ordering.with_ordinal(df, ["k"], ["lvl", "blk"], ["pos"], "n")
    some = ordering.with_ordinal(df, ["k"], ["lvl", "blk"], ["pos"], "n", hot=F.col("k") == "hot")
    for out in (plain, some):
        assert {r["pos"]: r["n"] for r in out.collect()} == want
        assert out.count() == len(rows)
    total = ordering.with_ordinal(df, [], ["lvl", "blk"], ["pos"], "n").collect()
    assert [r["n"] for r in sorted(total, key=lambda r: (r["lvl"], r["pos"]))] == list(range(1, 401))


@pytest.mark.parametrize("percent", [0.001, 0.1, 0.25, 0.5, 0.999])
def test_sample_images(spark, percent):
    rows = [(f"f{i % 3}", i, None if i % 11 == 0 else f"img{i // 2}") for i in range(600)] + [("none", i, None) for i in range(37)]
    df = spark.createDataFrame(rows, "source_input string, row_idx bigint, image_id string")
    got = {(r[0], r[1]) for r in sampling.sample_for_evaluation(df, percent, 9).select("source_input", "row_idx").collect()}
    want = set()
    for src in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == src]
        ids = sorted({r[2] for r in mine if r[2] is not None}, key=lambda x: digest(9, x))
        if ids:
            keep = set(ids[: max(1, int(round(percent * len(ids))))])
            want |= {(r[0], r[1]) for r in mine if r[2] in keep}
        else:
            ordered = sorted(mine, key=lambda r: digest(9, r[1]))
            want |= {(r[0], r[1]) for r in ordered[: max(1, int(round(percent * len(ordered))))]}
    assert got == want
    assert sampling.sample_for_evaluation(df, 1.0).count() == len(rows)


def test_review_sample_sizes(spark):
    images = spark.range(40).select(F.col("id").cast("string").alias("image_key"), F.col("id").alias("image_ord"))
    assert sampling.sample_review_images(images, 0).count() == 0
    assert sampling.sample_review_images(images, 1.0).count() == 40  # a fraction
    assert sampling.sample_review_images(images, 1.1).count() == 1
    assert sampling.sample_review_images(images, 26).count() == 11


def fold(frames, match):
    out = {}
    for folder in {f[0] for f in frames}:
        key = None
        for f in sorted(x for x in frames if x[0] == folder):
            same = key is not None and (match(key[2], [f[2]])[0] or match(key[3], [f[3]])[0])
            key = key if same else f
            out[f[0], f[1]] = key[1]
    return out


@pytest.mark.parametrize("threshold, chunk", [(-1.0, 25), (0.3, 12), (0.3, 1000), (0.8, 25)])
def test_keyframes_do_not_depend_on_chunks(spark, threshold, chunk):
    rng = np.random.default_rng(3)
    frames = []
    for i in range(160):
        folder = "hot" if i < 90 else f"f{i % 7}"
        frames.append((folder, f"{i:05d}", rng.normal(size=4).tolist(), rng.normal(size=4).tolist()))
    match = dedup.CosineMatch(threshold)
    want = fold(frames, match)
    df = spark.createDataFrame(frames, "folder string, path string, rgb_vec array<double>, thr_vec array<double>").repartition(6)
    got = dedup.keyframe_grouping(df, match, chunk_rows=chunk).collect()
    assert len(got) == len(frames)
    assert {(r["folder"], r["path"]): r["keyframe"] for r in got} == want
    summary = dedup.keyframe_summary(spark.createDataFrame([(r["path"], r["keyframe"]) for r in got], "path string, keyframe string")).first()
    assert summary["keyframes"] + summary["duplicates"] == summary["images"] == len(frames)


def test_empty_map_summary(spark):
    row = dedup.keyframe_summary(spark.createDataFrame([], "path string, keyframe string")).first()
    assert (row["images"], row["keyframes"], row["reduction_pct"]) == (0, 0, 0.0)


def test_fewshot_supports(spark):
    """Sizes, exclusions and independence from partitioning, with a hot pool."""
    rng = random.Random(5)
    rows = []
    for i in range(240):
        q = "hot?" if i % 3 else f"q{i % 4}"
        image = None if i % 17 == 0 else f"im{rng.randrange(40)}"
        rows.append((f"f{i % 4}", i, image, "Q", q, ["a", "b"], "a", "missing_files" if i % 5 == 0 else None))
    rows.append(("f0", 999, "solo", "Q", "alone?", ["a"], "a", None))
    schema = "source_input string, row_idx bigint, image_id string, question_id string, question string, options array<string>, gt_answer string, skip_reason string"
    df = spark.createDataFrame(rows, schema)
    for shots in (1, 2, 5, 100):
        got = {(r["source_input"], r["row_idx"]): r["supports"] for r in fewshot.icl_select_supports(df, shots).collect()}
        again = {(r["source_input"], r["row_idx"]): r["supports"] for r in fewshot.icl_select_supports(df.repartition(7), shots).collect()}
        assert got == again
        eligible = [r for r in rows if r[7] is None]
        assert set(got) == {(r[0], r[1]) for r in eligible}
        uid = lambda r: f"{r[0]}::::{r[2] or ''}::{r[3]}::{r[4]}"
        image = lambda r: r[2] or uid(r)
        by_row = {(r[0], r[1]): r for r in rows}
        for r in eligible:
            others = {image(o) for o in eligible if o[4] == r[4]} - {image(r)}
            picked = [by_row[s["source_input"], s["row_idx"]] for s in got[r[0], r[1]]]
            assert len(picked) == min(shots, len(others))
            assert len({image(p) for p in picked}) == len(picked)
            assert all(image(p) in others and p[7] is None and p[4] == r[4] for p in picked)
    assert all(r["supports"] == [] for r in fewshot.icl_select_supports(df, 0).collect())


def test_image_order_in_small_blocks(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        image = "hot" if i % 3 == 0 else f"i{rng.randrange(30)}"
        rows.append((f"s{i % 3}.json", i, image, f"c{rng.randrange(3)}", f"q{rng.randrange(4)}"))
    df = spark.createDataFrame(rows, "source_json string, row_idx bigint, image_key string, category string, question_id string")
    first = {}
    for r in sorted(rows):
        first.setdefault(r[2], len(first) + 1)
    slots = {}
    for image in first:
        mine = sorted((r for r in rows if r[2] == image), key=lambda r: (r[3], r[4], r[1], r[0]))
        slots.update({r[1]: (first[image], i) for i, r in enumerate(mine)})
    for block in (8, 65536):
        got = review.group_by_image(df, block_rows=block).collect()
        assert {r["row_idx"]: (r["image_ord"], r["slot"]) for r in got} == slots
