"""Keyframes of long scenes: the outcome of one pass, in few rounds."""

import random

import numpy as np
import pytest

from gradeloom.operators import dedup


def _near():
    """Local, so that tasks need no test module."""
    return lambda key, many: np.abs(many[:, 0] - key[0]) <= 1.0


def _one_pass(values):
    found, key = [], None
    for i, v in enumerate(values):
        if key is None or abs(v - values[key]) > 1.0:
            key = i
        found.append(key)
    return found


def _rounds(spark, monkeypatch, folders, chunk_rows):
    rows = [(f, f"{i:06d}", [float(v)], [99.0 * i]) for f, values in folders.items() for i, v in enumerate(values)]
    frames = spark.createDataFrame(rows, "folder string, path string, rgb_vec array<double>, thr_vec array<double>")
    calls, plain = [], dedup._arriving
    monkeypatch.setattr(dedup, "_arriving", lambda *a: calls.append(1) or plain(*a))
    got = {(r["folder"], int(r["path"])): int(r["keyframe"]) for r in dedup.keyframe_grouping(frames, _near(), chunk_rows).collect()}
    assert got == {(f, i): k for f, values in folders.items() for i, k in enumerate(_one_pass(values))}
    return len(calls)


def test_a_static_scene_of_64_ranges(spark, monkeypatch):
    # own keyframes, those of the range before, that of the first range, and nothing changes
    assert _rounds(spark, monkeypatch, {"still": [0.0] * 640}, 10) <= 4


def test_scenes_between_other_folders(spark, monkeypatch):
    scenes = [v for base in (0.0, 5.0, 5.8, 30.0) for v in [base] * 60]
    folders = {"a": [0.0, 9.0, 0.0], "b": scenes, "c": [1.0] * 75}
    assert _rounds(spark, monkeypatch, folders, 9) <= 6


@pytest.mark.parametrize("seed", range(2))
def test_wandering_scenes(spark, monkeypatch, seed):
    rng = random.Random(seed)
    walk, at = [], 0.0
    for _ in range(120):
        at += rng.choice([0.0, 0.0, 0.0, 0.4, -0.4, 3.0])
        walk.append(at)
    _rounds(spark, monkeypatch, {"walk": walk, "z": walk[:7]}, 8)
