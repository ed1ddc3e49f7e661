"""Normalisation, parsing and scoring against plain specifications."""

import math
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gradeloom.functions import frames, paths, text
from gradeloom.functions.choice import decided_answer, parse_choice, pick_label
from gradeloom.operators import scoring

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
LETTERS = st.text(alphabet="aAbB \t\n.,!?  \x1fÀé'", max_size=8)


def norm_spec(s):
    return "" if s is None else s.strip().lower()


def review_spec(s):
    return re.sub(r"\s+", " ", norm_spec(s)).strip(" \t\r\n.;:!?,\"'()[]{}")


def choice_spec(raw, options):
    n = norm_spec(raw)
    for o in options:
        if norm_spec(o) == n:
            return o
    for o in sorted(options, key=len, reverse=True):
        if norm_spec(o) in n:
            return o
    return None


@SLOW
@given(st.lists(st.one_of(st.none(), LETTERS), min_size=20, max_size=40))
def test_normalisers(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = df.select("i", text.norm_answer(F.col("v")).alias("a"), text.norm_review_text(F.col("v")).alias("r")).collect()
    for row in rows:
        assert row["a"] == norm_spec(values[row["i"]])
        assert row["r"] == review_spec(values[row["i"]])


@SLOW
@given(st.lists(st.tuples(st.one_of(st.none(), LETTERS), st.lists(LETTERS, max_size=5)), min_size=20, max_size=40))
def test_parse_choice(spark, cases):
    df = spark.createDataFrame([(i, r, o) for i, (r, o) in enumerate(cases)], "i int, raw string, options array<string>")
    for row in parse_choice(df, "raw", "options").collect():
        raw, options = cases[row["i"]]
        assert row["pred_answer"] == choice_spec(raw, options)


def _scored(spark, raw, options, gt="No", error=None):
    df = spark.createDataFrame(
        [(raw, options, gt, error)], "raw_output string, options array<string>, gt_answer string, error string"
    )
    return scoring.score_predictions(df).first()


@pytest.mark.parametrize(
    "raw, options, pred",
    [
        ("it is unknown", ["No", "Yes"], "No"),  # substring, not a word
        ("not returned", ["Returned", "Not returned"], "Not returned"),
        ("see: NOT RETURNED!", ["Returned", "Not returned"], "Not returned"),
        ("xyz", ["", "Yes"], ""),  # an empty option is in everything
        (None, ["No"], None),
        ("", ["No", " "], " "),
        ("x", [], None),
        ("ab", ["a", "b"], "a"),  # same length: first wins
    ],
)
def test_choice_edges(spark, raw, options, pred):
    assert _scored(spark, raw, options)["pred_answer"] == pred


def test_error_rows_and_null_options(spark):
    row = _scored(spark, None, ["No"], error="RuntimeError")
    assert (row["pred_answer"], row["correct"], row["raw_model_output"], row["error"]) == (None, False, None, "RuntimeError")
    row = _scored(spark, "No way", ["No", None])
    assert (row["pred_answer"], row["error"]) == (None, scoring.INVALID_OPTIONS)
    row = _scored(spark, "No", ["No", None])
    assert (row["pred_answer"], row["correct"], row["error"]) == ("No", True, None)
    assert _scored(spark, "No", ["No"], gt=None)["correct"] is False


def test_levels_of_empty_input_and_sums(spark):
    schema = "category string, question_id string, image_id string, correct boolean"
    empty = scoring.accuracy_all_levels(spark.createDataFrame([], schema)).collect()
    assert [(r["level"], r["total"], r["accuracy"]) for r in empty] == [("overall", 0, 0.0)]
    assert scoring.accuracy_overall(spark.createDataFrame([], schema)).first()["total"] == 0
    rows = [("c", "q1", None, True), (None, "q1", "i", False), (None, "q2", "i", None)]
    # a missing category is UNKNOWN, and an error row (false) counts in every level
    got = scoring.accuracy_all_levels(spark.createDataFrame([r for r in rows if r[3] is not None], schema)).collect()
    by = {(r["level"], r["key"]): (r["total"], r["correct"]) for r in got}
    assert by[("overall", None)] == (2, 1)
    assert by[("category", "UNKNOWN")] == (1, 0)
    assert by[("image", "UNKNOWN")] == (1, 1)
    for level in ("category", "question", "image"):
        assert sum(t for (lv, _), (t, _) in by.items() if lv == level) == 2


def test_review_labels(spark):
    df = spark.createDataFrame(
        [(["Yes.", "No"], "yes", 0), (["Yes", "No"], "yes", 1), (["Yes"], "yes", 3), ([], "yes", 0)],
        "options array<string>, model string, pick int",
    )
    label = pick_label(F.col("options"), F.col("pick"), F.col("model"))
    got = [
        (r[0], r[1])
        for r in df.select(label, decided_answer(label, F.col("options"), F.col("pick"), F.col("model"))).collect()
    ]
    assert got == [("correct", "yes"), ("corrected", "No"), (None, None), (None, None)]


def test_qa_key_prefix(spark):
    df = spark.createDataFrame([("s", 1, "", "/a", None, "", "q" * 100), ("s", 2, "7", "/a", "/b", "Q", "x")],
                               "s string, r int, i string, a string, b string, q string, t string")
    c = F.col
    key = text.qa_key(c("s"), c("r"), text.image_key(c("i"), c("a"), c("b")), c("q"), c("t"))
    assert [r[0] for r in df.select(key).collect()] == [
        "s|row:1|rgb:/a|thr:|qid:" + "q" * 80, "s|row:2|image_id:7|rgb:/a|thr:/b|qid:Q"
    ]


def test_frame_key(spark):
    values = ["00001", "frame_12_007", "abc", "", " 5 ", "-3", "1_000", "x9y"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [(r[0]["rank"], None if r[0]["frame"] is None else int(r[0]["frame"])) for r in df.select(frames.frame_sort_key(F.col("v"), F.lit(False))).collect()]
    assert got == [(0, 1), (0, 7), (1, None), (1, None), (0, 5), (0, -3), (0, 1000), (0, 9)]


def test_resize_half_even(spark):
    cases = [(1000, 500, 768), (3, 2, 1), (1, 1, 768), (1537, 1, 768), (25, 10, 10)]
    df = spark.createDataFrame(cases, "w bigint, h bigint, m bigint")
    for (w, h, m), r in zip(cases, df.select(frames.plan_resize(F.col("w"), F.col("h"), F.col("m")).alias("p")).collect()):
        s = m / float(max(w, h))
        want = (w, h) if max(w, h) <= m else (max(1, int(round(w * s))), max(1, int(round(h * s))))
        assert (r["p"]["w"], r["p"]["h"]) == want


@pytest.mark.parametrize("bad", ["", " ", "/", "  /"])
def test_empty_prefix_rejected(bad):
    with pytest.raises(ValueError):
        paths.clean_prefix(bad)


@SLOW
@given(st.lists(st.text(alphabet="ab./", max_size=10), min_size=20, max_size=40))
def test_paths(spark, values):
    import posixpath

    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = df.select(
        "i", paths.normalize_path(F.col("v")).alias("n"), paths.rewrite_path_prefix(F.col("v"), "/a/", "/new").alias("w"),
        paths.resolve_relative_path(F.col("v"), F.lit("/sets/x.json")).alias("r"),
    ).collect()
    for r in got:
        v = values[r["i"]]
        assert r["n"] == posixpath.normpath(v), v
        assert r["w"] == ("/new" + v[2:] if v == "/a" or v.startswith("/a/") else v)
        want = None if not v else v if v.startswith("/") else posixpath.normpath("/sets/" + v)
        assert r["r"] == want


def test_review_pct(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (10.0,), (150.0,), (-1.0,)], "p double")
    got = [r[0] for r in df.select(text.review_pct(F.col("p"))).collect()]
    assert got == [50.0, 100.0, 10.0, 100.0, 0.0]
    assert not any(math.isnan(v) for v in got)
