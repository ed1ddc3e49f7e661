"""Decisions, propagation and worklists on hand-written data."""

from pyspark.sql import functions as F

from gradeloom.operators import review

ITEMS = "qa_key string, image_key string, rgb_path string, question_id string, category string, options array<string>, model_answer string"
ACTIONS = "seq bigint, type string, qa_key string, label string, option_index int, human_answer string, auto_propagated boolean"


def items(spark):
    return spark.createDataFrame(
        [
            ("a", "ia", "/1", "Q", "c", ["x", "y"], "x"),
            ("b", "ib", "/2", "Q", "c", ["x", "y"], "y"),
            ("c", "ic", "/3", "Q", "c", ["p"], "p"),
            ("d", "id", "/4", "Q", "c", ["x", "y"], "x"),  # not in the map
            ("e", "ie", "/2", "R", "c", ["x", "y"], "x"),  # another question
        ],
        ITEMS,
    )


def group_map(spark):
    return spark.createDataFrame([("/1", "/1"), ("/2", "/1"), ("/3", "/1")], "path string, keyframe string")


def propagate(spark, actions, **kw):
    log = spark.createDataFrame(actions, ACTIONS)
    return {r["qa_key"]: (r["label"], r["option_index"], r["human_answer"], r["propagated_from"])
            for r in review.propagate_labels(items(spark), group_map(spark), log, **kw).collect()}


def test_correct_copies_take_the_members_own_answer(spark):
    got = propagate(spark, [(1, "action", "a", "correct", None, "x", False)])
    source = "Source: /1 (Keyframe: /1)"
    assert got == {"b": ("correct", None, "y", source), "c": ("correct", None, "p", source)}
    assert set(propagate(spark, [(1, "action", "a", "correct", None, "x", False)], safe=True)) == set()


def test_corrected_copies_use_the_option_number(spark):
    got = propagate(spark, [(1, "action", "a", "corrected", 1, "y", False)])
    assert got["b"][:3] == ("corrected", 1, "y")
    assert got["c"][:3] == ("corrected", 1, "")  # beyond the member's options


def test_first_decision_seeds_and_own_decisions_stay(spark):
    log = [
        (1, "action", "a", "corrected", 1, "y", False),
        (2, "action", "b", "correct", None, "y", True),  # a logged copy is not explicit
        (3, "action", "a", "correct", None, "x", False),  # re-decision changes no copy
        (4, "action", "c", "correct", None, "p", False),
        (5, "header", "d", None, None, None, None),
    ]
    got = propagate(spark, log)
    assert set(got) == {"b"}
    assert got["b"][:3] == ("corrected", 1, "y")
    resumed = spark.createDataFrame([("b",)], "qa_key string")
    assert propagate(spark, log, checkpoint=resumed) == {}


def test_latest_and_resume(spark):
    log = spark.createDataFrame(
        [(1, "action", "a", "correct", None, "x", False), (2, "header", "a", None, None, None, None), (3, "action", "a", "corrected", 1, "y", False)],
        ACTIONS,
    )
    latest = review.latest_decision(log)
    assert [(r["qa_key"], r["label"]) for r in latest.collect()] == [("a", "corrected")]
    old = spark.createDataFrame([("a", "correct", "x"), ("z", "correct", "q")], "qa_key string, label string, human_answer string")
    merged = {r["qa_key"]: (r["label"], r["resumed"]) for r in review.resume_merge(old, latest).collect()}
    assert merged == {"a": ("corrected", False), "z": ("correct", True)}


def test_restrictions(spark):
    rows = items(spark)
    assert review.restrict_to_remaining(rows, None).count() == 5
    some = spark.createDataFrame([(" /2 ",), ("/9",)], "path string")
    assert {r["qa_key"] for r in review.restrict_to_remaining(rows, some).collect()} == {"b", "e"}
    empty = spark.createDataFrame([], "question_id string")
    assert review.restrict_to_checkpoint_questions(rows, empty).count() == 5
    only = spark.createDataFrame([("R ",), (None,)], "question_id string")
    assert [r["qa_key"] for r in review.restrict_to_checkpoint_questions(rows, only).collect()] == ["e"]


def test_reports(spark):
    decisions = spark.createDataFrame(
        [("1", "correct", "q1", "", "m", "m"), ("2", "corrected", "q1", "c", "m", "h"), ("3", "corrected", "", "c", "m", "h"), ("4", "corrected", "q2", "c", "m", "h")],
        "qa_key string, label string, question_id string, category string, model_answer string, human_answer string",
    )
    top = [(r["question_id"], r["wrong_pct"]) for r in review.top_wrong_questions(decisions).collect()]
    assert top == [("(missing_question_id)", 100.0), ("q2", 100.0), ("q1", 50.0)]  # ties by key
    cats = [r["category"] for r in review.review_by_category(decisions).collect()]
    assert cats == ["c", "(missing_category)"]
    overall = review.review_overall(decisions, spark.range(8)).first()
    assert (overall["evaluated"], overall["evaluated_pct"], overall["wrong"]) == (4, 50.0, 3)
    assert review.review_overall(decisions.limit(0), spark.range(0)).first()["evaluated_pct"] == 0.0
    assert {r["mapping"] for r in review.corrections_histogram(decisions).collect()} == {"m  ->  h"}
    assert set(review.review_report(decisions, spark.range(8))) == {"overall", "top_questions", "categories", "corrections"}


def test_progress_without_sample(spark):
    decided = spark.createDataFrame([("a",), ("x",)], "qa_key string")
    row = review.review_progress(items(spark), decided).first()
    assert (row["reviewed"], row["total"]) == (1, 5)
    row = review.review_progress(items(spark).limit(0), decided).first()
    assert (row["reviewed"], row["total"], row["pct"]) == (2, 0, 0.0)


def test_neighbour_slots(spark):
    grouped = spark.createDataFrame(
        [("a1", 1, 0, "Q1"), ("a2", 1, 1, "Q9"), ("a3", 1, 2, ""), ("b1", 2, 0, "Q2"), ("b2", 2, 1, "Q1")],
        "qa_key string, image_ord bigint, slot bigint, question_id string",
    ).withColumn("n_items", F.lit(0))
    got = {r["qa_key"]: (r["next_slot"], r["prev_slot"]) for r in review.align_question_across_images(grouped).collect()}
    assert got == {"a1": (1, None), "a2": (1, None), "a3": (1, None), "b1": (None, 0), "b2": (None, 0)}
