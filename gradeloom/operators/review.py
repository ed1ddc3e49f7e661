"""Review items, decisions, label propagation, worklists and reports.

Items carry ``qa_key`` and ``image_key``; decisions are one row per ``qa_key``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..functions.choice import LABEL_CORRECT, LABEL_CORRECTED, decided_answer
from .ordering import global_ordinal, with_ordinal

# Rows of one file or one image beyond this many are ranked block by block.
BLOCK_ROWS = 65536

MISSING_QUESTION = "(missing_question_id)"
MISSING_CATEGORY = "(missing_category)"
TOP_QUESTIONS = 30
TOP_CORRECTED_QUESTIONS = 20
TOP_CORRECTIONS = 5


def with_keys(items: DataFrame) -> DataFrame:
    c = F.col
    return items.withColumn("image_key", text.image_key(c("image_id"), c("rgb_path"), c("thermal_path"))).withColumn(
        "qa_key", text.qa_key(c("source_json"), c("row_idx"), c("image_key"), c("question_id"), c("question"))
    )


# --- image and question order -------------------------------------------------


def image_order(items: DataFrame) -> DataFrame:
    """One row per image: first place it was seen, its items, and its ordinal.

    Ordinals follow (file, position).
    """
    first = F.min(F.struct("source_json", "row_idx"))
    images = items.groupBy("image_key").agg(first.alias("first"), F.count(F.lit(1)).alias("n_items"))
    placed = images.select(
        "image_key",
        "n_items",
        F.col("first.source_json").alias("first_source"),
        F.col("first.row_idx").alias("first_row"),
    )
    return global_ordinal(placed, ["first_source", "first_row", "image_key"], "image_ord")


def group_by_image(items: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Items with ``image_ord`` and ``slot``, the question's place in its image.

    Questions are ordered by category, question id and position.
    """
    images = image_order(items).select("image_key", "image_ord", "n_items")
    placed = items.join(images, "image_key").withColumn("__block", F.floor(F.col("row_idx") / block_rows))
    ranked = with_ordinal(
        placed, ["image_key"], ["category", "question_id", "__block"], ["row_idx", "source_json"], "slot",
        hot=F.col("n_items") > block_rows,
    )
    return ranked.withColumn("slot", F.col("slot") - 1).drop("__block")


# --- decisions ------------------------------------------------------------------


def latest_decision(actions: DataFrame) -> DataFrame:
    """Last action per item; header rows are ignored."""
    fields = [c for c in actions.columns if c not in ("qa_key", "type")]
    return (
        actions.where(F.col("type") == "action")
        .groupBy("qa_key")
        .agg(F.max_by(F.struct(*fields), "seq").alias("d"))
        .select("qa_key", "d.*")
    )


def resume_merge(checkpoint: DataFrame, latest: DataFrame) -> DataFrame:
    """Earlier decisions overlaid with new ones."""
    old = checkpoint.withColumn("resumed", F.lit(True))
    new = latest.withColumn("resumed", F.lit(False))
    both = old.unionByName(new, allowMissingColumns=True)
    fields = [c for c in both.columns if c != "qa_key"]
    return (
        both.groupBy("qa_key")
        .agg(F.max_by(F.struct(*fields), ~F.col("resumed")).alias("d"))
        .select("qa_key", "d.*")
    )


def pending_items(items: DataFrame, decided: DataFrame) -> DataFrame:
    return items.join(decided.select("qa_key"), "qa_key", "left_anti")


def attach_keyframe(items: DataFrame, group_map: DataFrame) -> DataFrame:
    """Add ``keyframe``; null for images outside the map."""
    known = group_map.select(F.col("path").alias("rgb_path"), "keyframe")
    return items.join(known, "rgb_path", "left")


# Copies of each seed row; spreads the members of one large keyframe group.
SEED_COPIES = 16


def propagate_labels(
    items: DataFrame,
    group_map: DataFrame,
    actions: DataFrame,
    checkpoint: DataFrame | None = None,
    safe: bool = False,
) -> DataFrame:
    """Decisions that undecided group members inherit.

    The earliest explicit decision in a (keyframe, question) group is the seed.
    It reaches every member that has no explicit decision of its own and was not
    decided in the resumed checkpoint; later decisions never change a copy. A
    "correct" copy takes the member's own model answer, a "corrected" one the
    seed's option number on the member's options. ``safe`` limits "correct" to
    members whose model answer equals the seed's.
    """
    grouped = attach_keyframe(items, group_map).where(F.col("keyframe").isNotNull())
    explicit = actions.where(
        (F.col("type") == "action") & ~F.coalesce(F.col("auto_propagated"), F.lit(False))
    )
    first = explicit.groupBy("qa_key").agg(
        F.min_by(F.struct("seq", "label", "option_index"), "seq").alias("act")
    )
    seeds = (
        grouped.join(first, "qa_key")
        .groupBy("keyframe", "question_id")
        .agg(
            F.min_by(
                F.struct("act.seq", "act.label", "act.option_index", "rgb_path", "model_answer"), F.col("act.seq")
            ).alias("seed")
        )
    )
    return inherit(grouped, seeds, first, checkpoint, safe)


def inherit(
    grouped: DataFrame, seeds: DataFrame, explicit: DataFrame, checkpoint: DataFrame | None = None, safe: bool = False
) -> DataFrame:
    """Copy each seed to the members of its group that nobody decided."""
    undecided = grouped.join(explicit.select("qa_key"), "qa_key", "left_anti")
    if checkpoint is not None:
        undecided = undecided.join(checkpoint.select("qa_key"), "qa_key", "left_anti")
    salted = undecided.withColumn("__salt", F.pmod(F.hash("qa_key"), F.lit(SEED_COPIES)))
    copies = seeds.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SEED_COPIES - 1))))
    joined = salted.join(copies, ["keyframe", "question_id", "__salt"]).drop("__salt")
    label, option = F.col("seed.label"), F.col("seed.option_index")
    if safe:
        same = text.norm_review_text(F.col("model_answer")) == text.norm_review_text(F.col("seed.model_answer"))
        joined = joined.where((label != LABEL_CORRECT) | same)
    return joined.select(
        *[c for c in grouped.columns],
        label.alias("label"),
        F.when(label == LABEL_CORRECTED, option).alias("option_index"),
        decided_answer(label, F.col("options"), option, F.col("model_answer")).alias("human_answer"),
        F.lit(True).alias("auto_propagated"),
        F.concat(
            F.lit("Source: "), F.col("seed.rgb_path"), F.lit(" (Keyframe: "), F.col("keyframe"), F.lit(")")
        ).alias("propagated_from"),
        F.col("seed.seq").alias("seed_seq"),
    )


# --- worklists ----------------------------------------------------------------


def restrict_to_remaining(items: DataFrame, paths: DataFrame | None) -> DataFrame:
    if paths is None:
        return items
    wanted = paths.select(text.strip(F.col("path")).alias("__path")).distinct()
    return items.join(wanted, text.strip(items["rgb_path"]) == wanted["__path"], "left_semi")


def distinct_question_ids(decisions: DataFrame) -> DataFrame:
    return (
        decisions.where(F.col("question_id").isNotNull())
        .select(text.strip(F.col("question_id")).alias("question_id"))
        .distinct()
    )


def restrict_to_checkpoint_questions(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Only questions seen in the checkpoint; an empty checkpoint restricts nothing."""
    seen = distinct_question_ids(decisions)
    flagged = items.withColumn("__qid", text.strip(F.coalesce(F.col("question_id"), F.lit("")))).join(
        seen.select(F.col("question_id").alias("__qid"), F.lit(True).alias("__hit")), "__qid", "left"
    )
    return flagged.where(F.col("__hit") | ~seen.exists()).drop("__qid", "__hit")


def review_worklist(grouped: DataFrame, decided: DataFrame, sampled_images: DataFrame | None = None, by: str = "image") -> DataFrame:
    """Pending items in visiting order, image by image or question by question."""
    todo = pending_items(grouped, decided)
    if sampled_images is not None:
        todo = todo.join(sampled_images.select("image_key"), "image_key", "left_semi")
    order = ["image_ord", "slot"] if by == "image" else ["slot", "image_ord"]
    return todo.orderBy(*order)


def next_pending_per_question_slot(grouped: DataFrame, decided: DataFrame) -> DataFrame:
    """Per slot: the first image still undecided there, else the first that has it."""
    done = decided.select("qa_key", F.lit(True).alias("__done"))
    flagged = grouped.select("qa_key", "image_key", "image_ord", "slot").join(done, "qa_key", "left")
    open_ord = F.when(F.col("__done").isNull(), F.col("image_ord"))
    return (
        flagged.groupBy("slot")
        .agg(
            F.min(open_ord).alias("open_ord"),
            F.min("image_ord").alias("any_ord"),
            F.count_if(F.col("__done").isNull()).alias("pending"),
        )
        .select("slot", F.coalesce("open_ord", "any_ord").alias("image_ord"), F.col("open_ord").isNotNull().alias("has_work"), "pending")
    )


def align_question_across_images(grouped: DataFrame) -> DataFrame:
    """Where the same question sits in the next and the previous image.

    Ordinals are dense, so a neighbour is an equi join on a shifted ordinal.
    Both directions share one aggregation and one join; without the question
    in the neighbour the slot is clamped to its length.
    """
    qid = text.strip(F.coalesce(F.col("question_id"), F.lit("")))
    base = grouped.select("qa_key", "image_ord", "slot", qid.alias("qid"))
    places = base.groupBy("image_ord", "qid").agg(F.min("slot").alias("place"), F.max("slot").alias("last"))

    def around(df: DataFrame, keys: list[str], value: str) -> DataFrame:
        moved = df.select("*", F.explode(F.array(F.lit(1), F.lit(-1))).alias("step")).withColumn(
            "image_ord", F.col("image_ord") - F.col("step")
        )
        return moved.groupBy("image_ord", *keys).agg(
            F.max(F.when(F.col("step") == 1, F.col(value))).alias(f"next_{value}"),
            F.max(F.when(F.col("step") == -1, F.col(value))).alias(f"prev_{value}"),
        )

    ends = around(places.groupBy("image_ord").agg(F.max("last").alias("last")), [], "last")
    same = around(places.where(F.col("qid") != ""), ["qid"], "place")

    def target(side: str) -> Column:
        clamped = F.greatest(F.lit(0), F.least(F.col("slot"), F.col(f"{side}_last")))
        there = F.col(f"{side}_last").isNotNull()
        return F.when(there, F.coalesce(F.col(f"{side}_place"), clamped)).alias(f"{side}_slot")

    return (
        base.join(ends, "image_ord", "left")
        .join(same, ["image_ord", "qid"], "left")
        .select("qa_key", "image_ord", "slot", target("next"), target("prev"))
    )


# --- reports -----------------------------------------------------------------


def _pct(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part * 100.0 / whole).otherwise(F.lit(0.0))


def _counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("evaluated"),
        F.count_if(F.col("label") == LABEL_CORRECTED).alias("wrong"),
        F.count_if(F.col("label") == LABEL_CORRECT).alias("correct"),
    ]


def _rates(df: DataFrame) -> DataFrame:
    return df.withColumn("wrong_pct", _pct(F.col("wrong"), F.col("evaluated"))).withColumn(
        "correct_pct", _pct(F.col("correct"), F.col("evaluated"))
    )


def _named(c: str, missing: str) -> Column:
    return F.when(text.is_blank(F.col(c)), F.lit(missing)).otherwise(F.col(c)).alias(c)


def review_overall(decisions: DataFrame, items: DataFrame) -> DataFrame:
    """One row of totals; ``items`` only contributes its row count."""
    total = items.agg(F.count(F.lit(1)).alias("n")).scalar()
    return _rates(decisions.agg(*_counts()).withColumn("total_rows", total)).withColumn(
        "evaluated_pct", _pct(F.col("evaluated"), F.col("total_rows"))
    )


def review_by_question(decisions: DataFrame) -> DataFrame:
    return _rates(decisions.groupBy(_named("question_id", MISSING_QUESTION)).agg(*_counts()))


def review_by_category(decisions: DataFrame) -> DataFrame:
    report = _rates(decisions.groupBy(_named("category", MISSING_CATEGORY)).agg(*_counts()))
    return report.orderBy(F.desc("evaluated"), "category")


def corrections_histogram(decisions: DataFrame) -> DataFrame:
    mapping = F.concat(
        F.coalesce("model_answer", F.lit("")), F.lit("  ->  "), F.coalesce("human_answer", F.lit(""))
    )
    return (
        decisions.where(F.col("label") == LABEL_CORRECTED)
        .groupBy(_named("question_id", MISSING_QUESTION), mapping.alias("mapping"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def top_wrong_questions(decisions: DataFrame, n: int = TOP_QUESTIONS) -> DataFrame:
    """Highest wrong rate first, then most evaluated; ties by question id."""
    return review_by_question(decisions).orderBy(F.desc("wrong_pct"), F.desc("evaluated"), "question_id").limit(n)


def top_corrections(
    decisions: DataFrame, questions: int = TOP_CORRECTED_QUESTIONS, per_question: int = TOP_CORRECTIONS
) -> DataFrame:
    """Most frequent mappings of the worst questions.

    A rank with an upper bound is cut before the shuffle, so a question with
    very many mappings sends only a few rows per task.
    """
    worst = top_wrong_questions(decisions, questions).select("question_id")
    order = W.partitionBy("question_id").orderBy(F.desc("n"), "mapping")
    return (
        corrections_histogram(decisions)
        .join(worst, "question_id", "left_semi")
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= per_question)
    )


def review_progress(sample_items: DataFrame, decided: DataFrame) -> DataFrame:
    """Decided share of the sample; without a sample, all decisions count."""
    done = decided.select("qa_key", F.lit(True).alias("__done"))
    counts = sample_items.select("qa_key").join(done, "qa_key", "left").agg(
        F.count(F.lit(1)).alias("total"), F.count("__done").alias("hit")
    )
    everything = decided.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.select(
        F.when(F.col("total") == 0, everything).otherwise(F.col("hit")).alias("reviewed"),
        "total",
        _pct(F.col("hit"), F.col("total")).alias("pct"),
    )


def review_report(decisions: DataFrame, items: DataFrame) -> dict[str, DataFrame]:
    """The tables of the review report."""
    return {
        "overall": review_overall(decisions, items),
        "top_questions": top_wrong_questions(decisions),
        "categories": review_by_category(decisions),
        "corrections": top_corrections(decisions),
    }
