"""Frame order of image ids and image geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

def frame_sort_key(image_id: Column, is_header: Column) -> Column:
    """``struct(rank, width, digits, frame)``: header rows, numbered frames, then the rest.

    Numbers of any length: they sort by sign and number of digits (``width``),
    then by ``digits``, the text that orders numbers of one width; ``frame`` is the plain number.
    """
    text = strip(F.coalesce(image_id, F.lit("")))
    whole = F.regexp_extract(text, r"^([+-]?\d+(?:_\d+)*)$", 1)
    last = F.regexp_extract(F.coalesce(image_id, F.lit("")), r"(\d+)\D*$", 1)
    digits = F.when(whole != "", F.replace(whole, F.lit("_"), F.lit(""))).otherwise(last)
    size = F.regexp_replace(F.regexp_replace(digits, "^[+-]", ""), "^0+", "")
    negative = F.startswith(digits, F.lit("-")) & (size != "")
    # a larger size is a smaller number below zero
    ordered = F.when(negative, F.translate(size, "0123456789", "9876543210")).otherwise(size)
    width = F.length(size) * F.when(negative, -1).otherwise(1)
    plain = F.when(size == "", "0").when(negative, F.concat(F.lit("-"), size)).otherwise(size)

    def key(rank: int, width: Column, digits: Column, frame: Column) -> Column:
        return F.struct(
            F.lit(rank).alias("rank"),
            width.cast("int").alias("width"),
            digits.cast("string").alias("digits"),
            frame.cast("string").alias("frame"),
        )

    return (
        F.when(is_header, key(-1, F.lit(0), F.lit(""), F.lit("-1")))
        .when(digits != "", key(0, width, ordered, plain))
        .otherwise(key(1, F.lit(0), F.lit(""), F.lit(None)))
    )


def plan_resize(width: Column, height: Column, max_side: Column) -> Column:
    """``struct(w, h)``: unchanged when small enough, else scaled half-even."""
    longest = F.greatest(width, height)
    scale = max_side.cast("double") / longest.cast("double")

    def side(size: Column) -> Column:
        return F.greatest(F.lit(1).cast("bigint"), F.rint(size * scale).cast("bigint"))

    fits = longest <= max_side
    return F.struct(
        F.when(fits, width.cast("bigint")).otherwise(side(width)).alias("w"),
        F.when(fits, height.cast("bigint")).otherwise(side(height)).alias("h"),
    )


def plan_side_by_side(w1: Column, h1: Column, w2: Column, h2: Column) -> Column:
    """Canvas size and paste offsets of two images placed next to each other."""
    tall = F.greatest(h1, h2)
    return F.struct(
        (w1 + w2).alias("canvas_w"),
        tall.alias("canvas_h"),
        F.floor((tall - h1) / 2).alias("left_y"),
        w1.alias("right_x"),
        F.floor((tall - h2) / 2).alias("right_y"),
    )
