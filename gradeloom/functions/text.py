"""Answer normalisation and row keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space at the edge of an answer.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The characters stripped from the edges of a reviewed answer.
REVIEW_EDGE = " \t\r\n.;:!?,\"'()[]{}"
# Fixed value: question prefix length in the key of a row without question id.
QUESTION_KEY_CHARS = 80

UNKNOWN = "UNKNOWN"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    """Null or the empty string."""
    return F.coalesce(c, F.lit("")) == ""


def norm_answer(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def norm_review_text(c: Column) -> Column:
    collapsed = F.regexp_replace(norm_answer(c), r"(?U)[\s\x1c-\x1f]+", " ")
    return F.btrim(collapsed, F.lit(REVIEW_EDGE))


def fill_unknown(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(UNKNOWN))


def image_key(image_id: Column, rgb: Column, thermal: Column) -> Column:
    paths = F.concat(
        F.lit("rgb:"), F.coalesce(rgb, F.lit("")), F.lit("|thr:"), F.coalesce(thermal, F.lit(""))
    )
    return F.when(is_blank(image_id), paths).otherwise(
        F.concat(F.lit("image_id:"), image_id, F.lit("|"), paths)
    )


def qa_key(
    source_json: Column, row_idx: Column, image: Column, question_id: Column, question: Column
) -> Column:
    """``image`` is the value of :func:`image_key`."""
    qid = F.when(
        is_blank(question_id), F.left(F.coalesce(question, F.lit("")), F.lit(QUESTION_KEY_CHARS))
    ).otherwise(question_id)
    return F.concat(
        source_json, F.lit("|row:"), row_idx.cast("string"), F.lit("|"), image, F.lit("|qid:"), qid
    )


def item_uid(
    source_input: Column, checkpoint_key: Column, image_id: Column, question_id: Column, question: Column
) -> Column:
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (source_input, checkpoint_key, image_id, question_id)]
    return F.concat_ws("::", *parts, norm_answer(question))


def icl_pool_key(question: Column, options: Column) -> Column:
    """Rows with the same question and the same option list share a pool.

    A JSON rendering keeps the pair unambiguous whatever the texts contain.
    """
    usable = (~is_blank(question)) & (F.coalesce(F.size(options), F.lit(0)) > 0)
    key = F.to_json(
        F.struct(norm_answer(question).alias("q"), F.transform(options, norm_answer).alias("o"))
    )
    return F.when(usable, key)


def review_pct(pct: Column) -> Column:
    """Values up to 1.0 are fractions; the result is clamped to 0..100."""
    scaled = F.when(pct <= 1.0, pct * 100.0).otherwise(pct)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), scaled))
