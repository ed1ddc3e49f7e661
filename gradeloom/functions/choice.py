"""Free text -> option, and the labels a reviewer's pick produces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import norm_answer, norm_review_text

# Fixed values.
LABEL_CORRECT = "correct"
LABEL_CORRECTED = "corrected"


def best_option(raw_norm: Column, options: Column) -> Column:
    """Winning option as ``struct(exact, weight, nth, text)``; null without a hit.

    ``raw_norm`` must be a materialised column (see ``parse_choice``): lambdas
    evaluate what they capture once per element. The maximum of the ranked hits
    is the first equal option if there is one, otherwise the longest contained
    option, earliest first among equals. An empty option is contained in
    everything.
    """
    forms = F.transform(
        options, lambda o, i: F.struct(norm_answer(o).alias("n"), o.alias("text"), i.alias("i"))
    )
    # options that are not contained are null, which the maximum passes over: one list less for every answer
    ranked = F.transform(
        forms,
        lambda f: F.when(
            F.contains(raw_norm, f["n"]),
            F.struct(
                (f["n"] == raw_norm).alias("exact"),
                F.when(f["n"] == raw_norm, 0).otherwise(F.length(f["text"])).alias("weight"),
                (-f["i"]).alias("nth"),
                f["text"].alias("text"),
            ),
        ),
    )
    return F.array_max(ranked)


def parse_choice(df, raw: str, options: str, out: str = "pred_answer", invalid: str | None = None):
    """Add the parsed option; optionally a flag for option lists holding a null.

    Such lists cannot be ranked by length, so without an equal option the row
    is an error.
    """
    best = "__best"
    staged = df.withColumn("__raw_norm", norm_answer(F.col(raw))).withColumn(
        best, best_option(F.col("__raw_norm"), F.col(options))
    )
    broken = F.exists(F.col(options), lambda o: o.isNull()) & ~F.coalesce(
        F.col(f"{best}.exact"), F.lit(False)
    )
    staged = staged.withColumn(out, F.when(~F.coalesce(broken, F.lit(False)), F.col(f"{best}.text")))
    if invalid:
        staged = staged.withColumn(invalid, F.coalesce(broken, F.lit(False)))
    return staged.drop(best, "__raw_norm")


def picked_option(options: Column, option_index: Column) -> Column:
    """The option text, null when there is no such option."""
    return F.when(option_index >= 0, F.get(options, option_index))


def pick_is_valid(options: Column, option_index: Column) -> Column:
    return (option_index >= 0) & (option_index < F.coalesce(F.size(options), F.lit(0)))


def pick_label(options: Column, option_index: Column, model_answer: Column) -> Column:
    agrees = norm_review_text(picked_option(options, option_index)) == norm_review_text(model_answer)
    return F.when(
        pick_is_valid(options, option_index),
        F.when(agrees, F.lit(LABEL_CORRECT)).otherwise(F.lit(LABEL_CORRECTED)),
    )


def decided_answer(label: Column, options: Column, option_index: Column, model_answer: Column) -> Column:
    """What ends up as the human answer under a label."""
    return F.when(label == LABEL_CORRECT, model_answer).when(
        label == LABEL_CORRECTED, F.coalesce(picked_option(options, option_index), F.lit(""))
    )
