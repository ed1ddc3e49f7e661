"""Prompt texts, content blocks and few-shot conversations as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The wording below must stay as it is for comparable results.
DESC_RGB = "You are provided with an RGB visual image of a scene.\n"
DESC_THERMAL = "You are provided with a radiometric thermal image rendered with an inferno colormap.\n"
DESC_BOTH = (
    "You are provided with two separate images of the same scene:\n"
    "1. The first image is a standard RGB visual aerial image.\n"
    "2. The second image is a radiometric thermal image rendered with an inferno colormap.\n"
    "Use BOTH images together to understand the scene.\n"
)
TEMP_HEAD = "Temperature Summary for the Thermal Image (in Celsius):\n"
TEMP_LINES = (
    ("min", "- Minimum Temp: "),
    ("max", "- Maximum Temp: "),
    ("mean", "- Mean Temp: "),
    ("top3_mean", "- Top 3% Mean: "),
)
TEMP_TAIL = "Use these anchor points to map the observed thermal colors to approximate real temperatures.\n"
NO_TEMP_NOTE = "No numeric temperature summary is provided in this run; rely on visible thermal patterns only."
CLOSING = "Answer with exactly ONE option text (copy it verbatim)."
INTRO_BODY = (
    "Each solved example contains images, the question, the answer options, and the correct answer. "
    "Use the solved examples as demonstrations of how to map the visual evidence to the correct option. "
    "When you answer the final query, return exactly one option text copied verbatim from the provided options."
)
SOLVED_BODY = (
    "Study the images, question, and options. The assistant reply that follows is the correct answer "
    "for this solved example."
)
QUERY_BODY = (
    "Base your answer only on the new images and the provided options. "
    "Return exactly one option text."
)
# Image tokens by model family; other families use DEFAULT_TOKEN
# and accept any of KNOWN_TOKENS as already present.
FAMILY_TOKENS = {"pixtral": "[IMG]", "minicpm": "<image>./</image>"}
DEFAULT_TOKEN = "<image>"
KNOWN_TOKENS = ("<image>", "<|image|>", "<img>", "[IMG]")
INLINE_TOKEN = "(<image>./</image>)"

BLANK_LINE = "\n\n"
BLOCK_TYPE = "struct<type:string,text:string,image_ref:string>"


def _uses_thermal(mode: Column) -> Column:
    return mode != "rgb"


def image_count(family: Column, mode: Column) -> Column:
    """Images sent per question; the llama family gets one merged canvas."""
    return F.when((mode == "rgb_thermal") & (family != "llama"), F.lit(2)).otherwise(F.lit(1))


def number_text(c: Column) -> Column:
    """A double in its shortest form: plain between 1e-4 and 1e16, else like ``1e-05``."""
    text, size = c.cast("string"), F.abs(c)
    plain = F.regexp_replace(text.try_cast("decimal(38,21)").cast("string"), "0+$", "")
    plain = F.when(F.endswith(plain, F.lit(".")), F.concat(plain, F.lit("0"))).otherwise(plain)
    head = F.regexp_replace(F.regexp_extract(text, "^([^E]+)E", 1), r"\.0$", "")
    power = F.regexp_extract(text, "E(-?)([0-9]+)$", 2)
    sign = F.when(F.regexp_extract(text, "E(-?)", 1) == "-", "-").otherwise("+")
    short = F.concat(head, F.lit("e"), sign, F.when(F.length(power) < 2, F.lpad(power, 2, "0")).otherwise(power))
    shown = (
        F.when(~text.contains("E"), text).when((size >= 1e-4) & (size < 1e16), plain).otherwise(short)
    )
    return F.coalesce(shown, F.lit("N/A"))


def temperature_block(temp: Column) -> Column:
    """The temperature text of a row, null without a summary."""
    # one expression over the lines: four copies of the number's text make a method too large for the JIT compiler
    lines = F.array(*[F.struct(F.lit(label).alias("label"), temp[field].alias("value")) for field, label in TEMP_LINES])
    shown = F.transform(lines, lambda line: F.concat(line["label"], number_text(line["value"]), F.lit("\n")))
    return F.when(temp.isNotNull(), F.concat(F.lit(TEMP_HEAD), F.array_join(shown, ""), F.lit(TEMP_TAIL)))


def context_of(mode: Column, block: Column) -> Column:
    """Mode text and, unless only the first image is sent, the temperature text."""
    head = F.when(mode == "rgb", DESC_RGB).when(mode == "thermal", DESC_THERMAL).otherwise(DESC_BOTH)
    shown = F.when(_uses_thermal(mode), F.coalesce(block, F.lit(""))).otherwise("")
    return F.btrim(F.concat(head, F.lit("\n"), shown), F.lit(" \n"))


def build_system_context(mode: Column, temp: Column) -> Column:
    return context_of(mode, temperature_block(temp))


def question_block(question: Column, options: Column) -> Column:
    bullets = F.array_join(F.transform(options, lambda o: F.concat(F.lit("- "), o)), "\n")
    return F.concat(F.lit("Question: "), question, F.lit(BLANK_LINE + "Options:\n"), bullets)


def task_of(block: Column, note: Column | None = None) -> Column:
    return F.concat_ws(BLANK_LINE, block, *([] if note is None else [note]), F.lit(CLOSING))


def missing_temp_note(mode: Column, no_temp: Column) -> Column:
    return F.when(no_temp & _uses_thermal(mode), F.lit(NO_TEMP_NOTE))


def build_task_instruction(
    question: Column, options: Column, mode: Column, temp: Column, second: bool = False
) -> Column:
    note = missing_temp_note(mode, temp.isNull()) if second else None
    return task_of(question_block(question, options), note)


def build_text_prompt(context: Column, task: Column, task_again: Column, repeat: Column) -> Column:
    """Context, task and, when repeating, the task once more."""
    return F.concat_ws(
        BLANK_LINE,
        F.when(context != "", context),
        task,
        F.when(repeat, task_again),
    )


def build_inline_prompt(
    context: Column, task: Column, task_again: Column, repeat: Column, images: Column
) -> Column:
    """Layout with the image tokens between the two task texts."""
    marks = F.array_join(F.array_repeat(F.lit(INLINE_TOKEN), images), "\n")
    return F.concat_ws(
        BLANK_LINE, F.when(context != "", context), task, F.when(marks != "", marks), F.when(repeat, task_again)
    )


def inject_image_placeholders(prompt: Column, family: Column, images: Column) -> Column:
    text = F.coalesce(prompt, F.lit(""))
    token = F.lit(DEFAULT_TOKEN)
    present = F.lit(False)
    for known in KNOWN_TOKENS:
        present = present | F.contains(text, F.lit(known))
    for name, own in FAMILY_TOKENS.items():
        token = F.when(family == name, own).otherwise(token)
        present = F.when(family == name, F.contains(text, F.lit(own))).otherwise(present)
    prefix = F.array_join(F.array_repeat(token, images), "\n")
    return (
        F.when(images <= 0, prompt)
        .when(present, text)
        .otherwise(F.concat_ws("\n", prefix, F.when(text != "", text)))
    )


def text_block(text: Column) -> Column:
    return F.struct(
        F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("image_ref")
    )


def image_blocks(refs: Column) -> Column:
    return F.transform(
        refs,
        lambda r: F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), r.alias("image_ref")),
    )


def image_refs(family: Column, mode: Column, rgb: Column, thermal: Column) -> Column:
    """Image references in sending order; a merged canvas is ``rgb|thermal``."""
    return (
        F.when(mode == "rgb", F.array(rgb))
        .when(mode == "thermal", F.array(thermal))
        .when(family == "llama", F.array(F.concat_ws("|", rgb, thermal)))
        .otherwise(F.array(rgb, thermal))
    )


def build_content_blocks(
    context: Column, task: Column, refs: Column, task_again: Column, repeat: Column, prefix: Column | None = None
) -> Column:
    """Optional prefix, context, task, the images and optionally the task again."""
    none = F.array().cast(f"array<{BLOCK_TYPE}>")
    lead = none if prefix is None else F.when(prefix != "", F.array(text_block(prefix))).otherwise(none)
    return F.concat(
        lead,
        F.when(context != "", F.array(text_block(context))).otherwise(none),
        F.array(text_block(task)),
        image_blocks(refs),
        F.when(repeat, F.array(text_block(task_again))).otherwise(none),
    )


def with_prompt_parts(df, mode: Column, repeat: Column, temp: Column, question: str = "question", options: str = "options"):
    """Add ``context``, ``task``, ``task_again`` and the flat ``prompt``."""
    q, o = F.col(question), F.col(options)
    return (
        df.withColumn("context", build_system_context(mode, temp))
        .withColumn("task", build_task_instruction(q, o, mode, temp))
        .withColumn("task_again", build_task_instruction(q, o, mode, temp, second=True))
        .withColumn("prompt", build_text_prompt(F.col("context"), F.col("task"), F.col("task_again"), repeat))
    )


def intro_text(shots: Column) -> Column:
    return F.concat(
        F.lit("You will first see "),
        shots.cast("string"),
        F.when(shots == 1, F.lit(" solved in-context example. ")).otherwise(F.lit(" solved in-context examples. ")),
        F.lit(INTRO_BODY),
    )


def solved_text(number: Column) -> Column:
    return F.concat(F.lit("Solved Example "), number.cast("string"), F.lit(":\n"), F.lit(SOLVED_BODY))


def query_text(shots: Column) -> Column:
    return F.concat(
        F.lit("Now answer a new query example using the "),
        shots.cast("string"),
        F.lit(" solved example(s) above as guidance. "),
        F.lit(QUERY_BODY),
    )


def build_fewshot_messages(
    supports: Column,
    family: Column,
    mode: Column,
    repeat: Column,
    context: Column,
    task: Column,
    task_again: Column,
    refs: Column,
) -> Column:
    """Conversation turns ``array<struct<role, content, answer>>``.

    ``supports`` holds structs with question, options, gt_answer, temp_summary,
    rgb_path and thermal_path. User turns carry ``content``, assistant turns
    ``answer``. Without supports there is a single user turn.
    """
    shots = F.coalesce(F.size(supports), F.lit(0))
    no_content = F.lit(None).cast(f"array<{BLOCK_TYPE}>")
    no_answer = F.lit(None).cast("string")

    def turns(s: Column, i: Column) -> Column:
        temp = s["temp_summary"]
        prefix = F.concat(
            F.when(i == 0, F.concat(intro_text(shots), F.lit(BLANK_LINE))).otherwise(""), solved_text(i + 1)
        )
        content = build_content_blocks(
            build_system_context(mode, temp),
            build_task_instruction(s["question"], s["options"], mode, temp),
            image_refs(family, mode, s["rgb_path"], s["thermal_path"]),
            build_task_instruction(s["question"], s["options"], mode, temp, second=True),
            repeat,
            prefix,
        )
        return F.array(
            F.struct(F.lit("user").alias("role"), content.alias("content"), no_answer.alias("answer")),
            F.struct(
                F.lit("assistant").alias("role"),
                no_content.alias("content"),
                F.coalesce(s["gt_answer"], F.lit("")).alias("answer"),
            ),
        )

    query = F.struct(
        F.lit("user").alias("role"),
        build_content_blocks(
            context, task, refs, task_again, repeat, F.when(shots > 0, query_text(shots)).otherwise("")
        ).alias("content"),
        no_answer.alias("answer"),
    )
    solved = F.flatten(F.transform(supports, turns))
    return F.when(shots > 0, F.concat(solved, F.array(query))).otherwise(F.array(query))


def message_images(messages: Column) -> Column:
    """Image references of all turns in order."""
    blocks = F.flatten(F.transform(messages, lambda m: F.coalesce(m["content"], F.array().cast(f"array<{BLOCK_TYPE}>"))))
    return F.transform(F.filter(blocks, lambda b: b["type"] == "image"), lambda b: b["image_ref"])


def alignment_error(messages: Column, supplied: Column) -> Column:
    """Null when every supplied image is consumed by exactly one image block."""
    used, given = F.size(message_images(messages)), F.coalesce(F.size(supplied), F.lit(0))
    return F.when(used > given, F.lit("not enough images for message spec")).when(
        used < given,
        F.concat(F.lit("consumed "), used.cast("string"), F.lit(" images for "), given.cast("string"), F.lit(" provided images")),
    )
