"""Benchmark decontamination by template windows.

Texts are canonicalised first: numbers become ``0``, a unit behind a number
``1``, and a name ``2``, where a name is a capitalised word in mid-sentence or
any word that opens a sentence. Windows of eight canonical tokens are
hash-joined between benchmark and documents. Matched windows on one diagonal
(document position minus item position) form an alignment; it counts only if its
slots are consistent: each value of the item meets one value of the document
throughout. So a question with other numbers or names is still caught, and
windows that merely have the same shape are not.

Capitals decide what a template takes for a name, so a text is read in three
``FORMS`` at once: the template of the text on one line (line breaks decide nothing),
the lower-case words with typed numbers, and the words with their numbers. A window
is searched for in the first two if it has ``MIN_LITERALS`` literal tokens there; the
windows that are too rich in numbers for that are searched for in the last, where
their numbers must be the same. On an alignment that one window found, all equal
windows of the form count, searched for or not, as long as the slots agree with them.
Windows of all forms count together.

Defined results: null and blank texts hold no window; an item of fewer than eight
tokens is searched as one window of its own length, one of fewer than
``MIN_LITERALS`` tokens is not searched for; rows of equal doc_id and text are
one document, rows that share a null or repeated id but not the text are searched
apart, items likewise, and meet only in the finding of their ids (most matches of one
row, slots of all); an empty benchmark or corpus gives no findings. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_RUN, BLANKS, bind, materialise, whole_row
from .simjoin import row_keys

ROW = ("k1", "k2")  # the key of a document's row

WINDOW = 8
MIN_LITERALS = 4
# Windows of one item that must align: half of them, or six in a long item (13 tokens in a row).
NEEDED = 6
# Up to this many benchmark windows (16 bytes each) are broadcast; beyond, both sides are shuffled.
BROADCAST_WINDOWS = 1_000_000

NUMBER = r"[0-9]+(?:[.,:][0-9]+)*"
UNITS = (
    "km|m|cm|mm|miles?|mi|feet|foot|ft|inch(?:es)?|kg|g|mg|lbs?|pounds?|oz|litres?|liters?|l|ml|hours?|hrs?|h|"
    "minutes?|min|seconds?|sec|s|days?|weeks?|months?|years?|dollars?|euros?|cents?|usd|eur|percent|degrees?"
)
UNIT_AFTER = rf"(?i)(0[%$€£]? ?)(?:{UNITS})\b"
OPENING = r"([.?][^\p{L}\p{N}\s]*\s+|^\s*)\p{L}+"
MID_NAME = r"([\p{Ll},;:2] )\p{Lu}\p{L}*"


def _strip(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}\s]+", ""))


def _tokens(text: Column) -> Column:
    # Only a text without tokens splits into an empty one; a condition on the text would compute all of it twice.
    return F.array_remove(F.split(F.btrim(text, F.lit(BLANKS)), BLANK_RUN), "")


def canonical(text: Column) -> Column:
    """The text on one line with typed placeholders, lower case, without punctuation."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), BLANK_RUN, " ")
    # the condition asks the text as it stands, so that its line is made once
    numbers = F.when(text.rlike("[0-9]"), F.regexp_replace(F.regexp_replace(t, NUMBER, "0"), UNIT_AFTER, "$11")).otherwise(t)
    named = F.regexp_replace(numbers, OPENING, "$12")
    named = F.regexp_replace(F.regexp_replace(named, MID_NAME, "$12"), MID_NAME, "$12")
    return _strip(named)


def canonical_tokens(text: Column) -> Column:
    return _tokens(canonical(text))


def surface_tokens(text: Column) -> Column:
    """The tokens as they stand, one for each canonical token."""
    return _tokens(_strip(F.coalesce(text, F.lit(""))))


def _typed(text: Column) -> Column:
    return _tokens(_strip(F.regexp_replace(F.coalesce(text, F.lit("")), NUMBER, "0")))


def _placeholder(token: Column) -> Column:
    return token.rlike("^[012]+$")


# Ways to read a text, one token for each surface token.
FORMS: tuple[Callable[[Column], Column], ...] = (canonical_tokens, _typed, surface_tokens)
TYPED, SURFACE = 1, 2


def readings(text: Column) -> dict[str, Column]:
    """``c0, c1, c2``: the tokens of a text in all forms."""
    return {f"c{k}": form(text) for k, form in enumerate(FORMS)}


def windows(rows: DataFrame, keys: list[str], wanted: list[tuple[int, int]], places: tuple[str, ...] = ()) -> DataFrame:
    """``keys, places, pos, form, width, h`` of all windows of the ``wanted`` forms and widths; ``rows`` has the readings.

    ``places`` are arrays of one value for each place of a window.

    The arrays are laid beside themselves with an offset for each place of a window, so
    that one pass over a text makes the windows of every form by plain expressions.
    """
    forms = sorted({f for f, _ in wanted})
    longest = max(w for _, w in wanted)
    beside = [F.slice(f"c{f}", F.lit(k + 1), F.size(f"c{f}")) for f in forms for k in range(longest)]
    at = rows.select(*keys, F.posexplode(F.arrays_zip(*beside, *[F.slice(c, F.lit(1), F.size(c)) for c in places])).alias("pos", "z"))
    further = [F.col("z").getField(str(len(beside) + i)).alias(c) for i, c in enumerate(places)]

    def token(form: int, k: int) -> Column:
        return F.col("z").getField(str(forms.index(form) * longest + k))

    hashes = [
        F.struct(
            F.lit(f).alias("form"),
            F.lit(w).alias("width"),
            F.when(token(f, w - 1).isNotNull(), F.xxhash64(F.lit(f), F.lit(w), *[token(f, k) for k in range(w)])).alias("h"),
        )
        for f, w in wanted
    ]
    return at.select(*keys, *further, "pos", F.inline(F.array(*hashes))).where("h is not null")


def _items(benchmark: DataFrame) -> DataFrame:
    """``item, item_id, text``: the distinct rows of the benchmark under a key."""
    rows = benchmark.select("item_id", "text").distinct()
    return rows.select(F.xxhash64(F.lit(1), "item_id", "text").alias("item"), "item_id", "text")


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """``item, form, width, n_windows, ipos, h`` of every window to search for; repeated items count once."""
    items = _items(benchmark).select("item", *[c.alias(k) for k, c in readings(F.col("text")).items()])
    items = items.withColumn("own", F.least(F.size("c0"), F.lit(WINDOW))).where(F.col("own") >= MIN_LITERALS)
    wanted = [(f, w) for f in range(len(FORMS)) for w in range(MIN_LITERALS, WINDOW + 1)]

    def literals(c: str) -> Column:
        """The number of literal tokens of each window."""
        ink = F.transform(c, lambda t: ~_placeholder(t))
        starts = F.sequence(F.lit(0), F.size(c) - F.col("own"))
        return bind(ink, lambda x: F.transform(starts, lambda p: F.size(F.filter(F.slice(x, p + 1, F.col("own")), lambda y: y))))

    n_windows = (F.size("c0") - F.col("own") + 1).alias("n_windows")
    items = items.select("item", "own", "c0", "c1", "c2", n_windows, literals("c0").alias("plain"), literals("c1").alias("typed"))
    rows = windows(items, ["item", "own", "n_windows"], wanted, ("plain", "typed")).where("width = own")
    rich = F.when(F.col("form") == 0, F.col("plain") >= MIN_LITERALS)
    rich = rich.when(F.col("form") == TYPED, F.col("typed") >= MIN_LITERALS).otherwise(F.col("typed") < MIN_LITERALS)
    return rows.where(rich).select("item", "form", "width", "n_windows", F.col("pos").alias("ipos"), "h")


def findings(docs: DataFrame, benchmark: DataFrame, window_limit: int = BROADCAST_WINDOWS) -> DataFrame:
    """``doc_id, item_id, n_windows, n_matched, n_slots``: every document and item with enough consistent windows.

    ``n_matched`` counts distinct item windows on consistent alignments,
    ``n_slots`` the slots that were compared, in each form.
    """
    return (
        row_findings(docs, benchmark, window_limit)
        .groupBy("doc_id", "item_id")
        .agg(F.max("n_windows").alias("n_windows"), F.max("n_matched").alias("n_matched"), F.sum("n_slots").alias("n_slots"))
    )


def row_findings(docs: DataFrame, benchmark: DataFrame, window_limit: int = BROADCAST_WINDOWS) -> DataFrame:
    """``k1, k2, doc_id, item, item_id, n_windows, n_matched, n_slots``: the findings by row of the two tables."""
    docs = row_keys(docs.select("doc_id", "text"))
    sought = materialise(benchmark_windows(benchmark), "decontam-windows")
    sizes = sought.groupBy("form", "width").count().collect()  # at most five rows a form
    if not sizes:
        return docs.where(F.lit(False)).select(
            *ROW,
            "doc_id",
            F.lit(0).cast("bigint").alias("item"),
            F.lit(None).cast(benchmark.schema["item_id"].dataType).alias("item_id"),
            *[F.lit(0).cast("bigint").alias(c) for c in ("n_windows", "n_matched", "n_slots")],
        )
    small = sum(r["count"] for r in sizes) <= window_limit
    read = docs.select(*ROW, *[c.alias(k) for k, c in readings(F.col("text")).items()])
    mine = windows(read, [*ROW], sorted((r["form"], r["width"]) for r in sizes)).select(*ROW, "pos", "h")
    hits = mine.join(F.broadcast(sought) if small else sought, "h")
    # One diagonal of one document and item is no longer than the item.
    runs = materialise(
        hits.groupBy(*ROW, "item", "form", "n_windows", (F.col("pos") - F.col("ipos")).alias("diagonal")).agg(
            F.collect_set("ipos").alias("at")
        ),
        "decontam-runs",
    )
    return _consistent(docs, benchmark, runs)


def _consistent(docs: DataFrame, benchmark: DataFrame, runs: DataFrame) -> DataFrame:
    texts = (
        docs.join(runs.select(*ROW).distinct(), [*ROW], "left_semi")
        .groupBy(*ROW)
        .agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    )
    read = F.array(*readings(F.col("text")).values())
    texts = texts.select(*ROW, "doc_id", read.alias("dcs"))
    items = _items(benchmark).select("item", "item_id", read.alias("cs"))
    rows = runs.join(items, "item").join(texts, [*ROW])
    rows = rows.withColumns({"c": F.get("cs", F.col("form")), "dc": F.get("dcs", F.col("form"))})
    rows = rows.withColumns({"w": F.get("cs", F.lit(SURFACE)), "dw": F.get("dcs", F.lit(SURFACE))}).drop("cs", "dcs")
    equal = F.transform("c", lambda x, t: F.coalesce(x == F.get("dc", (t + F.col("diagonal")).cast("int")), F.lit(False)))
    width = F.least(F.size("c"), F.lit(WINDOW))
    starts = F.sequence(F.lit(0), F.size("c") - width)
    whole = bind(equal, lambda e: F.filter(starts, lambda p: F.forall(F.slice(e, p + 1, width), lambda x: x)))
    rows = rows.withColumn("all", whole).drop("dc")

    def slots(at: str) -> Column:
        """Value pairs, with a blank between, of the slots that the windows ``at`` cover."""
        covered = F.array_distinct(F.flatten(F.transform(at, lambda p: F.sequence(p, p + (WINDOW - 1)))))
        inside = F.filter(covered, lambda t: (t < F.size("c")) & _placeholder(F.get("c", t)))
        return F.transform(
            inside, lambda t: F.concat_ws(" ", F.get("w", t), F.get("dw", (t + F.col("diagonal")).cast("int")))
        )

    def one_to_one(pairs: Column) -> Column:
        return F.size(F.array_distinct(F.transform(pairs, lambda x: F.substring_index(x, " ", 1)))) == F.size(F.array_distinct(pairs))

    keys = [*ROW, "doc_id", "item", "item_id"]
    rows = rows.withColumns({"pairs": slots("at"), "more": slots("all")}).withColumn("ok", one_to_one(F.col("more")))
    rows = rows.withColumns({c: F.when(F.col("ok"), F.col(m)).otherwise(F.col(c)) for c, m in (("at", "all"), ("pairs", "more"))})
    rows = rows.select(*keys, "n_windows", "at", "pairs").where(one_to_one(F.col("pairs")))
    matched = F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("bigint")
    return (
        rows.groupBy(*keys)
        .agg(
            F.max("n_windows").cast("bigint").alias("n_windows"),
            matched.alias("n_matched"),
            F.sum(F.size("pairs")).cast("bigint").alias("n_slots"),
        )
        .where(F.col("n_matched") >= F.least(F.lit(NEEDED), F.ceil(F.col("n_windows") / 2)))
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a finding of their own, with their own columns only."""
    bad = row_findings(docs, benchmark).select(*ROW).distinct()
    keyed = row_keys(docs.select(whole_row(docs), "doc_id", "text"))
    return keyed.join(bad, [*ROW], "left_anti").select("__row.*")
