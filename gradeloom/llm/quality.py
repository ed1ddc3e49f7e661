"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document; the ledger keeps its measurements and
one bit per failed rule. A policy is a named, versioned set of rules: whether it
rejects a document is one ``&`` on the stored bits, and ablations are counts over
bit patterns, so neither reads a text again.

Defined results: a null or blank text has no words and fails ``too_few_words``;
repeated rows are judged row by row; an empty table gives an empty ledger.
Columns of the input other than the text stay as they are; a column of the input
whose name the ledger needs is replaced by the ledger's.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_RUN, INK, bind, split_words, whole_row

WINDOW = 8
SYMBOLS = "#*$%&|<>"

MEASUREMENTS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_capitals",
    "n_marks",
)


@dataclass(frozen=True)
class Rule:
    name: str
    fails: str  # SQL over the measurements


RULES = (
    Rule("too_few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("capitals", "100 * n_capitals > 40 * word_chars"),
    Rule("exclamations", "10 * n_marks > n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("repeated_lines", "n_lines > 3 and 100 * n_dup_lines > 50 * n_lines"),
)
BIT = {rule.name: 1 << i for i, rule in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", 1, ("too_few_words", "repeated_windows"))
DEFAULT = Policy(
    "default",
    2,
    (*BASE.rules, "symbols", "capitals", "exclamations", "short_words", "long_words", "repeated_lines"),
)


def _window_hashes(words: Column) -> Column:
    """One hash per window of eight words; empty below eight words."""

    def over(h: Column) -> Column:
        starts = F.slice(h, F.lit(1), F.greatest(F.size(h) - (WINDOW - 1), F.lit(0)))
        return F.transform(starts, lambda first, i: F.xxhash64(first, *[F.get(h, i + k) for k in range(1, WINDOW)]))

    return bind(F.transform(words, lambda w: F.xxhash64(w)), over)


def _covered(windows: Column) -> Column:
    """Words inside windows whose hash occurs more than once: sort the hashes,
    keep the starts with an equal neighbour, add up the union of their spans."""

    def spans(p: Column) -> Column:
        widths = F.transform(p, lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - at, F.lit(WINDOW))))
        return F.aggregate(widths, F.lit(0), lambda total, w: total + w)

    def repeated(s: Column) -> Column:
        def start(x: Column, i: Column) -> Column:
            before, after = F.get(s, i - 1)["h"], F.get(s, i + 1)["h"]
            twice = F.coalesce(x["h"] == before, F.lit(False)) | F.coalesce(x["h"] == after, F.lit(False))
            return F.when(twice, x["p"])

        return bind(F.sort_array(F.array_compact(F.transform(s, start))), spans)

    pairs = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    return bind(F.sort_array(pairs), repeated)


def _repeat_words(words: Column) -> Column:
    def over(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) < F.size(w), _covered(w)).otherwise(F.lit(0))

    return bind(_window_hashes(words), over)


def _kept_chars(text: Column, drop: str) -> Column:
    return F.length(F.regexp_replace(text, drop, "")).cast("bigint")


def measure(text: Column) -> Column:
    """Struct of all measurements of a text."""
    t = F.coalesce(text, F.lit(""))

    def of_words(words: Column) -> Column:
        return F.struct(F.size(words).alias("n_words"), _repeat_words(words).alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        n = F.size(lines)
        return F.struct(n.alias("n_lines"), (n - F.size(F.array_distinct(lines))).alias("n_dup_lines"))

    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(INK))
    return F.struct(
        bind(split_words(t), of_words).alias("words"),
        bind(lines, of_lines).alias("lines"),
        _kept_chars(t, BLANK_RUN).alias("word_chars"),
        _kept_chars(t, f"[^{SYMBOLS}]+").alias("n_symbols"),
        _kept_chars(t, r"[^\p{Lu}]+").alias("n_capitals"),
        _kept_chars(t, "[^!]+").alias("n_marks"),
    )


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns but the text, the measurements (long) and ``fail_bits`` (long)."""
    own = [c for c in docs.columns if c != text and c not in (*MEASUREMENTS, "fail_bits", "__m")]
    measured = docs.select(*[F.col(f"`{c}`") for c in own], measure(F.col(text)).alias("__m")).select(
        *[F.col(f"`{c}`") for c in own],
        F.col("__m.words.n_words").cast("bigint").alias("n_words"),
        F.col("__m.word_chars").alias("word_chars"),
        F.col("__m.n_symbols").alias("n_symbols"),
        F.col("__m.lines.n_dup_lines").cast("bigint").alias("n_dup_lines"),
        F.col("__m.words.n_repeat_words").cast("bigint").alias("n_repeat_words"),
        F.col("__m.lines.n_lines").cast("bigint").alias("n_lines"),
        F.col("__m.n_capitals").alias("n_capitals"),
        F.col("__m.n_marks").alias("n_marks"),
    )
    bits = F.lit(0).cast("bigint")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(BIT[rule.name])).otherwise(F.lit(0)).cast("bigint"))
    return measured.withColumn("fail_bits", bits)


def rejected(policy: Policy, bits: Column | None = None) -> Column:
    bits = F.col("fail_bits") if bits is None else bits
    return bits.bitwiseAND(F.lit(policy.mask).cast("bigint")) != 0


def apply_policies(led: DataFrame, policies: Sequence[Policy]) -> DataFrame:
    """One boolean column ``kept_<name>_v<version>`` per policy."""
    return led.withColumns({f"kept_{p.name}_v{p.version}": ~rejected(p) for p in policies})


def ablations(led: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of the policy: rows it fails, rows only it fails, and rows kept without it.

    The ledger is first reduced to bit patterns, at most two to the number of rules.
    """
    masked = F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("bigint")).alias("bits")
    patterns = led.groupBy(masked).agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("bigint").alias("bit")) for r in policy.rules])
    one = patterns.select("bits", "n", F.explode(names).alias("r")).select("bits", "n", "r.rule", "r.bit")

    def total(when: Column, name: str) -> Column:
        return F.sum(F.when(when, F.col("n")).otherwise(0)).alias(name)

    return one.groupBy("rule", "bit").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0, "n_failed"),
        total(F.col("bits") == F.col("bit"), "n_only"),
        total((F.col("bits") == 0) | (F.col("bits") == F.col("bit")), "n_kept_without"),
    ).select(F.lit(policy.name).alias("policy"), F.lit(policy.version).alias("version"), "rule", "n_failed", "n_only", "n_kept_without")


def verdicts(docs: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept``."""
    return ledger(docs).withColumns({"base_failed": rejected(BASE), "kept": ~rejected(policy) & ~rejected(BASE)})


def keep(docs: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their own columns only."""
    led = ledger(docs.select(whole_row(docs), "text"))
    return led.where(~rejected(policy) & ~rejected(BASE)).select("__row.*")
