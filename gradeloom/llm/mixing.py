"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key ``-ln(u) / quality``; small keys come
first. A source's target is met by complete epochs over all its documents, then
by the documents in key order whose prefix sum of sizes stays within what is
left. The gap that remains is closed by one more document, the one behind the cut
whose size comes nearest to the gap, if that comes nearer than leaving it open.
Keys are cut into order-preserving bins per source, so only the bin in which the
budget ends is ever sorted.

Draws hash the seed, the doc_id and the whole text, so reruns agree and rows that
share a null or repeated id are drawn one by one. Rows that repeat in both are
interchangeable: they are counted before anything is sorted.

Defined results: a null source is a source (last in order); null or blank texts
have size 0 and follow their source's epochs; ties in the key are broken by
doc_id, then size, then by a hash of the text; a null, NaN or non-positive quality
counts as the smallest weight; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import count_words, materialise, unit_hash, whole_row

WEIGHT_CYCLE = (5.0, 2.0, 1.0)
MAX_REPEAT = 3
LEAST_QUALITY = 0.05
BINS = 4096
PIECE = 10_000  # rows that one task writes out of one counted row


def text_quality(text: Column) -> Column:
    """Share of letters, digits, blanks and common punctuation, sharpened; at least ``LEAST_QUALITY``."""
    t = F.coalesce(text, F.lit(""))
    odd = F.length(F.regexp_replace(t, r"[^#*$%&|<>{}\[\]\\^~=+_]+", ""))
    return F.greatest(F.lit(LEAST_QUALITY), F.lit(1.0) - F.lit(8.0) * odd / F.greatest(F.length(t), F.lit(1)))


def exponential_key(seed: int, quality: Column, *identity: Column) -> Column:
    usable = F.when(quality > LEAST_QUALITY, F.when(F.isnan(quality), LEAST_QUALITY).otherwise(quality)).otherwise(LEAST_QUALITY)
    return -F.ln(unit_hash(F.lit(seed), *identity)) / usable


def source_targets(sizes: DataFrame, total: Column | None = None) -> DataFrame:
    """``source, source_size, weight, target`` from ``source, source_size``.

    Weights repeat over the sources by code point. Targets share the total by
    weight, capped at ``MAX_REPEAT`` times the source; the excess is shared again.
    The fixpoint is found in one pass: in the order of cap over weight the capped
    sources come first. One row per source goes through these windows.
    """
    named = W.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.array(*[F.lit(w) for w in WEIGHT_CYCLE])
    s = sizes.select("source", "source_size", F.get(cycle, (F.row_number().over(named) - 1) % len(WEIGHT_CYCLE)).alias("weight"))
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    cap = F.col("source_size").cast("double") * MAX_REPEAT
    order = W.orderBy(F.col("ratio"), F.col("source").isNull(), F.col("source"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumns({"cap": cap, "ratio": cap / F.col("weight"), "total": F.sum("source_size").over(everything).cast("double")})
    rest = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weights = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # The level if this source and all later ones are not capped.
    s = s.withColumn("level", rest / weights).withColumn("free", F.col("level") <= F.col("ratio"))
    level = F.min(F.when(F.col("free"), F.struct("ratio", "level"))).over(everything)["level"]
    target = F.when(F.col("cap") <= 0, 0.0).otherwise(F.least(F.col("cap"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight")))
    return s.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, seed: int = 17, quality: Column | None = None) -> DataFrame:
    """``doc_id, source, size, source_size, weight, target, taken`` per row of ``docs``."""
    return _mixed(docs, seed, quality).drop("tie", "copies")


def _mixed(docs: DataFrame, seed: int, quality: Column | None = None) -> DataFrame:
    text = F.col("text")
    narrow = docs.select(
        "doc_id",
        "source",
        count_words(text).alias("size"),
        exponential_key(seed, text_quality(text) if quality is None else quality, F.col("doc_id"), text).alias("key"),
        F.xxhash64(text).alias("tie"),
    )
    # key / (1 + key) is monotone in the key: the bins keep its order.
    narrow = narrow.withColumn("bin", F.floor(F.col("key") / (F.col("key") + 1) * BINS).cast("int"))
    return _take(materialise(narrow, "mix-keys"))


def _take(narrow: DataFrame) -> DataFrame:
    bins = narrow.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))  # at most BINS rows a source
    sizes = bins.groupBy("source").agg(F.sum("bin_size").alias("source_size"))
    targets = source_targets(sizes)
    full = F.col("source_size") > 0
    epochs = F.when(full, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    targets = targets.withColumn("epochs", epochs).withColumn(
        "rest", F.col("target") - F.col("epochs") * F.col("source_size").cast("double")
    )
    before = W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    plan = (
        bins.withColumn("start", F.coalesce(F.sum("bin_size").over(before), F.lit(0)))
        .alias("b")
        .join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
        .select("b.source", "b.bin", "b.bin_size", "b.start", "source_size", "weight", "target", "epochs", "rest")
    )
    # A bin that ends within the budget counts in full; only the one that holds the end is sorted.
    end = F.col("start") + F.col("bin_size")
    edge = (F.col("start") < F.col("rest")) & (end > F.col("rest"))
    plan = plan.withColumns({"whole": end <= F.col("rest"), "edge": edge, "left": F.col("rest") - F.col("start")})
    plan = materialise(plan.drop("start", "bin_size", "rest"), "mix-plan")

    identity = ["key", "doc_id", "size", "tie"]
    counted = _with_bins(narrow, plan.where("edge").select("source", "bin", "left")).groupBy("source", "bin", "left", *identity).agg(
        F.count(F.lit(1)).alias("n")
    )
    words = F.col("n") * F.col("size")
    run = W.partitionBy("source").orderBy(*identity).rowsBetween(W.unboundedPreceding, W.currentRow)
    room = F.col("left") - (F.sum(words).over(run) - words)
    fits = F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least(F.col("n"), F.floor(room / F.col("size"))))).otherwise(0)
    cut = materialise(counted.withColumn("m", fits.cast("bigint")), "mix-cut")

    gaps = cut.groupBy("source").agg((F.first("left") - F.sum(F.col("m") * F.col("size"))).alias("gap"))
    # What stands behind the cut: one row per source and size.
    first = F.min(F.struct(*[c for c in identity if c != "size"], "bin")).alias("first")
    behind = _with_bins(narrow, plan.where("not whole and not edge").select("source", "bin")).where("size > 0")
    open_ = behind.groupBy("source", "size").agg(first).unionByName(cut.where("m < n and size > 0").groupBy("source", "size").agg(first))
    off = F.abs(F.col("gap") - F.col("size"))
    last = (
        open_.alias("o")
        .join(gaps.alias("g"), F.col("o.source").eqNullSafe(F.col("g.source")))
        .where(off < F.col("gap"))
        .groupBy("o.source")
        .agg(F.min(F.struct(off.alias("off"), F.col("first"), F.col("size"))).alias("x"))
        .select("source", "x.first.bin", F.struct("x.first.key", "x.first.doc_id", "x.size", "x.first.tie").alias("last"))
    )
    last = materialise(last, "mix-last")
    same = F.struct(*identity).eqNullSafe(F.col("last"))
    rows = _with_bins(narrow, _with_bins(plan, last, "left"))
    is_last = F.coalesce(same, F.lit(False)) & F.col("last").isNotNull()
    out = ["doc_id", "source", "size", "source_size", "weight", "target", "tie"]
    plain = rows.where(~F.col("edge") & ~is_last).select(*out, (F.col("epochs") + F.col("whole").cast("int")).alias("copies"))
    chosen = rows.where(~F.col("edge") & is_last).groupBy("source", "bin", *identity).agg(F.count(F.lit(1)).alias("n"))
    groups = cut.drop("left").unionByName(chosen.withColumn("m", F.lit(0).cast("bigint")))
    groups = _with_bins(groups, _with_bins(plan, last, "left")).withColumn("m", F.col("m") + is_last.cast("int"))
    # The groups as rows again, in pieces: the first m of n rows are taken once more.
    pieces = groups.select(*out, "epochs", "n", "m", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / PIECE).cast("bigint") - 1)).alias("piece"))
    from_, to = F.col("piece") * PIECE + 1, F.least(F.col("n"), (F.col("piece") + 1) * PIECE)
    pieces = pieces.repartition("source", "doc_id", "tie", "piece").select(*out, "epochs", "m", F.explode(F.sequence(from_, to)).alias("nth"))
    again = pieces.select(*out, (F.col("epochs") + (F.col("nth") <= F.col("m")).cast("int")).alias("copies"))
    every = plain.unionByName(again)
    # A document without words has no part in the last epoch.
    every = every.withColumn("copies", F.when(F.col("size") > 0, F.col("copies")).otherwise(F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)))
    return every.withColumn("copies", F.col("copies").cast("bigint")).withColumn("taken", F.col("copies") * F.col("size"))


def _with_bins(rows: DataFrame, plan: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the further columns of ``plan``, by source and bin."""
    mine = plan.withColumnsRenamed({"source": "__s", "bin": "__b"})
    return rows.join(mine, rows["source"].eqNullSafe(F.col("__s")) & (rows["bin"] == F.col("__b")), how).drop("__s", "__b")


def apply_mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """``docs`` with every row as often as the mix takes it; documents without words follow their source's epochs."""
    once = _mixed(docs, seed).groupBy("doc_id", "source", "size", "tie").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n"))
    once = once.select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("tie").alias("__t"), "copies", "n")
    keyed = docs.select(
        whole_row(docs), F.col("doc_id").alias("__id"), F.col("source").alias("__src"), F.xxhash64(F.col("text")).alias("__tie")
    )
    joined = keyed.join(
        once,
        F.col("__id").eqNullSafe(F.col("__d")) & F.col("__src").eqNullSafe(F.col("__s")) & (F.col("__tie") == F.col("__t")),
    )
    # Rows that repeat share their copies. Only a group at the cut has a remainder, two a source at most;
    # there rows are counted by their hash, and the remainder goes to the first hashes.
    share, rest = F.floor(F.col("copies") / F.col("n")), F.col("copies") % F.col("n")
    even = joined.where(rest == 0).select("__row", share.cast("int").alias("__k"), F.lit(1).cast("bigint").alias("__n"))
    odd = (
        joined.where(rest > 0)
        .withColumns({"__h": F.xxhash64("__row"), "share": share, "rest": rest})
        .groupBy("__d", "__s", "__t", "__h", "share", "rest")
        .agg(F.first("__row").alias("__row"), F.count(F.lit(1)).alias("__n"))
    )
    run = W.partitionBy("__d", "__s", "__t").orderBy("__h").rowsBetween(W.unboundedPreceding, -1)
    room = F.col("rest") - F.coalesce(F.sum("__n").over(run), F.lit(0))
    more = F.greatest(F.lit(0), F.least(F.col("__n"), room))
    odd = odd.select("__row", F.lit(1).alias("__k"), (F.col("share") * F.col("__n") + more).cast("bigint").alias("__n"))
    times = even.unionByName(odd).withColumn("__all", F.col("__k") * F.col("__n")).where("__all > 0")
    return times.select("__row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__all"))).alias("__i")).select("__row.*")
