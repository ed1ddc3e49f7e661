"""Near-duplicate grouping of frames around carried-forward keyframes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import parent_folder
from ..functions.text import strip
from ..session import shared_dir


class Matcher(Protocol):
    """Says which frames show the same scene as a key, per modality."""

    def __call__(self, key: np.ndarray, frames: np.ndarray) -> np.ndarray: ...


class CosineMatch:
    """Feature vectors match at a cosine similarity of ``threshold`` or more."""

    def __init__(self, threshold: float = 0.2):
        self.threshold = threshold

    def __call__(self, key, frames):
        key, frames = np.asarray(key, dtype=np.float64), np.asarray(frames, dtype=np.float64)
        dots = (frames * key).sum(axis=-1)
        scale = np.sqrt((frames * frames).sum(axis=-1)) * np.sqrt((key * key).sum(axis=-1))
        return np.divide(dots, scale, out=np.full(dots.shape, -1.0), where=scale > 0) >= self.threshold


class HammingMatch:
    """Perceptual hashes, held as 0/1 vectors, match within ``max_distance`` bits."""

    def __init__(self, max_distance: int = 10):
        self.max_distance = max_distance

    def __call__(self, key, frames):
        return (np.asarray(frames) != np.asarray(key)).sum(axis=-1) <= self.max_distance


def dedupe_images_first_seen(records: DataFrame, base: str | None = None) -> DataFrame:
    """One row per image path with the second path of its first appearance.

    ``records`` have ``source_json``, ``row_idx``, ``rgb_path`` and
    ``thermal_path``; rows without an image path are skipped.
    """
    rgb = strip(F.coalesce(F.col("rgb_path"), F.lit("")))
    thr = strip(F.coalesce(F.col("thermal_path"), F.lit("")))
    return (
        records.select("source_json", "row_idx", rgb.alias("path"), thr.alias("thermal"))
        .where(F.col("path") != "")
        .groupBy("path")
        .agg(F.min_by("thermal", F.struct("source_json", "row_idx")).alias("thermal_path"))
        .withColumn("folder", parent_folder(F.col("path"), base))
    )


# A folder beyond this many frames is cut into several tasks.
CHUNK_ROWS = 200_000
_RUN = 4


def _matches(match: Matcher, key: tuple, rgb: np.ndarray, thr: np.ndarray) -> np.ndarray:
    """First modality, and the second only where the first fails."""
    hit = np.asarray(match(key[0], rgb), dtype=bool)
    if not hit.all():
        rest = ~hit
        hit[rest] = match(key[1], thr[rest])
    return hit


def _stack(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_numpy()) if len(values) else np.empty((0, 0))


def _fold(match: Matcher):
    """Streaming fold over frames sorted by (folder, path).

    State is one keyframe. A row's ``in_key`` columns, if present and set, give
    the keyframe that arrives from the previous chunk of its folder. The last
    row of a task is followed by one state row with the current keyframe.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folder = key_path = key = chunk = None
        for batch in batches:
            if batch.empty:
                continue
            folders, paths = batch["folder"].to_numpy(), batch["path"].to_numpy()
            rgb, thr = _stack(batch["rgb_vec"]), _stack(batch["thr_vec"])
            keyframes = np.empty(len(batch), dtype=object)
            chunk = batch["chunk"].iloc[-1]
            at, width = 0, _RUN
            while at < len(batch):
                if folders[at] != folder:
                    folder, width = folders[at], _RUN
                    arriving = batch["in_path"].iloc[at] if "in_path" in batch else None
                    if arriving is not None and arriving == arriving:
                        key_path = arriving
                        key = (np.asarray(batch["in_rgb"].iloc[at]), np.asarray(batch["in_thr"].iloc[at]))
                    else:
                        key_path, key = paths[at], (rgb[at], thr[at])
                        keyframes[at] = key_path
                        at += 1
                        continue
                stop = min(at + width, len(batch))
                same = folders[at:stop] == folder
                if not same.all():
                    stop = at + int(np.argmin(same))
                hit = _matches(match, key, rgb[at:stop], thr[at:stop])
                if hit.all():
                    keyframes[at:stop] = key_path
                    at, width = stop, min(width * 2, 4096)
                    continue
                miss = at + int(np.argmin(hit))
                keyframes[at:miss] = key_path
                key_path, key, width = paths[miss], (rgb[miss], thr[miss]), _RUN
                keyframes[miss] = key_path
                at = miss + 1
            yield pd.DataFrame(
                {"chunk": batch["chunk"].to_numpy(), "folder": folders, "path": paths, "keyframe": keyframes,
                 "state_rgb": None, "state_thr": None}
            )
        if folder is not None:
            yield pd.DataFrame(
                {"chunk": [chunk], "folder": [folder], "path": [None], "keyframe": [key_path],
                 "state_rgb": [list(map(float, key[0]))], "state_thr": [list(map(float, key[1]))]}
            )

    return run


_OUT = "chunk int, folder string, path string, keyframe string, state_rgb array<double>, state_thr array<double>"


def keyframe_grouping(frames: DataFrame, match: Matcher, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``(folder, path, keyframe)``: each frame joins the current keyframe of its
    folder or becomes the next one.

    ``frames``: folder, path (unique per folder), rgb_vec, thr_vec. The result
    of a frame depends on the frames before it, so a folder is one sequence.
    Folders are spread over tasks. If one is longer than ``chunk_rows``, all
    frames are cut into sorted ranges that are folded at the same time, each as
    if its first frame were a keyframe. Then every range whose true incoming
    keyframe differs is folded again until nothing changes. Sequences started
    from different keyframes usually meet within a few frames, and a scene of any
    length is crossed at once (:func:`_arriving`), so this takes few rounds. All
    ranges before the first wrong one are right, and that one gets its true keyframe
    in the next round; the outcome is that of one sequential pass.
    """
    spark = frames.sparkSession
    frames = frames.select(
        "folder", "path", F.col("rgb_vec").cast("array<double>"), F.col("thr_vec").cast("array<double>")
    )
    sizes = frames.groupBy("folder").count().agg(F.max("count").alias("top"), F.sum("count").alias("rows")).first()
    total, top = sizes["rows"] or 0, sizes["top"] or 0
    if top <= chunk_rows:
        ordered = frames.repartition("folder").sortWithinPartitions("folder", "path").withColumn("chunk", F.lit(0))
        out = ordered.mapInPandas(_fold(match), _OUT)
        return out.where(F.col("path").isNotNull()).select("folder", "path", "keyframe")

    shared_dir(spark)
    chunks = -(-total // chunk_rows)
    ranged = (
        frames.repartitionByRange(chunks, "folder", "path")
        .sortWithinPartitions("folder", "path")
        .withColumn("chunk", F.spark_partition_id())
        .checkpoint()
    )
    folded = ranged.mapInPandas(_fold(match), _OUT).checkpoint()
    # the part of a range that continues a folder of an earlier range
    heads = ranged.groupBy("chunk", "folder").agg(F.count(F.lit(1)).alias("__rows")).checkpoint()
    used = None
    while True:
        arriving = _arriving(heads, folded.where(F.col("path").isNull()), used).checkpoint()
        changed = arriving
        if used is not None:
            before = used.select("chunk", "folder", F.col("in_path").alias("used_path"))
            changed = arriving.join(before, ["chunk", "folder"], "left").where(
                ~F.col("in_path").eqNullSafe(F.col("used_path"))
            ).drop("used_path")
        changed = changed.checkpoint()
        if changed.isEmpty():
            break
        # one row per range boundary, so the broadcast is bounded by ``chunks``
        redo = ranged.join(F.broadcast(changed), ["chunk", "folder"])
        again = redo.mapInPandas(_fold(match), _OUT)
        kept = folded.join(F.broadcast(changed.select("chunk", "folder")), ["chunk", "folder"], "left_anti")
        # a state row belongs to the last folder of a range; refolding an earlier
        # folder must not replace it
        tails = heads.groupBy("chunk").agg(F.max("folder").alias("folder"))
        states = again.where(F.col("path").isNull()).join(F.broadcast(tails), ["chunk", "folder"], "left_semi")
        folded = kept.unionByName(again.where(F.col("path").isNotNull())).unionByName(states).checkpoint()
        used = arriving
    return folded.where(F.col("path").isNotNull()).select("folder", "path", "keyframe")


def _arriving(heads: DataFrame, states: DataFrame, used: DataFrame | None) -> DataFrame:
    """Incoming keyframe of every range that continues its folder.

    A range that its last incoming keyframe passed through whole makes no keyframe of
    its own, so it hands on whatever comes: the keyframe is taken from the last range
    before it that did make one. A long scene is then crossed in one round.
    """
    tail = F.struct(
        F.col("keyframe").alias("in_path"), F.col("state_rgb").alias("in_rgb"), F.col("state_thr").alias("in_thr")
    )
    known = heads.join(states.select("chunk", "folder", tail.alias("tail")), ["chunk", "folder"], "left")
    if used is not None:
        came = used.select("chunk", "folder", F.col("in_path").alias("came"))
        passed = F.coalesce(F.col("tail.in_path") == F.col("came"), F.lit(False))
        known = known.join(came, ["chunk", "folder"], "left").withColumn("tail", F.when(~passed, F.col("tail")))
    earlier = W.partitionBy("folder").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    return (
        known.withColumn("last", F.last("tail", ignorenulls=True).over(earlier))
        .where(F.col("last").isNotNull())
        .select("chunk", "folder", "last.*")
    )


def pair_similarity(pairs: DataFrame, match: Matcher) -> DataFrame:
    """Add ``matched`` to rows holding both frames' vectors (``a_``/``b_``)."""

    @F.pandas_udf("boolean")
    def matched(a_rgb: pd.Series, b_rgb: pd.Series, a_thr: pd.Series, b_thr: pd.Series) -> pd.Series:
        if not len(a_rgb):
            return pd.Series([], dtype=bool)
        hit = np.asarray(match(_stack(a_rgb), _stack(b_rgb)), dtype=bool)
        rest = ~hit
        if rest.any():
            hit[rest] = match(_stack(a_thr[rest]), _stack(b_thr[rest]))
        return pd.Series(hit, index=a_rgb.index)

    return pairs.withColumn("matched", matched("a_rgb", "b_rgb", "a_thr", "b_thr"))


def keyframe_summary(group_map: DataFrame) -> DataFrame:
    duplicates: Column = F.count_if(F.col("path") != F.col("keyframe"))
    images = F.count(F.lit(1))
    return group_map.agg(
        images.alias("images"),
        F.count_distinct("keyframe").alias("keyframes"),
        duplicates.alias("duplicates"),
        F.when(images > 0, duplicates * 100.0 / images).otherwise(F.lit(0.0)).alias("reduction_pct"),
    )


def evaluated_images(group_map: DataFrame) -> DataFrame:
    return group_map.select(F.col("keyframe").alias("path")).distinct()


def remaining_images(group_map: DataFrame) -> DataFrame:
    """Images that are nobody's keyframe."""
    return group_map.select("path").subtract(group_map.select("keyframe"))
