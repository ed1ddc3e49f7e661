"""Image files as rows."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from .json_files import plain_path


# Spark counts 4 MB for opening a file, so a task would list 32 files; a listing opens none.
LISTING = {"spark.sql.files.openCostInBytes": "4096"}


def list_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """``(path, length)``, listed once; the content column is pruned, so no file is opened.

    Folders are listed by many tasks if there are more than
    ``spark.sql.sources.parallelPartitionDiscovery.threshold``, so spread many files over folders.
    """
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
        .select(plain_path(F.col("path")).alias("path"), "length")
    )
    before = {c: spark.conf.get(c) for c in LISTING}
    try:
        for c, value in LISTING.items():
            spark.conf.set(c, value)
        return materialise(found, "files")
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)


def scan_images(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """``(path, length, content)``, undecoded."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
        .select(plain_path(F.col("path")).alias("path"), "length", "content")
    )


def image_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Decoded geometry ``(path, width, height, n_channels)``; broken images drop out."""
    images = spark.read.format("image").option("dropInvalid", True).load(path)
    return images.select(
        plain_path(F.col("image.origin")).alias("path"),
        F.col("image.width").cast("bigint").alias("width"),
        F.col("image.height").cast("bigint").alias("height"),
        F.col("image.nChannels").alias("n_channels"),
    )


HEADER = "path string, format string, width long, height long, n_channels long, error string"

# Segments of a JPEG before its frame header; real files have some tens.
MAX_SEGMENTS = 10_000
_PNG_CHANNELS = {0: 1, 2: 3, 3: 3, 4: 2, 6: 4}


def read_header(read: Callable[[int, int], bytes]) -> tuple[str, int, int, int]:
    """``(format, width, height, n_channels)``; ``read(at, n)`` gives a byte range.

    PNG and GIF tell it in their first bytes. In a JPEG the frame header comes after
    segments of any length, which are stepped over, not read.
    """
    head = read(0, 26)
    if head[:8] == b"\x89PNG\r\n\x1a\n" and head[12:16] == b"IHDR" and len(head) == 26:
        width, height, _, kind = struct.unpack(">IIBB", head[16:26])
        if not width or not height or kind not in _PNG_CHANNELS:
            raise ValueError("bad PNG header")
        return "png", width, height, _PNG_CHANNELS[kind]
    if head[:6] in (b"GIF87a", b"GIF89a") and len(head) >= 10:
        return "gif", *struct.unpack("<HH", head[6:10]), 3
    if head[:2] != b"\xff\xd8":
        raise ValueError("empty file" if not head else "not a PNG, JPEG or GIF")
    at = 2
    for _ in range(MAX_SEGMENTS):
        part = read(at, 10)
        if len(part) < 4 or part[0] != 0xFF:
            break
        kind = part[1]
        if kind == 0xFF:  # a fill byte
            at += 1
        elif kind == 0x01 or 0xD0 <= kind <= 0xD7:  # markers without a length
            at += 2
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            if len(part) < 10:
                break
            height, width, channels = struct.unpack(">HHB", part[5:10])
            return "jpeg", width, height, channels
        elif kind in (0xD9, 0xDA):  # the end, or picture data without a frame header
            break
        else:
            at += 2 + struct.unpack(">H", part[2:4])[0]
    raise ValueError("no JPEG frame header")


def _ranged(path: str) -> tuple[str, int, int, int]:
    store, inside = fs.FileSystem.from_uri(path)
    with store.open_input_file(inside) as f:

        def read(at: int, n: int) -> bytes:
            f.seek(at)
            return f.read(n)

        return read_header(read)


def image_headers(files: DataFrame) -> DataFrame:
    """``path, format, width, height, n_channels, error``: one row per file, broken ones too; no pixel is decoded.

    ``files`` is a result of :func:`list_files`, whose files are opened by byte ranges
    on any store that ``pyarrow.fs`` knows, or of :func:`scan_images`, whose bytes
    Spark has read, for stores that only Spark reads. A null path or content is an error
    row. Spark's listing leaves out files without a byte, so those have no row.
    """
    given = "content" in files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, rows = batch.column("path").to_pylist(), []
            sources = batch.column("content") if given else paths
            for source in sources:
                try:
                    if given:
                        data = source.as_py()
                        rows.append((*read_header(lambda at, n, data=data: data[at : at + n]), None))
                    else:
                        rows.append((*_ranged(source), None))
                except Exception as exc:  # noqa: BLE001 - whatever is wrong with a file is data
                    rows.append((None, None, None, None, f"{type(exc).__name__}: {exc}"))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(paths, pa.string()), *columns], names=["path", "format", "width", "height", "n_channels", "error"]
            )

    return files.select("path", *(["content"] if given else [])).mapInArrow(run, HEADER)
