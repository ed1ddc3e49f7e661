"""WARC archives, index first.

Writing gives one index row per record: file, offset, length, URL and digest.
Reading starts from any selection of index rows: their byte ranges are sorted per
file, neighbours are coalesced into one read, and the records are cut out of it.
Every record is a gzip member of its own, so a range can be read without the rest.

Tasks write files with names of their own and hand over index rows only for what
they finished; a task that is run again writes another file, and a file that no
index row names is left over from such a loss. Files are reached through
``pyarrow.fs``, so the folder may be on any store that it knows.

Defined results: null html is an empty payload; a null URL has no target header; a
null page_id comes back as null; of records with equal payloads of at least
``min_bytes`` the one with the smallest page_id is the response (rows that repeat its
page_id as well), the others revisit it; payloads that occur under null page_ids alone
are all responses; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gradeloom.session import scratch_path

from .common import materialise, text_bytes, whole_groups

FILE_BYTES = 128 << 20  # a task starts another file beyond this
READ_BYTES = 8 << 20  # a coalesced read starts within one stretch of this length
TASK_BYTES = 32 << 20  # bytes that one task reads, about
READ_GAP = 64 << 10  # unselected bytes worth reading over
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, url string, record_type string, digest string, file string, offset long, length long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One gzip member. The HTTP header of a revisit keeps the length of the payload that it leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c < " " else c for c in url))
    if kind == "revisit":
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    head.append(f"Content-Length: {len(block)}")
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse(member: bytes) -> dict:
    """Headers, page ids, payload and its full length; a response whose digest does not hold is an error."""
    raw = zlib.decompress(member, 31)
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    full = next(int(x[16:]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != full or payload_digest(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")

    def page(name: str) -> int | None:
        text = fields.get(name, "<urn:page:>")[10:-1]
        return int(text) if text else None

    return {
        "page_id": page("WARC-Record-ID"),
        "url": fields.get("WARC-Target-URI"),
        "record_type": kind,
        "payload_bytes": full,
        "payload_digest": digest,
        "refers_to": page("WARC-Refers-To") if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, record_type, refers_to``."""
    html = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", "url", "html", F.sha1(html.cast("binary")).alias("d"))
    first = keyed.where(text_bytes(F.col("html")) >= min_bytes).groupBy("d").agg(F.min("page_id").alias("first"))
    first = materialise(first.withColumnRenamed("d", "__d"), "warc-first")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return keyed.join(first, F.col("d") == F.col("__d"), "left").select(
        "page_id",
        "url",
        "html",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"),
    )


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows = {k: [] for k in ("page_id", "url", "record_type", "digest", "file", "offset", "length")}
            for page_id, url, html, kind, ref in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                payload = (html or "").encode()
                digest = payload_digest(payload)
                member = record(page_id, url, payload, digest, kind, ref)
                out.write(member)
                for k, v in zip(rows, (page_id, url, kind, digest, name, at, len(member)), strict=True):
                    rows[k].append(v)
                at += len(member)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], names=list(rows))
        if out is not None:
            out.close()

    return write


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> tuple[str, DataFrame]:
    """Write one record per row of ``pages``; the folder and its index, itself a written table."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    planned = plan_records(pages.select(F.col("page_id").cast("bigint"), "url", "html"), min_bytes)
    return folder, materialise(planned.mapInArrow(_writer(folder), INDEX), "warc-index")


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for part, cuts in whole_groups(batches, ["file", "stretch"]):
            files, offsets, lengths = (part.column(c).to_pylist() for c in ("file", "offset", "length"))
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                start = offsets[a]
                with store.open_input_file(f"{root}/{files[a]}") as source:
                    source.seek(start)
                    buffer = source.read(offsets[z - 1] + lengths[z - 1] - start)
                found = [parse(buffer[offsets[i] - start : offsets[i] - start + lengths[i]]) for i in range(a, z)]
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[n] for f in found], k) for n, k in zip(found[0], kinds, strict=True)], names=list(found[0])
                )

    return read


def read_records(folder: str, selected: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the selected index rows: ``page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload``."""
    # A file holds about FILE_BYTES of records, so these windows are bounded.
    order = W.partitionBy("file").orderBy("offset")
    end = F.lag(F.col("offset") + F.col("length")).over(order)
    stretch = F.floor(F.col("offset") / READ_BYTES)
    new = end.isNull() | (F.col("offset") - end > READ_GAP) | (F.lag(stretch).over(order) != stretch)
    ranges = (
        selected.select("file", "offset", "length")
        .withColumn("new", new.cast("int"))
        .withColumn("stretch", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    )
    # Index rows are short, what they point at is not: the number of tasks follows the bytes to be read.
    total = selected.agg(F.sum("length")).first()[0] or 0
    read = (
        ranges.select("file", "stretch", "offset", "length")
        .repartition(max(1, -(-total // TASK_BYTES)), "file", "stretch")
        .sortWithinPartitions("file", "stretch", "offset")
        .mapInArrow(
            _reader(folder),
            "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary",
        )
    )
    return read if payloads else read.drop("payload")
