"""Interpolated modified Kneser-Ney language model, counted in Spark and kept as sorted hash arrays.

Tokens are the words of the lower-cased (A to Z) text and one end; n-grams also see one
start, which is never predicted. An n-gram is a 64-bit hash, equal n-grams of a chunk of
documents are one entry, and a level of the model is cut into shards by hash range. For
each level, from the longest n-grams down:

1. every chunk sends each shard its sorted hashes with what it knows of them (counts of
   its training texts, or what longer n-grams add to their prefixes and suffixes);
2. the task of a shard merges them into sorted arrays, writes these as a file below the
   shared folder, maps the file into memory, and answers each chunk in the order of its
   hashes: totals, and whether this chunk owns the n-gram, that is, counts it for all;
3. the chunk adds what the n-grams it owns mean for shorter ones.

With all answers a chunk scores its texts. Texts never leave their chunk: chunks are
buckets of a written table, so only hashes and answers are shuffled, about eight bytes
for a different n-gram of a chunk. A frequent n-gram is one entry a chunk, so no shard
depends on it; a task holds one chunk or one shard. Per level, five numbers come to the
driver. New texts are scored by :func:`score` from the files alone.

Probabilities: ``p(w|u) = max(a(uw) - D(a), 0) / a(u.) + gamma(u) p(w|u')`` with ``a``
the count for the longest n-grams and those that begin with the start, else the number
of different words before them; D1, D2 and D3+ come from the numbers of n-grams with
``a`` of 1 to 4 (0.5, 1 and 1.5 where those give none between 0 and their index); the
shortest level mixes with ``1 / (V + 1)``.

Defined results: a null text is an empty one, which has its end only; a null id is not
held out; repeated rows count and are scored each; a table without training text gives
``V = N = 0`` and the score of a uniform model over one token; an empty table gives no
row; a text of any length is one row of a chunk; further columns are not read.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.session import scratch_path

from .common import materialise, text_bytes, whole_groups

ORDER = 2
CHUNK_ROWS = 4096
SHARD_BYTES = 16 << 20  # of text for one shard of every level
ALPHA = 0.1  # added to every count by the plain unigram score

_INK = np.ones(256, dtype=bool)
_INK[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ONE, _TWO = np.random.default_rng(11).integers(1, 2**63, 2, dtype=np.uint64) | np.uint64(1)
_BYTE = np.random.default_rng(12).integers(1, 2**63, 256, dtype=np.uint64)
START, END = np.uint64(1), np.uint64(2)
FIELDS = ("adj", "raw", "sum", "n1", "n2", "n3")  # of a shorter level; the longest has adj only


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of start, words and end of every text one after the other, and where texts begin."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    ink = _INK[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    begin = offsets[:-1][offsets[:-1] < len(data)]
    first[begin] |= ink[begin]
    starts = np.flatnonzero(first)
    words = np.empty(0, dtype=np.uint64)
    if len(starts):
        data, ink = data[starts[0] :], ink[starts[0] :]
        offsets, starts = offsets - starts[0], starts - starts[0]
        place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
        power = np.cumprod(np.full(int(place.max()) + 1, _ONE, dtype=np.uint64))
        value = _BYTE[_LOWER[data]] * power[place]
        value[~ink] = 0
        words = _mix(np.add.reduceat(value, starts))
    n = np.diff(np.searchsorted(starts, offsets))
    at = np.concatenate([[0], np.cumsum(n + 2)])
    out = np.empty(at[-1], dtype=np.uint64)
    ends = np.zeros(at[-1], dtype=bool)
    ends[at[:-1]] = True
    ends[at[1:] - 1] = True
    out[~ends] = words
    out[at[:-1]], out[at[1:] - 1] = START, END
    return out, at


class Chunk:
    """N-grams of the texts of one chunk."""

    def __init__(self, texts: pa.Array, train: np.ndarray, order: int):
        word, at = tokens(texts)
        self.at, self.train = at, np.repeat(train, np.diff(at))
        place = np.arange(len(word)) - np.repeat(at[:-1], np.diff(at))
        self.hash, self.keys, self.index = {}, {}, {}
        self.full = {k: place >= k - 1 for k in range(1, order + 1)}
        self.opens = {k: place == k - 1 for k in range(1, order + 1)}  # n-grams that begin with the start
        h = word
        for k in range(1, order + 1):
            if k > 1:
                longer = np.zeros_like(h)
                longer[1:] = _mix(h[:-1] * _ONE + word[1:] * _TWO + np.uint64(k))
                h = longer
            self.hash[k] = h
            keys, index = np.unique(h[self.full[k]], return_inverse=True)
            self.keys[k] = keys
            self.index[k] = np.full(len(word), -1)
            self.index[k][self.full[k]] = index
        self.predicted = place > 0

    def counts(self, k: int, where: np.ndarray) -> np.ndarray:
        return np.bincount(self.index[k][where & self.full[k]], minlength=len(self.keys[k]))

    def sends(self, k: int, order: int, above: dict[str, np.ndarray] | None) -> dict[str, np.ndarray]:
        """What this chunk knows of its n-grams of level ``k``, given the answers for level ``k + 1``."""
        if k == order:
            return {"adj": self.counts(k, self.train & self.predicted)} | ({f: np.zeros(len(self.keys[k]), dtype=np.int64) for f in FIELDS[2:]} | {"raw": self.counts(k, self.train & self.predicted)} if k == 1 else {})
        size = len(self.keys[k])
        # One position per longer n-gram that this chunk owns.
        longer = self.full[k + 1]
        position = np.zeros(len(self.keys[k + 1]), dtype=np.int64)
        position[self.index[k + 1][longer]] = np.flatnonzero(longer)
        mine = np.flatnonzero(above["own"] > 0)
        position, a = position[mine], above["adj"][mine]
        before, after = self.index[k][position - 1], self.index[k][position]
        out = {"adj": np.bincount(after, minlength=size)}
        if k > 1:
            out["adj"] = out["adj"] + self.counts(k, self.train & self.opens[k])
        out["raw"] = self.counts(1, self.train & self.predicted) if k == 1 else np.zeros(size, dtype=np.int64)
        out["sum"] = np.bincount(before, weights=a, minlength=size).astype(np.int64)
        for i in (1, 2, 3):
            out[f"n{i}"] = np.bincount(before[(a == i) if i < 3 else (a > 2)], minlength=size)
        return out


def _pack(values: np.ndarray) -> bytes:
    """Numbers of 0 or more in the narrowest width; the first byte says which."""
    most = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w) - (w == 8))
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype=f"<u{blob[0]}", offset=1).astype(np.int64)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted different hashes as their gaps, in as many bytes as the largest needs."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return bytes([width]) + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack_keys(blob: bytes) -> np.ndarray:
    width = blob[0]
    cells = np.zeros(((len(blob) - 1) // width, 8), dtype=np.uint8)
    cells[:, :width] = np.frombuffer(blob, dtype=np.uint8, offset=1).reshape(-1, width)
    return np.cumsum(cells.view("<u8").ravel(), dtype=np.uint64)


def _bounds(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where the hashes of every shard begin."""
    edges = np.array([(s << 64) // shards for s in range(1, shards)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


@dataclass(frozen=True)
class Level:
    """Files of one level, and its totals: n-grams with ``adj`` of 1 to 4 and of 3 or more, sum of ``adj``, ``raw`` and its number."""

    files: dict[int, str]
    n: tuple[int, int, int, int]
    n3_up: int
    total: int
    raw_total: int
    raw_kinds: int

    def discounts(self) -> np.ndarray:
        n1, n2, n3, n4 = self.n
        out = np.array([0.0, 0.5, 1.0, 1.5])
        if n1 and n2:
            y = n1 / (n1 + 2 * n2)
            for i, (low, high) in enumerate(((n1, n2), (n2, n3), (n3, n4)), start=1):
                d = i - (i + 1) * y * high / low if low else -1.0
                if 0 < d < i and high:
                    out[i] = d
        return out


@dataclass(frozen=True)
class Model:
    order: int
    shards: int
    levels: dict[int, Level]
    fields: dict[int, tuple[str, ...]]


REQUEST = "shard int, chunk long, keys binary, `values` array<binary>"
ANSWER = "shard int, chunk long, answers array<binary>, stats array<long>, file string"


def _fields(k: int, order: int) -> tuple[str, ...]:
    return FIELDS if k < order or k == 1 else ("adj",)


def _told(table: pa.Table, fields: tuple[str, ...]) -> dict[str, np.ndarray]:
    """Answers of all shards of one level for one chunk."""
    order = np.argsort(np.asarray(table.column("shard")), kind="stable")
    lists = [table.column("answers")[int(i)].as_py() for i in order]
    return {f: np.concatenate([_unpack(x[j]) for x in lists] or [np.empty(0, dtype=np.int64)]) for j, f in enumerate((*fields, "own"))}


def _all_told(table: pa.Table, order: int) -> dict[int, dict[str, np.ndarray]]:
    level = np.asarray(table.column("level"))
    return {k: _told(table.filter(pa.array(level == k)), _fields(k, order)) for k in range(1, order + 1) if (level == k).any()}


def _rows_in_order(left: pa.Table) -> pa.Table:
    return left.take(pa.array(np.argsort(np.asarray(left.column("__row")), kind="stable")))


def _asker(k: int, order: int, shards: int, learn: bool):
    def ask(key: tuple, left: pa.Table, right: pa.Table | None) -> pa.Table:
        left = _rows_in_order(left)
        train = np.asarray(left.column("train")) & learn
        chunk = Chunk(left.column("text").combine_chunks(), train, min(order, k + 1))
        above = _told(right, _fields(k + 1, order)) if learn and right is not None else None
        keys = chunk.keys[k]
        sent = chunk.sends(k, order, above) if learn else {}
        bounds = _bounds(keys, shards)
        used = [s for s in range(shards) if bounds[s] < bounds[s + 1]]
        cut = [slice(bounds[s], bounds[s + 1]) for s in used]
        return pa.Table.from_arrays(
            [
                pa.array(used, pa.int32()),
                pa.array([key[0].as_py()] * len(used), pa.int64()),
                pa.array([_pack_keys(keys[c]) for c in cut], pa.binary()),
                pa.array([[_pack(sent[f][c]) for f in _fields(k, order)] if learn else [] for c in cut], pa.list_(pa.binary())),
            ],
            names=["shard", "chunk", "keys", "values"],
        )

    return ask


def _asked(chunks: DataFrame, k: int, order: int, shards: int, learn: bool, above: DataFrame | None = None) -> DataFrame:
    """Requests of all chunks for level ``k``."""
    ask = _asker(k, order, shards, learn)
    if above is None:
        return chunks.select("chunk", "__row", "train", "text").groupBy("chunk").applyInArrow(lambda key, left: ask(key, left, None), REQUEST)
    return _with_answers(chunks, ["train", "text"], above.select("shard", "chunk", "answers")).applyInArrow(ask, REQUEST)


def _merge(keys: list[np.ndarray], values: list[list[np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted different hashes with their summed values."""
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    return flat[first], [np.add.reduceat(np.concatenate(v)[order], first) for v in values]


def _save(folder: str, shard: int, keys: np.ndarray, values: list[np.ndarray]) -> str:
    """One file: number of n-grams, hashes, then each field as 8-byte or, if that holds it, 4-byte numbers."""
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    name = f"{shard}-{uuid.uuid4().hex}.arrays"
    widths = [4 if not len(v) or int(v.max()) < 2**32 else 8 for v in values]
    with store.open_output_stream(f"{root}/{name}") as out:
        out.write(np.array([len(keys), *widths], dtype="<u8").tobytes())
        out.write(keys.tobytes())
        for v, w in zip(values, widths, strict=True):
            out.write(v.astype(f"<u{w}").tobytes())
    return f"{folder.rstrip('/')}/{name}"


def _mapped(path: str, fields: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The arrays of a shard's file, mapped; a store that is no mounted folder is copied to a file without a name first."""
    store, place = fs.FileSystem.from_uri(path)
    if isinstance(store, fs.LocalFileSystem):
        source = place
    else:
        source = tempfile.TemporaryFile()
        with store.open_input_stream(place) as stream:
            while block := stream.read(1 << 24):
                source.write(block)
        source.flush()
    data = np.memmap(source, dtype=np.uint8, mode="r")
    head = data[: 8 * (1 + fields)].view("<u8")
    n, at = int(head[0]), 8 * (1 + fields)
    keys, at = data[at : at + 8 * n].view("<u8"), at + 8 * n
    values = []
    for w in head[1:].tolist():
        values.append(data[at : at + w * n].view(f"<u{w}"))
        at += w * n
    return keys, values


def _find(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.searchsorted(keys, asked)
    known = place < len(keys)
    known[known] = keys[place[known]] == asked[known]
    return place, known


def _looked_up(keys: np.ndarray, values: list[np.ndarray], asked: np.ndarray) -> list[np.ndarray]:
    place, known = _find(keys, asked)
    out = []
    for v in values:
        found = np.zeros(len(asked), dtype=np.int64)
        found[known] = v[place[known]]
        out.append(found)
    return out


def _settler(folder: str, n_fields: int):
    """Merge the requests of a shard into its file, then answer them from the mapped file."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, cuts in whole_groups(batches, ["shard"]):
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                group = part.slice(a, z - a)
                shard = group.column("shard")[0].as_py()
                asked = [_unpack_keys(b.as_py()) for b in group.column("keys")]
                sent = [[_unpack(b) for b in row.as_py()] for row in group.column("values")]
                keys, values = _merge(asked, [[row[f] for row in sent] for f in range(n_fields)])
                known = np.logical_or.reduce([v > 0 for v in values])
                path = _save(folder, shard, keys[known], [v[known] for v in values])
                keys, values = _mapped(path, n_fields)
                adj = values[0]
                raw = values[1] if n_fields > 1 else np.empty(0, dtype=np.int64)
                stats = [*(int((adj == i).sum()) for i in (1, 2, 3, 4)), int((adj > 2).sum()), int(adj.sum()), int(raw.sum()), int((raw > 0).sum())]
                taken = np.zeros(len(keys), dtype=bool)
                for i, (chunk, mine) in enumerate(zip(group.column("chunk").to_pylist(), asked, strict=True)):
                    place, found = _find(keys, mine)
                    own = np.zeros(len(mine), dtype=np.int64)
                    own[found] = ~taken[place[found]]
                    taken[place[found]] = True
                    answer = [_pack(v) for v in _looked_up(keys, values, mine)] + [_pack(own)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([shard], pa.int32()),
                            pa.array([chunk], pa.int64()),
                            pa.array([answer], pa.list_(pa.binary())),
                            pa.array([stats if i == 0 else None], pa.list_(pa.int64())),
                            pa.array([path if i == 0 else None], pa.string()),
                        ],
                        names=["shard", "chunk", "answers", "stats", "file"],
                    )

    return settle


def _answerer(files: dict[int, str], n_fields: int):
    """Answer the requests of new texts from the mapped files."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, cuts in whole_groups(batches, ["shard"]):
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                group = part.slice(a, z - a)
                shard = group.column("shard")[0].as_py()
                arrays = _mapped(files[shard], n_fields) if shard in files else (np.empty(0, dtype=np.uint64), [np.empty(0, dtype=np.int64)] * n_fields)
                for chunk, keys in zip(group.column("chunk").to_pylist(), group.column("keys"), strict=True):
                    mine = _unpack_keys(keys.as_py())
                    told = [_pack(v) for v in _looked_up(*arrays, mine)] + [_pack(np.zeros(len(mine), dtype=np.int64))]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([shard], pa.int32()),
                            pa.array([chunk], pa.int64()),
                            pa.array([told], pa.list_(pa.binary())),
                            pa.array([None], pa.list_(pa.int64())),
                            pa.array([None], pa.string()),
                        ],
                        names=["shard", "chunk", "answers", "stats", "file"],
                    )

    return answer


def log10_probabilities(chunk: Chunk, told: dict[int, dict[str, np.ndarray]], levels: dict[int, Level], order: int) -> np.ndarray:
    """Of every position; 0 at starts."""
    first = levels[1]
    p = np.full(len(chunk.train), 1.0 / (first.raw_kinds + 1))
    for k in range(1, order + 1):
        d = levels[k].discounts()
        here = chunk.full[k] & chunk.predicted
        index = chunk.index[k]
        a = told[k]["adj"][index[here]]
        if k == 1:
            total = np.full(len(a), first.total, dtype=np.int64)
            mass = np.full(len(a), d[1] * first.n[0] + d[2] * first.n[1] + d[3] * first.n3_up)
        else:
            context = chunk.index[k - 1][np.flatnonzero(here) - 1]
            below = told[k - 1]
            total = below["sum"][context]
            mass = d[1] * below["n1"][context] + d[2] * below["n2"][context] + d[3] * below["n3"][context]
        share = np.maximum(total, 1)
        seen = np.maximum(a - d[np.minimum(a, 3)], 0.0) / share + mass / share * p[here]
        p[here] = np.where(total > 0, seen, p[here])
    p[~chunk.predicted] = 1.0
    return np.log10(p)


def _scorer(levels: dict[int, Level], order: int, keep: list[str], names: list[str]):
    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        left = _rows_in_order(left)
        chunk = Chunk(left.column("text").combine_chunks(), np.zeros(left.num_rows, dtype=bool), order)
        told = _all_told(right, order)
        logs = log10_probabilities(chunk, told, levels, order)
        c = told[1]["raw"][chunk.index[1]]
        first = levels[1]
        plain = np.log10((c + ALPHA) / (first.raw_total + ALPHA * (first.raw_kinds + 1)))
        at = chunk.at[:-1]
        per = lambda v: np.add.reduceat(np.where(chunk.predicted, v, 0), at)
        out = {"n_tokens": np.diff(chunk.at) - 1, "n_known": per((c > 0).astype(np.int64)), "base_score": per(plain), "score": per(logs)}
        return pa.Table.from_arrays([*(left.column(x) for x in keep), *(pa.array(out[x]) for x in names)], names=[*keep, *names])

    return score


def _chunked(docs: DataFrame, keep: list[str], train: Column) -> tuple[DataFrame, int]:
    """Rows with ``chunk, __row, train, text`` in a bucketed table below the shared folder; and a fitting number of shards."""
    spark = docs.sparkSession
    row = F.monotonically_increasing_id()
    rows = docs.select(
        *[F.col(f"`{c}`") for c in keep if c != "text"], F.col("text"), train.alias("train"), text_bytes(F.col("text")).alias("__bytes"), row.alias("__row")
    ).withColumn("chunk", F.expr(f"__row div {CHUNK_ROWS}"))
    # Bucketing needs the number of buckets first; the size of the texts is one number.
    size = docs.agg(F.sum(text_bytes(F.col("text")))).first()[0] or 0
    shards = int(max(1, -(-size // SHARD_BYTES)))
    buckets = max(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"kneserney_{uuid.uuid4().hex}"
    rows.write.option("path", scratch_path(spark, "kneserney-chunks")).option("compression", "zstd").bucketBy(buckets, "chunk").saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"drop table {name}")  # the name only: the files lie outside the warehouse and stay
    return found, shards


def _routed(requests: DataFrame, shards: int) -> DataFrame:
    return requests.repartitionById(shards, "shard").sortWithinPartitions("shard", "chunk")


def _with_answers(chunks: DataFrame, columns: list[str], answers: DataFrame):
    return chunks.select("chunk", "__row", *columns).groupBy("chunk").cogroup(answers.groupBy("chunk"))


def _score_rows(chunks: DataFrame, answers: dict[int, DataFrame], levels: dict[int, Level], order: int, keep: list[str]) -> DataFrame:
    told = None
    for k, part in answers.items():
        part = part.select("shard", "chunk", "answers", F.lit(k).alias("level"))
        told = part if told is None else told.unionByName(part)
    names = ["n_tokens", "n_known", "base_score", "score"]
    kinds = ", ".join([f"`{c}` {chunks.schema[c].dataType.simpleString()}" for c in keep] + ["n_tokens long, n_known long, base_score double, score double"])
    return _with_answers(chunks, list(dict.fromkeys([*keep, "text"])), told).applyInArrow(_scorer(levels, order, keep, names), kinds)


def train_and_score(docs: DataFrame, train: Column, keep: list[str], order: int = ORDER) -> tuple[Model, DataFrame]:
    """Learn from the rows of ``text`` where ``train`` is true, and score all rows.

    The columns ``keep`` come with ``n_tokens, n_known, base_score, score``.
    """
    spark = docs.sparkSession
    chunks, shards = _chunked(docs, keep, train)
    folder = scratch_path(spark, "kneserney-model")
    answers, levels = {}, {}
    for k in range(order, 0, -1):
        fields = _fields(k, order)
        asked = _asked(chunks, k, order, shards, True, answers.get(k + 1))
        settled = _routed(asked, shards).mapInArrow(_settler(f"{folder}/{k}", len(fields)), ANSWER)
        answers[k] = materialise(settled, f"kneserney-answers-{k}")
        levels[k] = _level(answers[k])
    model = Model(order, shards, levels, {k: _fields(k, order) for k in levels})
    return model, _score_rows(chunks, answers, levels, order, keep)


def _level(answers: DataFrame) -> Level:
    """Totals of a level, and the file of every shard: one short row a shard comes to the driver."""
    rows = answers.where("stats is not null").select("shard", "stats", "file").collect()
    stats = np.sum([r["stats"] for r in rows] or [[0] * 8], axis=0).tolist()
    return Level({r["shard"]: r["file"] for r in rows}, tuple(stats[:4]), *stats[4:])


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Score texts with a model made before; the columns of :func:`train_and_score`."""
    chunks, _ = _chunked(docs, keep, F.lit(False))
    answers = {}
    for k in range(model.order, 0, -1):
        asked = _asked(chunks, k, model.order, model.shards, False)
        answers[k] = _routed(asked, model.shards).mapInArrow(_answerer(model.levels[k].files, len(model.fields[k])), ANSWER)
    return _score_rows(chunks, answers, model.levels, model.order, keep)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity of the model and of the plain unigram score, per ``held_out``."""
    ten = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(ten("score").alias("perplexity"), ten("base_score").alias("base_perplexity"))
