"""Language ID with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram binds the vectors of its
three letters, permuted (rolled) by their place, by elementwise product; a text
bundles (adds) its trigram vectors; a language prototype bundles the texts of the
language. A text gets the language whose centred prototype has the largest cosine
with the text's centred vector; the centre is the bundle of all prototypes.

Because bundling is addition, a prototype only needs the trigram counts of its
language: each text's counts are scaled to length 1, and summed over all training
rows they are at most ``SYMBOLS ** 3`` numbers per language, whatever the corpus.

Defined results: a null text or one without letters is ``und`` with score 0; rows
with a null language or null text teach nothing; without any training row all texts
are ``und``; ties go to the language first in code-point order; repeated rows get
equal predictions; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

DIMENSIONS = 512
SYMBOLS = 64  # 0 is the gap between words, 1 to 26 are a to z, other letters share the rest by hash
UNKNOWN = "und"

_PLANE = 0x3000


def _symbol_table() -> np.ndarray:
    table = np.zeros(_PLANE, dtype=np.uint8)
    for c in range(_PLANE):
        if chr(c).isalpha():
            table[c] = c - 96 if 97 <= c <= 122 else 27 + c * 2654435761 % 2**32 % (SYMBOLS - 27)
    return table


_TABLE = _symbol_table()


def _vectors(seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    letters = np.random.default_rng(seed).choice(np.array([-1, 1], dtype=np.int8), size=(SYMBOLS, DIMENSIONS))
    return np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1), letters


_FIRST, _SECOND, _THIRD = _vectors()


def bound(codes: np.ndarray) -> np.ndarray:
    """Vectors of trigram codes."""
    return _FIRST[codes >> 12] * _SECOND[(codes >> 6) & 63] * _THIRD[codes & 63]


def trigrams(text: str) -> np.ndarray:
    """Codes of all trigrams of the words of a text, each word between gaps; empty if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = np.minimum(points, _PLANE - 1)
    s = _TABLE[low]
    far = points >= _PLANE
    if far.any():
        s = s.copy()
        letters = np.fromiter((chr(c).isalpha() for c in points[far]), dtype=bool)
        s[far] = np.where(letters, 27 + points[far].astype(np.uint64) * 2654435761 % 2**32 % (SYMBOLS - 27), 0)
    s = np.concatenate([[0], s, [0]]).astype(np.int32)
    s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]  # one gap between words
    if len(s) < 3:
        return np.empty(0, dtype=np.int32)
    return (s[:-2] << 12) | (s[1:-1] << 6) | s[2:]


def weights(n: np.ndarray) -> np.ndarray:
    """Trigram counts of one text as a vector of length 1, in thousandths: no text rules its language."""
    return np.rint(1000 * n / np.sqrt(max(1, (n * n).sum()))).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts per language of one task; a row per language and trigram seen."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if lang not in counts:
                counts[lang] = np.zeros(SYMBOLS**3, dtype=np.int64)
            code, n = np.unique(trigrams(text), return_counts=True)
            counts[lang][code] += weights(n)
    for lang, n in counts.items():
        code = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int32)), pa.array(n[code])], names=["lang", "code", "n"]
        )


def train(labelled: DataFrame) -> dict[str, np.ndarray]:
    """Prototype per language from all rows of ``text, lang`` that are not null.

    Only the summed counts come to the driver: at most ``SYMBOLS ** 3`` per language.
    """
    rows = labelled.select("lang", "text").where("lang is not null and text is not null")
    counts = rows.mapInArrow(_count, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    found = materialise(counts, "langid-counts").toPandas()
    out = {}
    for lang, part in found.groupby("lang", sort=True):
        code, n = part["code"].to_numpy(), part["n"].to_numpy().astype(np.float64)
        proto = np.zeros(DIMENSIONS)
        for at in range(0, len(code), 8192):
            proto += n[at : at + 8192] @ bound(code[at : at + 8192]).astype(np.float64)
        out[str(lang)] = proto / np.linalg.norm(proto) if np.linalg.norm(proto) else proto
    return out


def _centred(prototypes: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray, np.ndarray]:
    names = sorted(prototypes)
    grid = np.array([prototypes[n] for n in names]) if names else np.zeros((0, DIMENSIONS))
    centre = grid.mean(axis=0) if len(names) > 1 else np.zeros(DIMENSIONS)
    rest = grid - centre
    size = np.linalg.norm(rest, axis=1, keepdims=True)
    return names, centre, np.divide(rest, size, out=np.zeros_like(rest), where=size > 0)


def _predictor(prototypes: dict[str, np.ndarray], keep: list[str]):
    names, centre, grid = _centred(prototypes)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for i, text in enumerate(texts):
                codes = trigrams(text) if text and names else np.empty(0)
                if not len(codes):
                    continue
                code, n = np.unique(codes, return_counts=True)
                vector = np.zeros(DIMENSIONS)
                for at in range(0, len(code), 8192):
                    vector += n[at : at + 8192].astype(np.float32) @ bound(code[at : at + 8192]).astype(np.float32)
                vector = vector / (np.linalg.norm(vector) or 1.0) - centre
                cosine = grid @ vector / (np.linalg.norm(vector) or 1.0)
                best = int(np.argmax(cosine))
                langs[i], scores[i] = names[best], min(1.0, max(0.0, (1.0 + float(cosine[best])) / 2.0))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(scores)],
                names=[*keep, "lang_pred", "score"],
            )

    return predict


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], keep: list[str]) -> DataFrame:
    """The columns ``keep`` with ``lang_pred`` and ``score``; only the text is an input."""
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return docs.select(*keep, "text").mapInArrow(
        _predictor(prototypes, keep), ", ".join([*kinds, "lang_pred string", "score double"])
    )


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
