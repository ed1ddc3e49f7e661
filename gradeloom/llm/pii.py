"""Personal data by weak supervision.

One pass over the texts finds candidate spans and lets labelers vote on each: a
pattern labeler (shape and checksum), a gazetteer labeler (known domains, dial
codes, card prefixes, network ranges, titles, key words) and a context labeler (words around
the span). Expectation-maximisation over the counts of vote patterns, which are
bounded by kinds times 3 ** labelers, estimates how reliable each labeler is for
each kind. Its posteriors are the soft labels on which a logistic span classifier
is trained, over votes, shape and hashed neighbouring words; it is fitted on the counts of
feature patterns of all candidates, which are bounded as well. It then decides on every
candidate of all documents.

Spans of the four strict kinds (email, ip, card, phone) always stay; the classifier
adds others: secret, name, number, handle.

Defined results: null and blank texts have no spans; documents without candidates
keep a row; repeated rows get equal spans; an empty table gives no rows; offsets are
code points, ends exclusive; other columns are passed through as asked.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "name", "number", "handle")
KINDS = BASE + ADDED
LABELERS = ("pattern", "gazetteer", "context")
SHAPES = 32
HASHED = 16
PRIOR = 0.5
EM_ROUNDS = 30

# The patterns of the strict kinds.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# As ``IP``: a match starts where a run of digits starts and takes whole runs, so a long run is read once.
IP_RUNS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")

SECRET = re.compile(r"[:=]\s*[\"']?([A-Za-z0-9_/+-]{16,})")
TITLED = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Sr|Sra|Mme)\.?\x20+(\w[\w'-]+(?:\x20\w[\w'-]+)?)")
NUMBER = re.compile(r"[0-9](?:[0-9().\x20-]{5,24})[0-9]")
HANDLE = re.compile(r"(?<![\w@.])@(\w[\w.]{2,29})")

# Gazetteers and context words.
TOP_DOMAINS = frozenset("com org net edu gov io co de fr es uk info eu".split())
SECRET_WORDS = frozenset("key token secret password passwd pwd apikey credential auth bearer".split())
TITLES = frozenset("mr mrs ms dr prof herr frau sr sra mme".split())
GIVEN_NAMES = frozenset("anna john maria peter paul james mary robert linda michael david hans pierre juan carlos sophie julia thomas".split())
CUES = {
    "email": frozenset("mail email e-mail contact write correo courriel".split()),
    "ip": frozenset("ip host server address login client addr".split()),
    "card": frozenset("card visa mastercard credit debit amex payment tarjeta carte karte".split()),
    "phone": frozenset("phone tel call mobile fax telephone cell telefon teléfono".split()),
    "secret": SECRET_WORDS,
    "name": frozenset("name contact dear signed author by".split()),
    "number": frozenset("phone tel call ssn passport account iban id telephone mobile fax".split()),
    "handle": frozenset("twitter follow instagram user handle account".split()),
}
DOUBTS = frozenset("version page figure section chapter isbn doi vol no example line item".split())
_WORD = re.compile(r"[\w-]+")
_DIGITS = str.maketrans("", "", "+-.() ")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As a search by ``EMAIL``, but only looks around the at signs."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            yield m.span()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the strict kinds in the order of start, then kind."""
    out = [(a, z, "email") for a, z in emails(text)] if "@" in text else []
    if re.search("[0-9]", text):
        for m in IP_RUNS.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((*m.span(), "ip"))
        for m in CARD.finditer(text):
            digits = m[0].translate(_DIGITS)
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def added_candidates(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Wider candidates that do not touch a strict span or each other."""
    found = []
    if "=" in text or ":" in text:
        found += [(*m.span(1), "secret") for m in SECRET.finditer(text)]
    found += [(*m.span(1), "name") for m in TITLED.finditer(text)]
    if re.search("[0-9]", text):
        found += [(*m.span(), "number") for m in NUMBER.finditer(text) if sum(c.isdigit() for c in m[0]) >= 7]
    if "@" in text:
        found += [(*m.span(1), "handle") for m in HANDLE.finditer(text)]
    out: list[tuple[int, int, str]] = []
    busy = sorted(taken)
    starts = [s[0] for s in busy]
    reach = list(accumulate((s[1] for s in busy), max))  # furthest end of the strict spans up to each
    for a, z, kind in sorted(found, key=lambda s: (s[0], KINDS.index(s[2]))):
        earlier = bisect_left(starts, z)  # strict spans that start before z
        if (not out or a >= out[-1][1]) and not (earlier and reach[earlier - 1] > a):
            out.append((a, z, kind))
    return out


def _mixed(span: str) -> bool:
    return any(c.isdigit() for c in span) and any(c.isalpha() for c in span)


def votes(text: str, start: int, end: int, kind: str) -> tuple[int, int, int, list[str]]:
    """Votes of the three labelers (1 for, -1 against, 0 abstains) and the words before the span."""
    span = text[start:end]
    before = [w.lower() for w in _WORD.findall(text[max(0, start - 60) : start])][-4:]
    after = [w.lower() for w in _WORD.findall(text[end : end + 30])][:1]
    digits = span.translate(_DIGITS)
    if kind == "email":
        pattern = 1 if "." in span.rpartition("@")[2].strip(".") and ".." not in span else -1
        gazetteer = 1 if span.rpartition(".")[2].lower() in TOP_DOMAINS else -1
    elif kind == "ip":
        pattern = 1 if all(p == "0" or not p.startswith("0") for p in span.split(".")) else -1
        gazetteer = -1 if span.startswith(("0.", "1.0.", "127.")) else 1
    elif kind == "card":
        pattern = 1 if len(digits) in (14, 15, 16) else -1
        gazetteer = 1 if digits[0] in "3456" else 0
    elif kind == "phone":
        pattern = 1 if 10 <= len(digits) <= 13 and span.count("(") == span.count(")") else -1
        gazetteer = 1 if digits[0] != "0" else -1
    elif kind == "secret":
        pattern = 1 if _mixed(span) and len(set(span)) >= 8 else -1
        gazetteer = 1 if re.fullmatch("[0-9a-f]{32,}|[A-Za-z0-9+/_-]{32,}", span) and _mixed(span) else 0
    elif kind == "name":
        pattern = 1 if all(w[:1].isupper() and w[1:].islower() for w in re.split("[ -]", span) if w) else -1
        gazetteer = 1 if any(w.lower() in GIVEN_NAMES for w in span.split()) else 0
    elif kind == "number":
        pattern = 1 if 9 <= len(digits) <= 15 and span.count("(") == span.count(")") and ".." not in span else -1
        gazetteer = 1 if re.match(r"0[1-9]|00[1-9]|[0-9]{3}-[0-9]{2}-[0-9]{4}$", span) else 0
    else:
        pattern = 1 if not span.isdigit() else -1
        gazetteer = -1 if span.lower() in ("media", "import", "param", "return", "override") else 0
    near = {*before, *after}
    context = 1 if near & CUES[kind] or kind == "name" and near & TITLES else -1 if near & DOUBTS else 0
    return pattern, gazetteer, context, before


def _scan(batches: Iterator[pa.RecordBatch], keep: list[str]) -> Iterator[pa.RecordBatch]:
    kind_no = {k: i for i, k in enumerate(KINDS)}
    for batch in batches:
        lists: dict[str, list] = {n: [] for n in ("kind", "start", "end", "vote", "shape", "near")}
        for text in batch.column("text").to_pylist():
            row: dict[str, list[int]] = {n: [] for n in lists}
            text = text or ""
            base = base_spans(text)
            for a, z, kind in [*base, *added_candidates(text, base)]:
                p, g, c, before = votes(text, a, z, kind)
                row["kind"].append(kind_no[kind])
                row["start"].append(a)
                row["end"].append(z)
                row["vote"].append((p + 1) * 9 + (g + 1) * 3 + c + 1)
                share = sum(x.isdigit() for x in text[a:z]) / (z - a)
                row["shape"].append(min(7, (z - a) // 6) * 4 + min(3, int(share * 4)))
                row["near"].append(zlib.crc32((before[-1] if before else "").encode()) % HASHED)
            for n in lists:
                lists[n].append(row[n])
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in keep), *(pa.array(v, pa.list_(pa.int32())) for v in lists.values())], names=[*keep, *lists]
        )


def candidates(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and, as arrays of equal length, kind, span, votes and features of all candidates."""
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    arrays = [f"{n} array<int>" for n in ("kind", "start", "end", "vote", "shape", "near")]
    found = docs.select(*keep, "text").mapInArrow(lambda b: _scan(b, keep), ", ".join([*kinds, *arrays]))
    return materialise(found, "pii-candidates")


def estimate(patterns: dict[tuple[int, int], int]) -> tuple[dict[tuple[int, int], float], np.ndarray]:
    """EM over counts by (kind, vote code): the posterior of each pattern and P(vote | class) per kind and labeler.

    Per kind a prior and, per labeler, the chances of its three votes given each class;
    it starts from labelers that are mostly right and is kept away from 0 and 1.
    """
    rates = np.tile(np.array([[0.6, 0.25, 0.15], [0.15, 0.25, 0.6]]), (len(KINDS), len(LABELERS), 1, 1))
    prior = np.full(len(KINDS), PRIOR)
    digits = {k: (k[1] // 9, k[1] // 3 % 3, k[1] % 3) for k in patterns}
    post: dict[tuple[int, int], float] = {}
    for _ in range(EM_ROUNDS):
        for k in patterns:
            kind = k[0]
            like = [
                (prior[kind] if y else 1 - prior[kind]) * np.prod([rates[kind, j, y, v] for j, v in enumerate(digits[k])]) for y in (0, 1)
            ]
            post[k] = float(like[1] / (like[0] + like[1]))
        for kind in range(len(KINDS)):
            mine = [k for k in patterns if k[0] == kind]
            if not mine:
                continue
            total = sum(patterns[k] for k in mine)
            prior[kind] = (sum(patterns[k] * post[k] for k in mine) + 2) / (total + 4)
            for j in range(len(LABELERS)):
                for y in (0, 1):
                    # Pseudo-counts that favour labelers better than chance keep the two classes from changing places.
                    tally = np.array([3.0, 2.0, 1.0]) if y == 0 else np.array([1.0, 2.0, 3.0])
                    tally = tally * max(1.0, 0.02 * total)
                    for k in mine:
                        tally[digits[k][j]] += patterns[k] * (post[k] if y else 1 - post[k])
                    rates[kind, j, y] = tally / tally.sum()
    return post, rates


def _features(kind: np.ndarray, vote: np.ndarray, shape: np.ndarray, near: np.ndarray) -> np.ndarray:
    n, k = len(kind), len(KINDS)
    out = np.zeros((n, 2 * k + 9 + SHAPES + HASHED))
    rows = np.arange(n)
    out[rows, kind] = 1
    score = (vote // 9 - 1) + (vote // 3 % 3 - 1) + (vote % 3 - 1)
    out[rows, k + kind] = score
    for j, v in enumerate((vote // 9, vote // 3 % 3, vote % 3)):
        out[rows, 2 * k + 3 * j + v] = 1
    out[rows, 2 * k + 9 + shape] = 1
    out[rows, 2 * k + 9 + SHAPES + near] = 0.5
    return out


def fit(found: DataFrame) -> np.ndarray:
    """Weights of the span classifier from the candidates of all documents."""
    each = found.select(F.explode(F.arrays_zip("kind", "vote", "shape", "near")).alias("c")).select("c.*")
    rows = each.groupBy("kind", "vote").agg(F.count(F.lit(1)).alias("n")).collect()  # at most kinds * 27
    patterns = {(r["kind"], r["vote"]): r["n"] for r in rows}
    width = _features(*[np.zeros(0, dtype=np.int64)] * 4).shape[1]
    if not patterns:
        return np.zeros(width + 1)
    post, _ = estimate(patterns)
    counted = each.groupBy("kind", "vote", "shape", "near").agg(F.count(F.lit(1)).alias("n"))
    sample = counted.toPandas()  # bounded by the feature patterns: kinds * 27 * SHAPES * HASHED
    x = _features(*(sample[c].to_numpy().astype(np.int64) for c in ("kind", "vote", "shape", "near")))
    y = np.array([post[k] for k in zip(sample["kind"], sample["vote"], strict=True)])
    n = sample["n"].to_numpy().astype(float)
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(width + 1)
    for _ in range(12):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-x @ w))
        hessian = (x * (n * p * (1 - p) + 1e-9)[:, None]).T @ x + np.eye(len(w))
        w -= np.linalg.solve(hessian, x.T @ (n * (p - y)) + w)
    return w


def decide(found: DataFrame, weights: np.ndarray, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with counts of the strict kinds, ``base_sha256`` and ``spans``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {c: batch.column(c) for c in ("kind", "start", "end", "vote", "shape", "near")}
            flat = {c: v.flatten().to_numpy().astype(np.int64) for c, v in cols.items()}
            x = _features(flat["kind"], flat["vote"], flat["shape"], flat["near"])
            yes = (x @ weights[:-1] + weights[-1] >= 0) | (flat["kind"] < len(BASE))
            ends = np.cumsum([len(v) for v in cols["kind"]]) if batch.num_rows else np.zeros(0, dtype=int)
            counts, shas, spans = [[] for _ in BASE], [], []
            first = 0
            for end in ends:
                own = sorted((flat["start"][i], flat["kind"][i], flat["end"][i]) for i in range(first, end) if yes[i])
                named = [(f"{KINDS[k]}:{a}:{z}", k < len(BASE)) for a, k, z in own]
                for j, c in enumerate(counts):
                    c.append(sum(k == j for _, k, _ in own))
                shas.append(hashlib.sha256(",".join(s for s, base in named if base).encode()).hexdigest())
                spans.append(",".join(s for s, _ in named))
                first = end
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(spans, pa.string())],
                names=[*keep, *(f"n_{k}" for k in BASE), "base_sha256", "spans"],
            )

    kinds = [f"`{c}` {found.schema[c].dataType.simpleString()}" for c in keep]
    out = [*kinds, *(f"n_{k} long" for k in BASE), "base_sha256 string", "spans string"]
    return found.mapInArrow(run, ", ".join(out))


def find(docs: DataFrame, keep: list[str]) -> DataFrame:
    found = candidates(docs, keep)
    return decide(found, fit(found), keep)
