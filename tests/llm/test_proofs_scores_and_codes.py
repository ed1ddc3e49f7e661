"""Merkle manifest, Kneser-Ney scoring and product codes against plain specifications."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import kneserney, merkle, vectorcode

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, digest string, chunk int, train string"


def _docs(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 1, "clash") for r in rows], DOCS)


def _key(row):
    return tuple(map(str, row))


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _leaf(row, more=0):
    doc_id, text, lang, source, n = row
    return _h(*map(_field, (doc_id, source, lang, None if n is None else n + more, text)))


def _tree(nodes, fanout):
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(paths):
            run = nodes[at[i] // fanout * fanout : at[i] // fanout * fanout + fanout]
            p.append((run[: at[i] % fanout], run[at[i] % fanout + 1 :]))
            at[i] //= fanout
        nodes = [_h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def _audited(rows, fanout):
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        mine = sorted(by[lang], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
        trees.append((mine, *_tree([_leaf(r) for r in mine], fanout)))
    root, over = _tree([t[1] for t in trees], fanout)
    out = []
    for (mine, sub, paths), above in zip(trees, over, strict=True):
        for r, p in zip(mine, paths, strict=True):
            node = _leaf(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            for left, right in p + above:
                node = _h(*left, node, *right)
            out.append((r[0], _leaf(r), sub, root, _h(*("".join(a + b) for a, b in p + above)), node, node == root))
    return out


@pytest.mark.parametrize("shape", [merkle.Shape(2, 10), merkle.Shape(2, 2), merkle.Shape(3, 1)])
def test_every_row_is_proved(spark, shape):
    r = random.Random(1)
    rows = [(i, f"t é{i}", r.choice(["en", "en", "fr", None, "é", ""]), r.choice(["a", None]), r.choice([1, 2, None])) for i in range(150)]
    rows += [(None, None, "alone", None, None), (1 << 62, "x" * 100_000, "en", "a", (1 << 63) - 1)]
    rows += [(5, "x", "en", "a", 1)] * 9 + [(5, "y", "en", "a", 1)] + [(None, "q", "en", "z", 9)] * 3
    got = [tuple(x) for x in merkle.audit(_docs(spark, rows).repartition(5), shape).collect()]
    assert sorted(got, key=_key) == sorted(_audited(rows, shape.fanout), key=_key)
    assert {x[-1] for x in got} == {True, False}


def test_a_request_reads_its_path_only_and_no_rows_give_no_root(spark):
    rows = [(i, str(i), "en", None, i) for i in range(70)]
    leaves = _docs(spark, rows).select("doc_id", "lang", merkle.leaf_digest(F.col("doc_id")).alias("digest"))
    manifest = merkle.build(leaves, "lang", "doc_id", merkle.Shape(2, 2))
    asked = manifest.leaves.where("rank in (0, 41, 69)").select("tree", "rank")
    proved = merkle.prove(manifest, asked).select("rank", merkle.fold(F.lower(F.hex("digest")), F.col("proof")).alias("folded"), F.size("proof").alias("n"))
    assert {(x["rank"], x["folded"], x["n"]) for x in proved.collect()} == {(i, manifest.root, 7) for i in (0, 41, 69)}
    assert merkle.audit(_docs(spark, rows).where("false")).count() == 0


def _train(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 != 0


def _discounts(counts):
    n = Counter(counts.values())
    out = [0, 0.5, 1.0, 1.5]
    if n[1] and n[2]:
        y = n[1] / (n[1] + 2 * n[2])
        for i in (1, 2, 3):
            d = i - (i + 1) * y * n[i + 1] / n[i] if n[i] else -1
            if 0 < d < i and n[i + 1]:
                out[i] = d
    return out


def _scored(rows, order):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    seqs = [(i, ["<start>", *re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)), "<end>"]) for i, t in rows]
    learn = [s for i, s in seqs if _train(i)]
    words = Counter(w for s in learn for w in s[1:])
    c = {order: Counter(tuple(s[j - order + 1 : j + 1]) for s in learn for j in range(max(1, order - 1), len(s)))}
    for k in range(order - 1, 0, -1):
        c[k] = Counter(g[1:] for g in c[k + 1])
        if k > 1:
            c[k].update(tuple(s[:k]) for s in learn if len(s) >= k)
    d, sums = {k: _discounts(c[k]) for k in c}, {k: defaultdict(lambda: [0, 0, 0, 0]) for k in c}
    for k in c:
        for g, a in c[k].items():
            sums[k][g[:-1]][0] += a
            sums[k][g[:-1]][min(a, 3)] += 1
    v, n = len(words), sum(words.values())
    out = []
    for i, s in seqs:
        score = plain = known = 0
        for j in range(1, len(s)):
            p = 1 / (v + 1)
            for k in range(1, min(order, j + 1) + 1):
                g = tuple(s[j - k + 1 : j + 1])
                t = sums[k].get(g[:-1])
                if t:
                    p = max(c[k][g] - d[k][min(c[k][g], 3)], 0) / t[0] + sum(d[k][x] * t[x] for x in (1, 2, 3)) / t[0] * p
            score, plain, known = score + math.log10(p), plain + math.log10((words[s[j]] + 0.1) / (n + 0.1 * (v + 1))), known + (words[s[j]] > 0)
        out.append((i, len(s) - 1, known, plain, score))
    return out, n


def _same_scores(got, want):
    key = lambda x: (str(x[0]), x[1], x[2], round(x[3], 6), round(x[4], 6))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:3] == w[:3] and abs(g[3] - w[3]) < 1e-6 and abs(g[4] - w[4]) < 1e-6


@pytest.mark.parametrize("order, shard_bytes", [(1, 600), (2, 16 << 20), (2, 600), (3, 600)])
def test_scores_equal_a_plain_model(spark, monkeypatch, order, shard_bytes):
    monkeypatch.setattr(kneserney, "CHUNK_ROWS", 64)
    monkeypatch.setattr(kneserney, "SHARD_BYTES", shard_bytes)
    r = random.Random(1)
    choice = ["The", "the", "a", "b", "Éa", "éa", "q", "x y", "\x0bz"]
    rows = [(i, r.choice([" ", "\n", "\t\t"]).join(r.choice(choice) for _ in range(r.randrange(0, 30)))) for i in range(200)]
    rows += [(None, None), (None, " a b "), (3, "a" * 50_000), (3, "a" * 50_000), (9, "\n\n"), (5, "the " * 20_000)]
    df = _docs(spark, [(i, t, "en", None, 1) for i, t in rows]).repartition(3)
    model, scored = kneserney.train_and_score(df, ~kneserney.held_out(F.col("doc_id")), ["doc_id"], order)
    want, n = _scored(rows, order)
    assert model.levels[1].raw_total == n and model.shards == (1 if shard_bytes > 1 << 20 else model.shards)
    _same_scores(scored.collect(), want)
    if order == 3:
        _same_scores(kneserney.score(df, model, ["doc_id"]).collect(), want)


def test_scores_without_training_or_rows(spark):
    df = _docs(spark, [(1, "a b", "en", None, 1)])
    _, scored = kneserney.train_and_score(df, F.lit(False), ["doc_id"])
    assert [tuple(x) for x in scored.collect()] == [(1, 3, 0, 0.0, 0.0)]
    _, none = kneserney.train_and_score(df.where("false"), F.lit(True), ["doc_id"])
    assert none.count() == 0


def test_probabilities_of_a_context_sum_to_one(spark):
    words = "a b c d e f".split()
    r = random.Random(2)
    train = [(None, " ".join(r.choice(words[:5]) for _ in range(r.randrange(1, 9)))) for _ in range(60)]
    model, _ = kneserney.train_and_score(_docs(spark, [(i, t, "en", None, 1) for i, t in train]), F.lit(True), ["doc_id"])
    seen = sorted({w for _, t in train for w in t.split()})
    texts = ["b"] + [f"b {w}" for w in [*seen, "never"]]
    got = dict(kneserney.score(_docs(spark, [(i, t, "en", None, 1) for i, t in enumerate(texts)]), model, ["text"]).select("text", "score").collect())
    ends = kneserney.score(_docs(spark, [(i, w, "en", None, 1) for i, w in enumerate(seen)]), model, ["text"])
    assert len(got) == len(texts) and ends.count() == len(seen)
    # p(w | b) p(end | w) is what "b w" adds to "b"; p(end | w) comes from "w" in the same way.
    chunk = kneserney.Chunk(kneserney.pa.array([f"b {w}" for w in [*seen, "never"]] + ["b"]), np.zeros(len(seen) + 2, dtype=bool), 2)
    told = {k: _look_up(model, k, chunk.keys[k]) for k in (1, 2)}
    logs = kneserney.log10_probabilities(chunk, told, model.levels, 2)
    at = chunk.at[:-1]
    total = sum(10 ** logs[a + 2] for a in at)  # each known word, one unknown, the end
    assert abs(total - 1) < 1e-9


def _look_up(model, k, keys):
    bounds = kneserney._bounds(keys, model.shards)
    fields = model.fields[k]
    out = {f: np.zeros(len(keys), dtype=np.int64) for f in fields}
    for s, path in model.levels[k].files.items():
        arrays, values = kneserney._mapped(path, len(fields))
        for f, v in zip(fields, kneserney._looked_up(arrays, values, keys[bounds[s] : bounds[s + 1]]), strict=True):
            out[f][bounds[s] : bounds[s + 1]] = v
    return out


def _coded(rows, coder):
    kept = [(i, np.floor(np.array(v, dtype=float) * 4096).astype(int).tolist(), lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(len(v) for _, v, _ in kept)
    width = -(-width // coder.parts) * coder.parts
    kept = [(i, [*v, *[0] * (width - len(v))], lab) for i, v, lab in kept]
    w = width // coder.parts
    part = lambda v, p: v[p * w : (p + 1) * w]
    first = sorted(kept, key=lambda x: (x[0] is None, x[0] or 0, x[1]))[: coder.entries]
    books = [[part(v, p) for _, v, _ in first] for p in range(coder.parts)]
    near = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(part(v, p), c, strict=True)), e) for e, c in enumerate(books[p]))
    for _ in range(coder.rounds):
        groups = defaultdict(list)
        for _, v, _ in kept:
            for p in range(coder.parts):
                groups[p, near(v, p)[1]].append(part(v, p))
        for (p, e), g in groups.items():
            books[p][e] = [sum(c) // len(g) for c in zip(*g, strict=True)]
    found = [[near(v, p) for p in range(coder.parts)] for _, v, _ in kept]
    total = Counter()
    for (_, _, lab), f in zip(kept, found, strict=True):
        total[lab] += sum(x for x, _ in f)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for _, e in f), sum(x for x, _ in f), total[lab], digest) for (i, _, lab), f in zip(kept, found, strict=True)]


VECTORS = "vec_id long, embedding array<float>, label int, code string, error string"


def _vectors(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], VECTORS)


@pytest.mark.parametrize("coder", [vectorcode.Coder(), vectorcode.Coder(parts=3, entries=4, rounds=2)])
def test_codes_equal_a_plain_quantiser(spark, coder):
    r = random.Random(5)
    f32 = lambda x: float(np.float32(x))
    rows = [(i, [f32(r.gauss(0, 0.3)) for _ in range(16)], r.choice([1, 2, None])) for i in range(120)]
    rows += [(7, rows[7][1], None)] * 40 + [(None, [0.5] * 16, 3), (200, None, 1), (201, [1.0, None] * 8, 1), (202, [float("nan")] * 16, 1)]
    rows += [(203, [float("inf")] * 16, 1), (204, [0.25] * 5, 2), (205, [], 2), (206, [-1e-9] * 16, 2)]
    got = [tuple(x) for x in vectorcode.compress(_vectors(spark, rows).repartition(4), coder).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()]
    assert sorted(got, key=_key) == sorted(_coded(rows, coder), key=_key)


def test_few_rows_no_rows_and_large_components(spark):
    rows = [(3, [1.0] * 8, 1), (1, [2.0] * 8, None)]
    got = vectorcode.compress(_vectors(spark, rows)).collect()
    assert {(x["vec_id"], x["code"], x["error"]) for x in got} == {(1, "00" * 8, 0), (3, "01" * 8, 0)}
    assert vectorcode.compress(_vectors(spark, rows).where("false")).count() == 0
    with pytest.raises(ValueError, match="too large"):
        vectorcode.compress(_vectors(spark, [(1, [1e30] * 8, 1)]))
    books = vectorcode.train(_vectors(spark, rows), vectorcode.Coder())
    decoded = vectorcode.decode(vectorcode.encode(_vectors(spark, rows), books, ["vec_id"]), books)
    assert dict(decoded.select("vec_id", "decoded").collect()) == {3: [1.0] * 8, 1: [2.0] * 8}


def test_limb_products_are_exact():
    r = np.random.default_rng(3)
    for high in (10, 2**12, 2**26, 2**30):
        a, b = (r.integers(-high, high, size) for size in ((2, 9, 7), (2, 7, 5)))
        a[0, 0, 0], b[0, 0, 0] = -high, high
        want = np.matmul(a.astype(object), b.astype(object))
        assert (vectorcode.exact_products(a, b) == want).all()
