"""Near duplicates and decontamination against plain specifications."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import decontam, simjoin
from gradeloom.llm.components import connected_components

SCHEMA = "doc_id long, text string, node string, size int, `class` string"


def _rows(texts):
    return [(i, t, "x", 1, "y") for i, t in texts]


def _sets(texts):
    out = {}
    for i, t in texts:
        w = (t or "").encode().split()
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def _expected(texts):
    sets = _sets(texts)
    links, root = {i: 0 for i, _ in texts}, {i: i for i, _ in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        union = len(sets[a] | sets[b])
        if union and 5 * len(sets[a] & sets[b]) >= 4 * union:
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (find(i), links[i]) for i, _ in texts}


def _corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    texts, n = [], 0
    for _ in range(25):
        words = [r.choice(vocabulary) for _ in range(r.choice([3, 8, 60, 200]))]
        for _ in range(r.choice([1, 1, 2, 4, 12])):
            copy = list(words)
            for _ in range(r.randrange(0, 6)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            texts.append((n, r.choice([" ", "\n", "  "]).join(copy)))
            n += 1
    texts += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "a b"), (n + 4, "a  b"), (n + 5, "long " * 3000)]
    return texts


@pytest.mark.parametrize("block", [256, 3])
def test_join_equals_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(simjoin, "BLOCK", block)
    monkeypatch.setattr(simjoin, "FAMILY_BLOCK", block)
    texts = _corpus(block)
    df = spark.createDataFrame(_rows(texts), SCHEMA)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in simjoin.classes(df).collect()}
    assert got == _expected(texts)


def test_keep_one_of_each_class(spark):
    texts = _corpus(4)
    df = spark.createDataFrame(_rows(texts) + _rows(texts[:3]), SCHEMA)
    kept = simjoin.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(c for c, _ in _expected(texts).values()))


def test_join_without_ids_or_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"], r["n_copies"]) for r in simjoin.classes(df).collect())
    assert got == [("7", "7", 2, 3), ("None", "7", 2, 3), ("None", "7", 2, 3), ("None", "None", 0, 1)]
    assert simjoin.classes(df.where("false")).count() == 0
    assert simjoin.keep_one(df).count() == 2


def test_pruning_keeps_pairs_above_the_threshold():
    least = simjoin.least_matches()
    r = np.random.default_rng(1)
    equal = r.random((20000, simjoin.HASHES)) < 0.85
    counts = equal.cumsum(axis=1)
    steps = np.arange(simjoin.STEP, simjoin.HASHES + 1, simjoin.STEP)
    assert ((counts[:, steps - 1] >= least[steps]).all(axis=1)).mean() > 0.999
    far = (r.random((20000, simjoin.HASHES)) < 0.4).cumsum(axis=1)
    assert ((far[:, steps - 1] >= least[steps]).all(axis=1)).mean() < 0.01


def test_common_counts_over_several_slices(monkeypatch):
    monkeypatch.setattr(simjoin, "COLUMNS", 7)
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 60, 30)).astype(np.uint64) for _ in range(9)]
    got = simjoin.common_counts(sets, np.arange(4), np.arange(4, 9))
    assert got.tolist() == [[len(set(sets[i]) & set(sets[j])) for j in range(4, 9)] for i in range(4)]


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(5, 5), (7, 6)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + k: 100 for k in range(30)}}
    assert connected_components(df.where("false")).count() == 0


ITEM = "Anna has 12 apples and she gives 5 apples to Bob every single week. How many apples does Anna keep?"


def _found(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): (r["n_matched"], r["n_slots"]) for r in decontam.findings(d, b, **kw).collect()}


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_reparameterised_questions(spark, limit):
    docs = [
        (1, "Some words before. " + ITEM + " And some behind."),
        (2, "Before. Carla has 40 apples and she gives 7 apples to Dan every single week. How many apples does Carla keep?"),
        (3, "Before. Carla has 40 apples and she gives 7 apples to Dan every single week. How many apples does Eve keep?"),
        (4, "Apples and pears are given away every single week. How many people keep 12 apples?"),
        (5, None),
        (6, ""),
        (None, ITEM),
        (8, "x " * 5000 + ITEM),
        (8, "x " * 5000 + ITEM),
    ]
    items = [(1, ITEM), (1, ITEM), (2, None), (3, "of the in"), (4, "")]
    got = _found(spark, docs, items, window_limit=limit)
    assert set(got) == {(1, 1), (2, 1), (None, 1), (8, 1)}
    assert got[(2, 1)][0] == got[(1, 1)][0] == 13


def test_short_items_and_empty_tables(spark):
    docs = [(1, "Well. Look at the quick brown fox run"), (2, "Look at the slow brown fox")]
    items = [(9, "Look at the quick brown fox")]
    assert set(_found(spark, docs, items)) == {(1, 9)}
    assert _found(spark, docs, []) == {} and _found(spark, [], items) == {}


def test_tokens_stay_aligned(spark):
    texts = ["In 2019 Anna Smith ran 5 km. Then | John %%% paid $3.50!", "", "a1 5km 3.5 miles", "\n\nÉté. Ça va"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select(decontam.canonical_tokens(F.col("t")).alias("c"), decontam.surface_tokens(F.col("t")).alias("w")).collect():
        assert len(r["c"]) == len(r["w"])


def test_clean_rows_stay(spark):
    d = spark.createDataFrame([(1, ITEM, "k"), (2, "other", "k"), (None, None, None)], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    kept = decontam.drop_contaminated(d, b)
    assert kept.columns == d.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "None"]


def test_rows_that_share_an_id_are_searched_apart(spark):
    clean = "Before. Carla has 40 apples and she gives 7 apples to Dan every single week. How many apples does Eve keep?"
    docs = [(None, "Well. " + ITEM), (None, "Well. " + clean), (None, "other"), (7, "Well. " + ITEM), (7, "other"), (None, None)]
    items = [(1, ITEM), (None, "x y z a b c d e f g"), (None, "h i j k l m n o p q")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert set(_found(spark, docs, items)) == {(None, 1), (7, 1)}
    kept = {(r["doc_id"], r["text"]) for r in decontam.drop_contaminated(d, b).collect()}
    assert kept == {(None, "Well. " + clean), (None, "other"), (7, "other"), (None, None)}


def _dropped(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {i for i, _ in docs} - {r["doc_id"] for r in decontam.drop_contaminated(d, b).collect()}


def test_capitals_and_line_breaks_hide_no_copy(spark):
    words = ITEM.split()
    other = ITEM.replace("Anna", "Carla").replace("12", "40").split()
    docs = [
        (1, "Before. " + ITEM.upper()),
        (2, "Before. " + ITEM.upper().replace("12", "40")),
        (3, "\n".join(" ".join(words[k : k + 4]) for k in range(0, len(words), 4))),
        (4, "\n".join(" ".join(other[k : k + 4]) for k in range(0, len(other), 4))),
        (5, "APPLES AND PEARS ARE GIVEN AWAY EVERY SINGLE WEEK.\nHow many\npeople keep 12 apples?"),
    ]
    assert _dropped(spark, docs, [(1, ITEM)]) == {1, 2, 3, 4}
    found = _found(spark, docs, [(1, ITEM)])
    assert set(found) == {(k, 1) for k in (1, 2, 3, 4)} and found[(1, 1)][0] == found[(3, 1)][0] == 13


def test_every_layout_of_every_item_is_found(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    docs = {}
    for k, (i, t) in enumerate(items):
        words = t.split()
        docs[3 * k] = (i, "It was said that " + t + " and so on.")
        docs[3 * k + 1] = (i, "It was said that " + t.upper() + " and so on.")
        docs[3 * k + 2] = (i, "\n".join(" ".join(words[n : n + 4]) for n in range(0, len(words), 4)))
    found = set(_found(spark, [(d, t) for d, (_, t) in docs.items()], items))
    assert {(d, i) for d, (i, _) in docs.items()} <= found


def test_a_long_item_and_its_windows(spark):
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(2000)]
    long = " ".join(words)
    got = _found(spark, [(1, "Before. " + long + " behind"), (2, " ".join(words[100:112])), (3, " ".join(words[100:113]))], [(1, long)])
    assert {k: n for k, (n, _) in got.items()} == {(1, 1): 1993, (3, 1): 6}


def test_items_of_numbers_are_found(spark):
    total = "What is the sum of {}, {}, {}, {}, {}, {}, {}, {}, {} and {}?"
    row = "Sort 7 3 9 1 4 8 2 6 5 0 now"
    docs = [
        (1, "Well. " + total.format(*range(12, 42, 3))),
        (2, "Well. " + total.format(*range(50, 60))),
        (3, "Well. What is the sum of 50, 51, 52 and nothing else at all in this text?"),
        (4, "Well. " + row),
        (5, "Well. Sort 1 2 3 4 5 6 7 8 9 0 now"),
    ]
    items = [(1, total.format(*range(12, 42, 3))), (2, row)]
    assert _dropped(spark, docs, items) == {1, 2, 4}
    assert set(_found(spark, docs, items)) == {(1, 1), (2, 1), (4, 2)}


def test_stated_loss_of_the_join():
    """README: 11 in 100,000 at 0.8, 27 in a million at 0.82, 3 in a million at 0.85."""
    for p, stated in [(0.8, 11e-5), (0.82, 27e-6), (0.85, 3e-6)]:
        alive, dropped = {0: 1.0}, 0.0
        for n in range(simjoin.STEP, simjoin.HASHES + 1, simjoin.STEP):
            after = {}
            for m, q in alive.items():
                for k in range(simjoin.STEP + 1):
                    after[m + k] = after.get(m + k, 0.0) + q * math.comb(simjoin.STEP, k) * p**k * (1 - p) ** (simjoin.STEP - k)
            dropped += sum(q for m, q in after.items() if m < simjoin._LEAST[n])
            alive = {m: q for m, q in after.items() if m >= simjoin._LEAST[n]}
        loss = dropped + (1 - p**simjoin.ROWS) ** simjoin.BANDS
        assert 0.9 * stated < loss < 1.1 * stated


def test_every_form_of_a_text_is_computed_once(spark):
    texts = [None, "", " \n", "...", "7", "The Big Bad Wolf ran 12 km.\n Then 5", "\x0b x \f"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    read = docs.select(*[c.alias(k) for k, c in decontam.readings(F.col("text")).items()])
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    # one stripping of marks a form, one pass over sentence openings in the template
    assert plan.count(r"[^\p{L}\p{N}\s]+") == 3 and plan.count(decontam.OPENING) == 1
    got = [tuple(r) for r in read.collect()]
    assert got[:4] == [([], [], [])] * 4 and got[4] == (["0"], ["0"], ["7"]) and got[6] == (["2"], ["x"], ["x"])
    assert got[5][0] == ["2", "2", "2", "2", "ran", "0", "1", "2", "0"] and got[5][2][-2:] == ["then", "5"]
