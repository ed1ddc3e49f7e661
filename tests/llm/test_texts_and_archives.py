"""HTML labeller, archives, language ID and personal data."""

import hashlib
import random
import re
import string
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gradeloom.llm import htmltext, langid, pii, warc

WORDS = "the of and river stone quick brown house walking slowly under large trees while singing".split()


def _sentence(r, n=None):
    return " ".join(r.choice(WORDS) for _ in range(n or r.randrange(6, 25))).capitalize() + "."


def _page(r, wrap=("<article>", "</article>")):
    paras = [_sentence(r) for _ in range(r.randrange(1, 6))]
    nav = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in r.sample(WORDS, 4))
    html = (
        f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul>{nav}</ul></nav>"
        f"<!-- x --><div class=\"ad\">{_sentence(r)}</div>{wrap[0]}<h1>{paras[0]}</h1><p>{'</p><p>'.join(paras)}{wrap[1]}"
        f"<footer>&copy; {_sentence(r, 3)}</footer></body></html>"
    )
    return html, " ".join([paras[0], *paras])


@pytest.fixture(scope="module")
def labeller(spark):
    r = random.Random(1)
    rows = [(i, _page(r)[0]) for i in range(250)]
    return htmltext.train(spark.createDataFrame(rows, "page_id long, html string"))


def test_main_text_of_held_out_pages(spark, labeller):
    r = random.Random(2)
    pages = [_page(r) for _ in range(60)] + [_page(r, ("<div class='entry-content'>", "</div>")) for _ in range(40)]
    rows = [(i, h, "clash", 3) for i, (h, _) in enumerate(pages)] + [(0, pages[0][0], "clash", 3)]
    df = spark.createDataFrame(rows, "page_id long, html string, text string, n int")
    got = htmltext.extract(df, labeller, ["page_id"]).collect()
    assert len(got) == len(rows)
    exact = [r["text"] == pages[r["page_id"]][1] for r in got]
    assert np.mean(exact) > 0.95


def test_odd_pages(spark, labeller):
    rows = [(1, None), (2, ""), (3, "plain &amp; text"), (4, "<p"), (5, "<article>" + "<p>word here</p>" * 3000), (6, "<!-- open"), (7, "<a b='")]
    df = spark.createDataFrame(rows, "page_id long, html string")
    got = {r["page_id"]: r["text"] for r in htmltext.extract(df, labeller, ["page_id"]).collect()}
    assert len(got) == 7 and got[1] == got[2] == got[6] == ""
    assert got[5].count("word here") > 2900
    assert htmltext.extract(df.where("false"), labeller, ["page_id"]).count() == 0
    assert htmltext.train(df.where("false")) is None
    bare = {r["page_id"]: r["text"] for r in htmltext.extract(df, None, ["page_id"]).collect()}
    assert bare[5] == " ".join(["word here"] * 3000)


def test_deep_nesting_is_linear():
    start = time.perf_counter()
    page = htmltext.blocks("<div>a " * 50_000 + "</div>" * 50_000 + "<article><p>b")
    assert len(page) == 50_001 and page[49_999].path.depth == 50_000 and page[-1].path.depth == 2
    assert [htmltext.plain_role(b.path) for b in page[-2:]] == [0.0, 1.0]
    x = htmltext.features(page)
    assert np.abs(x[-1]).sum() < 20 and time.perf_counter() - start < 20


def test_blocks():
    page = "<body><div>a &lt;b&gt;  <b>c</b>d<br>e<script>no</script><p>x&nbsp;y<p>z</div><ul><li>1<li>2</ul>tail &am"
    assert [b.text for b in htmltext.blocks(page)] == ["a <b> cd e", "x y", "z", "1", "2", "tail &am"]


@pytest.mark.parametrize(
    "page, want",
    [
        ("<html><head><title>T</title><body><article><p>Main text", ["Main text"]),
        ("<head><title>T</title><p>a</p>", ["a"]),
        ("<html><head><meta x><style>p</style></head><body>a", ["a"]),
        ("<p>a<button>b<p>c", ["a", "b", "c"]),
        ("<select><option>a<p>b</p><select><option>x</select>", ["a", "b"]),
        ("<p>a<button>x</button>b", ["ab"]),
        ("<article><object><p>a</p></object><math><mi>b</mi></math><noscript>c</noscript><svg>d", ["a", "b", "c", "d"]),
        ("<title>a<p>b<iframe>c", ["a", "b", "c"]),
        ("<p>a<template><p>x</template><textarea>x</textarea><script>x", ["a"]),
    ],
)
def test_open_elements_swallow_nothing(page, want):
    assert [b.text for b in htmltext.blocks(page)] == want


def test_sample_counts_a_page_once(spark, monkeypatch):
    monkeypatch.setattr(htmltext, "SAMPLE_PAGES", 20)
    pages = [(f"<p>page {k}",) for k in range(200)]
    once = htmltext.sample_pages(spark.createDataFrame(pages, "html string"))
    assert 5 <= len(once) <= 40
    hot = [(h,) for h in once[:3] for _ in range(500)]
    assert htmltext.sample_pages(spark.createDataFrame(hot + pages, "html string").repartition(7)) == once


def test_gradients_match_differences():
    r = np.random.default_rng(3)
    model = htmltext.Labeller()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x = r.standard_normal((3, 5, htmltext.DIMS)).astype(np.float32)
    mask = np.arange(5)[None, :] < np.array([5, 3, 1])[:, None]
    y = (r.random((3, 5)) < 0.5).astype(np.float64)

    def loss():
        p = np.clip(model.scores(x, mask), 1e-7, 1 - 1e-7)
        return -(np.where(mask, y * np.log(p) + (1 - y) * np.log(1 - p), 0).sum()) / mask.sum()

    for name, g in model.gradients(x, mask, y).items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        kept = model.p[name][at]
        model.p[name][at] = kept + 1e-3
        up = loss()
        model.p[name][at] = kept - 1e-3
        down = loss()
        model.p[name][at] = kept
        assert abs((up - down) / 2e-3 - g[at]) < 0.05 * max(0.01, abs(g[at])), name


PAGES = [
    (5, "u\nx", "<p>é"), (3, None, "<p>é"), (None, "v", None), (9, "w", ""), (9, "w", ""), (4, "x", "y" * 300_000), (2, "x", "z"), (8, "q", "<p>é"),
]


@pytest.mark.parametrize("least", [0, 4])
def test_archives_round_trip(spark, least, monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 400)
    df = spark.createDataFrame([(*p, "k", 1) for p in PAGES], "page_id long, url string, html string, file string, offset int")
    folder, index = warc.write_archives(df, min_bytes=least)
    assert index.count() == len(PAGES)
    got = warc.read_records(folder, index).collect()
    first = {}
    for i, _, h in PAGES:
        if i is not None and len((h or "").encode()) >= least:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in PAGES:
        payload = (h or "").encode()
        again = (h or "") in first and first[h or ""] != i
        want.append((i, len(payload), warc.payload_digest(payload), "revisit" if again else "response", first[h or ""] if again else None))
    assert sorted(map(str, want)) == sorted(
        str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got
    )
    assert all(r["payload"] is None or warc.payload_digest(bytes(r["payload"])) == r["payload_digest"] for r in got)
    some = warc.read_records(folder, index.where("page_id in (4, 2)")).collect()
    assert sorted(r["page_id"] for r in some) == [2, 4]


def test_archives_of_nothing(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    folder, index = warc.write_archives(empty)
    assert index.count() == 0 and warc.read_records(folder, index).count() == 0


def test_damage_is_seen():
    good = warc.record(1, "u", b"payload", warc.payload_digest(b"payload"), "response", None)
    assert warc.parse(good)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(warc.record(1, "u", b"payload", warc.payload_digest(b"other"), "response", None))


def test_languages_of_held_out_rows(spark):
    r = random.Random(5)
    letters = {"xx": "aeioubcd", "yy": "aeioustvéè", "zz": "бвгдеж"}
    rows = []
    for i in range(400):
        lang = r.choice(sorted(letters))
        rows.append((i, " ".join("".join(r.choice(letters[lang]) for _ in range(r.randrange(3, 9))) for _ in range(r.randrange(8, 80))), lang, 1.0))
    rows += [(1000, None, "xx", 1.0), (1001, "12 !?", "yy", 1.0), (1002, "abc", None, 1.0), (None, "bad cab", "xx", 1.0), (1003, "é " * 30000, "yy", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    held = df.withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.train(held.where("not held_out"))
    got = langid.predict(held, model, ["doc_id", "held_out"]).collect()
    assert sorted(model) == ["xx", "yy", "zz"] and len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1000]["lang_pred"] == by_id[1001]["lang_pred"] == "und" and by_id[1000]["score"] == 0
    right = [by_id[i]["lang_pred"] == lang for i, _, lang, _ in rows[:400] if by_id[i]["held_out"]]
    assert len(right) > 80 and np.mean(right) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    none = langid.train(df.where("false"))
    assert {r["lang_pred"] for r in langid.predict(df, none, ["doc_id"]).collect()} == {"und"}


def test_prototype_is_the_bundle_of_all_trigrams(spark):
    texts = ["Abc abd", "cab"]
    model = langid.train(spark.createDataFrame([(t, "q") for t in texts], "text string, lang string"))
    total = 0
    for t in texts:
        codes, n = np.unique(langid.trigrams(t), return_counts=True)
        total = total + n @ langid.bound(codes).astype(float) / np.sqrt((n * n).sum())
    assert np.allclose(model["q"], total / np.linalg.norm(total), atol=1e-3)


def _plain_spans(text):
    """The base rules, each by its pattern alone."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(x) for x in re.sub("[^0-9]", "", m[0])]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(a, z, pii.BASE[k]) for a, k, z in sorted(out)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab.@-+ 0123456789()%é\n", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == _plain_spans(text)


def test_spans_of_documents(spark):
    r = random.Random(7)
    texts = []
    for _ in range(300):
        filler = " ".join("".join(r.choice(string.ascii_lowercase) for _ in range(5)) for _ in range(12))
        extra = r.choice(["mail bob.x@mail.example.com now", "+1 (317) 555-0123", "4111 1111 1111 1111", "10.20.30.40", "a 1.2.3.999 z", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', ""])
        texts.append(f"é {filler} {extra} {filler}")
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(900, None, "x"), (901, "", "x"), (902, "9 " * 20000, "x"), (None, texts[0], "x"), (0, texts[0], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = pii.find(df, ["doc_id"]).collect()
    assert len(got) == len(rows)
    secrets = 0
    for row in got:
        text = dict((i, t) for i, t, _ in rows)[row["doc_id"]] or ""
        base = _plain_spans(text)
        assert [row[f"n_{k}"] for k in pii.BASE] == [sum(x == k for _, _, x in base) for k in pii.BASE]
        joined = ",".join(f"{k}:{a}:{z}" for a, z, k in base)
        assert row["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        spans = row["spans"].split(",") if row["spans"] else []
        assert [s for s in spans if s.split(":")[0] in pii.BASE] == ([x for x in joined.split(",") if x])
        secrets += "secret" in row["spans"]
    assert secrets == sum("token" in (t or "") for _, t, _ in rows)
    assert pii.find(df.where("false"), ["doc_id"]).count() == 0


def test_reliabilities_follow_the_votes():
    """A labeler that votes at random is found out; the posterior follows the good ones."""
    r = np.random.default_rng(6)
    counts = {}
    for _ in range(4000):
        y = r.random() < 0.5
        votes = [2 if (r.random() < 0.95) == y else 0 for _ in range(2)] + [int(r.integers(0, 3))]
        key = (4, votes[0] * 9 + votes[1] * 3 + votes[2])
        counts[key] = counts.get(key, 0) + 1
    post, rates = pii.estimate(counts)
    assert rates[4, 0, 1, 2] > 0.85 and rates[4, 1, 0, 0] > 0.85
    assert abs(rates[4, 2, 1, 2] - rates[4, 2, 0, 2]) < 0.15
    assert post[(4, 2 * 9 + 2 * 3)] > 0.9 and post[(4, 2)] < 0.1


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="0129.. -+@a:=AbcDefGh", max_size=60))
def test_added_spans_keep_clear_of_strict_ones(text):
    base = pii.base_spans(text)
    added = pii.added_candidates(text, base)
    assert not any(a < y and x < z for a, z, _ in added for x, y, _ in base)
    assert all(one[1] <= two[0] for one, two in zip(added, added[1:]))


def test_long_runs_of_digits_are_read_once():
    start = time.perf_counter()
    assert pii.base_spans("1" * 1_000_000 + " 10.0.0.1") == [(1_000_001, 1_000_009, "ip")]
    assert time.perf_counter() - start < 20
