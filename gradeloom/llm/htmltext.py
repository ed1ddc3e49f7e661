"""Main-text extraction by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, each with the
path of tags (with class and id words) above it. A bidirectional LSTM in numpy reads
the blocks of the whole page in order, each as a vector of hashed path parts, hashed
words and a few shape figures, and decides for every block whether it belongs to the
main text. Scripts, styles and comments hold no blocks, nor do titles, templates,
frames and form controls that are closed; the text of all other elements is kept for it.

The labeller is fitted on a bounded sample of the given pages (``SAMPLE_PAGES``)
whose tags tell their role plainly: what stands in ``article`` or ``main`` and under no
name of a menu, header, footer, notice, advert, form or comment list is main text.
Every sampled page also trains in ``VARIANTS`` rebuilt forms, with main text and
boilerplate moved under other usual names, so that it is names and their
surroundings that are learned rather than one template.

Defined results: null, empty and markup-free html gives the empty text or the text
itself as far as the labeller keeps it; tags cut off at the end are dropped; repeated
rows get equal texts; without usable sample pages (or an empty table) blocks are kept
by the untrained rule of the sample labels; other columns are passed through as asked.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES = 400  # pages that the labeller is fitted on, about
SAMPLE_BYTES = 200_000  # longer pages are not sampled; they are labelled like all others
VARIANTS = 3
PATH_DIMS, WORD_DIMS, SHAPE_DIMS = 128, 24, 6
DIMS = PATH_DIMS + WORD_DIMS + SHAPE_DIMS
HIDDEN = 16
EPOCHS = 14
BATCH_STEPS = 60_000  # blocks, padding included, that go through the network at once

# How HTML elements break text.
SILENT = ("script", "style")  # up to the end of the page if need be
CLOSED = ("title", "template", "iframe", "textarea")  # silent if closed before the next of the kind; else only the tag goes
CONTROLS = ("select", "button")  # silent if closed before any other block
HEAD = frozenset("html head base link meta noscript script style template title".split())  # what leaves a head open
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main menu nav ol p pre section summary table ul".split()
)
MAIN_NAMES = frozenset("article main".split())
SIDE_NAMES = frozenset(
    "nav footer aside form header menu menubar sidebar advert advertisement ad ads banner promo sponsor sponsored cookie cookies consent notice "
    "popup modal newsletter subscribe social share sharing related comment comments reply replies respond breadcrumb breadcrumbs pager pagination "
    "login search widget copyright disclaimer alert toolbar dialog masthead topbar".split()
)
SIDE_LIST = tuple(sorted(SIDE_NAMES))
# What the variants are built from.
MAIN_WRAPS = (
    "article", "main", "div content", "div main content", "div post", "div post body", "div entry content", "section article body",
    "div article", "main article", "div story", "div page content", "section content", "div text",
)
SIDE_WRAPS = (
    "nav", "header", "footer", "aside", "form", "div ad", "div ads", "div advert", "div advertisement", "div banner", "div sidebar", "aside sidebar",
    "div menu", "ul menu", "div nav", "div navbar", "div cookie notice", "div cookie consent", "div notice", "div popup", "div modal",
    "div newsletter", "form subscribe", "div social share", "div share", "div related", "section related posts", "div comments", "section comments",
    "div comment list", "ol comment list", "li comment", "div comment", "div replies", "div breadcrumb", "div pagination", "div promo", "div sponsored",
    "div footer", "div header", "header site header", "footer site footer", "form search", "form login", "div widget", "div disclaimer", "div alert",
)
MAIN_LEAVES = (
    "p", "p", "p", "h2", "h3", "ul li", "ul li", "ul li", "ol li", "ol li p", "blockquote", "pre", "table tr td", "table tbody tr td", "div",
    "figure figcaption", "section p", "div p", "dl dd", "section ul li", "div ul li",
)
SIDE_LEAVES = ("p", "ul li", "div", "ul li", "h3", "form", "div p", "")

_SILENT = "|".join(SILENT)
_CLOSED = "|".join(CLOSED)
_CONTROLS = "|".join(CONTROLS)
_BLOCK = "|".join(sorted(CLOSES_P | {"body", *SILENT, *CLOSED, *CONTROLS}))
_REST = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*"
_PIECE = re.compile(
    rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<({_SILENT})\b{_REST}>.*?(?:</\1\s*>|\Z)"
    rf"|<({_CLOSED})\b{_REST}>(?:[^<]|<(?!/?\2\b))*+</\2\s*>|<({_CONTROLS})\b{_REST}>(?:[^<]|<(?!/?(?:{_BLOCK})\b))*+</\3\s*>"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>{_REST})(?:>|\Z)",
    re.S | re.I,
)
_NAMING = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[a-z]+", re.I)


class Element:
    """An open element, linked to the one around it; what the labeller reads of its path is worked out once."""

    __slots__ = ("above", "depth", "name", "role", "tag", "vector")

    def __init__(self, name: str, above: Element | None):
        self.name, self.above = name, above  # tag and names
        self.tag = name.split(" ", 1)[0]
        self.depth = above.depth + 1 if above else 1
        self.role: tuple[bool, bool] | None = None
        self.vector: np.ndarray | None = None


def element_path(*names: str) -> Element | None:
    """The innermost of elements nested in this order."""
    e = None
    for name in names:
        e = Element(name, e)
    return e


@dataclass
class Block:
    text: str
    path: Element | None
    links: float  # share of the text inside links


def _element(tag: str, attributes: str) -> str:
    names = []
    for groups in _NAMING.findall(attributes) if "=" in attributes else ():
        names += [n.lower() for n in _NAME.findall("".join(groups))]
    return " ".join([tag, *names])


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page in page order; text with character references decoded and white space folded.

    Time and memory grow with the length of the page, however deep its elements nest.
    """
    page = page or ""
    stack: list[Element] = []
    levels: dict[str, list[int]] = {}  # where in the stack a tag is open
    out: list[Block] = []
    held: list[str] = []
    linked = depth_a = at = 0
    in_head = False

    def close(level: int) -> None:
        while len(stack) > level:
            levels[stack.pop().tag].pop()

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                out.append(Block(text, stack[-1] if stack else None, min(1.0, linked / len(text))))
            held.clear()
        linked = 0

    def say(piece: str) -> None:
        nonlocal linked
        if piece:
            held.append(piece)
            if depth_a:
                linked += len(piece)

    for m in _PIECE.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if in_head and not m["end"] and tag not in HEAD:
            flush()
            in_head = False
            if levels.get("head"):
                close(levels["head"][0])
        if tag in INLINE:
            if tag == "a":
                depth_a = max(0, depth_a + (-1 if m["end"] else 1))
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            else:
                held.append(" ")
            continue
        flush()
        depth_a = 0
        if m["end"]:
            if levels.get(tag):
                close(levels[tag][-1])
            continue
        top = stack[-1].tag if stack else ""
        if (tag in CLOSES_P and top == "p") or (tag in ("li", "dt", "dd", "tr", "td", "th", "option") and top == tag):
            close(len(stack) - 1)
        if not m["rest"].endswith("/"):
            levels.setdefault(tag, []).append(len(stack))
            stack.append(Element(_element(tag, m["rest"]), stack[-1] if stack else None))
            in_head = in_head or tag == "head"
    say(page[at:])
    flush()
    return out


def _unknown(e: Element | None, what: str) -> list[Element]:
    """The elements from the outermost on whose ``what`` is not worked out yet, down to ``e``."""
    chain = []
    while e is not None and getattr(e, what) is None:
        chain.append(e)
        e = e.above
    return chain[::-1]


def plain_role(path: Element | None) -> float:
    """The label of the sample: 1 for main text by its names."""
    if path is None:
        return 0.0
    for e in _unknown(path, "role"):
        main, side = e.above.role if e.above else (False, False)
        names = set(e.name.split(" "))
        e.role = (main or bool(names & MAIN_NAMES), side or bool(names & SIDE_NAMES))
    return float(path.role == (True, False))


def _path_vector(path: Element) -> np.ndarray:
    """Signed counts of the hashed tags and names of all elements of a path."""
    for e in _unknown(path, "vector"):
        above = e.above.vector if e.above else np.zeros(PATH_DIMS, dtype=np.float32)
        if e.name in ("html", "body"):
            e.vector = above
            continue
        e.vector = above.copy()
        for name in e.name.split(" "):
            h = zlib.crc32(name.encode())
            e.vector[h % PATH_DIMS] += 1.0 if h & 0x10000 else -1.0
    return path.vector


def features(page: list[Block]) -> np.ndarray:
    out = np.zeros((len(page), DIMS), dtype=np.float32)
    n = max(1, len(page) - 1)
    for i, b in enumerate(page):
        if b.path is not None:
            out[i, :PATH_DIMS] = _path_vector(b.path)
            h = zlib.crc32(b"leaf " + b.path.name.encode())
            out[i, h % PATH_DIMS] += 0.5
        words = b.text.split(" ")
        hashes = np.fromiter((zlib.crc32(w.lower().encode()) for w in words), dtype=np.int64, count=len(words))
        out[i, PATH_DIMS : PATH_DIMS + WORD_DIMS] = np.bincount(hashes % WORD_DIMS, minlength=WORD_DIMS) / len(words)
        out[i, -SHAPE_DIMS:] = (
            min(1.0, np.log1p(len(b.text)) / 8),
            b.links,
            min(1.0, 10 * sum(b.text.count(c) for c in ".,;!?") / len(b.text)),
            i / n,
            min(1.0, (b.path.depth if b.path else 0) / 12),
            min(1.0, len(words) / 40),
        )
    return out


class Labeller:
    """A bidirectional LSTM with a logistic output per block."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        self.p: dict[str, np.ndarray] = {}
        for d in ("f", "b"):
            self.p["x" + d] = (r.standard_normal((DIMS, 4 * HIDDEN)) * 0.15).astype(np.float32)
            self.p["h" + d] = (r.standard_normal((HIDDEN, 4 * HIDDEN)) * 0.15).astype(np.float32)
            bias = np.zeros(4 * HIDDEN, dtype=np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1.0
            self.p["c" + d] = bias
        self.p["o"] = (r.standard_normal(2 * HIDDEN) * 0.2).astype(np.float32)
        self.p["q"] = np.zeros(1, dtype=np.float32)

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool):
        n, steps, _ = x.shape
        pre = x @ self.p["x" + d] + self.p["c" + d]
        h, c = np.zeros((n, HIDDEN), dtype=np.float32), np.zeros((n, HIDDEN), dtype=np.float32)
        hs = np.zeros((n, steps, HIDDEN), dtype=np.float32)
        trace = []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = pre[:, t] + h @ self.p["h" + d]
            g = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            a = np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :]
            m = mask[:, t, None]
            c_new = f * c + i * a
            tc = np.tanh(c_new)
            if keep:
                trace.append((t, i, f, o, a, c, tc, h, m))
            c, h = np.where(m, c_new, c), np.where(m, o * tc, h)
            hs[:, t] = h
        return hs, trace

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        hf, hb = self._run("f", x, mask, False)[0], self._run("b", x, mask, False)[0]
        return 1 / (1 + np.exp(-(np.concatenate([hf, hb], axis=2) @ self.p["o"] + self.p["q"])))

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        (hf, tf), (hb, tb) = self._run("f", x, mask, True), self._run("b", x, mask, True)
        hidden = np.concatenate([hf, hb], axis=2)
        p = 1 / (1 + np.exp(-(hidden @ self.p["o"] + self.p["q"])))
        dz = np.where(mask, p - y, 0).astype(np.float32) / max(1, mask.sum())
        g = {"o": np.einsum("nt,nth->h", dz, hidden), "q": dz.sum()[None]}
        for d, trace, side in (("f", tf, self.p["o"][:HIDDEN]), ("b", tb, self.p["o"][HIDDEN:])):
            dh, dc = np.zeros_like(hf[:, 0]), np.zeros_like(hf[:, 0])
            gx, gh, gb = np.zeros_like(self.p["x" + d]), np.zeros_like(self.p["h" + d]), np.zeros_like(self.p["c" + d])
            for t, i, f, o, a, c, tc, h, m in reversed(trace):
                dh = dh + dz[:, t, None] * side
                live = np.where(m, dh, 0)
                dct = np.where(m, dc, 0) + live * o * (1 - tc * tc)
                back = np.concatenate([dct * a * i * (1 - i), dct * c * f * (1 - f), live * tc * o * (1 - o), dct * i * (1 - a * a)], axis=1)
                gx += x[:, t].T @ back
                gh += h.T @ back
                gb += back.sum(axis=0)
                dh = np.where(m, back @ self.p["h" + d].T, dh)
                dc = np.where(m, dct * f, dc)
            g |= {"x" + d: gx, "h" + d: gh, "c" + d: gb}
        return g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], seed: int = 7, rate: float = 0.01) -> Labeller:
        r = np.random.default_rng(seed)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(EPOCHS):
            order = sorted(range(len(pages)), key=lambda i: (len(pages[i][0]), i))
            batches = [order[i : i + 32] for i in range(0, len(order), 32)]
            for at in r.permutation(len(batches)):
                x, mask = padded([pages[i][0] for i in batches[at]])
                y = np.zeros(mask.shape, dtype=np.float32)
                for row, i in enumerate(batches[at]):
                    y[row, : len(pages[i][1])] = pages[i][1]
                step += 1
                for k, g in self.gradients(x, mask, y).items():
                    g = np.clip(g, -1, 1)
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.999 * m2[k] + 0.001 * g * g
                    self.p[k] -= (rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x = np.zeros((len(pages), steps, DIMS), dtype=np.float32)
    mask = np.zeros((len(pages), steps), dtype=bool)
    for i, p in enumerate(pages):
        x[i, : len(p)], mask[i, : len(p)] = p, True
    return x, mask


def rebuilt(page: list[Block], labels: np.ndarray, others: list[str], r: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """The page with its blocks under other usual names, and boilerplate before, between and behind the main text."""

    def one(options):
        return options[int(r.integers(len(options)))]

    main_wrap = one(MAIN_WRAPS)
    outer = ("html", "body", *(("div page",) if r.random() < 0.3 else ()))
    out: list[tuple[Block, float]] = []

    def side(inside: tuple[str, ...]) -> None:
        wrap, leaf = one(SIDE_WRAPS), one(SIDE_LEAVES)
        if r.random() < 0.6:
            wrap = " ".join([one(("div", "section", "aside", "p")), *(one(SIDE_LIST) for _ in range(int(r.integers(1, 3))))])
        path = (*inside, wrap, *leaf.split(" ")) if leaf else (*inside, wrap)
        for _ in range(int(r.integers(1, 6))):
            words = one(others).split(" ")
            words = words[: int(r.integers(1, max(2, len(words) + 1)))]
            out.append((Block(" ".join(words), element_path(*path), float(r.random() < 0.4)), 0.0))

    for _ in range(int(r.integers(0, 4))):
        side(outer)
    inside, usual = (*outer, main_wrap), "p"
    for b, y in zip(page, labels, strict=True):
        if not y:
            continue
        if r.random() < 0.5:
            usual = one(MAIN_LEAVES)  # neighbours tend to stand under the same element
        leaf = b.path.name if r.random() < 0.4 else usual
        path = element_path(*inside, *(leaf.split(" ") if leaf in MAIN_LEAVES else (leaf,)))
        out.append((Block(b.text, path, b.links), 1.0))
        if r.random() < 0.05:
            side(inside)
    if r.random() < 0.4:
        side(inside)
    for _ in range(int(r.integers(0, 4))):
        side(outer)
    return [b for b, _ in out], np.array([y for _, y in out], dtype=np.float32)


def train(pages: DataFrame, seed: int = 5) -> Labeller | None:
    """Fit on about ``SAMPLE_PAGES`` pages, taken by a hash; None if no page tells its roles."""
    return _fitted(sample_pages(pages, seed), seed)


def sample_pages(pages: DataFrame, seed: int = 5) -> list[str]:
    """About ``SAMPLE_PAGES`` different pages, the same whatever the order and number of their rows."""
    fit = pages.where(F.coalesce(F.octet_length("html"), F.lit(0)).between(1, SAMPLE_BYTES))
    fit = fit.select("html", F.xxhash64(F.lit(seed), "html").alias("h"))
    n = max(1, fit.select("h").distinct().count())
    drawn = fit.where(F.pmod("h", F.lit(n)) < SAMPLE_PAGES).groupBy("h").agg(F.min("html").alias("html"))
    # The bound of the sample.
    return sorted(r["html"] for r in drawn.orderBy("h").limit(2 * SAMPLE_PAGES).collect())


def _fitted(texts: list[str], seed: int) -> Labeller | None:
    sample = []
    for text in texts:
        page = blocks(text)
        labels = np.array([plain_role(b.path) for b in page], dtype=np.float32)
        if labels.any():
            sample.append((page, labels))
    if not sample:
        return None
    r = np.random.default_rng(seed)
    others = [b.text for page, _ in sample for b in page]
    ready = []
    for page, labels in sample:
        ready.append((features(page), labels))
        for _ in range(VARIANTS):
            other, roles = rebuilt(page, labels, others, r)
            ready.append((features(other), roles))
    return Labeller().fit(ready)


def _main_texts(model: Labeller | None, htmls: list[str | None]) -> list[str]:
    pages = [blocks(h) for h in htmls]
    if model is None:
        keep = [np.array([plain_role(b.path) for b in p]) for p in pages]
    else:
        keep = [np.zeros(len(p)) for p in pages]
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        while order:
            # Pages of like length go together; a very long page goes alone.
            longest = len(pages[order[-1]])
            take = max(1, BATCH_STEPS // longest)
            some, order = order[-take:], order[:-take]
            scores = model.scores(*padded([features(pages[i]) for i in some]))
            for row, i in enumerate(some):
                keep[i] = scores[row, : len(pages[i])]
    return [" ".join(b.text for b, s in zip(p, k, strict=True) if s >= 0.5) for p, k in zip(pages, keep, strict=True)]


def extract(pages: DataFrame, model: Labeller | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with ``text``, the main text of ``html``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = _main_texts(model, part.column("html").to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, "text"])

    kinds = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep]
    return pages.select(*keep, "html").mapInArrow(run, ", ".join([*kinds, "text string"]))
