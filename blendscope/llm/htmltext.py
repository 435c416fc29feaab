"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks: text between block-level tags, with the path of the nearest ``PATH_DEPTH`` open tags. Each
block is a vector of the mean embedding of its hashed path words (tag names, class, id and role words), the mean embedding of its hashed
words, and a few numbers; a bidirectional LSTM reads the sequence both ways and labels every block.

The fit: pages of a bounded sample (``SAMPLE`` rows with the smallest hashes of their page_id, one per page_id, ``SAMPLE_CHARS``
characters in all) are labelled by what their own markup says: inside ``article`` or ``main``, outside what is marked as boilerplate; on pages
without these, the long running texts with few links. They are then rewritten ``VARIANTS`` times: the article under other names, menus,
notices, forms, adverts, sidebars and reader comments set around and into it, so that no single tag name decides. Where fewer than
``BASE`` pages teach anything, as many made-up articles are rewritten as well, so that every table has a fitted labeller.

Untidy markup loses no text: a quote opens only after ``=``; ``script`` and ``style`` without an end hide the rest of the page, as
in browsers, other elements without running text only up to their end tag, and not at all without one.

Defined cases: null or empty html, or a page without article blocks, has an empty text; a null url or page_id stays null;
repeated rows give repeated rows; very long and deeply nested pages take linear time; an empty table gives no rows; other columns are
not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import lru_cache
from html import unescape
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blendscope.session import materialize

from .textvec import Texts

SAMPLE = 400
SAMPLE_CHARS = 32 << 20
BASE = 40
VARIANTS = 3
PATH_DEPTH = 64
GRID = 20_000  # (step, page) places of pages that are read together
PATH_BUCKETS, WORD_BUCKETS = 1024, 1024
PATH_SIZE, WORD_SIZE, NUMBERS, HIDDEN = 12, 6, 6, 16
INPUT = PATH_SIZE + WORD_SIZE + NUMBERS
TRAIN_BLOCKS = 80  # blocks of a training sequence; longer pages give several
EPOCHS, BATCH, RATE = 6, 32, 0.01
STEPS = 300  # batches at least: few pages are read more often
SEED = 20

# Tag names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
                   "strong sub sup time tt u var wbr br".split())
RAW = frozenset("script style noscript template textarea title iframe svg object select".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
BLOCKS_CLOSE_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p "
                           "pre section table ul".split())
SCOPES = frozenset("article aside body div footer form header main nav section table td th ul ol".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>=]+|=\s*+(?:\"[^\"]*\"|'[^']*')?)*+)>|<[!?/][^>]*>?|<[A-Za-z][^>]*(?:>|\Z)", re.S)
END_OF = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD_PARTS = re.compile(r"[A-Za-z]+")


@lru_cache(maxsize=50_000)
def path_code(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % PATH_BUCKETS


def own_codes(tag: str, attributes: str) -> list[int]:
    codes = [path_code(tag)]
    if attributes:
        for found in NAMES.findall(attributes):
            codes += [path_code("." + w.lower()) for w in WORD_PARTS.findall("".join(found))]
    return codes


def parse(html: str) -> list[tuple[str, tuple, float]]:
    """Blocks in page order: text, path codes, share of the text inside links."""
    blocks: list[tuple[str, tuple, float]] = []
    stack: list[tuple[str, list[int]]] = []
    pieces: list[str] = []
    linked, at, links = 0, 0, 0
    opened: Counter = Counter()  # names of the open tags, so that a stray end tag costs nothing
    endless: set[str] = set()  # tags that have no end tag in the rest of the page

    def flush():
        nonlocal linked
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                near = list(islice((own for tag, own in reversed(stack) if tag not in INLINE), PATH_DEPTH))
                codes = tuple(c for own in reversed(near) for c in own)
                blocks.append((text, codes, min(1.0, linked / len(text))))
            pieces.clear()
            linked = 0

    def pop(n: int):
        nonlocal links
        while len(stack) > n:
            tag = stack.pop()[0]
            links -= tag == "a"
            opened[tag] -= 1

    while at < len(html):
        match = TOKEN.search(html, at)
        text = html[at:match.start()] if match else html[at:]
        if text:
            pieces.append(text)
            linked += len(text) if links else 0
        if not match:
            break
        at = match.end()
        name = match.group(2)
        if name is None:
            continue
        tag, closing = name.lower(), match.group(1)
        if tag in INLINE:
            if tag == "br":
                pieces.append(" ")
            elif closing:
                for i in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                    if stack[i][0] == tag:
                        links -= tag == "a"
                        opened[tag] -= 1
                        del stack[i]
                        break
                    if stack[i][0] not in INLINE:
                        break
            elif tag not in VOID:
                stack.append((tag, []))
                opened[tag] += 1
                links += tag == "a"
            continue
        flush()
        if closing:
            for i in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[i][0] == tag:
                    pop(i)
                    break
        elif tag in RAW:
            if tag not in endless and not match.group(3).endswith("/"):
                end = END_OF[tag].search(html, at)
                if end:
                    at = end.end()
                elif tag in ("script", "style"):
                    at = len(html)
                else:
                    endless.add(tag)
        elif tag not in VOID:
            shut = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCKS_CLOSE_P else set())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in shut:
                    pop(i)
                    break
                if stack[i][0] in SCOPES:
                    break
            stack.append((tag, own_codes(tag, match.group(3))))
            opened[tag] += 1
    flush()
    return blocks


# ---------------------------------------------------------------- vectors

def ragged_mean(table: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Mean rows of a table per run of codes; zeros for an empty run."""
    out = np.zeros((len(sizes), table.shape[1]), table.dtype)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = np.cumsum(sizes) - sizes
        out[full] = np.add.reduceat(table[codes], starts[full]) / sizes[full, None]
    return out


class Inputs:
    """What the labeller reads of a batch of blocks: path codes, word codes, numbers."""

    def __init__(self, pages: list[list[tuple]]):
        blocks = [b for page in pages for b in page]
        self.lengths = np.array([len(p) for p in pages], np.int64)
        self.path_sizes = np.array([len(b[1]) for b in blocks], np.int64)
        self.paths = np.array([c for b in blocks for c in b[1]], np.int64)
        texts = Texts([b[0] for b in blocks], lower=True)
        starts, ends = texts.words()
        self.words = (texts.hashes(starts, ends) % np.uint64(WORD_BUCKETS)).astype(np.int64)
        self.word_sizes = np.bincount(texts.owner(starts), minlength=len(blocks)) if len(blocks) else np.zeros(0, np.int64)
        chars = np.array([len(b[0]) for b in blocks], float)
        stops = np.array([sum(b[0].count(c) for c in ".,;:!?") for b in blocks], float)
        place = np.concatenate([np.arange(n) / max(1, n - 1) for n in self.lengths]) if len(pages) else np.zeros(0)
        self.numbers = np.stack([
            np.log1p(chars) / 5, np.log1p(self.word_sizes) / 5, np.array([b[2] for b in blocks], float),
            np.minimum(stops / np.maximum(self.word_sizes, 1), 1), place, np.ones(len(blocks))], 1) if blocks else np.zeros((0, NUMBERS))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Embeddings, two LSTMs and a logistic output, in numpy."""

    def __init__(self, params: dict | None = None):
        if params is None:
            rng = np.random.default_rng(SEED)
            params = {"path": rng.normal(0, 0.3, (PATH_BUCKETS, PATH_SIZE)), "word": rng.normal(0, 0.1, (WORD_BUCKETS, WORD_SIZE)),
                      "out": rng.normal(0, 0.2, 2 * HIDDEN), "bias": np.zeros(1)}
            for way in ("f", "b"):
                params[f"{way}w"] = rng.normal(0, 0.2, (INPUT + HIDDEN, 4 * HIDDEN))
                params[f"{way}c"] = np.concatenate((np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)))
        self.p = params

    def vectors(self, inputs: Inputs) -> np.ndarray:
        return np.concatenate((ragged_mean(self.p["path"], inputs.paths, inputs.path_sizes),
                               ragged_mean(self.p["word"], inputs.words, inputs.word_sizes), inputs.numbers), 1)

    def run(self, way: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states (steps, pages, HIDDEN) in reading order; where the mask is 0 the state stays as it is."""
        w, c = self.p[f"{way}w"], self.p[f"{way}c"]
        steps, n, _ = x.shape
        h, s = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        out = np.empty((steps, n, HIDDEN))
        inner = x @ w[:INPUT] + c
        for t in range(steps):
            a = inner[t] + h @ w[INPUT:]
            i, f, o = (sigmoid(a[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(a[:, 3 * HIDDEN:])
            m = mask[t][:, None]
            new = f * s + i * g
            tanh = np.tanh(new)
            if keep is not None:
                keep.append((h, s, i, f, o, g, tanh, m))
            s = np.where(m > 0, new, s)
            h = np.where(m > 0, o * tanh, h)
            out[t] = h
        return out

    def back(self, way: str, x: np.ndarray, kept: list, dout: np.ndarray, grads: dict) -> np.ndarray:
        w = self.p[f"{way}w"]
        dx = np.zeros_like(x)
        dh, ds = np.zeros_like(dout[0]), np.zeros_like(dout[0])
        for t in range(len(kept) - 1, -1, -1):
            h, s, i, f, o, g, tanh, m = kept[t]
            dh = dh + dout[t]
            live = dh * m
            dnew = ds * m + live * o * (1 - tanh * tanh)
            da = np.concatenate((dnew * g * i * (1 - i), dnew * s * f * (1 - f), live * tanh * o * (1 - o), dnew * i * (1 - g * g)), 1)
            grads[f"{way}w"] += np.concatenate((x[t], h), 1).T @ da
            grads[f"{way}c"] += da.sum(0)
            dx[t] = da @ w[:INPUT].T
            dh = dh * (1 - m) + da @ w[INPUT:].T
            ds = ds * (1 - m) + dnew * f
        return dx

    def grid(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of a batch's blocks in a (steps, pages) grid, forwards and backwards, and the grid's mask."""
        steps, n = int(lengths.max(initial=1)), len(lengths)
        page = np.repeat(np.arange(n), lengths)
        t = np.arange(len(page)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        mask = np.zeros((steps, n))
        mask[t, page] = 1
        return t * n + page, (lengths[page] - 1 - t) * n + page, mask

    def forward(self, vectors: np.ndarray, lengths: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Probability of each block that it is main text."""
        ahead, behind, mask = self.grid(lengths)
        states = []
        for way, at in (("f", ahead), ("b", behind)):
            x = np.zeros((mask.size, INPUT))
            x[at] = vectors
            x = x.reshape(*mask.shape, INPUT)
            kept: list | None = [] if keep is not None else None
            states.append(self.run(way, x, mask, kept).reshape(-1, HIDDEN)[at])
            if keep is not None:
                keep[way] = (x, kept, at, mask.shape)
        both = np.concatenate(states, 1)
        if keep is not None:
            keep["both"] = both
        return sigmoid(both @ self.p["out"] + self.p["bias"])

    def gradients(self, inputs: Inputs, labels: np.ndarray) -> dict:
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        keep: dict = {}
        vectors = self.vectors(inputs)
        d = (self.forward(vectors, inputs.lengths, keep) - labels) / len(labels)
        grads["out"] = keep["both"].T @ d
        grads["bias"] = d.sum(keepdims=True)
        dboth = d[:, None] * self.p["out"]
        dv = np.zeros_like(vectors)
        for k, way in enumerate(("f", "b")):
            x, kept, at, shape = keep[way]
            dout = np.zeros((shape[0] * shape[1], HIDDEN))
            dout[at] = dboth[:, k * HIDDEN:(k + 1) * HIDDEN]
            dv += self.back(way, x, kept, dout.reshape(*shape, HIDDEN), grads).reshape(-1, INPUT)[at]
        for name, codes, sizes, part in (("path", inputs.paths, inputs.path_sizes, dv[:, :PATH_SIZE]),
                                         ("word", inputs.words, inputs.word_sizes, dv[:, PATH_SIZE:PATH_SIZE + WORD_SIZE])):
            np.add.at(grads[name], codes, np.repeat(part / np.maximum(sizes, 1)[:, None], sizes, axis=0))
        return grads

    def label(self, pages: list[list[tuple]]) -> list[np.ndarray]:
        """Whether each block of each page is main text; pages of like length are read together."""
        out: list = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        while order:
            # As many pages as their grid, as long as the longest of them, has room for; a very long page is alone.
            n = 1
            while n < min(64, len(order)) and (n + 1) * len(pages[order[n]]) <= GRID:
                n += 1
            at, order = order[:n], order[n:]
            inputs = Inputs([pages[i] for i in at])
            keep = self.forward(self.vectors(inputs), inputs.lengths) >= 0.5
            for i, part in zip(at, np.split(keep, np.cumsum(inputs.lengths)[:-1])):
                out[i] = part
        return out


# ---------------------------------------------------------------- training pages

MARK = "\ue000"  # begins the text of a block that is main text

# Names under which pages keep their article and their boilerplate.
ARTICLES = ["article", "main", "div class=content", "div id=content", "div class='post entry'", "div class=article-body", "section class=story",
            "div class='main text'", "td class=body", "div", "section", "article class=post"]
AROUND = {
    "menu": ["nav", "div class=menu", "ul class=nav", "div id=navigation", "header", "div class=breadcrumb", "div class='top bar'"],
    "foot": ["footer", "div class=footer", "div id=copyright", "div class='site footer'"],
    "side": ["aside", "div class=sidebar", "div class='related posts'", "div class=widget", "section class=recommended"],
    "note": ["div class='cookie notice'", "div id=banner", "div role=alert", "div class=newsletter", "div class=consent"],
    "ad": ["div class=ad", "div class=advert", "div class='sponsored promo'", "div id=ads", "aside class=ad"],
    "form": ["form", "form class=search", "fieldset", "form id=login"],
    "comment": ["div class=comments", "section id=comments", "ol class=commentlist", "div class='comment reply'", "div id=disqus"],
}
BOILERPLATE = frozenset("nav header footer aside form fieldset".split())


LEAST_WORDS, MOST_LINKED = 12, 0.3  # of a running text, on pages whose markup names no article


def teacher(html: str) -> tuple[list[str], list[str]]:
    """Article and other block texts of a page as its own markup names them, or else by the length of running texts."""
    article, main = path_code("article"), path_code("main")
    outside = {path_code(t) for t in BOILERPLATE} | {path_code("." + w) for w in ("ad", "comment", "comments", "sidebar", "notice")}
    blocks = parse(html)
    good = [bool({article, main} & set(codes)) and not outside & set(codes) for _, codes, _ in blocks]
    if not any(good):
        good = [len(text.split()) >= LEAST_WORDS and linked < MOST_LINKED and not outside & set(codes) for text, codes, linked in blocks]
    return [b[0] for b, g in zip(blocks, good) if g], [b[0] for b, g in zip(blocks, good) if not g]


def made_up(n: int) -> list[tuple[list[str], list[str]]]:
    """Articles and other texts of invented words, as ``teacher`` gives them."""
    rng = np.random.default_rng(SEED + 1)
    words = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(2, 9)))) for _ in range(600)]

    def text(least: int, most: int) -> str:
        picked = " ".join(words[i] for i in rng.integers(0, len(words), int(rng.integers(least, most))))
        return f"{picked[0].upper()}{picked[1:]}."

    return [([text(4, 9), *[text(12, 70) for _ in range(int(rng.integers(1, 7)))]], [text(1, 12) for _ in range(4)]) for _ in range(n)]


def element(name: str, inner: str) -> str:
    return f"<{name}>{inner}</{name.split()[0]}>"


def variant(article: list[str], pool: list[str], rng: np.random.Generator) -> str:
    """A page with the given article under some name, and boilerplate made of texts of the pool."""
    def words(low: int, high: int) -> str:
        text = pool[rng.integers(len(pool))].split()
        first = rng.integers(max(1, len(text) - low))
        return " ".join(text[first:first + int(rng.integers(low, high))])

    def extra(kind: str) -> str:
        name = AROUND[kind][rng.integers(len(AROUND[kind]))]
        if kind == "menu":
            inner = "".join(f"<li><a href=#>{words(1, 3)}</a></li>" for _ in range(rng.integers(2, 9)))
        elif kind == "form":
            inner = f"<p>{words(1, 6)}</p><label>{words(1, 3)}</label><button>{words(1, 3)}</button>"
        elif kind in ("comment", "side"):
            inner = "".join(f"<p>{words(3, 40)}</p>" for _ in range(rng.integers(1, 5)))
        else:
            inner = words(3, 25) if rng.random() < 0.5 else f"<p>{words(3, 25)}</p>"
        return element(name, inner)

    def some(kinds: str, most: int) -> list[str]:
        kinds_list = kinds.split()
        return [extra(kinds_list[rng.integers(len(kinds_list))]) for _ in range(rng.integers(0, most + 1))]

    body = [f"<{'h1' if i == 0 and rng.random() < 0.7 else 'p'}>{MARK}{t}" for i, t in enumerate(article)]
    for piece in some("ad note comment side form", 2):
        body.insert(int(rng.integers(1, len(body) + 1)), piece)
    name = ARTICLES[rng.integers(len(ARTICLES))]
    before, after = ["menu"], ["foot"]
    return ("<html><body>" + "".join([extra(k) for k in before] + some("menu ad note form", 3)) + element(name, "".join(body))
            + "".join(some("comment side ad form note", 3) + [extra(k) for k in after]) + "</body></html>")


def examples(pages: list[str]) -> list[tuple[list[tuple], np.ndarray]]:
    """(blocks, labels) of at most TRAIN_BLOCKS blocks each."""
    rng = np.random.default_rng(SEED)
    taught = [teacher(html) for html in pages]
    found = sum(bool(inside) for inside, _ in taught)
    if found < BASE:
        pages, taught = [*pages, *[""] * (BASE - found)], [*taught, *made_up(BASE - found)]
    pool = [t for inside, rest in taught for t in [*inside[:3], *rest] if t.strip()]
    out = []

    def add(blocks: list[tuple], labels: np.ndarray):
        for a in range(0, len(blocks), TRAIN_BLOCKS):
            out.append((blocks[a:a + TRAIN_BLOCKS], labels[a:a + TRAIN_BLOCKS]))

    for html, (inside, _) in zip(pages, taught):
        if not inside:
            continue
        known = set(inside)
        blocks = parse(html)
        if blocks:
            add(blocks, np.array([b[0] in known for b in blocks], float))
        for _ in range(VARIANTS):
            blocks = parse(variant(inside, pool, rng))
            labels = np.array([b[0].startswith(MARK) for b in blocks], float)
            add([(b[0].removeprefix(MARK) or " ", *b[1:]) for b in blocks], labels)
    return out


def train(pages: list[str]) -> Labeller:
    """Adam over shuffled batches; the same pages give the same labeller."""
    data, model = examples(pages), Labeller()
    rng = np.random.default_rng(SEED)
    m, v = ({k: np.zeros_like(x) for k, x in model.p.items()} for _ in range(2))
    step = 0
    for _ in range(max(EPOCHS, -(-STEPS // max(1, -(-len(data) // BATCH))))):
        order = rng.permutation(len(data))
        for first in range(0, len(order), BATCH):
            part = [data[i] for i in order[first:first + BATCH]]
            grads = model.gradients(Inputs([b for b, _ in part]), np.concatenate([y for _, y in part]))
            step += 1
            for k, g in grads.items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                model.p[k] -= RATE * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


def fit(pages: DataFrame) -> Labeller:
    """Fitted on the pages with the smallest hashes of their ids; ids are chosen first, so that only their pages move."""
    ids = materialize(pages.where("html is not null and page_id is not null").select("page_id")
                      .orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE), "page-sample").distinct()
    rows = pages.where("html is not null").select("page_id", "html").join(F.broadcast(ids), "page_id").groupBy("page_id").agg(F.min("html").alias("html"))
    # At most SAMPLE rows are put in order and summed up here.
    so_far = F.sum(F.length("html")).over(W.orderBy(F.xxhash64("page_id"), "page_id"))
    chosen = materialize(rows, "page-texts").withColumn("so_far", so_far).where(F.col("so_far") <= SAMPLE_CHARS).collect()
    chosen.sort(key=lambda r: r["page_id"])
    return train([r["html"] for r in chosen])


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """page_id, url and text: the main blocks in page order, one newline between them."""
    sent = pages.sparkSession.sparkContext.broadcast(model.p)

    def run(batches):
        labeller = Labeller(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                blocks = [parse(html or "") for html in part.column(2).to_pylist()]
                texts = ["\n".join(b[0] for b, good in zip(page, keep) if good) for page, keep in zip(blocks, labeller.label(blocks))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("bigint"), "url", "html").mapInArrow(run, "page_id bigint, url string, text string")
