"""Ranked search against brute force in Python integers."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from blendscope.llm import balltree


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute_force(docs, items, k=10):
    bags = [(i, Counter(words(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    terms = {}
    for item, text in items:
        terms.setdefault(item, set()).update(words(text))
    out = []
    for item, query in terms.items():
        found = []
        for i, bag in bags:
            m = 100 - 90 + 90 * bag.total() * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m))
                        for t in query if t in bag)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:k])]
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def compare(docs, items, **how):
    got = ordered([tuple(r) for r in balltree.ranked(docs, items, **how).collect()])
    want = brute_force([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got == ordered(want)
    return got


def corpus(frame, seed=4, n=600):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 80), weights=[1 / (i + 1) for i in range(300)])) for _ in range(n)]
    texts += [texts[0]] * 40 + ["W1, w2; W3!"] * 30  # ties
    items = [(i, " ".join(rng.sample(vocabulary, 12)) + " nowhere") for i in range(20)] + [(20, texts[0]), (21, "w1 w2 w3")]
    docs = [(i, t, "x", i) for i, t in enumerate(texts)]
    return frame(docs, "doc_id bigint, text string, score string, rank int"), frame(items, "item_id bigint, text string")


def test_random_corpus(frame):
    compare(*corpus(frame))


def test_several_batches_of_queries(frame):
    docs, items = corpus(frame, n=100)
    compare(docs, items, batch_entries=40)


def test_hard_rows(frame, hard_docs):
    items = frame([(1, "one two three", "k"), (1, "FOUR four", "k"), (2, None, "k"), (3, "", "k"), (4, "word", "k"), (None, "日本語 other", "k"),
                   (5, "nowhere", "k"), (6, "text whose id is missing", "k")], "item_id bigint, text string, doc_id string")
    got = compare(hard_docs, items)
    assert {r[0] for r in got} == {1, 4, 6, None} and any(r[2] is None for r in got)


def test_empty_tables(frame):
    no_docs, no_items = frame([], "doc_id bigint, text string"), frame([], "item_id bigint, text string")
    docs, items = frame([(1, "a b")], "doc_id bigint, text string"), frame([(1, "a b")], "item_id bigint, text string")
    assert balltree.ranked(no_docs, items).count() == balltree.ranked(docs, no_items).count() == balltree.ranked(no_docs, no_items).count() == 0


def test_bounds_hold_and_close_leaves():
    rng = np.random.default_rng(8)
    width, n = 400, 1500
    sizes = rng.integers(0, 30, n)
    term = np.concatenate([np.sort(rng.choice(width, s, replace=False)) for s in sizes])
    x = rng.integers(1, 1_000_000, len(term))
    w = rng.integers(0, 9000, width)
    block = balltree.Block(pa.array(np.arange(n)), sizes, term, x, w)
    dense = np.zeros((n, width), np.int64)
    dense[np.repeat(np.arange(n), sizes), term] = x
    leaves = closed = 0
    for _ in range(50):
        query = np.sort(rng.choice(np.flatnonzero(w), 15, replace=False))
        exact = dense[:, query] @ w[query]
        at = np.searchsorted(block.terms, query)
        upper = block.upper(at, w[query], float(np.sqrt(w[query].sum())))
        ids = block.ids.to_numpy()
        weights = np.zeros(len(block.terms), np.int64)
        weights[at] = w[query]
        tenth = np.sort(exact)[-10]
        for node, (a, b) in enumerate(zip(block.first, block.last)):
            assert (exact[ids[a:b]] <= upper[node]).all() and (block.scores(a, b, weights) == exact[ids[a:b]]).all()
            if block.left[node] < 0:
                leaves += 1
                closed += upper[node] < tenth
    assert closed > leaves / 10


def test_lengths_beyond_64_bits():
    n = np.array([10**12, 1], np.int64)
    got = balltree.impacts(n, np.array([1, 1]), np.array([3, 1]), 10**9, 10**13)
    m = [10 + 90 * int(v) * 10**9 // 10**13 for v in n]
    assert got.tolist() == [10**9 * 3 // (3000 + 8 * m[0]), 10**9 // (1000 + 8 * m[1])]
