"""Source divergence against brute force in Python integers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from blendscope.llm import divergence

COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def brute_force(rows, least, top=50):
    texts = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")))
             for lang, source, text in rows]
    held = defaultdict(Counter)
    for lang, _, words in texts:
        held[lang].update(set(words))
    kept = {lang: sorted((t for t, n in c.items() if n >= least), key=str.encode) for lang, c in held.items()}
    counts = defaultdict(Counter)
    for lang, source, words in texts:
        counts[lang, source].update(w for w in words if w in set(kept[lang]))
    out = []
    for lang, terms in kept.items():
        sources = sorted({s for a, s, _ in texts if a == lang}, key=str.encode)
        whole = sum((counts[lang, s] for s in sources), Counter())

        def prices(c, terms=terms):
            return [1 + 10**9 * (c[t] + 5) // (c.total() + 5 * len(terms)) for t in terms]

        q = prices(whole)
        for s in sources:
            p = prices(counts[lang, s])
            pairs = sorted(((-sum(abs(a - b) for a, b in zip(p, prices(counts[lang, o]))), o.encode(), o) for o in sources if o != s))
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)]
            over = sorted((b - a, t.encode(), t) for a, b, t in zip(p, q, terms) if counts[lang, s][t] and a > b)[:top]
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(over)]
    return sorted(out)


def compare(docs, least, top=50, **how):
    rows = [(r.lang, r.source, r.text) for r in docs.select("lang", "source", "text").collect()]
    got = sorted(tuple(r) for r in divergence.audit(docs, least, top, **how).select(*COLUMNS).collect())
    assert got == brute_force(rows, least, top)
    return got


def corpus(frame, sources, docs, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(docs):
        source = rng.randrange(sources) if rng.random() < 0.7 else 0  # a third of all rows in one group
        words = [rng.choice(["the", "The", "é", "ß7x", f"w{chr(97 + rng.randrange(26))}", f"s{chr(97 + source % 26)}q"]) for _ in range(rng.randint(0, 30))]
        rows.append((i, " ".join(words) + ".", rng.choice(["en", "de"]), f"src{source}", "clash"))
    return frame(rows, "doc_id bigint, text string, lang string, source string, value string")


def test_random_corpus(frame):
    got = compare(corpus(frame, 6, 300), 3)
    assert any(r[2] == "term" for r in got)


def test_several_tiles(frame):
    compare(corpus(frame, 23, 400), 3, 4, tile=5)


def test_hard_rows(hard_docs):
    compare(hard_docs, 1)


def test_no_kept_terms_gives_pairs_of_zero(frame):
    docs = frame([("a", "en", "x"), ("b", "en", "y"), (None, None, "z")], "text string, lang string, source string")
    assert compare(docs, 30) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_empty_table(frame):
    assert divergence.audit(frame([], "text string, lang string, source string")).count() == 0


def test_counts_beyond_doubles(spark):
    df = spark.sql("select 9000000000123456789L as n, 9000000000123456790L as total, 3L as v")
    got = df.select(divergence.price("n", "total", "v").alias("p")).first().p
    assert got == 1 + 10**9 * (9000000000123456789 + 5) // (9000000000123456790 + 15)


@pytest.mark.parametrize(("rows", "columns", "filled"), [(1, 1, 1.0), (2, 9, 0.3), (7, 40, 0.1), (8, 8, 0.0), (5, 33, 0.9)])
def test_trees_price_each_cell(rows, columns, filled):
    rng = np.random.default_rng(rows)
    cells = np.where(rng.random((rows, columns)) < filled, rng.integers(1, 10**9, (rows, columns)), -1)
    empty = rng.integers(1, 10**9, rows)
    row, col = np.nonzero(cells >= 0)
    bits = (rows - 1).bit_length()
    tree = divergence.Tree(row, col, cells[row, col], bits)
    full = np.where(cells >= 0, cells, empty[:, None])
    want = np.abs(full[:, None, :] - full[None, :, :]).sum(2)
    assert (divergence.differences(tree, tree, empty, empty, columns, bits, False) == want).all()
    half = divergence.differences(tree, tree, empty, empty, columns, bits, True)
    assert (np.triu(half, 1) == np.triu(want, 1)).all()
