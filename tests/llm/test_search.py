"""Exact top-k against brute force, with ties, sparse vectors and unusable rows."""

import math
import random

from blendscope.llm import search
from pyspark.sql import functions as F


def brute_force(rows, k):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, w in usable:
        if q % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(w, v)), i) for i, v in usable if i != q)[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(found, 1)]
    return sorted(out)


def compare(frame, rows, k=5):
    vectors = frame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, score int").repartition(3)
    got = search.top_k(vectors, F.col("vec_id") % 50 == 0, k)
    assert sorted(map(tuple, got.collect())) == brute_force(rows, k)


def test_random_sparse_and_ties(frame, monkeypatch):
    monkeypatch.setattr(search, "QUERIES", 3)
    monkeypatch.setattr(search, "ROWS", 64)
    rng = random.Random(4)
    rows = [(i, [rng.choice([0.0, 0.0, 0.5, -0.25, 1.0]) for _ in range(8)]) for i in range(400)]
    rows += [(1000 + i, [0.5] * 8) for i in range(200)]  # one very common vector
    compare(frame, rows)


def test_shuffled_query_blocks(frame, monkeypatch):
    monkeypatch.setattr(search, "QUERIES", 2)
    monkeypatch.setattr(search, "BROADCAST_BYTES", 0)
    rng = random.Random(6)
    compare(frame, [(i, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(600)], k=3)


def test_unusable_rows_and_lengths(frame):
    rows = [(0, [1.0, 2.0]), (50, None), (100, [float("nan"), 1.0]), (1, [1.0, None]), (2, [float("inf")]), (None, [1.0]),
            (3, [1.0]), (4, []), (5, [0.1, 0.1, 9.0]), (150, []), (6, [-1.0, -1.0]), (6, [-1.0, -1.0])]
    compare(frame, rows)


def test_empty_table(frame):
    compare(frame, [])
