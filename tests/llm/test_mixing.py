"""Mixing: every slot inside its window, deviations below a block, a step-by-step schedule as brute force."""

import random

from blendscope.llm import mixing
from pyspark.sql import functions as F


def edf(share):
    """Slots of each source in one period, by simulation; among equal deadlines the smaller share first, then the source."""
    period, done, slots = sum(share), [0] * len(share), [[] for _ in share]
    for t in range(period):
        ready = [(-(-(done[s] + 1) * period // a), a, s) for s, a in enumerate(share) if done[s] < a and done[s] * period // a <= t]
        s = min(ready)[2]
        slots[s].append(t)
        done[s] += 1
    return slots


def test_schedule_equals_simulation(frame):
    for share in ([1], [3, 1], [5, 3, 1, 1], [7, 7, 7], [97, 2, 1], [13, 11, 6, 4, 3, 1], [300] + [1] * 300, [5, 5, 2, 2, 2, 9]):
        keys = frame([(f"k{i:03d}", a) for i, a in enumerate(share)], "key string, share bigint")
        got = {r.key: (r.share, r.period, r.slots) for r in mixing.schedule(keys).collect()}
        want = edf(share)
        assert got == {f"k{i:03d}": (a, sum(share), want[i]) for i, a in enumerate(share)}


def test_deviation_stays_below_a_block(frame):
    share = [41, 23, 9, 5, 1]
    keys = frame([(str(i), a) for i, a in enumerate(share)], "key string, share bigint")
    rows = mixing.schedule(keys).collect()
    period = sum(share)
    for r in rows:
        for t in range(period + 1):
            assert abs(sum(s < t for s in r.slots) - t * r.share / period) < 1


def test_half_of_the_weight_beside_thousands(frame):
    n = 4999
    sizes = frame([("hot", 10**9)] + [(f"s{i:04d}", 10**6) for i in range(n)], "key string, total bigint")
    weights = frame([("hot", float(n))] + [(f"s{i:04d}", 1.0) for i in range(n)], "source string, weight double")
    keyed = sizes.withColumn("key", mixing.source_key(F.col("key")))
    rows = {r.key: r for r in mixing.schedule(mixing.shares(keyed, weights, 0.5)).collect()}
    hot = rows["=hot"]
    assert (hot.share, hot.period, len(rows)) == (n, 2 * n, n + 1) and all(len(r.slots) == r.share for r in rows.values())
    assert all(abs(i - s / 2) < 1 and abs(i + 1 - (s + 1) / 2) < 1 for i, s in enumerate(hot.slots))
    assert sorted(s for r in rows.values() for s in r.slots) == list(range(2 * n))


def test_shares_of_uneven_weights(frame):
    sizes = frame([(f"k{i}", (i + 1) * 1_000_003) for i in range(40)], "key string, total bigint")
    rows = {r.key: r.share for r in mixing.shares(sizes, None, 0.5).collect()}
    whole, w = sum(rows.values()), {f"k{i}": ((i + 1) * 1_000_003) ** 0.5 for i in range(40)}
    assert all(abs(rows[k] - whole * w[k] / sum(w.values())) < 1 for k in rows) and min(rows.values()) >= mixing.FINE


def test_many_different_shares(frame):
    sizes = frame([(f"k{i:04d}", (i + 1) ** 2) for i in range(1500)], "key string, total bigint")
    shares = mixing.shares(sizes, None, 0.5, most=20_000)
    rows = shares.collect()
    assert len({r.share for r in rows}) <= mixing.MOST_CLASSES and min(r.share for r in rows) >= 1
    placed = mixing.schedule(shares).collect()
    assert sorted(s for r in placed for s in r.slots) == list(range(sum(r.share for r in rows)))


def documents(frame, n=600):
    rng = random.Random(7)
    rows = [(i, "x" * rng.randint(0, 900), "hot" if rng.random() < 0.4 else f"s{rng.randrange(5)}", "clash") for i in range(n)]
    rows += [(n, "y" * 9000, "s1", "clash"), (n + 1, None, None, None), (None, "abc", None, None), (3, "x" * 5, "s1", "clash")]
    return frame(rows, "doc_id bigint, text string, source string, slot string").repartition(4)


def test_windows_and_places(frame):
    docs = documents(frame)
    rows = mixing.mix(docs, F.length("text"), block=1000).collect()
    assert len(rows) == docs.count()
    streams = {}
    for r in rows:
        assert r.release <= r.slot < r.deadline and r.block == r.start // 1000
        streams.setdefault(r.source, []).append((r.start, len(r.doc.text or "")))
    for stream in streams.values():
        stream.sort()
        assert all(a[0] + a[1] == b[0] for a, b in zip(stream, stream[1:]))
    owner = {}
    for r in rows:
        assert owner.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)


def test_given_weights(frame):
    docs = frame([(i, "x" * 100, "ab"[i % 2]) for i in range(400)], "doc_id bigint, text string, source string")
    weights = frame([("a", 3.0), ("b", 1.0), ("unused", 5.0)], "source string, weight double")
    rows = mixing.mix(docs, F.length("text"), weights=weights, block=1000).orderBy("slot", "start").collect()
    head = [r.source for r in rows if r.slot < 16]
    assert head.count("a") == 3 * head.count("b") == 120


def test_mixed_keeps_all_rows_and_columns(frame, hard_docs):
    for docs in (documents(frame), hard_docs):
        got = mixing.mixed(docs, block=500)
        assert got.columns == docs.columns
        assert sorted(map(repr, got.collect())) == sorted(map(repr, docs.collect()))


def test_empty_table(frame):
    assert mixing.mixed(frame([], "doc_id bigint, text string, source string")).count() == 0
