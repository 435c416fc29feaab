"""Toxicity: held-out accuracy on a planted vocabulary, and what a score may depend on."""

import math
import random
import zlib

import numpy as np
from blendscope.llm import toxicity
from pyspark.sql import functions as F

BAD = ["vile", "filth", "brute"]


def corpus(frame):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(900):
        words = ["w%d" % rng.randrange(400) for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", ",", "!"]))
        docs.append((i, " ".join(words), "zz"))
        labels.append((i, int(toxic)))
    return frame(docs, "doc_id bigint, text string, score string"), frame(labels, "doc_id bigint, toxic int"), dict(labels)


def test_held_out_accuracy(frame):
    docs, labels, truth = corpus(frame)
    got = toxicity.score(docs, toxicity.fit(docs, labels)).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held]
    assert len(got) == 900 and sum((r.score >= 0.5) == truth[r.doc_id] for r in held) / len(held) > 0.95


def test_held_out_labels_change_nothing(frame):
    docs, labels, _ = corpus(frame)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (toxicity.fit(docs, x) for x in (labels, flipped))
    assert (one[0] == two[0]).all() and (one[1] == two[1]).all()


def test_hard_rows_without_labels(frame, hard_docs):
    weights = toxicity.fit(hard_docs, frame([(2, None), (None, 1)], "doc_id bigint, toxic int"))
    got = toxicity.score(hard_docs, weights).collect()
    assert len(got) == hard_docs.count() and all(r.score == 0.5 for r in got)


def test_empty_table(frame):
    docs = frame([], "doc_id bigint, text string")
    assert toxicity.score(docs, toxicity.fit(docs, frame([], "doc_id bigint, toxic int"))).count() == 0


def test_features_are_words_pairs_and_skips():
    one, two = toxicity.features(["a b c", "A, b! c"])
    assert one.tolist() == two.tolist() and len(one) == 3 + 2 + 1
    assert [len(f) for f in toxicity.features([None, "", "x", "x y"])] == [0, 0, 1, 3]


def test_calibration_recovers_a_scale():
    rng = np.random.default_rng(1)
    sums = rng.normal(0, 1, 20_000)
    labels = (rng.random(20_000) < 1 / (1 + np.exp(-(2 * sums - 1)))).astype(int)
    scale, shift = toxicity.calibration(sums, labels)
    assert abs(scale - 2) < 0.15 and abs(shift + 1) < 0.15
    assert toxicity.calibration(sums, np.zeros(20_000, int)) == toxicity.calibration(np.zeros(0), np.zeros(0, int)) == (1.0, 0.0)


def test_ftrl_equals_a_plain_version():
    rng = random.Random(4)
    rows = [(sorted(rng.sample(range(40), rng.randint(0, 12))), rng.randint(0, 1)) for _ in range(400)]
    model, z, n = toxicity.Ftrl(), {}, {}

    def weight(i):
        l1, l2 = (0.0, 0.0) if i == toxicity.BUCKETS else (toxicity.L1, toxicity.L2)
        zi = z.get(i, 0.0)
        if abs(zi) <= l1:
            return 0.0
        return ((l1 if zi > 0 else -l1) - zi) / ((toxicity.BETA + math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA + l2)

    for at, label in rows:
        model.learn(np.array(at, np.int64), label)
        at = [*at, toxicity.BUCKETS]
        w = [weight(i) for i in at]
        g = 1 / (1 + math.exp(-sum(w))) - label
        for i, wi in zip(at, w):
            old = n.get(i, 0.0)
            z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / toxicity.ALPHA * wi
            n[i] = old + g * g
    places = np.array([*range(40), toxicity.BUCKETS])
    want = [weight(i) for i in places.tolist()]
    assert np.allclose(model.weights(places), want, rtol=1e-9, atol=1e-12)
    assert 0 < sum(w == 0 for w in want) < len(want)
