"""Quality classifier: held-out accuracy, plain versions of its two steps, and what a score may depend on."""

import random
import zlib

import numpy as np
from blendscope.llm import nbsvm
from pyspark.sql import functions as F


def corpus(frame):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(900):
        good = rng.random() < 0.8
        words = ["w%d" % rng.randrange(400) for _ in range(rng.randint(20, 60))]
        if not good:
            kind = rng.randrange(3)
            at = rng.randrange(len(words))
            words = ([words[at]] * 30 if kind == 0 else [w + "$$$" for w in words] if kind == 1 else [w.upper() + "!!" for w in words])
        docs.append((i, " ".join(words), "zz"))
        labels.append((i, int(good)))
    return frame(docs, "doc_id bigint, text string, score string"), frame(labels, "doc_id bigint, quality int"), dict(labels)


def test_held_out_accuracy(frame):
    docs, labels, truth = corpus(frame)
    got = nbsvm.score(docs, nbsvm.fit(docs, labels)).withColumn("held", nbsvm.held_out(F.col("doc_id"))).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held]
    assert len(got) == 900 and sum((r.score >= 0.3) == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert all(r.score >= 0.3 for r in held if truth[r.doc_id])


def test_held_out_labels_change_nothing(frame):
    docs, labels, _ = corpus(frame)
    flipped = labels.withColumn("quality", F.when(nbsvm.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (nbsvm.fit(docs, x) for x in (labels, flipped))
    assert all((np.asarray(a) == np.asarray(b)).all() for a, b in zip(one, two))


def test_ratios_are_those_of_a_plain_count(frame):
    rows = [("a b", 1), ("a c", 1), ("a $$", 0), ("", 0), (None, 1), ("a b", 1)]
    ratios, good, bad = nbsvm.log_ratios(frame(rows, "text string, label int"))
    assert (good, bad) == (4, 2)
    counts = np.ones((2, nbsvm.BUCKETS))
    seen = set()
    for text, label in rows:
        at = next(iter(nbsvm.indicators([text])))
        counts[1 - label][at] += 1
        seen |= set(at.tolist())
    want = np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())
    at = np.array(sorted(seen))
    assert np.allclose(ratios[at], want[at]) and np.count_nonzero(np.delete(ratios, at)) == 0


def test_descent_reaches_the_primal_optimum(monkeypatch):
    """The dual's weights against a subgradient check: no small step lowers the hinge objective noticeably."""
    monkeypatch.setattr(nbsvm, "EPOCHS", 400)
    monkeypatch.setattr(nbsvm, "STILL", 1e-6)
    monkeypatch.setattr(nbsvm, "MIXED", 1.0)
    rng = np.random.default_rng(2)
    rows = [np.sort(rng.choice(30, 6, replace=False)).astype(np.int32) for _ in range(80)]
    labels = np.array([int(r[0] < 4) for r in rows])
    ratios = np.zeros(nbsvm.BUCKETS)
    ratios[:30] = rng.normal(0, 1, 30)
    w = nbsvm.descend(rows, labels, ratios)
    y = 2 * labels - 1
    cost = len(y) / (2 * np.array([(labels == 0).sum(), (labels == 1).sum()])[labels])

    def objective(v):
        x = np.array([v[r] @ nbsvm.scaled(r, ratios) + v[nbsvm.BUCKETS] for r in rows])
        return 0.5 * v @ v + (cost * np.maximum(0, 1 - y * x)).sum()

    best = objective(w)
    for _ in range(300):
        step = np.zeros_like(w)
        step[np.append(np.arange(30), nbsvm.BUCKETS)] = rng.normal(0, rng.choice([1e-3, 1e-2, 0.1]), 31)
        assert objective(w + step) >= best - 1e-4


def test_hard_rows_without_labels(frame, hard_docs):
    model = nbsvm.fit(hard_docs, frame([(2, None), (None, 1), (5, 1)], "doc_id bigint, quality int"))
    got = nbsvm.score(hard_docs, model).collect()
    assert model is None and len(got) == hard_docs.count() and all(r.score == 0.5 for r in got)


def test_hard_rows_with_labels(frame, hard_docs):
    labels = frame([(i, int(i in (3, 5))) for i in range(1, 9)] + [(5, 0)], "doc_id bigint, quality int")
    got = nbsvm.score(hard_docs, nbsvm.fit(hard_docs, labels)).collect()
    assert len(got) == hard_docs.count() and all(0 <= r.score <= 1 for r in got)


def test_empty_table(frame):
    docs = frame([], "doc_id bigint, text string")
    assert nbsvm.score(docs, nbsvm.fit(docs, frame([], "doc_id bigint, quality int"))).count() == 0


def test_indicators_do_not_depend_on_the_batch():
    texts = ["a b\n", "\n\nA a a", None, "", "x" * 10, "$$ !! é É 7x"]
    together = [a.tolist() for a in nbsvm.indicators(texts)]
    assert together == [next(iter(nbsvm.indicators([t]))).tolist() for t in texts]
    assert together[2] == together[3] == [] and len(together[4]) == 1
