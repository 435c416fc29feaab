"""Quality rules: the counts against plain Python, the ratio against its definition."""

import collections
import math
import random
import re

import numpy as np
import pytest
from blendscope.llm import quality
from blendscope.llm.textvec import Texts
from pyspark.sql import functions as F


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_counts_of_random_texts():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "b", "é#", "日本", "<x>", "\n", "\n\n", "\t", "\r"]) for _ in range(rng.randint(0, 120))) for _ in range(800)]
    texts += [None, "", "\n", "a\na\n\na ", "x y z w v u t s x y z w v u t s"]
    got = list(zip(*(c.tolist() for c in quality.base_counts(Texts(texts)))))
    assert got == [plain_counts(t) for t in texts]


def test_grams_stay_inside_their_text():
    texts = ["abcde", "abc", None, "éé"]
    bucket, first, last = quality.grams(Texts(texts))
    assert (last - first).tolist() == [2, 0, 0, 1]
    alone, a, _ = quality.grams(Texts(["bcde"]))
    assert bucket[first[0] + 1] == alone[a[0]]


def fixture(frame):
    rng = random.Random(8)
    def sentence(n, tail=""):
        return " ".join(rng.choice(["river", "stone", "walks", "under", "bright", "morning", "paper"]) + str(rng.randrange(9)) + tail for _ in range(n))
    docs = [(i, sentence(60)) for i in range(120)] + [(i, sentence(60, "###")) for i in range(120, 160)]
    labels = [(i, int(i < 120), 0) for i in range(0, 160, 2)]
    return (frame([(*d, "x") for d in docs], "doc_id bigint, text string, kept string"),
            frame(labels, "doc_id bigint, quality int, toxic int"), dict(docs))


def test_junk_goes_and_clean_text_stays(frame):
    docs, labels, texts = fixture(frame)
    rules = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.judge(docs, rules).collect()}
    assert {i for i, r in got.items() if r.kept} == set(range(120))
    kept = quality.keep(docs, rules)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(120))

    counts = [collections.Counter(), collections.Counter()]
    for doc, text in texts.items():
        bucket, first, last = quality.grams(Texts([text]))
        for b in bucket[first[0]:last[0]].tolist():
            counts[1][b] += 1
            counts[0][b] += doc < 120 and doc % 2 == 0
    total = [sum(c.values()) + quality.PRIOR * quality.BUCKETS for c in counts]
    bucket, first, last = quality.grams(Texts([texts[7]]))
    want = np.mean([math.log((counts[0][b] + quality.PRIOR) / total[0]) - math.log((counts[1][b] + quality.PRIOR) / total[1])
                    for b in bucket[first[0]:last[0]].tolist()])
    assert got[7].score == pytest.approx(want)


def test_shuffled_join_gives_the_same(frame, monkeypatch):
    docs, labels, _ = fixture(frame)
    one = quality.fit(docs, labels)
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 0)
    two = quality.fit(docs, labels)
    assert np.allclose(one.ratio, two.ratio) and one.threshold == pytest.approx(two.threshold)


def test_hard_rows_and_missing_labels(frame, hard_docs):
    none = frame([(None, None)], "doc_id bigint, quality int")
    rules = quality.fit(hard_docs, none)
    got = quality.judge(hard_docs, rules).collect()
    want = sorted((r.doc_id is None, r.doc_id or 0, *plain_counts(r.text)) for r in hard_docs.collect())
    assert sorted((r.doc_id is None, r.doc_id or 0, *(r[c] for c in quality.COUNTS)) for r in got) == want
    assert all(r.kept != r.base_failed for r in got)  # without labels only the base rule decides
    assert quality.keep(hard_docs, rules).columns == hard_docs.columns


def test_empty_table(frame):
    docs, labels = frame([], "doc_id bigint, text string"), frame([], "doc_id bigint, quality int")
    assert quality.judge(docs, quality.fit(docs, labels)).count() == 0


def test_cut_weighs_lost_good_documents():
    scores, good = np.array([0.0, 1.0, 2.0, 3.0]), np.array([False, True, False, True])
    assert 0 < quality.cut(scores, good) < 1
    assert quality.cut(scores, np.ones(4, bool)) == -np.inf


def test_cut_of_rows_is_that_of_arrays(frame):
    rng = np.random.default_rng(4)
    for n, shift in ((1, 0), (40, 2), (3000, 1), (3000, 0), (500, -4)):
        good = rng.random(n) < 0.5
        scores = rng.normal(size=n) + shift * good
        rows = frame([(float(s), int(g)) for s, g in zip(scores, good)], "score double, quality bigint").repartition(7)
        assert quality.cut_rows(rows) == quality.cut(scores, good)
    tied = frame([(0.0, 0), (1.0, 1), (1.0, 0), (1.0, 0), (2.0, 1)], "score double, quality bigint")
    assert quality.cut_rows(tied) == 0.25


def test_threshold_takes_every_labelled_document(frame, monkeypatch):
    docs, labels, _ = fixture(frame)
    seen = []
    monkeypatch.setattr(quality, "cut_rows", lambda scored: seen.append(scored.count()) or 0.0)
    many = docs.crossJoin(docs.sparkSession.range(150).toDF("again")).withColumn("doc_id", docs.doc_id + 1000 * F.col("again"))
    ids = labels.crossJoin(docs.sparkSession.range(300).toDF("again")).withColumn("doc_id", labels.doc_id + 1000 * F.col("again"))
    more = many.unionByName(many.withColumn("doc_id", F.col("doc_id") + 150_000))
    quality.fit(more, ids)
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 0)
    quality.fit(more, ids)
    assert seen == [24_000, 24_000]
