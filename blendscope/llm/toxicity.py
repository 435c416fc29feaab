"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of ASCII letters and digits, A-Z as a-z, and of all other characters outside ASCII. A text's features are the
distinct hashes of its words, of neighbouring pairs and of pairs with one word between, in ``BUCKETS`` buckets. Every
coordinate has its own rate, and L1 leaves few weights, which are broadcast.

The fit reads at most ``SAMPLE`` labelled rows (those with the smallest hashes of their doc_id), one text at a time in one
task, ``EPOCHS`` times; a quarter of them is left out of that and fits the scale and intercept that turn sums of
weights, which L1 shrinks, into probabilities. Labels, lang, source and doc_id are no inputs of a score.

Defined cases: null or empty text has the score of the intercept; a null doc_id is never held out and stays null;
repeated rows give repeated rows; without usable labels every score is 0.5; an empty table gives no rows; other columns
are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blendscope.session import materialize

from .textvec import BASE, Texts, chunks, mix

BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
SAMPLE = 12_000
EPOCHS = 3
CALIBRATION = 4  # one labelled row in so many fits the probabilities
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.1
FOLDS, HELD_OUT = 3, 1

WORD = np.zeros(256, bool)
WORD[[b for b in range(128) if chr(b).isalnum()]] = True
WORD[128:] = True
KINDS = mix(np.arange(11, 14, dtype=np.uint64))


def features(texts):
    """Sorted distinct buckets of each text."""
    for _, part in chunks(texts):
        batch = Texts(part, lower=True)
        edge = np.flatnonzero(np.diff(np.concatenate(([False], WORD[batch.data], [False])).view(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        words = batch.hashes(starts, ends)
        shift = np.uint64(64 - BUCKET_BITS)
        one = mix(words ^ KINDS[0]) >> shift
        two = mix((words[:-1] ^ KINDS[1]) * BASE + words[1:]) >> shift
        skip = mix((words[:-2] ^ KINDS[2]) * BASE + words[2:]) >> shift
        first = np.searchsorted(starts, batch.starts).tolist()
        for a, b in zip(first, [*first[1:], len(words)]):
            yield np.unique(np.concatenate((one[a:b], two[a:max(a, b - 1)], skip[a:max(a, b - 2)]))).astype(np.int32)


class Ftrl:
    """FTRL-proximal for 0/1 features; coordinate ``BUCKETS`` is the intercept, without penalties."""

    def __init__(self):
        self.z, self.n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        plain = at == BUCKETS
        l1, l2 = np.where(plain, 0.0, L1), np.where(plain, 0.0, L2)
        w = -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, BUCKETS)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def calibration(sums: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Scale and intercept of the logistic fit of labels to sums (Newton steps, smoothed targets); (1, 0) without both labels."""
    ones = int(labels.sum())
    if not 0 < ones < len(labels):
        return 1.0, 0.0
    goal = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))
    x = np.stack((sums, np.ones(len(sums))), 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        w -= np.linalg.solve((x.T * np.maximum(p * (1 - p), 1e-6)) @ x + 1e-3 * np.eye(2), x.T @ (p - goal))
    return (float(w[0]), float(w[1])) if np.isfinite(w).all() and w[0] > 0 else (1.0, 0.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights) of the coordinates that are not zero, at most one per bucket and the intercept."""
    marks = (labels.where("toxic is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
             .agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(~held_out(F.col("doc_id"))))
    order = (F.xxhash64("doc_id"), "doc_id")
    chosen = marks.orderBy(*order).limit(SAMPLE)
    texts = docs.select(F.col("doc_id").cast("bigint"), "text").join(F.broadcast(chosen), "doc_id")

    def hashed(batches):
        for batch in batches:
            at = list(features(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a.tobytes() for a in at], pa.binary()),
                                              batch.column(2)], names=["doc_id", "at", "toxic"])

    rows = materialize(texts.mapInArrow(hashed, "doc_id bigint, at binary, toxic int"), "toxic-sample")
    apart = F.pmod(F.xxhash64(F.lit("calibration"), "doc_id"), F.lit(CALIBRATION)) == 0
    last = F.lit(EPOCHS + 1)
    passes = rows.withColumn("epoch", F.explode(F.when(apart, F.array(last)).otherwise(F.sequence(F.lit(1), F.lit(EPOCHS)))))
    ordered = passes.repartition(1).sortWithinPartitions("epoch", *order, "at").select("at", "toxic", "epoch")

    def learn(batches):
        model, sums, labels = Ftrl(), [], []
        for batch in batches:
            for at, toxic, epoch in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                at = np.frombuffer(at.as_buffer(), np.int32)
                if epoch <= EPOCHS:
                    model.learn(at, toxic)
                else:
                    sums.append(model.weights(np.append(at, BUCKETS)).sum())
                    labels.append(toxic)
        scale, shift = calibration(np.array(sums), np.array(labels))
        w = model.weights(np.arange(BUCKETS + 1)) * scale
        w[BUCKETS] += shift
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_pydict({"bucket": at, "weight": w[at]})

    found = ordered.mapInArrow(learn, "bucket bigint, weight double").toArrow()
    return found["bucket"].to_numpy().astype(np.int32), found["weight"].to_numpy()


def score_texts(texts: list, dense: np.ndarray) -> np.ndarray:
    total = np.array([dense[at].sum() for at in features(texts)]) + dense[BUCKETS]
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id and score (0 to 1) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        dense = np.zeros(BUCKETS + 1)
        dense[sent.value[0]] = sent.value[1]
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score_texts(part.column(1).to_pylist(), dense))],
                                                 names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, score double")
