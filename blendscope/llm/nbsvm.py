"""Quality classifier: naive Bayes support vectors over hashed n-gram indicators.

A text is read as tokens: words (ASCII letters and digits, and all other characters outside ASCII), runs of other visible
characters, and line ends. Its indicators are the distinct hashes of four kinds of n-grams in ``BUCKETS`` buckets: single
lower-cased tokens, pairs of them, and pairs and triples of token shapes. A shape tells how a word is written (lower case, capital,
all capitals, digits, outside ASCII), spells marks out, and tells whether a token repeats the one before it.

The fit has two steps. Every labelled row outside the held-out fold counts: per bucket and class, the share of rows that hold
it, whose log ratio scales the indicator. On the scaled indicators, each row cut to length one, a linear hinge-loss model is fitted by
dual coordinate descent over at most ``SAMPLE`` labelled rows (those with the smallest hashes of their doc_id, one row per
doc_id) whose features take at most ``SAMPLE_BYTES``, in one task; one in ``CALIBRATION`` of these is left out of the descent and
fits the scale and intercept that turn sums into probabilities. Weights are drawn towards their mean by ``MIXED``, as the method
has it. Labels, lang, source and doc_id are no inputs of a score.

Defined cases: null or empty text has no indicators and the score of the intercept; a null doc_id is never held out and stays
null; repeated rows give repeated rows, and count each; a doc_id with several labels has the largest; without labelled rows of
both kinds every score is 0.5; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blendscope.session import materialize

from .textvec import BASE, SPACES, Texts, chunks, mix
from .toxicity import calibration

BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
SAMPLE = 20_000
SAMPLE_BYTES = 128 << 20
# Labels (12 bytes each) of at most so many documents are broadcast; above, both sides are shuffled.
BROADCAST_ROWS = 2_000_000
CALIBRATION = 4
PRIOR = 1.0  # added to every bucket of both classes
COST = 1.0
EPOCHS = 12
STILL = 0.01  # descent ends when no projected gradient of a pass is larger
MIXED = 0.75  # share of a bucket's own weight; the rest is the mean size of all weights
FOLDS, HELD_OUT = 5, 0

WORD = np.zeros(256, bool)
WORD[[b for b in range(128) if chr(b).isalnum()]] = True
WORD[128:] = True
CLASS = np.where(WORD, 1, np.where(SPACES, 0, 2)).astype(np.int8)
CLASS[0x0A] = 3
UPPER, LOWERCASE, DIGIT = (np.array([b < 128 and test(chr(b)) for b in range(256)]) for test in (str.isupper, str.islower, str.isdigit))
KINDS = mix(np.arange(21, 26, dtype=np.uint64))


def tokens(batch: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte of every token, its hash with A-Z as a-z, and the code of its shape."""
    data = batch.data
    kind = CLASS[data]
    turn = np.diff(kind, prepend=np.int8(-1)) != 0
    turn[batch.starts] = True  # what a text begins with does not depend on its neighbour in the batch
    edge = np.flatnonzero(turn)
    starts = edge[kind[edge] != 0]
    ends = np.append(edge, len(data))[np.searchsorted(edge, starts) + 1]
    ends = np.where(kind[starts] == 3, starts + 1, ends)  # one line end, however many follow
    plain = Texts.__new__(Texts)
    plain.data = np.where(UPPER[data], data + np.uint8(32), data)
    names = plain.hashes(starts, ends)

    def holds(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[ends] - total[starts]

    upper, lower = holds(UPPER[data]), holds(LOWERCASE[data])
    shape = ((upper > 0) + 2 * ((upper > 1) & (lower == 0)) + 4 * (holds(DIGIT[data]) > 0) + 8 * (holds(data >= 128) > 0)).astype(np.uint64)
    word = kind[starts] == 1
    shape = np.where(word, mix(shape + np.uint64(1)), names)
    same = np.zeros(len(names), bool)
    same[1:] = names[1:] == names[:-1]
    first = np.searchsorted(starts, batch.starts)
    same[first[first < len(same)]] = False
    return starts, names, np.where(same, mix(shape), shape)


def indicators(texts):
    """Sorted distinct buckets of each text."""
    shift = np.uint64(64 - BUCKET_BITS)
    for _, part in chunks(texts):
        batch = Texts(part)
        starts, names, shapes = tokens(batch)
        one = mix(names ^ KINDS[0]) >> shift
        two = mix((names[:-1] ^ KINDS[1]) * BASE + names[1:]) >> shift
        pair = (shapes[:-1] ^ KINDS[2]) * BASE + shapes[1:]
        three = mix((pair[:-1] ^ KINDS[3]) * BASE + shapes[2:]) >> shift
        pair = mix(pair) >> shift
        first = np.searchsorted(starts, batch.starts)
        last = np.searchsorted(starts, batch.ends)
        for a, b in zip(first.tolist(), last.tolist()):
            near = max(a, b - 1)
            yield np.unique(np.concatenate((one[a:b], two[a:near], pair[a:near], three[a:max(a, b - 2)]))).astype(np.int32)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def marks(labels: DataFrame) -> DataFrame:
    """doc_id and label (0 or 1) of the rows that may be learned from."""
    doc_id = F.col("doc_id").cast("bigint").alias("doc_id")
    grouped = labels.where("quality is not null and doc_id is not null").groupBy(doc_id).agg(F.max(F.col("quality").cast("int")).alias("label"))
    return grouped.where(~held_out(F.col("doc_id")) & F.col("label").isin(0, 1))


def log_ratios(labelled: DataFrame) -> tuple[np.ndarray, int, int]:
    """Log ratio of the two classes per bucket over all rows (text, label), and how many rows each class has."""
    kind = "bucket int, good bigint, bad bigint"

    def count(batches):
        held = np.zeros((2, BUCKETS + 1), np.int64)
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for y, at in zip(label.tolist(), indicators(batch.column(0).to_pylist())):
                held[1 - y][at] += 1
                held[1 - y][BUCKETS] += 1
        at = np.flatnonzero(held.any(0))
        yield pa.RecordBatch.from_pydict({"bucket": at.astype(np.int32), "good": held[0][at], "bad": held[1][at]})

    parts = labelled.select("text", "label").mapInArrow(count, kind)
    found = parts.groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toArrow()
    counts = np.zeros((2, BUCKETS + 1))
    at = found["bucket"].to_numpy()
    counts[0][at], counts[1][at] = found["good"].to_numpy(), found["bad"].to_numpy()
    good, bad = int(counts[0][BUCKETS]), int(counts[1][BUCKETS])
    share = counts[:, :BUCKETS] + PRIOR
    share /= share.sum(1, keepdims=True)
    # A bucket that no labelled row holds says nothing.
    return np.where(counts[:, :BUCKETS].any(0), np.log(share[0] / share[1]), 0.0), good, bad


def scaled(at: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """Values of a text's indicators: their log ratios, cut to length one."""
    x = ratios[at]
    return x / max(np.sqrt(x @ x), 1e-12)


def descend(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """Weights, intercept last, of the hinge-loss model by dual coordinate descent; both classes weigh the same in sum."""
    y = np.where(labels == 1, 1.0, -1.0)
    share = np.array([(y == s).sum() for s in (-1, 1)])
    most = COST * len(y) / (2 * share[(y > 0).astype(int)])
    values = [scaled(at, ratios) for at in rows]
    length = np.array([x @ x for x in values]) + 1.0
    w, alpha = np.zeros(BUCKETS + 1), np.zeros(len(y))
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        largest = 0.0
        for i in rng.permutation(len(y)).tolist():
            at, x = rows[i], values[i]
            g = y[i] * (w[at] @ x + w[BUCKETS]) - 1
            pg = min(g, 0.0) if alpha[i] == 0 else max(g, 0.0) if alpha[i] == most[i] else g
            largest = max(largest, abs(pg))
            if pg:
                new = min(max(alpha[i] - g / length[i], 0.0), most[i])
                step = (new - alpha[i]) * y[i]
                w[at] += step * x
                w[BUCKETS] += step
                alpha[i] = new
        if largest < STILL:
            break
    mean = np.abs(w[:BUCKETS]).sum() / max(1, np.count_nonzero(w[:BUCKETS]))
    w[:BUCKETS] = np.where(w[:BUCKETS] != 0, (1 - MIXED) * mean + MIXED * w[:BUCKETS], 0.0)
    return w


Model = tuple[np.ndarray, np.ndarray, float]


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """(log ratios, their weights times ratios, intercept) per bucket, or None without rows of both classes."""
    known = materialize(marks(labels), "quality-labels")
    texts = docs.select(F.col("doc_id").cast("bigint"), "text")
    small = known.count() <= BROADCAST_ROWS
    ratios, good, bad = log_ratios(texts.join(F.broadcast(known) if small else known, "doc_id"))
    if not good or not bad:
        return None
    order = (F.xxhash64(F.lit("nbsvm"), "doc_id"), "doc_id")
    chosen = known.orderBy(*order).limit(SAMPLE)

    def hashed(batches):
        for batch in batches:
            at = [a.tobytes() for a in indicators(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.binary()), batch.column(2)], names=["doc_id", "at", "label"])

    rows = materialize(texts.join(F.broadcast(chosen), "doc_id").mapInArrow(hashed, "doc_id bigint, at binary, label int")
                       .groupBy("doc_id").agg(F.min("at").alias("at"), F.first("label").alias("label")), "quality-sample")
    # At most SAMPLE rows: their sizes may be summed up in one task.
    sizes = rows.select("doc_id", F.sum(F.length("at") + 64).over(W.orderBy(*order)).alias("so_far")).where(F.col("so_far") <= SAMPLE_BYTES)
    apart = (F.pmod(F.xxhash64(F.lit("calibration"), "doc_id"), F.lit(CALIBRATION)) == 0).alias("apart")
    kept = rows.join(sizes, "doc_id").repartition(1).sortWithinPartitions(*order).select("at", "label", apart)
    sent = docs.sparkSession.sparkContext.broadcast(ratios)

    def learn(batches):
        held, y, left_out = [], [], []
        for batch in batches:
            held += [np.frombuffer(a.as_buffer(), np.int32) for a in batch.column(0)]
            y += batch.column(1).to_pylist()
            left_out += batch.column(2).to_pylist()
        y, left_out, r = np.array(y, int), np.array(left_out, bool), sent.value
        w = descend([a for a, out in zip(held, left_out) if not out], y[~left_out], r) if 0 < y[~left_out].sum() < (~left_out).sum() else np.zeros(BUCKETS + 1)
        sums = np.array([w[a] @ scaled(a, r) + w[BUCKETS] for a, out in zip(held, left_out) if out])
        scale, shift = calibration(sums, y[left_out])
        w *= scale
        w[BUCKETS] += shift
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_pydict({"bucket": at.astype(np.int32), "weight": w[at]})

    found = kept.mapInArrow(learn, "bucket int, weight double").toArrow()
    w = np.zeros(BUCKETS + 1)
    w[found["bucket"].to_numpy()] = found["weight"].to_numpy()
    return ratios, w[:BUCKETS] * ratios, float(w[BUCKETS])


def score_texts(texts: list, model: Model | None) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    ratios, weights, intercept = model
    sums = [weights[at].sum() / max(np.sqrt((ratios[at] ** 2).sum()), 1e-12) + intercept for at in indicators(texts)]
    return 1 / (1 + np.exp(-np.clip(sums, -35, 35)))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score (0 to 1, higher: good likelier) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                scores = score_texts(part.column(1).to_pylist(), sent.value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, score double")
