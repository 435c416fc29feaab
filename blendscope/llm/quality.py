"""Quality rules: repetition counts, and a hashed n-gram log-likelihood ratio of trusted to raw text.

Two multinomials over ``BUCKETS`` hashed byte ``GRAM``-grams are counted: one over all trusted documents, one over
all documents. A document's score is the mean over its n-grams of the log ratio of the two; it passes from a threshold
on, the same for every document. The threshold is set where, of all labelled documents that the base rules pass, the fewest
errors are made, a lost good document counting ``LOSS`` times a kept bad one. Equal scores fall on one side.

Defined cases: null or empty text has no words and fails the base rule; a null doc_id stays null; repeated rows give
repeated rows and count each; without trusted documents, or labelled ones of both kinds, every score passes; an empty
table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blendscope.session import local_table, materialize

from .textvec import BASE, SPACES, Texts, chunks, mix

GRAM = 4
BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
PRIOR = 0.5  # added to every bucket of both counts
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # percent of the words
# Trusted or labelled ids (8 bytes each) of at most so many documents are broadcast; above, the texts are shuffled to the trusted
# ones, and all texts are scored and only scores are shuffled to the labels.
BROADCAST_ROWS = 2_000_000
LOSS = 20
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(batch: Texts) -> list[np.ndarray]:
    """The five counts of ``COUNTS`` for each text."""
    data = batch.data
    starts, ends = batch.words()
    owner = batch.owner(starts)
    n_words = np.bincount(owner, minlength=batch.n)

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[batch.ends] - total[batch.starts]

    visible = ~SPACES[data]
    word_chars = per_text(visible & ((data & 0xC0) != 0x80))
    symbols = per_text(SYMBOLS[data])

    stops = np.flatnonzero(data == 10)
    begins = np.concatenate(([0], stops[:-1] + 1))
    seen = np.concatenate(([0], np.cumsum(visible)))
    full = seen[stops] > seen[begins]
    begins, stops = begins[full], stops[full]
    home = batch.owner(begins)
    lines = mix(batch.hashes(begins, stops) ^ mix(home.astype(np.uint64)))
    _, first = np.unique(lines, return_index=True)
    dup_lines = np.bincount(home, minlength=batch.n) - np.bincount(home[first], minlength=batch.n)

    covered = np.zeros(len(starts) + 1, np.int64)
    n = len(starts) - WINDOW + 1
    if n > 0:
        words = batch.hashes(starts, ends)
        rolled = mix(owner[:n].astype(np.uint64))
        for k in range(WINDOW):
            rolled = mix(rolled * BASE + words[k:k + n])
        at = np.flatnonzero(owner[:n] == owner[WINDOW - 1:])
        _, which, count = np.unique(rolled[at], return_inverse=True, return_counts=True)
        at = at[count[which] > 1]
        covered[at] += 1
        covered[at + WINDOW] -= 1
    repeated = np.bincount(owner[np.cumsum(covered)[:-1] > 0], minlength=batch.n)
    return [n_words, word_chars, symbols, dup_lines, repeated]


def grams(batch: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the n-gram at every position, and each text's range of positions whose n-gram lies inside it."""
    data = np.concatenate((batch.data, np.zeros(GRAM, np.uint8)))
    code = np.zeros(len(batch.data), np.uint32)
    for k in range(GRAM):
        code |= data[k:k + len(code)].astype(np.uint32) << np.uint32(8 * k)
    bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)
    return bucket, batch.starts, np.maximum(batch.starts, batch.ends - GRAM + 1)


def count_grams(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts over the trusted rows and over all rows of (text, trusted), in one pass; only sums leave the executors."""
    def run(batches):
        totals = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = batch.slice(at, 1000)
                trusted = np.array(rows.column(1).to_pylist(), bool)
                for begin, part in chunks(rows.column(0).to_pylist()):
                    batch_texts = Texts(part)
                    bucket, first, last = grams(batch_texts)
                    for kind, chosen in enumerate((trusted[begin:begin + len(part)], np.ones(len(part), bool))):
                        full = chosen & (last > first)
                        edge = np.zeros(len(bucket) + 1, np.int8)
                        edge[first[full]] += 1
                        edge[last[full]] -= 1
                        totals[kind] += np.bincount(bucket[np.cumsum(edge[:-1], dtype=np.int8) > 0], minlength=BUCKETS)
        seen = np.flatnonzero(totals[1])
        yield pa.RecordBatch.from_pydict({"bucket": seen, "trusted": totals[0, seen], "n": totals[1, seen]})

    sums = (texts.mapInArrow(run, "bucket bigint, trusted bigint, n bigint").groupBy("bucket")
            .agg(F.sum("trusted").alias("trusted"), F.sum("n").alias("n")).toArrow())
    out = np.zeros((2, BUCKETS), np.int64)
    out[:, sums["bucket"].to_numpy()] = sums["trusted"].to_numpy(), sums["n"].to_numpy()
    return out[0], out[1]


def log_ratio(trusted: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log ratio of the two multinomials per bucket; zeros without trusted text."""
    if not trusted.sum():
        return np.zeros(BUCKETS)
    return (np.log(trusted + PRIOR) - np.log(trusted.sum() + PRIOR * BUCKETS)
            - np.log(raw + PRIOR) + np.log(raw.sum() + PRIOR * BUCKETS))


def score_texts(texts: list, ratio: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Base counts and scores; a text shorter than an n-gram scores 0."""
    counts, scores = [], []
    for _, part in chunks(texts):
        batch = Texts(part)
        counts.append(base_counts(batch))
        bucket, first, last = grams(batch)
        total = np.concatenate(([0.0], np.cumsum(ratio[bucket])))
        scores.append((total[last] - total[first]) / np.maximum(1, last - first))
    return [np.concatenate(c) for c in zip(*counts)], np.concatenate(scores)


def cut(scores: np.ndarray, good: np.ndarray) -> float:
    """Where to cut so that ``LOSS`` x lost good + kept bad is least; a quarter of the way from the worse to the better score around the place."""
    if not good.any() or good.all():
        return -np.inf
    order = np.argsort(scores, kind="stable")
    scores, good = scores[order], good[order]
    lost = np.concatenate(([0], np.cumsum(good)))
    kept = (~good).sum() - np.concatenate(([0], np.cumsum(~good)))
    place = int(np.argmin(LOSS * lost + kept))
    return -np.inf if place == 0 else between(scores[place - 1], scores[place] if place < len(scores) else None)


def between(worse: float, better: float | None) -> float:
    return float(worse + 1e-9 if better is None else 0.75 * worse + 0.25 * better)


def cut_rows(scored: DataFrame) -> float:
    """``cut`` of all rows (score, quality), between different scores only.

    Scores are counted, sorted by a range exchange and written once; each part tries its own places on top of what lies before it,
    and one row per part meets the driver.
    """
    counted = scored.groupBy("score").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") != 1).alias("bad"))
    stored = materialize(counted.orderBy("score").withColumn("place", F.monotonically_increasing_id()), "quality-scores")
    stored = stored.withColumn("part", F.shiftright("place", 33)).drop("place")
    parts = stored.groupBy("part").agg(F.sum("good"), F.sum("bad"), F.min("score")).orderBy("part").collect()
    n_good, n_bad = sum(p[1] for p in parts), sum(p[2] for p in parts)
    if not n_good or not n_bad:
        return -np.inf
    rows, good, bad = [], 0, 0
    for i, (part, more_good, more_bad, _) in enumerate(parts):
        rows.append((part, good, bad, parts[i + 1][3] if i + 1 < len(parts) else None))
        good, bad = good + more_good, bad + more_bad
    before = local_table(scored.sparkSession, rows, "part bigint, good_before bigint, bad_before bigint, next_part double")
    inside = Window.partitionBy("part").orderBy("score")
    cost = (LOSS * (F.col("good_before") + F.sum("good").over(inside)) + n_bad - F.col("bad_before") - F.sum("bad").over(inside))
    tried = stored.join(F.broadcast(before), "part").select(F.struct(
        cost.alias("cost"), "score", F.coalesce(F.lead("score").over(inside), "next_part").alias("better")).alias("x"))
    best = tried.agg(F.min("x")).first()[0]
    return -np.inf if n_bad <= best["cost"] else between(best["score"], best["better"])


class Rules:
    """The fitted ratio (one number per bucket) and threshold: a fixed size whatever the input."""

    def __init__(self, ratio: np.ndarray, threshold: float):
        self.ratio, self.threshold = ratio, threshold


def fit(docs: DataFrame, labels: DataFrame) -> Rules:
    """Counts cover all documents and all trusted ones (labels.quality = 1)."""
    marks = (labels.where("quality is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
             .agg(F.max(F.col("quality").cast("bigint")).alias("quality")))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    trusted = marks.where("quality = 1").select("doc_id", F.lit(True).alias("trusted"))
    few = trusted.count() <= BROADCAST_ROWS
    marked = texts.join(F.broadcast(trusted) if few else trusted, "doc_id", "left")
    ratio = log_ratio(*count_grams(marked.select("text", F.coalesce("trusted", F.lit(False)))))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                counts, scores = score_texts(part.column(1).to_pylist(), ratio)
                keep = ~base_failed(counts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores)], names=["doc_id", "score"]).filter(pa.array(keep))

    few = marks.count() <= BROADCAST_ROWS
    labelled = texts.join(F.broadcast(marks), "doc_id", "left_semi") if few else texts
    scored = labelled.mapInArrow(run, "doc_id bigint, score double").join(F.broadcast(marks) if few else marks, "doc_id")
    return Rules(ratio, cut_rows(scored))


def base_failed(counts: list[np.ndarray]) -> np.ndarray:
    n_words, repeated = counts[0], counts[4]
    return (n_words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n_words)


def judge(docs: DataFrame, rules: Rules) -> DataFrame:
    """One row per document: doc_id, the five counts, score, base_failed, kept."""
    sent = docs.sparkSession.sparkContext.broadcast((rules.ratio, rules.threshold))

    def run(batches):
        ratio, threshold = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                counts, scores = score_texts(part.column(1).to_pylist(), ratio)
                failed = base_failed(counts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(scores), pa.array(failed),
                     pa.array(~failed & (scores >= threshold))], names=["doc_id", *COUNTS, "score", "base_failed", "kept"])

    kinds = ", ".join(f"{c} bigint" for c in COUNTS)
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        run, f"doc_id bigint, {kinds}, score double, base_failed boolean, kept boolean")


def keep(docs: DataFrame, rules: Rules) -> DataFrame:
    """The rows of documents that pass, unchanged, without a shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast((rules.ratio, rules.threshold))
    place = docs.columns.index("text")

    def run(batches):
        ratio, threshold = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                counts, scores = score_texts(part.column(place).to_pylist(), ratio)
                yield part.filter(pa.array(~base_failed(counts) & (scores >= threshold)))

    return docs.mapInArrow(run, docs.schema)
