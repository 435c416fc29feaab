"""Near duplicates: one-permutation MinHash, banded buckets, star-shaped candidates, links confirmed on full sets.

A document's set holds the hashes of its distinct five-word shingles. One hash of every shingle gives all ``BINS``
minima: the upper bits name the bin, the rest competes for its minimum. An empty bin takes the value of the bin that a
fixed random sequence of its own meets first among the filled ones (optimal densification), so bins stay
independent. ``BANDS`` bands of ``ROWS`` bins make the bucket keys: a pair at the similarity of 0.75 shares none of
them with a probability of about 5e-6.

Copies with equal sets are grouped first; only one of each takes part. In every bucket one member is the centre and
is compared with each other one, so pairs grow with the members, not with their square. Buckets that still hold several
components after that get another centre, compared with the members of other components, for ``ROUNDS`` rounds. A round's
links are contracted to links of components, so later rounds work on ever fewer nodes.

Members of buckets that hold several components even then meet in an exact prefix join: shingles of every set are ordered
rare ones first, and a pair at 0.75 has a shingle in common within the first seventh of the smaller set and the first
quarter of the larger one, at places that leave enough shingles behind them. So pairs that no centre linked are found,
while members of one template, whose own shingles come first, do not meet. How rare a shingle is decides only the cost:
it is read from counts per 2^20 hash ranges. Nothing is capped: any bucket, however large, takes part in full, and a hot
one is aggregated before the shuffle and split in joins. Sets that more than one in ``HOT`` documents share, at most ``HOT``
of them, are broadcast to their documents; the others meet theirs in a shuffle.

Defined cases: null or empty text, or text of white space, has an empty set and is linked with nothing; fewer than
five words are one shingle; rows with a null doc_id are linked with nothing, get a null component and are
kept; rows of one doc_id are one document; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blendscope.session import materialize

from .graph import components
from .textvec import BASE, Texts, chunks, mix

WORDS = 5
SIMILAR = 75  # in hundredths
ROWS, BANDS = 4, 32
BINS = ROWS * BANDS
BIN_BITS = BINS.bit_length() - 1
PROBES = 512
ROUNDS = 3
HOT = 10_000
RANGE_BITS = 20  # hash ranges in which shingles are counted, to put rare ones first

# A table of ids or pairs of ids of at most so many rows (8 or 16 bytes each) may be broadcast; above, the join shuffles.
BROADCAST_ROWS = 1_000_000

FEATURES = "doc_id bigint, n_shingles bigint, set_id binary, bands array<bigint>"
BAND_SEEDS = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
PROBE = (mix(np.arange(BINS * PROBES, dtype=np.uint64) + np.uint64(99)) % np.uint64(BINS)).astype(np.int64).reshape(BINS, PROBES)


def shingle_sets(texts):
    """Sorted distinct 64-bit shingle hashes of each text; A-Z count as a-z."""
    for _, part in chunks(texts):
        batch = Texts(part, lower=True)
        starts, ends = batch.words()
        words = batch.hashes(starts, ends)
        n = len(words)
        first = np.searchsorted(starts, batch.starts)
        rolled = np.zeros(n, np.uint64)
        for k in range(min(WORDS, n)):
            rolled[:n - k] = mix(rolled[:n - k] * BASE + words[k:])
        for a, b in zip(first.tolist(), [*first[1:].tolist(), n]):
            if b - a >= WORDS:
                yield np.unique(rolled[a:b - WORDS + 1])
            elif b > a:
                code = np.array([b - a], np.uint64)
                for word in words[a:b]:
                    code = mix(code * BASE + word)
                yield code
            else:
                yield np.zeros(0, np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Densified minima, one row per set; sets are not empty."""
    edges = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BIN_BITS)
    minima, filled = np.zeros((len(sets), BINS), np.uint64), np.zeros((len(sets), BINS), bool)
    for i, values in enumerate(sets):
        at = np.searchsorted(values, edges)
        filled[i] = np.diff(np.append(at, len(values))) > 0
        minima[i, filled[i]] = values[at[filled[i]]]
    known = filled.copy()
    open_rows = np.flatnonzero(~known.all(1))
    for probe in range(PROBES):
        if not len(open_rows):
            break
        source = PROBE[:, probe]
        take = ~known[open_rows] & filled[open_rows][:, source]
        values = minima[open_rows]
        minima[open_rows] = np.where(take, values[:, source], values)
        known[open_rows] |= take
        open_rows = open_rows[~known[open_rows].all(1)]
    for i in open_rows:  # no probe met a filled bin: take the next filled one
        full = np.flatnonzero(filled[i])
        empty = np.flatnonzero(~known[i])
        minima[i, empty] = minima[i, full[np.searchsorted(full, empty) % len(full)]]
    return minima


def band_keys(minima: np.ndarray) -> np.ndarray:
    keys = np.broadcast_to(BAND_SEEDS, (len(minima), BANDS)).copy()
    for row in range(ROWS):
        keys = mix(keys * BASE + minima[:, row::ROWS])
    return keys


def features(docs: DataFrame) -> DataFrame:
    """Set size, digest of the set and bucket keys of each document; sets below three shingles link only to equal ones."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = list(shingle_sets(part.column(1).to_pylist()))
                large = [i for i, s in enumerate(sets) if len(s) > 2]
                bands: list = [None] * len(sets)
                if large:
                    for i, keys in zip(large, band_keys(signatures([sets[i] for i in large])).view(np.int64)):
                        bands[i] = keys
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_id", "bands"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, FEATURES)


def full_sets(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(
                    [s.tobytes() for s in shingle_sets(part.column(1).to_pylist())], pa.binary())], names=["node", "shingles"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "node bigint, shingles binary")


def few(ids: DataFrame, n: int) -> DataFrame:
    return F.broadcast(ids) if n <= BROADCAST_ROWS else ids


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b), those whose full sets are similar enough."""
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = sorted((np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)), key=len)
                spot = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[spot] == x).sum())
                keep.append(100 * both >= SIMILAR * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    # Each side gets its sets from one scan; below the limit only the sets needed are shuffled, to meet each other.
    sent = few(pairs, pairs.count())
    one, two = (sets.join(sent, F.col("node") == F.col(c)).select("a", "b", F.col("shingles").alias(f"set_{c}")) for c in "ab")
    return one.join(two, ["a", "b"]).mapInArrow(run, "a bigint, b bigint")


def star_pairs(buckets: DataFrame, turn: int) -> DataFrame:
    """Pairs (a < b) of each bucket's centre of this turn with its members of other components, sizes permitting.

    The first centre is the smallest id, as the original of a group usually is; later ones are drawn by a hash.
    """
    key = F.lit(0) if turn == 0 else F.xxhash64("node", F.lit(turn), "band")
    centres = (buckets.select("band", F.struct(key.alias("key"), "node", "n", "label").alias("row")).groupBy("band")
               .agg(F.min("row").alias("centre"), F.min("row.label").alias("low"), F.max("row.label").alias("high"))
               .where("low != high").select(F.col("band").alias("centre_band"), "centre"))
    pairs = buckets.join(centres, F.expr(f"""band = centre_band and label != centre.label
        and 100 * least(n, centre.n) >= {SIMILAR} * greatest(n, centre.n)"""))
    return pairs.select(F.least("node", "centre.node").alias("a"), F.greatest("node", "centre.node").alias("b")).distinct()


def range_counts(sets: DataFrame) -> np.ndarray:
    """Number of shingles of all sets per hash range; a fixed number of counts."""
    def run(batches):
        counts = np.zeros(1 << RANGE_BITS, np.int64)
        for batch in batches:
            values = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(0)]
            if values:
                counts += np.bincount((np.concatenate(values) >> np.uint64(64 - RANGE_BITS)).astype(np.int64), minlength=len(counts))
        at = np.flatnonzero(counts)
        for first in range(0, len(at), 50_000):
            part = at[first:first + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[part])], names=["slot", "n"])

    found = sets.select("shingles").mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << RANGE_BITS, np.int64)
    counts[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return counts


def rare_shingles(members: DataFrame, counts: np.ndarray) -> DataFrame:
    """The first quarter of each set of (node, n, label, shingles), rare shingles first, without those of one set only."""
    sent = members.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                tokens, places = [], []
                for x in part.column(3):
                    values = np.frombuffer(x.as_buffer(), np.uint64)
                    times = sent.value[(values >> np.uint64(64 - RANGE_BITS)).astype(np.int64)]
                    order = np.lexsort((values, times))[:len(values) // 4 + 1]
                    kept = np.flatnonzero(times[order] > 1)
                    tokens.append(values[order[kept]])
                    places.append(kept)
                sizes = [len(t) for t in tokens]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(places))]
                    + [pa.array(np.repeat(part.column(i).to_numpy(), sizes)) for i in range(3)],
                    names=["token", "place", "node", "n", "label"])

    return members.select("node", "n", "label", "shingles").mapInArrow(
        run, "token bigint, place bigint, node bigint, n bigint, label bigint")


def prefix_pairs(buckets: DataFrame, sets: DataFrame) -> DataFrame | None:
    """Pairs (a < b) of different components, among the members of buckets with several, that can still be similar enough.

    Of a shingle's members those of its commonest component meet only the others, so a large component costs no square.
    """
    mixed = buckets.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
    open_nodes = materialize(buckets.join(mixed.select("band"), "band").select("node", "n", "label").distinct(), "open-nodes")
    n = open_nodes.count()
    if not n:
        return None
    members = materialize(sets.join(few(open_nodes, n), "node"), "open-sets")
    spread = materialize(rare_shingles(members, range_counts(members)), "rare-shingles")
    shared = (spread.groupBy("token", "label").agg(F.count("*").alias("times")).groupBy("token")
              .agg(F.max(F.struct("times", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1")
              .select("token", F.col("top.label").alias("top")))
    # Written first: a join of two plain shuffles can be split at a hot shingle, one with an aggregate in its stage cannot.
    rows = materialize(spread.join(materialize(shared, "shared-tokens"), "token"), "shared-shingles")
    one = rows.where("7 * place <= n").select("token", F.expr("int(label = top)").alias("side"),
                                              F.struct("node", "n", "label", "place").alias("x"))
    two = rows.select("token", F.explode(F.expr("if(label = top, array(0), array(0, 1))")).alias("side"),
                      F.struct("node", "n", "label", "place").alias("y"))
    # A pair at SIMILAR has at least 3/7 of both sizes in common, and nothing in common before its first shared shingle.
    pairs = one.join(two, ["token", "side"]).where(
        f"""x.label != y.label and (x.n < y.n or x.n = y.n and x.node < y.node)
        and {100 + SIMILAR} * least(x.n - x.place, y.n - y.place) >= {SIMILAR} * (x.n + y.n)""")
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest linked doc_id), kept (it is that one)."""
    known = materialize(features(docs), "features")
    with_id = known.where("doc_id is not null")
    copies = (with_id.where("n_shingles > 0").groupBy("set_id")
              .agg(F.min("doc_id").alias("rep"), F.count("*").alias("times")))
    copies = materialize(copies, "copies")
    single = with_id.where("bands is not null").join(
        copies, (with_id.set_id == copies.set_id) & (with_id.doc_id == copies.rep), "left_semi")
    rows = single.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low != high")
    buckets = materialize(rows.join(shared.select("band"), "band").select("band", "node", "n", F.col("node").alias("label")),
                          "buckets")

    nodes = materialize(buckets.select("node").distinct(), "nodes")
    sets = materialize(full_sets(docs.join(few(nodes, nodes.count()), F.col("doc_id") == F.col("node"), "left_semi")), "sets")

    labels, seen = nodes.select("node", F.col("node").alias("label")), None
    for turn in range(ROUNDS):
        pairs = star_pairs(buckets, turn)
        pairs = materialize(pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti"), "pairs")
        seen = pairs if seen is None else seen.unionByName(pairs)
        found = materialize(confirm(pairs, sets), "confirmed")
        if found.isEmpty():
            continue
        labels = joined_by(labels, found)
        buckets = materialize(buckets.drop("label").join(labels, "node"), "buckets")

    pairs = prefix_pairs(buckets, sets)
    if pairs is not None:
        found = materialize(confirm(materialize(pairs.join(seen, ["a", "b"], "left_anti"), "pairs"), sets), "confirmed")
        if not found.isEmpty():
            labels = joined_by(labels, found)

    named = materialize(copies.join(labels, copies.rep == labels.node, "left")
                        .select("set_id", "times", F.coalesce("label", "rep").alias("component_id")), "named-sets")
    return labelled(known, named)


def joined_by(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, label) after links (a, b) between nodes joined their components; the smallest node stays the label."""
    one, two = (labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}")) for c in "ab")
    between = (links.join(one, "a").join(two, "b").where("label_a != label_b")
               .select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct())
    moved = components(materialize(between, "label-links")).select(F.col("node").alias("label"), F.col("label").alias("to"))
    after = labels.join(few(moved, moved.count()), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return materialize(after, "labels")


def labelled(known: DataFrame, named: DataFrame, hot_share: int = HOT) -> DataFrame:
    """Documents with the component of their set; no task gets all copies of a hot set, nor all documents without one."""
    known = known.select("doc_id", "n_shingles", "set_id")
    least = known.count() // hot_share
    hot = named.where(F.col("times") > least).select("set_id", "component_id")
    with_set = known.where("doc_id is not null and set_id is not null")
    near = with_set.join(F.broadcast(hot), "set_id", "left") if least else with_set.withColumn("component_id", F.lit(None).cast("bigint"))
    rest = near.where("component_id is null").drop("component_id").join(
        named.where(F.col("times") <= least) if least else named, "set_id")
    alone = known.where("doc_id is null or set_id is null").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "n_shingles", "component_id"]
    out = alone.select(columns).unionByName(near.where("component_id is not null").select(columns)).unionByName(rest.select(columns))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents kept, unchanged; of rows with one doc_id the one with the smallest text stays."""
    kept = near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    first = F.row_number().over(W.partitionBy("doc_id").orderBy("text"))
    one = (rows.where("doc_id is not null").join(kept, "doc_id", "left_semi").withColumn("turn", first)
           .where("turn = 1").select("doc.*"))
    return one.unionByName(docs.where("doc_id is null"))
