"""Random forests over many rows: each tree is grown by one task, level by level in numpy, from rows of one byte a feature.

The trees are those of MLlib's forests in kind: at most 32 bins a feature, a Poisson bag of all rows for each tree, the square root of the
features drawn anew for each node, the largest Gini gain, no lower bound on a leaf, leaves of equal prediction merged. The draws are others.
MLlib sends the statistics of all nodes of a level through a shuffle, once per task; with fully grown trees that is many times the rows.

Rows are read from the shared folder in blocks. As long as a node has more than ``HELD_ROWS``, its rows are only counted block by block; smaller
ones are then gathered, as many nodes at once as fit. So a task holds a bounded number of rows whatever their number.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions.columns import col
from ..session import agg_row, arrow_uri, scratch_path

BINS = 32
HELD_ROWS = 10_000_000  # rows of a tree, copies counted, that a task holds at once
STEP_ROWS = 1 << 16  # rows worked on at once, for the processor's caches
FEW_ROWS = 48  # nodes below have fewer rows than cells in their histograms, so their rows are sorted instead
LEAST_GAIN = 1e-12
PREDICTED_AT_ONCE = 100_000
WALKED_AT_ONCE = 1 << 14

TREES = "tree int, feature binary, cut binary, left binary, counts binary, importance array<double>"


# ---------------------------------------------------------------- bins and blocks

def find_cuts(stored: DataFrame, names) -> dict:
    """``{feature: thresholds}`` of all rows: quantiles, or between all values where there are at most ``BINS``."""
    shares = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    found = agg_row(stored, {
        **{c: F.percentile_approx(col(c), shares, F.lit(10_000)) for c in names},
        **{(c, "bad"): F.count_if(col(c).isNull() | F.isnan(col(c))) for c in names}})
    if bad := [c for c in names if found[c, "bad"]]:
        raise ValueError(f"NULL or NaN among the features: {bad}")
    cuts = {c: sorted(set(found[c])) for c in names}
    # Quantiles that repeat may stand for few values, or for one that most rows have.
    tied = [c for c in names if len(cuts[c]) < BINS - 1]
    seen = agg_row(stored, {c: F.approx_count_distinct(col(c)) for c in tied}) if tied else {}
    few = [c for c in tied if seen[c] <= 2 * BINS]
    for c, values in (agg_row(stored, {c: F.sort_array(F.collect_set(col(c))) for c in few}) if few else {}).items():
        if len(values) <= BINS:
            cuts[c] = [(x + y) / 2 for x, y in zip(values, values[1:])]
    return cuts


def bin_rows(columns, cuts) -> np.ndarray:
    """One byte a feature: the number of thresholds below the value."""
    out = np.empty((len(columns[0]), len(cuts)), np.uint8)
    for i, (values, edges) in enumerate(zip(columns, cuts)):
        numbers = values.to_numpy(zero_copy_only=False).astype(float)
        if np.isnan(numbers).any():  # as MLlib's assembler does
            raise ValueError("NULL or NaN among the features")
        out[:, i] = np.searchsorted(np.asarray(edges, float), numbers, side="left")
    return out


def write_blocks(stored: DataFrame, names, labels: dict, cuts: dict) -> str:
    """Path of the rows as blocks: their bins, and the number of their value in each label."""
    edges, known = [cuts[c] for c in names], {k: pa.array(v, pa.string()) for k, v in labels.items()}

    def run(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        for batch in batches:
            if batch.num_rows:
                x = bin_rows([batch.column(i) for i in range(len(edges))], edges)
                ys = [pc.index_in(batch.column(len(edges) + i).cast(pa.string()), value_set=v).to_numpy(zero_copy_only=False).astype(np.uint8)
                      for i, v in enumerate(known.values())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([first], pa.int64()), pa.array([x.tobytes()], pa.binary()), *[pa.array([y.tobytes()], pa.binary()) for y in ys]],
                    ["id", "x", *[f"y{i}" for i in range(len(ys))]])
                first += 1

    path = scratch_path(stored.sparkSession, "forest-blocks")
    kinds = ", ".join(["id bigint", "x binary", *[f"y{i} binary" for i in range(len(labels))]])
    stored.select(*[col(c) for c in names], *[col(c) for c in labels]).mapInArrow(run, kinds).write.parquet(path)
    return path


def parquet_rows(path: str, columns=None):
    """Record batches of the Parquet files of a folder, of few rows each."""
    system, place = fs.FileSystem.from_uri(arrow_uri(path))
    files = sorted(f.path for f in system.get_file_info(fs.FileSelector(place)) if f.base_name.startswith("part-"))
    for name in files:
        with system.open_input_file(name) as f:
            yield from pq.ParquetFile(f).iter_batches(batch_size=8, columns=columns)


def read_blocks(path: str, width: int, label: int):
    """(block number, bins, label numbers) of every block."""
    for batch in parquet_rows(path, ["id", "x", f"y{label}"]):
        for i, x, y in zip(*(c for c in batch.columns)):
            yield i.as_py(), np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, width), np.frombuffer(y.as_buffer(), np.uint8)


# ---------------------------------------------------------------- one tree

class Tree:
    """Nodes in arrays; the children of a node stand beside each other, after it. ``left`` is -1 for a leaf."""

    def __init__(self, classes: int):
        self.n, self.batches = 0, []
        self.feature, self.cut, self.left = np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.int32)
        self.gain, self.counts = np.zeros(0), np.zeros((0, classes), np.int64)

    def add(self, counts: np.ndarray) -> int:
        first, self.n = self.n, self.n + len(counts)
        if self.n > len(self.left):
            more = max(self.n, 2 * len(self.left)) - len(self.left)
            for name in ("feature", "cut", "left", "gain", "counts"):
                a = getattr(self, name)
                setattr(self, name, np.concatenate([a, np.full((more, *a.shape[1:]), -1 if name == "left" else 0, a.dtype)]))
        self.counts[first:self.n] = counts
        self.batches.append((first, self.n))
        return first

    def split(self, ids, score, feature, cut, left) -> tuple:
        """Give the nodes whose best split gains something two children: (which these are, the first child)."""
        total = self.counts[ids]
        weight = total.sum(1)
        gain = score - (total * total).sum(1) / weight
        ok = gain > LEAST_GAIN * weight
        at = ids[ok]
        kids = np.empty((2 * len(at), total.shape[1]), np.int64)
        kids[::2], kids[1::2] = left[ok], total[ok] - left[ok]
        first = self.add(kids)
        self.feature[at], self.cut[at], self.gain[at] = feature[ok], cut[ok], gain[ok]
        self.left[at] = first + 2 * np.arange(len(at))
        return ok, first

    def open(self, ids) -> np.ndarray:
        """Whether nodes have rows of several classes."""
        return self.counts[ids].max(1) < self.counts[ids].sum(1)

    def finish(self, width: int) -> dict:
        """Merged and without unused nodes; leaves are numbered -1, -2, ... in ``left``."""
        n, guess = self.n, self.counts[:self.n].argmax(1)
        left, keep = self.left[:n].copy(), np.ones(n, bool)
        for first, end in reversed(self.batches):
            at = first + np.flatnonzero(left[first:end] >= 0)
            a = left[at]
            same = (left[a] < 0) & (left[a + 1] < 0) & (guess[a] == guess[a + 1])
            keep[a[same]] = keep[a[same] + 1] = False
            left[at[same]] = -1
        inner = left >= 0
        importance = np.bincount(self.feature[:n][inner & keep], self.gain[:n][inner & keep], width)
        number = np.cumsum(keep) - 1
        left[inner] = number[left[inner]]
        leaf = keep & ~inner
        left[leaf] = -1 - np.arange(leaf.sum())
        return {"feature": self.feature[:n][keep].tobytes(), "cut": self.cut[:n][keep].tobytes(), "left": left[keep].astype(np.int32).tobytes(),
                "counts": self.counts[:n][leaf].astype(np.int64).tobytes(), "importance": importance.tolist()}


def walk(feature, cut, left, x: np.ndarray) -> np.ndarray:
    """Node without children that each row of ``x`` ends in."""
    n, width = x.shape
    out = np.empty(n, np.int32)
    for start in range(0, n, WALKED_AT_ONCE):
        flat = x[start:start + WALKED_AT_ONCE].reshape(-1)
        part = out[start:start + WALKED_AT_ONCE]
        live, node = np.arange(len(part)), np.zeros(len(part), np.int32)
        while len(live):
            down = left[node]
            ended = down < 0
            if ended.any():
                part[live[ended]] = node[ended]
                go = ~ended
                live, node, down = live[go], node[go], down[go]
            node = down + (flat[live * width + feature[node]] > cut[node])
    return out


def gini(lefts, totals) -> np.ndarray:
    """Sum over both sides of squared class weights by weight, -1 where a side is empty; one array per class."""
    wl = wr = ql = qr = 0
    for a, t in zip(lefts, totals):
        b = t - a
        wl, wr, ql, qr = wl + a, wr + b, ql + a * a, qr + b * b
    some = (wl > 0) & (wr > 0)
    return np.where(some, ql / np.where(some, wl, 1) + qr / np.where(some, wr, 1), -1.0)


def best_of_cells(cells, totals) -> tuple:
    """(score, bin, left counts) of the best cut of each node, from weights by class, node and bin."""
    left = cells.cumsum(axis=2)[:, :, :-1]
    score = gini(left, totals.T[:, :, None])
    at, each = score.argmax(1), np.arange(len(totals))
    return score[each, at], at, left[:, each, at].T


def by_sorting(b, y, w, node, totals) -> tuple:
    """The same for nodes of few rows: rows are sorted by node and bin, only bins that occur are looked at."""
    k, c = totals.shape
    bits = 4 + max(1, (c - 1).bit_length())
    v = (((node << 5) | b) << bits) | (y << 4) | w
    v.sort()
    cell = v >> bits
    ends = np.append(np.flatnonzero(cell[1:] != cell[:-1]), len(v) - 1)
    at, weight, kind = cell[ends] >> 5, v & 15, (v >> 4) & ((1 << (bits - 4)) - 1)
    totals = totals.astype(float)
    before = totals.cumsum(0) - totals
    left = np.stack([np.cumsum(weight * (kind == i))[ends] - before[at, i] for i in range(c)])
    score = gini(left, totals.T[:, at])
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    most = np.maximum.reduceat(score, first)
    hits = np.flatnonzero(score == most[at])
    hits = hits[np.append(True, at[hits][1:] != at[hits][:-1])]
    return most, cell[ends[hits]] & (BINS - 1), left[:, hits].T


def steps(sizes, mask):
    """Runs of nodes of a kind with about ``STEP_ROWS`` rows, larger nodes alone: arrays of their numbers."""
    which = np.flatnonzero(mask)
    if len(which):
        n = sizes[which]
        turn = np.cumsum(n) // STEP_ROWS
        yield from np.split(which, 1 + np.flatnonzero((turn[1:] != turn[:-1]) | (n[1:] > STEP_ROWS) | (n[:-1] > STEP_ROWS)))


def drawn(rng, nodes: int, width: int) -> np.ndarray:
    """The features each node may split by, the square root of their number."""
    m = math.ceil(math.sqrt(width))
    return rng.random((nodes, width), np.float32).argpartition(m - 1, axis=1)[:, :m]


def best_splits(flat, y, w, rows, sizes, feats, totals) -> tuple:
    """(score, feature, bin, left counts) per node; ``flat`` has one feature after the other, the rows of a node stand together in ``rows``."""
    k, c = totals.shape
    score, feature, cut, left = np.full(k, -1.0), np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, c))
    starts = np.cumsum(sizes) - sizes
    for few in (False, True):
        for some in steps(sizes, (sizes < FEW_ROWS) == few):
            pieces = []
            if len(some) == 1:
                first, end = starts[some[0]], starts[some[0]] + sizes[some[0]]
                pieces = [(np.zeros(min(STEP_ROWS, end - i), np.int64), rows[i:min(end, i + STEP_ROWS)]) for i in range(first, end, STEP_ROWS)]
            else:
                n = sizes[some]
                node = np.repeat(np.arange(len(some)), n)
                pieces = [(node, rows[np.arange(len(node)) + np.repeat(starts[some] - np.cumsum(n) + n, n)])]
            cells = np.zeros((feats.shape[1], c * len(some) * BINS))
            for node, mine in pieces:
                yy, ww = y[mine].astype(np.int64), w[mine].astype(np.int64 if few else np.float64)
                key, lines = (yy * len(some) + node) * BINS, feats[some] * len(y)
                for s in range(feats.shape[1]):
                    # A single node's rows are looked up in one line.
                    place = mine + lines[0, s] if len(some) == 1 else lines[:, s].take(node) + mine
                    b = flat.take(place)
                    if few:
                        take(by_sorting(b.astype(np.int64), yy, ww, node, totals[some]), some, feats[:, s], score, feature, cut, left)
                    else:
                        cells[s] += np.bincount(key + b, ww, cells.shape[1])
            for s in range(0 if few else feats.shape[1]):
                take(best_of_cells(cells[s].reshape(c, len(some), BINS), totals[some]), some, feats[:, s], score, feature, cut, left)
    return score, feature, cut, left


def take(found, some, drawn, score, feature, cut, left) -> None:
    """Put down what ``found`` has better for the nodes ``some``."""
    got, at, part = found
    better = got > score[some]
    to = some[better]
    score[to], feature[to], cut[to], left[to] = got[better], drawn[to], at[better], part[better]


def parted(rows, sizes, right) -> tuple:
    """``rows`` with those of each node's left child before those of its right one, and the sizes of the children."""
    ends = np.cumsum(sizes)
    seen = np.cumsum(right, dtype=np.int32)
    upto = seen[ends - 1]
    before = np.append(0, upto[:-1]).astype(np.int32)
    lefts = sizes - (upto - before)
    seen -= np.repeat(before, sizes)
    out = np.empty_like(rows)
    to = np.arange(len(rows), dtype=np.int32) - seen
    np.copyto(to, np.repeat((ends - sizes + lefts - 1).astype(np.int32), sizes) + seen, where=right)
    out[to] = rows
    return out, np.stack([lefts, sizes - lefts], 1).reshape(-1)


def grow(tree: Tree, x, y, w, ids, rows, sizes, level: int, depth: int, rng) -> None:
    """Grow nodes ``ids`` of ``level`` to the end; ``x`` has a line per feature, ``rows`` the nodes' rows one node after the other."""
    flat = x.reshape(-1)
    while len(ids) and level < depth:
        found = best_splits(flat, y, w, rows, sizes, drawn(rng, len(ids), len(x)), tree.counts[ids])
        ok, first = tree.split(ids, *found)
        rows, sizes = rows[np.repeat(ok, sizes)], sizes[ok]
        if not len(rows):
            return
        right = flat[np.repeat(found[1][ok] * len(y), sizes) + rows] > np.repeat(found[2][ok].astype(np.uint8), sizes)
        rows, sizes = parted(rows, sizes, right)
        ids = np.arange(first, tree.n)
        live = tree.open(ids)
        rows, ids, sizes, level = rows[np.repeat(live, sizes)], ids[live], sizes[live], level + 1


def bag(seed: int, tree: int, block: int, n: int) -> np.ndarray:
    """How often each row of a block is in the bag of a tree."""
    return np.minimum(np.random.default_rng([abs(seed), tree, block]).poisson(1.0, n), 15).astype(np.uint8)


def one_tree(blocks, width: int, classes: int, depth: int, seed: int, tree: int, label: int, held: int) -> dict:
    """A tree from ``blocks()``, which reads all blocks anew: large nodes by counting, the others from gathered rows."""
    rng = np.random.default_rng([abs(seed), tree, label, 1])
    made, total = Tree(classes), np.zeros((1, classes), np.int64)

    def passed():
        for block, x, y in blocks():
            w = bag(seed, tree, block, len(y))
            mine = np.flatnonzero(w)
            yield x[mine], y[mine], w[mine]

    kept: list | None = []
    for x, y, w in passed():
        total[0] += np.bincount(y, w, classes).astype(np.int64)
        # As long as all of them fit, this pass has gathered the rows as well.
        if total.sum() > held:
            kept = None
        elif kept is not None:
            kept.append((x, y, w))
    made.add(total)
    levels = {0: 0}
    waiting, frontier = [], np.flatnonzero(made.open(np.arange(1)))
    while len(frontier):
        heavy = frontier[(made.counts[frontier].sum(1) > held) & (np.array([levels[i] for i in frontier]) < depth)]
        waiting += [i for i in frontier if i not in set(heavy)]
        if not len(heavy):
            break
        feats = drawn(rng, len(heavy), width)
        cells = np.zeros((feats.shape[1], classes * len(heavy) * BINS))
        place = np.full(made.n, -1)
        place[heavy] = np.arange(len(heavy))
        for x, y, w in passed():
            node = place[walk(made.feature, made.cut, made.left, x)]
            mine = np.flatnonzero(node >= 0)
            node, key = node[mine], (y[mine].astype(np.int64) * len(heavy) + node[mine]) * BINS
            for s in range(feats.shape[1]):
                cells[s] += np.bincount(key + x[mine, feats[node, s]], w[mine], cells.shape[1])
        totals, each = made.counts[heavy], np.arange(len(heavy))
        found = [best_of_cells(part.reshape(classes, len(heavy), BINS), totals) for part in cells]
        pick = np.stack([f[0] for f in found]).argmax(0)
        ok, first = made.split(heavy, *(np.stack(a)[pick, each] for a in (
            [f[0] for f in found], list(feats.T), [f[1] for f in found], [f[2] for f in found])))
        kids = np.arange(first, made.n)
        levels |= {int(kid): levels[parent] + 1 for kid, parent in zip(kids, np.repeat(heavy[ok], 2))}
        frontier = kids[made.open(kids)]
    waiting = sorted((int(i) for i in waiting if levels[i] < depth), key=lambda i: (levels[i], i))
    while waiting:
        # Nodes of one level whose rows fit together.
        group, n = [], 0
        while waiting and levels[waiting[0]] == levels[(group or waiting)[0]] and (not group or n + made.counts[waiting[0]].sum() <= held):
            n += made.counts[waiting[0]].sum()
            group.append(waiting.pop(0))
        place = np.full(made.n, -1)
        place[group] = np.arange(len(group))
        parts = []
        for x, y, w in kept if kept is not None else passed():
            node = place[walk(made.feature, made.cut, made.left, x)] if made.n > 1 else np.zeros(len(y), np.int64)
            mine = slice(None) if made.n == 1 else np.flatnonzero(node >= 0)
            parts.append((x[mine], y[mine], w[mine], node[mine]))
        kept = None
        n = sum(len(p[1]) for p in parts)
        x, y, w, node = np.empty((width, n), np.uint8), np.empty(n, np.uint8), np.empty(n, np.uint8), np.empty(n, np.int32)
        while parts:
            part = parts.pop()
            end, n = n, n - len(part[1])
            x[:, n:end], y[n:end], w[n:end], node[n:end] = part[0].T, *part[1:]
        rows = np.argsort(node, kind="stable").astype(np.int32) if len(group) > 1 else np.arange(len(y), dtype=np.int32)
        sizes = np.bincount(node, minlength=len(group))
        del part, node
        grow(made, x, y, w, np.array(group), rows, sizes, levels[group[0]], depth, rng)
    return made.finish(width)


# ---------------------------------------------------------------- the forest

def fit(stored: DataFrame, names, labels, trees: int, depth: int, seed: int) -> dict:
    """``{label: Forest}`` from a written table of features and labels; each tree of all of them is a task's work."""
    spark = stored.sparkSession
    cuts = find_cuts(stored, names)
    found = agg_row(stored, {c: F.collect_set(col(c)) for c in labels})
    values = {c: sorted(found[c]) for c in labels}
    blocks, width = write_blocks(stored, names, values, cuts), len(names)
    classes, held = [len(values[c]) for c in labels], HELD_ROWS

    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                number, label = divmod(i, len(classes))
                made = one_tree(lambda: read_blocks(blocks, width, label), width, classes[label], depth, seed, number, label, held)
                yield pa.RecordBatch.from_pylist([{"label": labels[label], "tree": number, **made}], schema=pa.schema([
                    ("label", pa.string()), ("tree", pa.int32()), *[(c, pa.binary()) for c in ("feature", "cut", "left", "counts")],
                    ("importance", pa.list_(pa.float64()))]))

    jobs = trees * len(classes)
    path = scratch_path(spark, "forest-trees")
    spark.range(0, jobs, 1, jobs).mapInArrow(run, f"label string, {TREES}").write.partitionBy("label").parquet(path)
    forests = {}
    for c in labels:
        grown, shares = spark.read.schema(TREES).parquet(f"{path}/label={c}"), np.zeros(width)
        for row in sorted(grown.select("tree", "importance").collect()):  # a number per tree and feature
            each = np.array(row.importance)
            shares += each / each.sum() if each.sum() else each
        forests[c] = Forest(grown, list(names), [cuts[x] for x in names], values[c], (shares / (shares.sum() or 1.0)).tolist())
    return forests


class Importances(list):
    def toArray(self) -> np.ndarray:
        return np.array(self)


class Forest:
    """A fitted forest; its trees stay in the shared folder, a few arrays each, and are read one at a time."""

    def __init__(self, trees: DataFrame, names, cuts, labels, importances):
        self.trees, self.names, self.cuts, self.labels = trees, names, cuts, labels
        self.featureImportances = Importances(importances)

    def save(self, path: str) -> None:
        about = json.dumps({"names": self.names, "cuts": self.cuts, "labels": self.labels, "importances": list(self.featureImportances)})
        self.trees.withColumn("about", F.lit(about)).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forest:
        trees = spark.read.schema(f"{TREES}, about string").parquet(path)
        about = json.loads(trees.first()["about"])
        return cls(trees.drop("about"), about["names"], about["cuts"], about["labels"], about["importances"])

    def folder(self) -> str:
        """Where the trees are: the one folder that their files lie in."""
        return self.trees.inputFiles()[0].rsplit("/", 1)[0]

    def probability(self) -> Column:
        """Mean over the trees of the share of each label in the row's leaf, in the order of ``labels``."""
        folder, cuts, classes = self.folder(), self.cuts, len(self.labels)

        @arrow_udf("array<double>")
        def share(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for x, sizes in gathered(batches, cuts):
                votes = np.zeros((len(x), classes))
                for *nodes, shares in read_trees(folder, classes):
                    votes += shares[-1 - nodes[2][walk(*nodes, x)]]
                votes /= votes.sum(1, keepdims=True)
                for part in np.split(votes, np.cumsum(sizes)[:-1]):
                    yield pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * classes, pa.array(part.reshape(-1)))

        return share(F.struct(*[col(c).cast("double").alias(f"f{i}") for i, c in enumerate(self.names)]))

    def predict(self, df: DataFrame, target: str, probability: str) -> DataFrame:
        """Add ``probability`` and the label with the largest one, the first of equals."""
        out = df.withColumn(probability, self.probability())
        names, at = F.array(*[F.lit(x) for x in self.labels]), F.array_position(probability, F.array_max(probability))
        return out.withColumn(target, F.element_at(names, at.cast("int")))


def gathered(batches, cuts):
    """(bins, sizes of the batches) of ``PREDICTED_AT_ONCE`` rows, since every tree is read once for them."""
    parts, n = [], 0
    for batch in batches:
        parts.append(bin_rows(batch.flatten(), cuts))
        n += len(batch)
        if n >= PREDICTED_AT_ONCE:
            yield np.concatenate(parts), [len(x) for x in parts]
            parts, n = [], 0
    if parts:
        yield np.concatenate(parts), [len(x) for x in parts]


def read_trees(folder: str, classes: int):
    """(feature, cut, left, shares of the classes by leaf) of one tree after the other."""
    for batch in parquet_rows(folder, ["feature", "cut", "left", "counts"]):
        for feature, cut, left, counts in zip(*batch.columns):
            counts = np.frombuffer(counts.as_buffer(), np.int64).reshape(-1, classes)
            yield (np.frombuffer(feature.as_buffer(), np.uint8), np.frombuffer(cut.as_buffer(), np.uint8),
                   np.frombuffer(left.as_buffer(), np.int32), counts / counts.sum(1, keepdims=True))
