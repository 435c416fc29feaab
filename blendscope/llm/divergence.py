"""Source divergence audit: a K-squared quadtree over the group-term count matrix, traversed jointly for pairs of groups.

A group is a (lang, source) that occurs. Terms are runs of ASCII letters and characters outside ASCII, A-Z as a-z. Each lang keeps
the terms that at least ``least_docs`` of its documents hold. With V kept terms, and N occurrences of them in the group, a kept term
that occurs count times there has the price p = 1 + floor(10^9 (count + 5) / (N + 5 V)); q is that of the whole lang. Two groups
differ by the sum of |p - p'| over all kept terms.

The matrix of a lang is cut into tiles of ``TILE`` groups and into shards of about ``SHARD`` terms (by hash); every pair of
tiles of a shard is one group of rows. There each tile becomes a forest of trees, one for each square of the matrix: a node has
one bit for each of its four quadrants, whose number in the next level is the rank of that bit. Two trees are traversed together,
level by level: where a quadrant is empty in both, each pair of its groups differs by the same amount in each of its
terms, so only the number of terms is noted; else its children follow, down to single cells. Only sums per pair of groups leave a shard.

Counts are summed up by task before they are shuffled; the hot term, group or lang is one row per task and group. Prices and sums
are exact integers (prices by decimals).

Defined cases: null text, lang or source is ''; every (lang, source) that occurs is a group, even without terms; the only group of
a lang has no pairs; a lang without kept terms has pairs of value 0 and no terms; repeated rows count each; ties stand in the order of
UTF-8 bytes; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blendscope.session import materialize

from .textvec import Texts, chunks, spread

TILE = 128
SHARD = 2048
CELLS = 4 << 20  # (group, group, term) triples of one traversal at most
HELD_ROWS = 400_000  # partial counts a task holds before it merges them
BROADCAST_GROUPS = 200_000  # groups of at most so many rows are broadcast; above, the joins shuffle
UNIT, EXTRA = 1_000_000_000, 5

TERM = np.zeros(256, bool)
TERM[[b for b in range(128) if chr(b).isalpha()]] = True
TERM[128:] = True


# ---------------------------------------------------------------- counts

def term_counts(langs: list, sources: list, texts: list) -> pa.Table:
    """(lang, source, term, n, docs) of a few texts."""
    batch = Texts(texts, lower=True)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], TERM[batch.data], [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    _, first, code = np.unique(batch.hashes(starts, ends), return_index=True, return_inverse=True)
    size = ends[first] - starts[first]
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    data = np.ascontiguousarray(batch.data[spread(starts[first], size)])
    terms = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data))
    numbers: dict = {}
    group = np.array([numbers.setdefault(key, len(numbers)) for key in zip(langs, sources)], np.int64)
    width = max(1, len(first))
    in_doc, times = np.unique(batch.owner(starts) * width + code, return_counts=True)
    cell, at = np.unique(group[in_doc // width] * width + in_doc % width, return_inverse=True)
    names = list(numbers)
    where = cell // width
    return pa.table({
        "lang": pa.array([k[0] for k in names], pa.string()).take(pa.array(where)),
        "source": pa.array([k[1] for k in names], pa.string()).take(pa.array(where)),
        "term": terms.take(pa.array(cell % width)),
        "n": np.bincount(at, weights=times, minlength=len(cell)).astype(np.int64),
        "docs": np.bincount(at, minlength=len(cell)).astype(np.int64)})


def merged(parts: list[pa.Table]) -> pa.Table:
    total = pa.concat_tables(parts).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return total.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"])


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that hold it), once per task that saw it."""

    def run(batches):
        held: list[pa.Table] = []
        for batch in batches:
            langs, sources, texts = (c.to_pylist() for c in batch.columns)
            for first, part in chunks(texts):
                stop = first + len(part)
                held.append(term_counts(langs[first:stop], sources[first:stop], part))
                if sum(map(len, held)) >= HELD_ROWS:
                    held = [merged(held)]
                    if len(held[0]) >= HELD_ROWS // 2:
                        yield from held.pop().to_batches(max_chunksize=50_000)
        if held:
            yield from merged(held).to_batches(max_chunksize=50_000)

    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*blank).mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


def price(n: str, total: str, kept: str) -> Column:
    """1 + floor(UNIT (n + EXTRA) / (total + EXTRA kept)) without rounding, however large the counts."""
    top = f"cast({UNIT} as decimal(10, 0)) * cast({n} + {EXTRA} as decimal(20, 0))"
    return F.expr(f"1 + ({top}) div cast({total} + {EXTRA} * {kept} as decimal(20, 0))")


# ---------------------------------------------------------------- the tree

def morton(row: np.ndarray, col: np.ndarray, bits: int) -> np.ndarray:
    """Bits of row and column in turn, the row's first."""
    out = np.zeros(len(row), np.int64)
    for b in range(bits):
        out |= (((row >> b) & 1) << (2 * b + 1)) | (((col >> b) & 1) << (2 * b))
    return out


class Tree:
    """K-squared trees of the squares of ``1 << bits`` rows and columns that lie side by side.

    ``roots`` are the squares that hold a cell; ``child[l][4 * node + quadrant]`` is the node's quadrant in level l + 1, or -1.
    Cells, the last level, stand in Morton order, ``values`` with them.
    """

    def __init__(self, row: np.ndarray, col: np.ndarray, values: np.ndarray, bits: int):
        side = (1 << bits) - 1
        code = ((col >> bits) << (2 * bits)) | morton(row, col & side, bits)
        order = np.argsort(code)
        level, self.values, self.child = code[order], values[order], []
        for _ in range(bits):
            parents, at = np.unique(level >> 2, return_inverse=True)
            child = np.full(4 * len(parents), -1, np.int64)
            child[4 * at + (level & 3)] = np.arange(len(level))  # the rank of the quadrant's bit
            self.child.insert(0, child)
            level = parents
        self.roots = level

    def root(self, square: np.ndarray) -> np.ndarray:
        if not len(self.roots):
            return np.full(len(square), -1)
        at = np.minimum(np.searchsorted(self.roots, square), len(self.roots) - 1)
        return np.where(self.roots[at] == square, at, -1)

    def down(self, level: int, node: np.ndarray, quadrant: int) -> np.ndarray:
        child = self.child[level]
        return np.where(node >= 0, child[4 * node + quadrant], -1) if len(child) else node


def differences(a: Tree, b: Tree, empty_a: np.ndarray, empty_b: np.ndarray, columns: int, bits: int, same: bool) -> np.ndarray:
    """Sum over all columns of |p - p'| for every row of a and row of b (only a's before b's if they are the same tile).

    ``empty_a`` and ``empty_b`` hold the price that a row pays in a column without a cell.
    """
    rows, others = len(empty_a), len(empty_b)
    total = np.zeros(rows * others, np.int64)
    empty = np.zeros((rows, others), np.int64)
    side = 1 << bits
    squares = -(-columns // side)
    step = max(1, CELLS >> (3 * bits))
    for first in range(0, squares, step):
        c = np.arange(first, min(squares, first + step))
        i = j = np.zeros(len(c), np.int64)
        x, y = a.root(c), b.root(c)
        for level in range(bits + 1):
            size = side >> level
            none = (x < 0) & (y < 0)
            if none.any():
                blocks = -(-others // size)
                terms = np.minimum(size, columns - c[none] * size)
                noted = np.bincount(i[none] * blocks + j[none], weights=terms, minlength=-(-rows // size) * blocks).astype(np.int64)
                empty += noted.reshape(-1, blocks).repeat(size, 0).repeat(size, 1)[:rows, :others]
                i, j, c, x, y = (v[~none] for v in (i, j, c, x, y))
            if level == bits:
                break
            parts = []
            for r in (0, 1):
                for s in (0, 1):
                    for k in (0, 1):
                        p, q, t, half = 2 * i + r, 2 * j + s, 2 * c + k, size >> 1
                        inside = (p * half < rows) & (q * half < others) & (t * half < columns)
                        if same:
                            inside &= p <= q
                        parts.append((p[inside], q[inside], t[inside], a.down(level, x[inside], 2 * r + k), b.down(level, y[inside], 2 * s + k)))
            i, j, c, x, y = (np.concatenate(v) for v in zip(*parts))
        if len(i):
            left = np.where(x >= 0, a.values[x] if len(a.values) else 0, empty_a[i])
            right = np.where(y >= 0, b.values[y] if len(b.values) else 0, empty_b[j])
            # Below 2^53 by far (SHARD terms of at most 10^9), so sums of doubles are exact.
            total += np.bincount(i * others + j, weights=np.abs(left - right), minlength=len(total)).astype(np.int64)
    return total.reshape(rows, others) + empty * np.abs(empty_a[:, None] - empty_b[None, :])


def price_shard(key: tuple, table: pa.Table, size: int) -> pa.Table:
    """(lang, g, h, value, terms) of the pairs of groups of two tiles, over the terms of a shard that one of the tiles holds; g before h."""
    lang, _, one, two = (k.as_py() for k in key)
    row, p = table["row"].to_numpy(), table["p"].to_numpy()
    codes = table["term"].combine_chunks().dictionary_encode()
    head = codes.indices.is_null().to_numpy(zero_copy_only=False)
    col = codes.indices.fill_null(0).to_numpy()[~head]
    # Frequent terms first, so that rare ones share empty quadrants.
    often = np.bincount(col, minlength=len(codes.dictionary))
    place = np.empty(len(often), np.int64)
    place[np.lexsort((np.arange(len(often)), -often))] = np.arange(len(often))
    col = place[col]
    tiles = []
    for tile in (one, two):
        inside = row // size == tile
        empty = np.zeros(int((inside & head).sum()), np.int64)
        empty[row[inside & head] - tile * size] = p[inside & head]
        cells = inside[~head]
        tiles.append((empty, row[~head][cells] - tile * size, col[cells], p[~head][cells]))
    bits = max(len(t[0]) - 1 for t in tiles).bit_length()
    trees = [Tree(*t[1:], bits) for t in tiles]
    value = differences(*trees, tiles[0][0], tiles[1][0], len(often), bits, one == two)
    g, h = np.nonzero(np.triu(np.ones(value.shape, bool), 1) if one == two else np.ones(value.shape, bool))
    return pa.table({"lang": pa.array([lang] * len(g), pa.string()), "g": (g + one * size).astype(np.int32),
                     "h": (h + two * size).astype(np.int32), "value": value[g, h],
                     "terms": np.full(len(g), len(often), np.int64)})


# ---------------------------------------------------------------- the audit

def audit(docs: DataFrame, least_docs: int = 30, terms: int = 50, tile: int = TILE) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank: how far each group is from the others of its lang, and its ``terms`` most overweight terms."""
    cells = count_terms(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = W.partitionBy("lang", "term")
    cells = cells.select("*", F.sum("n").over(term).alias("lang_n"), F.sum("docs").over(term).alias("lang_docs"),
                         (F.row_number().over(term.orderBy("source")) == 1).cast("bigint").alias("is_first"))
    kept = materialize(cells.where(F.col("lang_docs") >= least_docs).drop("docs", "lang_docs"), "kept-terms")

    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("is_first").alias("firsts"))
    groups = docs.select(*blank).distinct().join(sums, ["lang", "source"], "left")
    lang = W.partitionBy("lang")
    groups = groups.select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), (F.row_number().over(lang.orderBy("source")) - 1).alias("row"),
        F.count("*").over(lang).alias("size"), F.coalesce(F.sum("total").over(lang), F.lit(0)).alias("lang_total"),
        F.coalesce(F.sum("firsts").over(lang), F.lit(0)).alias("v"))
    groups = materialize(groups.withColumns({
        "shards": F.greatest(F.lit(1), F.ceil(F.col("v") / SHARD)), "tiles": F.ceil(F.col("size") / tile).cast("int"),
        "empty": F.when(F.col("v") > 0, price("0", "total", "v")).otherwise(F.lit(0).cast("bigint"))}), "groups")
    few = groups.count() <= BROADCAST_GROUPS

    def near(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df

    priced = kept.join(near(groups), ["lang", "source"]).withColumn("p", price("n", "total", "v"))
    shape = ("lang", "shard", "row", "tiles", "term", "p")
    rows = priced.withColumn("shard", F.pmod(F.xxhash64("term"), "shards")).select(*shape)
    heads = groups.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1)))
    rows = rows.unionByName(heads.select(*shape[:4], F.lit(None).cast("string").alias("term"), F.col("empty").alias("p")))
    own = F.floor(F.col("row") / tile).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    rows = rows.select("lang", "shard", "row", "term", "p", own.alias("own"), other)
    rows = rows.select("lang", "shard", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "row", "term", "p")
    pairs = rows.groupBy("lang", "shard", "one", "two").applyInArrow(
        lambda key, table: price_shard(key, table, tile), "lang string, g int, h int, value bigint, terms bigint")
    pairs = pairs.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))

    def named(number: str, name: str) -> DataFrame:
        return near(groups.select("lang", F.col("row").alias(number), F.col("source").alias(name), F.col("empty").alias(f"{name}_empty"), "v"))

    pairs = pairs.join(named("g", "one").drop("v"), ["lang", "g"]).join(named("h", "two"), ["lang", "h"])
    # Kept terms that neither tile holds: one large empty quadrant.
    pairs = pairs.withColumn("value", F.expr("value + (v - terms) * abs(one_empty - two_empty)"))
    both = F.inline(F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")),
                            F.struct(F.col("two").alias("source"), F.col("one").alias("item"))))
    pairs = pairs.select("lang", "value", both).withColumn("part", F.lit("pair"))
    over = priced.withColumn("q", price("lang_n", "lang_total", "v")).where("n > 0 and p > q")
    over = over.select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"), F.lit("term").alias("part"))
    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).alias("rank")
    columns = ("lang", "source", "part", "item", "value")
    top = over.select(*columns, rank).where(F.col("rank") <= terms)
    return pairs.select(*columns, rank).unionByName(top)
