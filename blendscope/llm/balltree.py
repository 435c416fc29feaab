"""Ranked lexical search: an exact sparse ball tree for inner products.

Terms are runs of ASCII letters and digits and of characters outside ASCII, A-Z as a-z. A document is a sparse row: for each term
of the queries that it holds, the integer x = (10^9 tf) div (1000 tf + 8 m), m its normalised length; a query is its terms'
integer weights w. The score is the inner product, w from 1000 ln((2 N + 2) / (2 df + 1)).

Blocks of ``BLOCK`` documents each become a ball tree: a node holds the centroid c of its rows and the largest distance r
of a row from it, in coordinates x w^(1/2), where the query's are w^(1/2); it is split in halves along the line through two far rows, down
to ``LEAF`` rows. No row of a node scores above q.c + |q| r. In thousands of dimensions that alone shuts no node out, so a node
also holds its radius along each term, s (how far a row goes beyond c there), and the smaller of |q| r and q.s is added to q.c.
A query opens the nodes of a block best first, and ends when the best bound left is below its k-th score so far, which a task
carries from block to block. Bounds are doubles, widened by ``SLACK``, so no row is lost to rounding; rows of opened leaves are
scored in 64-bit integers.

Queries go by batches of about ``BATCH`` (query, term) entries, 8 bytes each to every task; one scan of the texts a batch keeps the
entries of its terms. Corpus counts (N, L, df) are exact. Terms are told apart by 64-bit hashes.

Defined cases: null and empty texts have no terms, do not count in N and are never found; a document with a null id counts and is
found like any other, last among ties; repeated rows are each a document; rows of one query id make one query of all their
terms, null being an id too; a query without terms, or none of whose terms scores, has no rows; an empty table gives no
rows; other columns are not looked at.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blendscope.session import materialize

from .textvec import Texts, chunks, spread

BLOCK = 4096
BLOCK_ENTRIES = 2_000_000
LEAF = 16
BATCH = 2_000_000
SLACK = 1e-9
CODES = ("<i4", "<i4")

TERM = np.zeros(256, bool)
TERM[[b for b in range(128) if chr(b).isalnum()]] = True
TERM[128:] = True


def term_hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every term of a few texts, in order."""
    batch = Texts(texts, lower=True)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], TERM[batch.data], [False])).view(np.int8)))
    return batch.owner(edge[::2]), batch.hashes(edge[::2], edge[1::2])


# ---------------------------------------------------------------- queries

def query_terms(queries: DataFrame, id_column: str) -> DataFrame:
    """(id, term) of the distinct terms of each query."""

    def run(batches):
        for batch in batches:
            for first, part in chunks(batch.column(1).to_pylist()):
                row, term = term_hashes(part)
                pair = np.unique(np.stack((row.astype(np.int64), term.view(np.int64)), 1), axis=0)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + pair[:, 0])), pa.array(pair[:, 1])], names=["id", "term"])

    return queries.select(F.col(id_column).cast("bigint"), "text").mapInArrow(run, "id bigint, term bigint").distinct()


class Queries:
    """A batch of queries as sparse rows over the sorted terms they hold; sent to every task."""

    def __init__(self, table: pa.Table):
        found = table.column("id").combine_chunks().dictionary_encode()
        self.n = len(found.dictionary) + (found.null_count > 0)
        self.ids = pa.concat_arrays([found.dictionary, pa.nulls(self.n - len(found.dictionary), pa.int64())])
        query = found.indices.fill_null(len(found.dictionary)).to_numpy(zero_copy_only=False)
        self.terms, term = np.unique(table.column("term").to_numpy().view(np.uint64), return_inverse=True)
        order = np.lexsort((term, query))
        self.term, self.bounds = term[order], np.searchsorted(query[order], np.arange(self.n + 1))

    def weigh(self, n: int, df: np.ndarray) -> None:
        """Integer weight of each term."""
        self.w = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)


# ---------------------------------------------------------------- documents

def sparse_rows(docs: DataFrame, id_column: str, terms) -> DataFrame:
    """(id, n, terms, tf) of the documents with a term: number of its terms with repeats, and the entries of the queries' terms."""

    def run(batches):
        known = terms.value
        for batch in batches:
            for first, part in chunks(batch.column(1).to_pylist()):
                row, found = term_hashes(part)
                n = np.bincount(row, minlength=len(part))
                at = np.minimum(np.searchsorted(known, found), max(0, len(known) - 1))
                hit = known[at] == found if len(known) else np.zeros(len(found), bool)
                entry, tf = np.unique(row[hit] * max(1, len(known)) + at[hit], return_counts=True)
                bounds = np.searchsorted(entry // max(1, len(known)), np.arange(len(part) + 1))
                term, tf = (entry % max(1, len(known))).astype(CODES[0]), tf.astype(CODES[1])
                full = np.flatnonzero(n)
                rows = [[v[bounds[i]:bounds[i + 1]].tobytes() for i in full] for v in (term, tf)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(first + full)), pa.array(n[full], pa.int64()), *(pa.array(r, pa.binary()) for r in rows)],
                    names=["id", "n", "terms", "tf"])

    return docs.select(F.col(id_column).cast("bigint"), "text").mapInArrow(run, "id bigint, n bigint, terms binary, tf binary")


def document_frequencies(rows: DataFrame, size: int) -> np.ndarray:
    """Documents per term; tasks send one row per term they saw."""

    def run(batches):
        held = np.zeros(size, np.int64)
        for batch in batches:
            for cell in batch.column(0):
                held[np.frombuffer(cell.as_buffer(), CODES[0])] += 1
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"term": at, "df": held[at]})

    found = rows.select("terms").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(size, np.int64)
    df[found["term"].to_numpy()] = found["df"].to_numpy()
    return df


def impacts(n: np.ndarray, sizes: np.ndarray, tf: np.ndarray, docs: int, total: int) -> np.ndarray:
    """x of every entry."""
    if len(n) and 90 * int(n.max()) * docs >= 1 << 63:
        m = np.array([10 + 90 * int(v) * docs // total for v in n], np.int64)
    else:
        m = 10 + 90 * n * docs // max(1, total)
    return 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, sizes))


# ---------------------------------------------------------------- the tree

class Block:
    """Documents as sparse rows over the terms that occur in them, and their ball tree."""

    def __init__(self, ids: pa.Array, sizes: np.ndarray, term: np.ndarray, x: np.ndarray, w: np.ndarray):
        self.terms, local = np.unique(term, return_inverse=True)
        width, scale = len(self.terms), np.sqrt(w[self.terms])
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        y = x * scale[local]
        row = np.repeat(np.arange(len(sizes)), sizes)
        square = np.bincount(row, weights=y * y, minlength=len(sizes))

        def dot(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
            at = spread(bounds[rows], sizes[rows])
            return np.bincount(np.repeat(np.arange(len(rows)), sizes[rows]), weights=y[at] * point[local[at]], minlength=len(rows))

        def dense(r: int) -> np.ndarray:
            out = np.zeros(width)
            out[local[bounds[r]:bounds[r + 1]]] = y[bounds[r]:bounds[r + 1]]
            return out

        def far(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(square[rows] - 2 * dot(rows, point) + point @ point, 0))

        # Rows in the order of the leaves; node i has the rows first[i] to last[i], and two children or none.
        order = np.arange(len(sizes))
        self.first, self.last, self.left, self.radius, centres = [0], [len(sizes)], [], [], []
        node = 0
        while node < len(self.first):
            a, b = self.first[node], self.last[node]
            rows = order[a:b]
            at = spread(bounds[rows], sizes[rows])
            centre = np.bincount(local[at], weights=y[at], minlength=width) / (b - a)
            away = far(rows, centre)
            # The distance is a difference of squares: its rounding is that of the squares.
            self.radius.append(float(away.max()) + np.sqrt(SLACK * (float(square[rows].max()) + float(centre @ centre))))
            inside = np.flatnonzero(centre)
            most = np.zeros(width)
            np.maximum.at(most, local[at], y[at])
            centres.append((inside, centre[inside], np.maximum(most[inside] - centre[inside], 0)))
            if b - a <= LEAF:
                self.left.append(-1)
            else:
                one = dense(rows[int(away.argmax())])
                two = dense(rows[int(far(rows, one).argmax())])
                side = dot(rows, one - two)
                half = (b - a) // 2
                order[a:b] = rows[np.argsort(side, kind="stable")]
                self.left.append(len(self.first))
                self.first += [a, a + half]
                self.last += [a + half, b]
            node += 1
        # Centroids and radii by term: which nodes hold it, and how much.
        at = np.concatenate([c[0] for c in centres])
        by_term = np.argsort(at, kind="stable")
        self.node = np.repeat(np.arange(len(centres)), [len(c[0]) for c in centres])[by_term]
        self.value, self.reach = (np.concatenate([c[i] for c in centres])[by_term] for i in (1, 2))
        self.postings = np.searchsorted(at[by_term], np.arange(width + 1))
        self.radius = np.array(self.radius)
        self.ids = ids.take(pa.array(order))
        self.sizes = sizes[order]
        entries = spread(bounds[order], self.sizes)
        self.local, self.x = local[entries], x[entries]
        self.bounds = np.concatenate(([0], np.cumsum(self.sizes)))

    def upper(self, terms: np.ndarray, w: np.ndarray, length: float) -> np.ndarray:
        """No row of node i scores above upper[i]; ``terms`` are numbers in this block."""
        sizes = self.postings[terms + 1] - self.postings[terms]
        at = spread(self.postings[terms], sizes)
        q = np.repeat(np.sqrt(w), sizes)
        inner, reach = (np.bincount(self.node[at], weights=v[at] * q, minlength=len(self.radius)) for v in (self.value, self.reach))
        return (inner + np.minimum(length * self.radius, reach)) * (1 + SLACK) + 1

    def scores(self, a: int, b: int, weights: np.ndarray) -> np.ndarray:
        """Exact scores of the rows a to b."""
        start, stop = self.bounds[a], self.bounds[b]
        total = np.concatenate(([0], np.cumsum(weights[self.local[start:stop]] * self.x[start:stop])))
        return total[self.bounds[a + 1:b + 1] - start] - total[self.bounds[a:b] - start]


class Best:
    """The k best rows of one query so far: higher score first, then smaller id, a null id last."""

    def __init__(self, k: int):
        self.k, self.rows, self.least = k, [], 1

    def add(self, scores: np.ndarray, ids: list) -> None:
        self.rows = heapq.nsmallest(self.k, self.rows + [(-s, i is None, i or 0) for s, i in zip(scores.tolist(), ids)])
        if len(self.rows) == self.k:
            self.least = -self.rows[-1][0]


def search_block(block: Block, queries: Queries, best: list[Best]) -> int:
    """Merge the rows of a block into the best of each query; how many leaves were opened."""
    weights, opened = np.zeros(len(block.terms), np.int64), 0
    for q in range(queries.n):
        term = queries.term[queries.bounds[q]:queries.bounds[q + 1]]
        term = term[queries.w[term] > 0]
        at = np.searchsorted(block.terms, term)
        here = block.terms[np.minimum(at, len(block.terms) - 1)] == term if len(block.terms) else np.zeros(len(term), bool)
        if not here.any():
            continue
        at, w = at[here], queries.w[term[here]]
        # |q| counts the terms that occur in the block: on the others every row and centroid is 0.
        upper = block.upper(at, w, float(np.sqrt(w.sum())))
        weights[at] = w
        mine, heap = best[q], [(-upper[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < mine.least:
                break
            child = block.left[node]
            if child >= 0:
                for c in (child, child + 1):
                    if upper[c] >= mine.least:
                        heapq.heappush(heap, (-min(upper[c], -bound), c))
                continue
            opened += 1
            a, b = block.first[node], block.last[node]
            scores = block.scores(a, b, weights)
            good = np.flatnonzero(scores >= mine.least)
            if len(good):
                mine.add(scores[good], block.ids.take(pa.array(a + good)).to_pylist())
        weights[at] = 0
    return opened


def search(rows: DataFrame, sent, k: int, docs: int, total: int, id_columns: tuple[str, str]) -> DataFrame:
    """The best rows of each task for each query."""

    def run(batches):
        queries = sent.value
        best = [Best(k) for _ in range(queries.n)]
        held: list[tuple] = []
        entries = 0

        def close():
            n, sizes, term, tf = (np.concatenate(v) for v in list(zip(*held))[1:])
            x = impacts(n, sizes, tf.astype(np.int64), docs, total)
            search_block(Block(pa.concat_arrays([h[0] for h in held]), sizes, term, x, queries.w), queries, best)

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                term, tf = (np.frombuffer(b"".join(part.column(c).to_pylist()), CODES[c - 2]) for c in (2, 3))
                sizes = np.array([len(b) for b in part.column(2).to_pylist()], np.int64) // 4
                held.append((part.column(0), part.column(1).to_numpy(), sizes, term, tf))
                entries += len(term)
                if sum(len(h[0]) for h in held) >= BLOCK or entries >= BLOCK_ENTRIES:
                    close()
                    held, entries = [], 0
        if held:
            close()
        for i, b in enumerate(best):
            if b.rows:
                query = queries.ids.take(pa.array([i] * len(b.rows)))
                ids = pa.array([None if null else i for _, null, i in b.rows], pa.int64())
                yield pa.RecordBatch.from_arrays([query, ids, pa.array([-s for s, _, _ in b.rows], pa.int64())], names=[*id_columns, "score"])

    return rows.where(F.length("terms") > 0).mapInArrow(run, f"{id_columns[0]} bigint, {id_columns[1]} bigint, score bigint")


def ranked(docs: DataFrame, queries: DataFrame, k: int = 10, doc_id: str = "doc_id", query_id: str = "item_id",
           batch_entries: int = BATCH) -> DataFrame:
    """query id, rank (from 1), document id and score of the k best documents of every query, with a score above 0."""
    spark = docs.sparkSession
    pairs = materialize(query_terms(queries, query_id), "query-terms")
    batches = max(1, -(-pairs.count() // batch_entries))
    out = None
    for number in range(batches):
        part = pairs.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == number)
        chosen = Queries(part.toArrow())
        rows = materialize(sparse_rows(docs, doc_id, spark.sparkContext.broadcast(chosen.terms)), "sparse-rows")
        n, total = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        chosen.weigh(n, document_frequencies(rows, len(chosen.terms)))
        found = search(rows, spark.sparkContext.broadcast(chosen), k, n, total, (query_id, doc_id))
        out = found if out is None else out.unionByName(found)
    order = W.partitionBy(query_id).orderBy(F.desc("score"), F.asc_nulls_last(doc_id))
    return (out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select(query_id, "rank", doc_id, "score"))
