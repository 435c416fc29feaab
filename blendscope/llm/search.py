"""Exact top-k by inner product: exhaustive term-at-a-time accumulation.

A vector is a sparse row of terms (its dimensions) with integer weights, floor(256 * x). Rows to search stand in blocks
of ``ROWS``, each as postings per term; queries in blocks of ``QUERIES``, each as sparse rows. For every query the
postings of its terms, times its weight, are scattered into a dense array of scores; a partition selection takes the k
best of the block, smaller ids first among equals, and a window merges the blocks.

Every block of queries meets every block of rows once: query blocks are dealt to as many parts as there are blocks,
row blocks go to each part. Query blocks are broadcast while they take less than ``BROADCAST_BYTES``; beyond, both sides
are shuffled by part.

Defined cases: rows with a null id, a null vector, or null or non-finite components take no part; vectors may differ in
length (missing terms count 0); rows with the query's id are not its candidates; equal rows are each a candidate; an
empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blendscope.session import materialize

ROWS = 8192
QUERIES = 512
BROADCAST_BYTES = 32 << 20
SCALE = 256
NEVER = np.iinfo(np.int64).min


def quantised(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, weights) of the rows that take part."""
    finite = F.forall(vector_column, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    weights = F.transform(vector_column, lambda x: F.floor(SCALE * x.cast("double")).cast("bigint"))
    usable = F.col(id_column).isNotNull() & F.col(vector_column).isNotNull() & finite
    return vectors.where(usable).select(F.col(id_column).cast("bigint").alias("id"), weights.alias("weights"))


def csr(keys: np.ndarray, n: int) -> np.ndarray:
    """Where the entries of each of ``n`` keys begin, keys ascending."""
    return np.searchsorted(keys, np.arange(n + 1))


def blocks(rows: DataFrame, size: int, by_term: bool) -> DataFrame:
    """Rows of a partition packed into blocks: ids, and entries sorted by term (postings) or by row (queries)."""
    kind = pa.schema([("ids", pa.binary()), ("bounds", pa.binary()), ("others", pa.binary()), ("weights", pa.binary())])

    def one(held: list[tuple]):
        held.sort(key=lambda r: r[0])
        ids = np.array([r[0] for r in held], np.int64)
        sizes = np.array([len(r[1]) for r in held], np.int64)
        weights = np.concatenate([np.zeros(0, np.int64), *(r[1] for r in held)])
        row = np.repeat(np.arange(len(held)), sizes)
        term = np.arange(len(weights)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        seen = weights != 0
        row, term, weights = row[seen], term[seen], weights[seen]
        if by_term:
            order = np.argsort(term, kind="stable")
            row, term, weights = row[order], term[order], weights[order]
        key, other = (term, row) if by_term else (row, term)
        n = int(sizes.max(initial=0)) if by_term else len(held)
        parts = (ids, csr(key, n).astype(np.int64), other.astype(np.int32), weights)
        return pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], schema=kind)

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            for i, w in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.append((i, w.values.to_numpy()))
                if len(held) == size:
                    yield one(held)
                    held = []
        if held:
            yield one(held)

    return rows.mapInArrow(run, "ids binary, bounds binary, others binary, weights binary")


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores; among equals the first ones."""
    n = len(scores)
    if n > k:
        limit = np.partition(scores, n - k)[n - k]
        above = np.flatnonzero(scores > limit)
        return np.concatenate((above, np.flatnonzero(scores == limit)[:k - len(above)]))
    return np.arange(n)


def accumulate(row_block: tuple, query_block: tuple, k: int):
    """(query id, row id, score) arrays of the k best rows of the block for each query."""
    ids, bounds, rows, values = row_block
    query_ids, query_bounds, terms, weights = query_block
    found = []
    for q, (a, b) in enumerate(zip(query_bounds[:-1].tolist(), query_bounds[1:].tolist())):
        scores = np.zeros(len(ids), np.int64)
        for term, weight in zip(terms[a:b].tolist(), weights[a:b]):
            if term + 1 < len(bounds):
                first, last = bounds[term], bounds[term + 1]
                if last - first == len(ids):  # every row holds the term
                    scores += weight * values[first:last]
                else:
                    scores[rows[first:last]] += weight * values[first:last]
        own = ids == query_ids[q]
        scores[own] = NEVER
        at = best(scores, k)
        at = at[~own[at]]
        found.append((np.full(len(at), query_ids[q]), ids[at], scores[at]))
    return [np.concatenate(c) for c in zip(*found)]


KINDS = (np.int64, np.int64, np.int32, np.int64)


def top_k(vectors: DataFrame, is_query: Column, k: int, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), the id and score of each query's k best rows; ``is_query`` is a condition on the ids."""
    rows = quantised(vectors, id_column, vector_column)
    chosen = quantised(vectors.where(is_query), id_column, vector_column)
    queries = materialize(blocks(chosen, QUERIES, by_term=False), "query-blocks")
    n, size = queries.select(F.count("*"), F.sum(F.length("weights") + F.length("others"))).first()
    parts = max(1, n)
    queries = queries.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int"))
    queries = queries.select("part", *(F.col(c).alias(f"q_{c}") for c in ("ids", "bounds", "others", "weights")))
    spread = blocks(rows, ROWS, by_term=True).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    pairs = spread.join(F.broadcast(queries) if (size or 0) <= BROADCAST_BYTES else queries, "part").drop("part")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                data = [np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in enumerate(KINDS * 2)]
                query, row, score = accumulate(data[:4], data[4:], k)
                yield pa.RecordBatch.from_pydict({"query_id": query, id_column: row, "score": score})

    found = pairs.mapInArrow(run, f"query_id bigint, {id_column} bigint, score bigint")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), id_column)
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", id_column, "score"))
