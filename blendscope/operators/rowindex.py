"""Row position and exact quantiles, without a window or a sort that meets in one task."""

from __future__ import annotations

import math
import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_double, col
from ..session import agg_row, local_table, materialize

PARTITION_BITS = 33  # monotonically_increasing_id() keeps the partition above this many row bits


def tie_digest(df: DataFrame) -> Column:
    """Digest of all columns: a repeatable order among rows that the keys do not tell apart."""
    return F.xxhash64(*[col(c) for c in df.columns])


RUN_BUCKETS = 4096  # buckets of row digests, counted to find long runs of equal rows
RUN_CHUNK = 10_000  # copies of a row dealt out at once


def long_runs(df: DataFrame, chunk: int = RUN_CHUNK) -> list:
    """Buckets of the row digest that hold far more rows than the others, hence perhaps one row very often.

    One scan; at most ``RUN_BUCKETS`` counts per task are shuffled.
    """
    sizes = df.groupBy(run_bucket(df).alias("bucket")).count().collect()  # at most RUN_BUCKETS rows
    limit = max(chunk, 2 * sum(r["count"] for r in sizes) // RUN_BUCKETS)
    return sorted(r["bucket"] for r in sizes if r["count"] > limit)


def run_bucket(df: DataFrame) -> Column:
    return F.pmod(tie_digest(df), F.lit(RUN_BUCKETS)).cast("int")


def indexed(df: DataFrame, order_by, name: str = "_idx", keep=None, chunk: int = RUN_CHUNK) -> tuple:
    """(``df`` with a dense 0-based position in ``order_by`` order, row count).

    The sort is a range exchange; it is written once to the shared folder so that the partition
    sizes and the rows come from the same run. Only one number per partition meets the driver.
    ``keep`` limits the written columns. ``order_by`` should identify a row; rows it does not tell
    apart are ordered by a digest, which keeps the order repeatable and spreads a hot key.

    Equal rows cannot be told apart by any key, so a range sort puts them all in one task. A scan looks for such runs first; their
    rows then take part in the sort once, with their number, and are dealt out afterwards, ``chunk`` copies at a time, over all tasks.
    """
    if not order_by:
        raise ValueError("row positions need order_by columns")
    keys = [col(k) if isinstance(k, str) else k for k in order_by]
    columns = list(df.columns) if keep is None else list(keep)
    runs = long_runs(df, chunk)
    rows = df
    if runs:
        hot = run_bucket(df).isin(runs)
        everything = [col(c) for c in df.columns]
        rows = df.where(~hot).withColumn("_copies", F.lit(1).cast("bigint")).unionByName(
            df.where(hot).groupBy(*everything).agg(F.count("*").alias("_copies")))
    times = ["_copies"] if runs else []
    ordered = rows.orderBy(*keys, tie_digest(df)).withColumn("_mid", F.monotonically_increasing_id())
    stored = materialize(ordered.select(*[col(c) for c in columns], *times, "_mid"), "rowindex")
    stored = stored.withColumn("_part", F.shiftright("_mid", PARTITION_BITS))

    sizes = stored.groupBy("_part").agg(F.sum("_copies") if runs else F.count("*")).orderBy("_part").collect()
    starts, total = [], 0
    for part, size in sizes:
        starts.append((part, total))
        total += size
    offsets = local_table(df.sparkSession, starts, "_part bigint, _start bigint")
    inner = F.col("_mid").bitwiseAND((1 << PARTITION_BITS) - 1)
    if runs:
        before = Window.partitionBy("_part").orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
        stored, inner = stored.withColumn("_before", F.coalesce(F.sum("_copies").over(before), F.lit(0))), F.col("_before")
    # One row per partition of the sort: always small enough to broadcast.
    placed = stored.join(F.broadcast(offsets), "_part").select(
        *[col(c) for c in columns], *times, (F.col("_start") + inner).alias(name))
    if runs:
        placed = deal_out(placed, columns, name, chunk)
    return placed, total


def deal_out(runs: DataFrame, columns: list, name: str, chunk: int) -> DataFrame:
    """Each row ``_copies`` times, at the positions from ``name`` on; long runs go out in chunks over all tasks."""
    one = F.lit(1).cast("bigint")
    few = runs.where(F.col("_copies") <= chunk).withColumn("_first", F.lit(0).cast("bigint"))
    many = runs.where(F.col("_copies") > chunk).withColumn(
        "_first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1, F.lit(chunk).cast("bigint"))))
    # A number of partitions that is given is not made smaller for the few bytes of the chunks.
    many = many.repartition(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col(name) + F.col("_first"))
    last = F.least(F.col("_copies") - one, F.col("_first") + (chunk - 1))
    out = few.unionByName(many).withColumn("_copy", F.explode(F.sequence("_first", last, one)))
    return out.select(*[col(c) for c in columns], (F.col(name) + F.col("_copy")).alias(name))


def dense_index(df: DataFrame, order_by, name: str = "_idx") -> DataFrame:
    """``df`` with a dense 0-based row position in ``order_by`` order."""
    return indexed(df, order_by, name)[0]


# ---------------------------------------------------------------- exact quantiles

SMALL_COLUMN = 50_000  # up to this many values one percentile() buffer is the cheapest way
BUCKETS = 1024  # equal-width buckets an interval within two doublings is cut into per scan
PER_DOUBLING = 32  # buckets per doubling in a wider interval
ABOVE_ALL_STEPS = 40_000  # makes the step of the smallest double positive
SMALL_BUCKET = 200_000  # a bucket with so few values is resolved value by value


def exact_quantiles(df: DataFrame, cols, probs, facts=None, small: int = SMALL_COLUMN,
                    small_bucket: int = SMALL_BUCKET, weight: str = None) -> dict:
    """``{column: [value per prob]}``, linear interpolation between order statistics, NULLs left out.

    ``weight`` names a column that says how often a row counts; then ``facts`` is needed, with weighted counts.

    Columns with at most ``small`` values use ``percentile``, whose buffer holds every distinct value.
    Longer ones are narrowed instead: a scan counts values per bucket, the bucket that holds a wanted
    rank is cut again, until it holds one value or few. The number of scans does not depend on how many
    decades the values span: a first one leaves an interval within a doubling, each next one its 1024th part. All columns and ranks share each scan, and only
    counts per bucket are shuffled. ``facts`` = ``{column: (count, min, max)}`` saves a scan.
    """
    cols, probs = list(cols), list(probs)
    if facts is None:
        seen = agg_row(df, {(c, f): getattr(F, f)(as_double(c)) for c in cols for f in ("count", "min", "max")})
        facts = {c: (seen[c, "count"], seen[c, "min"], seen[c, "max"]) for c in cols}
    out = {c: [None] * len(probs) for c in cols if facts[c][0] == 0}
    short = [c for c in cols if 0 < facts[c][0] <= small]
    if short:
        found = agg_row(df, {
            c: F.percentile(as_double(c), F.array(*[F.lit(float(p)) for p in probs]), col(weight) if weight else 1) for c in short
        }, batch=20)
        out.update({c: list(v) for c, v in found.items()})

    wanted = {}  # (column, prob index) -> the two ranks and how far between them
    for c in cols:
        if facts[c][0] > small:
            for i, p in enumerate(probs):
                pos = p * (facts[c][0] - 1)
                wanted[c, i] = (math.floor(pos), math.ceil(pos), pos)
    ranks = {(c, k) for (c, _), (k0, k1, _) in wanted.items() for k in (k0, k1)}
    values = _values_at(df, ranks, facts, small_bucket, F.lit(1) if weight is None else col(weight))
    for (c, i), (k0, k1, pos) in wanted.items():
        v0, v1 = values[c, k0], values[c, k1]
        # The same arithmetic as percentile(), so that a column's length does not show in the last digit.
        out.setdefault(c, [None] * len(probs))[i] = v0 if k0 == k1 or v0 == v1 else (k1 - pos) * v0 + (pos - k0) * v1
    return out


def _values_at(df: DataFrame, ranks: set, facts: dict, small_bucket: int, weight: Column) -> dict:
    """``{(column, rank): value}`` by repeated bucketing."""
    values = {}
    # (column, rank) -> (low, high, values below low, values from low to high)
    spans = {(c, k): (float(facts[c][1]), float(facts[c][2]), 0, facts[c][0]) for c, k in ranks}
    while True:
        for key, (low, high, _, _) in spans.items():
            if low == high:
                values[key] = low
        spans = {key: s for key, s in spans.items() if key not in values}
        if not spans:
            return values
        cuts = sorted({(c, *s) for (c, _), s in spans.items()})
        cells = []
        for j, (c, low, high, _, n) in enumerate(cuts):
            cells += [F.lit(j), _bucket(as_double(c), low, high, n <= small_bucket), as_double(c)]
        counted = (
            df.select(F.stack(F.lit(len(cuts)), *cells).alias("cut", "bucket", "x"), weight.alias("_w")).where("bucket is not null")
            .groupBy("cut", "bucket").agg(F.sum("_w").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        )
        # Per cut at most BUCKETS or small_bucket rows, so the running count per cut is bounded.
        running = counted.withColumn("upto", F.sum("n").over(Window.partitionBy("cut").orderBy("bucket")))
        goals = local_table(df.sparkSession, [
            (cuts.index((c, *s)), k, k - s[2]) for (c, k), s in spans.items()
        ], "cut int, rank bigint, inner_rank bigint")
        hits = running.join(F.broadcast(goals), "cut").where(
            (F.col("inner_rank") < F.col("upto")) & (F.col("inner_rank") >= F.col("upto") - F.col("n"))
        ).select("cut", "rank", "low", "high", (F.col("upto") - F.col("n")).alias("before"), "n").collect()
        spans = {
            (cuts[h.cut][0], h.rank): (h.low, h.high, cuts[h.cut][3] + h.before, h.n) for h in hits
        }


def _bucket(x, low: float, high: float, by_value: bool):
    """Bucket number of ``x`` in [low, high], or ``x`` itself; NULL outside."""
    inside = x.between(low, high)
    # Halves, so that the width cannot overflow; infinities count as the largest finite number.
    start, stop = (max(-sys.float_info.max, min(sys.float_info.max, v)) * 0.5 for v in (low, high))
    if by_value or stop <= start:
        return F.when(inside, x)
    finite = F.greatest(F.lit(-sys.float_info.max), F.least(F.lit(sys.float_info.max), x))
    small, large = sorted((abs(start), abs(stop)))
    if start < 0 < stop or large > 4 * small:
        # Steps that grow with the value: however many decades an interval spans, a step spans the 32nd part of a doubling.
        step = F.floor(F.log2(F.abs(finite)) * PER_DOUBLING) + ABOVE_ALL_STEPS
        return F.when(inside, F.when(x == 0, 0.0).otherwise(F.signum(x) * step))
    place = finite * 0.5
    step = F.floor((place - start) * (BUCKETS / (stop - start))).cast("double")
    return F.when(inside, F.least(step, F.lit(BUCKETS - 1.0)))


def rank_quantile(df: DataFrame, cols, probs, small: int = SMALL_COLUMN) -> DataFrame:
    """Exact quantiles as rows (column, prob, value)."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    found = exact_quantiles(df, cols, probs, small=small)
    rows = [(c, float(p), v) for c in cols for p, v in zip(probs, found[c])]
    return local_table(df.sparkSession, rows, "column string, prob double, value double")
