"""Per-column and per-table statistics."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import INTEGRAL, as_double, col, numeric_names
from ..functions.values import percent
from ..session import agg_row, local_table, together
from ..sources.io import normalize
from .rowindex import exact_quantiles, indexed, tie_digest

COLUMN_PROFILE = (
    "ordinal int, column string, type string, n_rows bigint, null_count bigint, null_percent double, "
    "mean double, std double, min double, max double, q1 double, q3 double, unique_count bigint, "
    "mode string, mode_freq bigint, mode_percent double, outlier_count bigint, outlier_percent double"
)


def require_rows(df: DataFrame, n_rows: int) -> None:
    if n_rows == 0 or not df.columns:
        raise ValueError("the dataset is empty")


def shape(df: DataFrame) -> DataFrame:
    """One row: rows, columns, cells."""
    width = len(df.columns)
    n = df.count()
    require_rows(df, n)
    return df.sparkSession.range(1).select(
        F.lit(n).cast("bigint").alias("n_rows"), F.lit(width).alias("n_cols"),
        F.lit(n * width).cast("bigint").alias("n_cells"))


def null_counts(df: DataFrame) -> DataFrame:
    """Rows (column, null_count, null_percent) for all columns in one scan."""
    df = normalize(df)
    seen = agg_row(df, {"*": F.count(F.lit(1)), **{(c,): F.count(col(c)) for c in df.columns}})
    n = seen["*"]
    require_rows(df, n)
    rows = [(c, n - seen[c,], 100.0 * (n - seen[c,]) / n) for c in df.columns]
    return local_table(df.sparkSession, rows, "column string, null_count bigint, null_percent double")


# ---------------------------------------------------------------- distinct values and modes

def value_counts(df: DataFrame, cols=None, by=()) -> DataFrame:
    """Rows (ordinal, num_value, dbl_value, str_value, n): how often each non-NULL value occurs, per value of the columns ``by``.

    Columns of a family share one shuffle of (column, value) keys that are counted before they move,
    so a value that fills a third of the table is one row per map task.
    """
    names = df.columns if cols is None else list(cols)
    types = {f.name: f.dataType for f in df.schema.fields}
    by = [col(c) for c in by]
    fixed, text = [], []
    for i, c in enumerate(names):
        if isinstance(types[c], INTEGRAL):
            fixed += [F.lit(i), col(c).cast("bigint"), F.lit(None).cast("double")]
        elif isinstance(types[c], (T.FloatType, T.DoubleType)):
            fixed += [F.lit(i), F.lit(None).cast("bigint"), as_double(c)]
        else:
            text += [F.lit(i), col(c).cast("string")]
    out = None
    if fixed:
        cells = df.select(*by, F.stack(F.lit(len(fixed) // 3), *fixed).alias("ordinal", "num_value", "dbl_value"))
        out = (cells.where("num_value is not null or dbl_value is not null")
               .groupBy(*by, "ordinal", "num_value", "dbl_value").agg(F.count("*").alias("n"))
               .select(*by, "ordinal", "num_value", "dbl_value", F.lit(None).cast("string").alias("str_value"), "n"))
    if text:
        cells = df.select(*by, F.stack(F.lit(len(text) // 2), *text).alias("ordinal", "str_value"))
        words = (cells.where("str_value is not null").groupBy(*by, "ordinal", "str_value").agg(F.count("*").alias("n"))
                 .select(*by, "ordinal", F.lit(None).cast("bigint").alias("num_value"),
                         F.lit(None).cast("double").alias("dbl_value"), "str_value", "n"))
        out = words if out is None else out.unionByName(words)
    return out


def distinct_and_mode(df: DataFrame, cols=None) -> DataFrame:
    """Rows (ordinal, unique_count, mode, mode_freq); the smallest of equally frequent values wins."""
    return modes_of(value_counts(df, cols))


def modes_of(counted: DataFrame) -> DataFrame:
    """``distinct_and_mode`` from value counts."""
    best = counted.groupBy("ordinal").agg(F.count("*").alias("unique_count"), F.max("n").alias("mode_freq"))
    # Numbers aggregate by hash; only the text values that reach the highest count are compared with each other.
    top = counted.join(F.broadcast(best), "ordinal").where("n = mode_freq")  # best has one row per column
    return top.groupBy("ordinal", "unique_count", "mode_freq").agg(
        F.min("num_value").alias("num"), F.min("dbl_value").alias("dbl"), F.min("str_value").alias("str")
    ).select("ordinal", "unique_count", F.coalesce("str", F.col("num").cast("string"), F.col("dbl").cast("string")).alias("mode"),
             "mode_freq")


def distinct_counts(df: DataFrame, cols=None, approx: bool = False) -> dict:
    """``{column: distinct non-NULL values}``."""
    names = df.columns if cols is None else list(cols)
    if not names:
        return {}
    if approx:
        return agg_row(df, {c: F.approx_count_distinct(col(c), 0.01) for c in names})
    rows = value_counts(df, names).groupBy("ordinal").count().collect()  # one row per column
    found = dict(rows)
    return {c: found.get(i, 0) for i, c in enumerate(names)}


# ---------------------------------------------------------------- outliers

def number_facts(df: DataFrame, cols, extra: dict = None) -> tuple:
    """One scan: ``{column: (count, min, max)}``, ``{column: mean}`` and the ``extra`` aggregates."""
    parts = dict(extra or {})
    for c in cols:
        x = as_double(c)
        parts.update({(c, "n"): F.count(x), (c, "min"): F.min(x), (c, "max"): F.max(x), (c, "mean"): F.avg(x)})
    seen = agg_row(df, parts)
    return {c: (seen[c, "n"], seen[c, "min"], seen[c, "max"]) for c in cols}, {c: seen[c, "mean"] for c in cols}, seen


def deviation(name: str, mean: float):
    """Sum of squared distances from a known mean: stable, and a plain sum for the code generator."""
    return F.sum((as_double(name) - F.lit(mean)) * (as_double(name) - F.lit(mean)))


def sample_std(facts: tuple, squares: float):
    """Standard deviation of a sample; None below two values, 0 for a constant."""
    n, low, high = facts
    if n < 2:
        return None
    return 0.0 if low == high else math.sqrt(squares / (n - 1))


def iqr_bounds(df: DataFrame, cols=None, facts=None) -> dict:
    """``{column: (q1, q3, lower, upper)}`` with fences 1.5 interquartile ranges out; None when no value."""
    names = numeric_names(df) if cols is None else list(cols)
    out = {}
    for c, (q1, q3) in exact_quantiles(df, names, [0.25, 0.75], facts).items():
        if q1 is not None:
            reach = 1.5 * (q3 - q1)
            out[c] = (q1, q3, q1 - reach, q3 + reach)
    return out


def outside(name: str, bounds: tuple):
    return (as_double(name) < bounds[2]) | (as_double(name) > bounds[3])


def outlier_rows(df: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` lies strictly outside the fences."""
    df = normalize(df)
    found = iqr_bounds(df, [column])
    return df.where(outside(column, found[column])) if column in found else df.where(F.lit(False))


# ---------------------------------------------------------------- the column profile

def table_facts(df: DataFrame) -> tuple:
    """What one scan tells about all columns: ``number_facts`` plus the row count ``*`` and every count."""
    others = {(c, "n"): F.count(col(c)) for c in df.columns if c not in numeric_names(df)}
    return number_facts(df, numeric_names(df), {"*": F.count(F.lit(1)), **others})


def column_profile(df: DataFrame, approx_distinct: bool = False, facts: tuple = None) -> DataFrame:
    """One row per column: nulls, moments, quartiles, distinct values, mode, outliers.

    A scan for the moments, then side by side: scans for quartiles and outliers, and the value counts,
    which alone shuffle. ``approx_distinct`` replaces those by a sketch and gives no modes.
    """
    df = normalize(df)
    if not df.columns:
        raise ValueError("the dataset is empty")
    facts, means, seen = facts or table_facts(df)
    n = seen["*"]
    require_rows(df, n)
    numeric = numeric_names(df)

    def spread():
        bounds = iqr_bounds(df, numeric, facts)
        return bounds, agg_row(df, {
            key: value for c, b in bounds.items() for key, value in (
                ((c, "outliers"), F.count_if(outside(c, b))), ((c, "squares"), deviation(c, means[c])))
        }) if bounds else {}

    def values():
        if approx_distinct:
            approx = distinct_counts(df, approx=True)
            return {i: (approx[c], None, None) for i, c in enumerate(df.columns)}
        return {r[0]: tuple(r[1:]) for r in distinct_and_mode(df).collect()}  # one row per column

    (bounds, wide), counted = together(df.sparkSession, spread, values)
    return profile_rows(df, n, {c: seen[c, "n"] for c in df.columns}, facts, means, bounds, wide, counted)


def profile_rows(df: DataFrame, n: int, filled: dict, facts: dict, means: dict, bounds: dict, wide: dict, counted: dict) -> DataFrame:
    """The column profile from its parts: values per column, (count, min, max) and means of numeric ones, fences, sums of squares
    and outliers, and (distinct, mode, mode frequency) by ordinal."""
    rows = []
    for i, c in enumerate(df.columns):
        nulls = n - filled[c]
        unique, mode, freq = counted.get(i, (0, "N/A", 0))
        row = [i, c, "Numeric" if c in facts else "Categorical", n, nulls, 100.0 * nulls / n]
        if c in facts:
            std = sample_std(facts[c], wide.get((c, "squares")))
            row += [0.0 if v is None else float(v) for v in (means[c], std, facts[c][1], facts[c][2])]
            q1, q3 = bounds[c][:2] if c in bounds else (None, None)
            out = wide.get((c, "outliers"), 0)
            row += [q1, q3, unique, None, None, None, out, 100.0 * out / n]
        else:
            row += [None] * 6
            row += [unique, mode, freq, None if freq is None else 100.0 * freq / n, 0, 0.0]
        rows.append(tuple(row))
    return local_table(df.sparkSession, rows, COLUMN_PROFILE)


def row_digest(df: DataFrame) -> list:
    """Two 64-bit hashes of a whole row. NULL flags take part, since a hash passes over NULLs."""
    cells = [*[col(c) for c in df.columns], *[col(c).isNull() for c in df.columns]]
    return [F.xxhash64(*cells).alias("_h1"), F.xxhash64(F.lit("second"), *cells).alias("_h2")]


def duplicate_rows(df: DataFrame, digest: bool = False) -> DataFrame:
    """One row: rows, distinct rows (NULLs equal), duplicates. Copies collapse before the shuffle.

    ``digest`` compares 128-bit digests instead of rows: 16 bytes per row are shuffled however wide the
    table is, and two different rows count as one with a chance of about n * n / 2**129.
    """
    df = normalize(df)
    groups = df.select(*row_digest(df)).groupBy("_h1", "_h2") if digest else df.groupBy(*[col(c) for c in df.columns])
    return groups.agg(F.count("*").alias("_copies")).agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("n_rows"), F.count("*").alias("distinct_rows"),
    ).withColumn("duplicate_rows", F.col("n_rows") - F.col("distinct_rows"))


def correlation_dict(df: DataFrame, cols=None, known: tuple = None) -> dict:
    """``{(x, y): r}`` for the upper triangle and the diagonal; 0 where r is undefined."""
    names = numeric_names(df) if cols is None else list(cols)
    pairs = [(x, y) for i, x in enumerate(names) for y in names[i:]]
    if not pairs:
        return {}
    facts, means, seen = known or number_facts(df, names, {"*": F.count(F.lit(1))})
    full = {c for c in names if facts[c][0] == seen["*"]}
    flat = {c for c in names if facts[c][0] < 2 or facts[c][1] == facts[c][2]}

    def centred(c):
        return as_double(c) - F.lit(means[c])

    # Without NULLs a pair is one sum of products around the known means. With NULLs each pair has its own
    # rows, hence its own means, which the matrix pass finds in one scan for all pairs, as it does for many pairs.
    live = [(x, y) for x, y in pairs if x not in flat and y not in flat]
    if len(live) > MANY_PAIRS or any(x not in full for x, _ in live):
        found = gram_correlation(df, [c for c in names if c not in flat], means)
        return {p: found.get(p, 0.0) for p in pairs}
    sums = agg_row(df, {(x, y): F.sum(centred(x) * centred(y)) for x, y in live}) if live else {}
    return {(x, y): pearson(sums[x, y], sums[x, x], sums[y, y]) if (x, y) in sums else 0.0 for x, y in pairs}


def pearson(xy, xx, yy) -> float:
    """r from sums of squares and products; 0 without variance."""
    spread = math.sqrt(xx) * math.sqrt(yy) if xx and yy and xx > 0 and yy > 0 else 0.0
    return max(-1.0, min(1.0, xy / spread)) if spread > 0 else 0.0


MANY_PAIRS = 300  # from about 24 columns on, one scan with matrix products beats many scans of sums
FLAT_SHARE = 1e-13  # below this share of its sum of squares a variance is rounding


def gram_correlation(df: DataFrame, names: list, means: dict) -> dict:
    """Upper triangle of the pairwise-complete matrix in one scan.

    Each task multiplies its Arrow batches with themselves and emits one row per pair of columns, so
    what is shuffled and collected depends on the width of the table only.
    """
    centre = np.array([means[c] for c in names])

    def products(batches):
        total = 0.0
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            here = (~np.isnan(x)).astype(float)
            z = np.where(here > 0, x - centre, 0.0)
            total = total + np.stack([here.T @ here, z.T @ here, (z * z).T @ here, z.T @ z])
        if isinstance(total, np.ndarray):
            i, j = np.triu_indices(len(centre))
            n, one, two, both = total
            yield pa.RecordBatch.from_arrays(
                [pa.array(v) for v in (i, j, n[i, j], one[i, j], one[j, i], two[i, j], two[j, i], both[i, j])],
                names=["i", "j", "n", "x", "y", "xx", "yy", "xy"])

    parts = df.select(*[as_double(c).alias(f"c{k}") for k, c in enumerate(names)]).mapInArrow(
        products, "i bigint, j bigint, n double, x double, y double, xx double, yy double, xy double")
    sums = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")]).collect()
    out = {}
    for s in sums:
        if s.n > 1:
            xx, yy = s.xx - s.x * s.x / s.n, s.yy - s.y * s.y / s.n
            xx, yy = (0.0 if v <= FLAT_SHARE * whole else v for v, whole in ((xx, s.xx), (yy, s.yy)))
            out[names[s.i], names[s.j]] = pearson(s.xy - s.x * s.y / s.n, xx, yy)
    return out


def cross_correlation(rows: DataFrame, left: list, right: list, means: dict) -> dict:
    """``{(x, y): r}`` of every column of ``left`` with every one of ``right`` over the rows where both have a value.

    One scan: each task multiplies the two halves of its Arrow batches and emits one row per pair. ``means`` of the columns, or anything near
    them, keep the sums small. Pairs without variance are left out.
    """
    centre = np.array([means[c] or 0.0 for c in (*left, *right)])
    width = len(left)

    def products(batches):
        total = 0.0
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            here = (~np.isnan(x)).astype(float)
            z = np.where(here > 0, x - centre, 0.0)
            (a, b), (ha, hb) = ((v[:, :width], v[:, width:]) for v in (z, here))
            total = total + np.stack([ha.T @ hb, a.T @ hb, ha.T @ b, (a * a).T @ hb, ha.T @ (b * b), a.T @ b])
        if isinstance(total, np.ndarray):
            i, j = (v.ravel() for v in np.indices(total.shape[1:]))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (i, j, *(t.ravel() for t in total))], names=["i", "j", "n", "x", "y", "xx", "yy", "xy"])

    parts = rows.select(*[as_double(c).alias(f"c{k}") for k, c in enumerate((*left, *right))]).mapInArrow(
        products, "i bigint, j bigint, n double, x double, y double, xx double, yy double, xy double")
    out = {}
    for s in parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")]).collect():  # one row per pair
        if s.n > 1:
            xx, yy = s.xx - s.x * s.x / s.n, s.yy - s.y * s.y / s.n
            if xx > FLAT_SHARE * s.xx and yy > FLAT_SHARE * s.yy:
                out[left[s.i], right[s.j]] = pearson(s.xy - s.x * s.y / s.n, xx, yy)
    return out


def correlation(df: DataFrame, known: tuple = None) -> DataFrame:
    """Pearson matrix of the numeric columns as rows (col_x, col_y, r); empty below two such columns.

    Each pair uses the rows where both values are present. Scans only; rows are never shuffled.
    """
    df = normalize(df)
    names = numeric_names(df)
    rows = []
    if len(names) > 1:
        upper = correlation_dict(df, names, known)
        rows = [(x, y, upper.get((x, y), upper.get((y, x)))) for x in names for y in names]
    return local_table(df.sparkSession, rows, "col_x string, col_y string, r double")


def null_heatmap(df: DataFrame, order_by, bins: int = 40) -> DataFrame:
    """NULL percentage per (row bin, column), rows taken in ``order_by`` order.

    Only NULL flags and the sort keys are sorted; the wide values never move.
    """
    df = normalize(df)
    flags = [f"f{i}" for i in range(len(df.columns))]
    keys = [f"k{i}" for i in range(len(order_by))]
    slim = df.select(*[col(c).isNull().cast("int").alias(f) for c, f in zip(df.columns, flags)],
                     *[col(k).alias(a) for k, a in zip(order_by, keys)], tie_digest(df).alias("tie"))
    placed, n = indexed(slim, [*keys, "tie"], keep=flags)
    require_rows(df, n)
    used = min(bins, n)
    size = n // used
    binned = placed.withColumn("bin", F.least(F.floor(F.col("_idx") / size), F.lit(used - 1)).cast("int"))
    wide = binned.groupBy("bin").agg(F.count("*").alias("n"), *[F.sum(f).alias(f) for f in flags])
    first = F.col("bin") * size
    last = F.when(F.col("bin") == used - 1, F.lit(n - 1)).otherwise(first + size - 1)
    cells = [x for c, f in zip(df.columns, flags) for x in (F.lit(c), F.col(f))]
    return wide.select(
        "bin", F.format_string("Rows %d-%d", first, last).alias("label"), "n",
        F.stack(F.lit(len(flags)), *cells).alias("column", "nulls"),
    ).select("bin", "label", "column", percent(F.col("nulls"), F.col("n")).alias("null_percent"))


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Rows (value, n, percent) of ``target``; NULL is a class of its own."""
    counts = normalize(df.select(col(target))).groupBy(col(target).cast("string").alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))  # one row; the counts behind it are those of the left side, shuffled once
    return counts.join(F.broadcast(total)).select("value", "n", percent(F.col("n"), F.col("_all")).alias("percent"))


def describe(df: DataFrame) -> DataFrame:
    """One row per numeric column: count, mean, std, min, quartiles, max."""
    df = normalize(df)
    names = numeric_names(df)
    if not names:
        return local_table(df.sparkSession, [], DESCRIBE)
    facts, means, _ = number_facts(df, names)
    quartiles = exact_quantiles(df, names, [0.25, 0.5, 0.75], facts)
    squares = agg_row(df, {c: deviation(c, means[c]) for c in names if facts[c][0] > 0})
    rows = [
        (c, facts[c][0], means[c], sample_std(facts[c], squares.get(c)), facts[c][1], *quartiles[c], facts[c][2])
        for c in names
    ]
    return local_table(df.sparkSession, rows, DESCRIBE)


DESCRIBE = ("column string, count bigint, mean double, std double, min double, "
            "q25 double, q50 double, q75 double, max double")


def missing_summary(columns: DataFrame) -> DataFrame:
    """From a column profile: missing cells, columns with any, numeric columns."""
    return columns.agg(
        F.sum("null_count").alias("missing_cells"),
        F.count_if(F.col("null_count") > 0).alias("columns_with_missing"),
        F.count_if(F.col("type") == "Numeric").alias("numeric_columns"),
    )


def missing_status(columns: DataFrame) -> DataFrame:
    """From a column profile: High / Some / Clean per named column, judged on the 1-digit percentage."""
    share = F.round("null_percent", 1)
    return columns.where(~F.lower("column").contains("unnamed")).select(
        "column", "null_count", share.alias("percent"),
        F.when(share > 50, "High Missing").when(share > 20, "Some Missing").otherwise("Clean").alias("status"),
        (F.col("null_count") > 0.2 * F.col("n_rows")).alias("flagged"),
    )


def histogram(df: DataFrame, column: str, closed_last: bool = True) -> DataFrame:
    """Rows (bin, low, high, n) of ``column`` in at most eight equal bins ``[low, high)``; the last holds the maximum too.

    The bin count is sqrt(n) up to 8 and may be fractional; then the last bin reaches past the maximum. For parity,
    ``closed_last=False`` leaves the maximum out when the count is whole.
    """
    df = normalize(df.select(col(column)))
    x = as_double(column)
    seen = agg_row(df, {"n": F.count(x), "low": F.min(x), "high": F.max(x)})
    schema = "bin int, low double, high double, n bigint"
    if seen["n"] < 2:
        return local_table(df.sparkSession, [], schema)
    width = min(8.0, math.sqrt(seen["n"]))
    size = (seen["high"] - seen["low"]) / width or 1.0
    lows = [seen["low"] + i * size for i in range(math.ceil(width))]
    highs = [low + size for low in lows]
    tests = {}
    for i, (low, high) in enumerate(zip(lows, highs)):
        inside = (x >= low) & (x < high)
        if closed_last and i == len(lows) - 1:
            inside = (x >= low) & (x <= max(high, seen["high"]))
        tests[i] = F.count_if(inside)
    found = agg_row(df, tests)
    return local_table(df.sparkSession, [(i, lows[i], highs[i], found[i]) for i in range(len(lows))], schema)


def inspect(df: DataFrame) -> DataFrame:
    """One row: shape, names, types, empty columns, rows without any value."""
    df = normalize(df)
    any_value = F.coalesce(*[F.when(col(c).isNotNull(), F.lit(1)) for c in df.columns])
    seen = agg_row(df, {"*": F.count(F.lit(1)), "some": F.count(any_value),
                        **{(c,): F.count(col(c)) for c in df.columns}})
    row = (seen["*"], len(df.columns), df.columns, [t for _, t in df.dtypes],
           [c for c in df.columns if seen[c,] == 0], seen["*"] - seen["some"])
    return local_table(df.sparkSession, [row],
                       "n_rows bigint, n_cols int, columns array<string>, types array<string>, "
                       "empty_columns array<string>, empty_rows bigint")

