"""Sets of values too large to compare exactly: theta sketches that merge, with a stated error. Exact counts stay the default elsewhere.

A state is one row per column and family (``whole``, ``real``, ``text``, as in ``compat.value_index``) of at most 8 * 2^lg bytes,
whatever the table holds. States of files, days or partitions may be written, kept and merged later without reading the rows again.

With K = 2^lg, a count up to K is exact. Beyond, its relative standard error is 1 / sqrt(K). A share common to two tables of n and m
distinct values is seen through a sample of theta = min(1, K / max(n, m)) of all values; its bounds are those of a count in that sample.
Bounds span ``z`` standard errors. NULLs count nowhere, an empty text is a value; an empty table or a column of NULLs has the estimate 0.
A number never equals a text; whole numbers meet fractions as doubles. Estimates beyond K may depend, within the bounds, on how rows are
dealt to tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import INTEGRAL, as_double, col, dtype_of, is_numeric
from ..session import local_table, materialize
from ..sources.io import normalize

LG_ENTRIES = 14  # 16,384 values a sketch: 0.8 % standard error, 128 kB
Z = 3.0  # standard errors that bounds span to either side
GROUPS = 64  # sketches of a column that are merged apart before the last task merges these
STATE = "column string, family string, kind string, lg int, sketch binary"


def _cells(df: DataFrame, name: str) -> list:
    """(family, kind of the column, value as sketched)."""
    kind = dtype_of(df, name)
    if isinstance(kind, INTEGRAL):
        return [("whole", "whole", col(name).cast("bigint")), ("real", "whole", as_double(name))]
    if is_numeric(kind):
        return [("real", "real", as_double(name))]
    return [("text", "text", F.concat(F.lit("="), col(name).cast("string")))]  # a sketch passes over an empty text


def states(df: DataFrame, columns=None, lg: int = LG_ENTRIES) -> DataFrame:
    """Rows (column, family, kind, lg, sketch) of ``columns`` (all): one scan; only sketches move, merged in two steps."""
    df = normalize(df)
    names = df.columns if columns is None else list(columns)
    cells = [(c, *x) for c in names for x in _cells(df, c)]
    if not cells:
        return local_table(df.sparkSession, [], STATE)
    parts = df.groupBy(F.pmod(F.spark_partition_id(), F.lit(GROUPS)).alias("_group")).agg(*[
        F.theta_sketch_agg(value, lg).alias(f"s{i}") for i, (_, _, _, value) in enumerate(cells)])
    whole = parts.agg(*[F.theta_union_agg(f"s{i}", lg).alias(f"s{i}") for i in range(len(cells))])
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(family).alias("family"), F.lit(kind).alias("kind"), F.lit(lg).alias("lg"),
                 F.col(f"s{i}").alias("sketch")) for i, (c, family, kind, _) in enumerate(cells)])
    return whole.select(F.inline(rows)).where("sketch is not null")


def merge(parts: DataFrame, lg: int = LG_ENTRIES) -> DataFrame:
    """States of the union of the tables whose states ``parts`` holds, by column; their accuracy is that of the coarsest part.

    Where a column is whole in one part and a fraction in another, all of it counts as fractions.
    """
    merged = parts.groupBy("column", "family").agg(
        F.max(F.col("kind") == "real").alias("_real"), F.min("kind").alias("kind"), F.least(F.min("lg"), F.lit(lg)).alias("lg"),
        F.theta_union_agg("sketch", lg).alias("sketch"))
    mixed = merged.withColumn("_real", F.max("_real").over(Window.partitionBy("column")))
    return mixed.where("not (_real and family = 'whole')").select(
        "column", "family", F.when(F.col("_real") & (F.col("family") == "real"), "real").otherwise(F.col("kind")).alias("kind"),
        "lg", "sketch")


def _count_bounds(n: Column, lg: Column, z: float) -> tuple:
    """(low, high) of a distinct count with the estimate ``n``."""
    step = F.lit(z) / F.sqrt(F.pow(F.lit(2.0), lg) - 2.0)
    exact = n <= F.pow(F.lit(2.0), lg)
    low = F.greatest(F.floor(n / (1.0 + step)), F.pow(F.lit(2.0), lg).cast("bigint"))  # beyond K there are more than K values
    return F.when(exact, n).otherwise(low), F.when(exact, n).otherwise(F.ceil(n / F.greatest(1.0 - step, F.lit(0.01))))


def distinct(found: DataFrame, z: float = Z) -> DataFrame:
    """Rows (column, family, n, low, high) from states: distinct values and their bounds, in the finest family of each column."""
    n = F.theta_sketch_estimate("sketch").alias("n")
    rows = found.where("family != 'real' or kind = 'real'").select("column", "family", "lg", n)
    low, high = _count_bounds(F.col("n"), F.col("lg"), z)
    return rows.select("column", "family", "n", low.cast("bigint").alias("low"), high.cast("bigint").alias("high"))


def _overlap(pairs: DataFrame, by: list, z: float) -> DataFrame:
    """From rows with the sketches ``a`` and ``b``: sizes, common values with bounds, and their share of all values."""
    sized = pairs.select(
        *by, "column", "family", "lg", F.theta_sketch_estimate("a").alias("n_a"), F.theta_sketch_estimate("b").alias("n_b"),
        F.theta_sketch_estimate(F.theta_intersection("a", "b")).alias("n_both"))
    entries, larger = F.pow(F.lit(2.0), F.col("lg")), F.greatest("n_a", "n_b").cast("double")
    theta = F.least(F.lit(1.0), entries / F.greatest(larger, F.lit(1.0)))
    seen, half = F.col("n_both") * theta, F.lit(z * z / 2.0)
    width = F.lit(z) * F.sqrt(seen + F.lit(z * z / 4.0))
    most = F.least(_count_bounds(F.col("n_a"), F.col("lg"), z)[1], _count_bounds(F.col("n_b"), F.col("lg"), z)[1])
    exact = larger <= entries
    low = F.when(exact, F.col("n_both")).otherwise(F.greatest(F.floor((seen + half - width) / theta), F.lit(0)))
    high = F.when(exact, F.col("n_both")).otherwise(F.least(F.ceil((seen + half + width) / theta), most))
    either = F.greatest(F.col("n_a") + F.col("n_b") - F.col("n_both"), F.lit(0))
    return sized.select(
        *by, "column", "family", "n_a", "n_b", "n_both", low.cast("bigint").alias("low"), high.cast("bigint").alias("high"),
        F.coalesce(F.try_divide(F.col("n_both").cast("double"), either.cast("double")), F.lit(0.0)).alias("jaccard"))


def _pairs(a: DataFrame, b: DataFrame, by_a: list, by_b: list, extra: Column = None) -> DataFrame:
    """States of two sides side by side: the same column in the finest family that both have."""
    left = a.select(*by_a, "column", "family", F.col("kind").alias("_ka"), F.col("lg").alias("_la"), F.col("sketch").alias("a"))
    right = b.select(*by_b, "column", "family", F.col("kind").alias("_kb"), F.col("lg").alias("_lb"), F.col("sketch").alias("b"))
    met = left.join(right, ["column", "family"]).where("not (family = 'real' and _ka = 'whole' and _kb = 'whole')")
    return (met if extra is None else met.where(extra)).withColumn("lg", F.least("_la", "_lb"))


def overlap(a: DataFrame, b: DataFrame, z: float = Z) -> DataFrame:
    """Rows (column, family, n_a, n_b, n_both, low, high, jaccard) for the columns that two tables' states have in common.

    ``low`` and ``high`` bound ``n_both``. A column that is a number in one table and a text in the other has no row.
    """
    return _overlap(_pairs(a, b, [], []), [], z)


def catalog_overlap(tables: dict, columns: dict = None, lg: int = LG_ENTRIES, z: float = Z) -> DataFrame:
    """``overlap`` for all pairs of ``{name: table}``, as rows that begin with dataset_a and dataset_b in the given order.

    Each table is read once, its states are written; pairs are made of states alone.
    """
    place = {n: i for i, n in enumerate(tables)}
    every = materialize(reduce(DataFrame.unionByName, [
        states(df, (columns or {}).get(n), lg).withColumn("_t", F.lit(place[n])) for n, df in tables.items()]), "set-states")
    names = F.array(*[F.lit(n) for n in tables])
    pairs = _pairs(every.withColumnRenamed("_t", "_ta"), every.withColumnRenamed("_t", "_tb"), ["_ta"], ["_tb"], F.col("_ta") < F.col("_tb"))
    named = pairs.withColumns({"dataset_a": F.get(names, "_ta"), "dataset_b": F.get(names, "_tb")})
    return _overlap(named, ["dataset_a", "dataset_b"], z)
