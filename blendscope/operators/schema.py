"""Operators over column names and types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, dtype_of, is_numeric, is_string, numeric_names
from ..functions.names import clean_name, unique_names
from ..session import local_table


def clean_names(df: DataFrame) -> DataFrame:
    """Rename all columns to their cleaned form; collisions are numbered."""
    return df.toDF(*unique_names([clean_name(c) for c in df.columns]))


def numeric_cols(df: DataFrame) -> list:
    return numeric_names(df)


def column_table(tables: dict) -> DataFrame:
    """One row per column of each named table: dataset, ordinal, name, kind, type."""
    spark = next(iter(tables.values())).sparkSession
    rows = [
        (name, i, f.name, "numeric" if is_numeric(f.dataType) else "other", f.dataType.simpleString())
        for name, df in tables.items() for i, f in enumerate(df.schema.fields)
    ]
    return local_table(spark, rows, "dataset string, ordinal int, name string, kind string, type string")


def common_columns(a: DataFrame, b: DataFrame) -> list:
    """Names in both, in A's order."""
    right = set(b.columns)
    return [c for c in a.columns if c in right]


def only_in_first(a: DataFrame, b: DataFrame) -> list:
    right = set(b.columns)
    return [c for c in a.columns if c not in right]


def column_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: common names, names of one side only, all names sorted."""
    row = (common_columns(a, b), only_in_first(a, b), only_in_first(b, a), sorted(set(a.columns) | set(b.columns)))
    return local_table(
        a.sparkSession, [row],
        "common array<string>, only_a array<string>, only_b array<string>, all_columns array<string>",
    )


def column_presence(tables: dict) -> DataFrame:
    """One row per column name over all named tables: where it occurs and how many values it has there."""
    counted = None
    for name, df in tables.items():
        one = df.agg(*[F.count(col(c)).alias(c) for c in df.columns]).select(
            F.lit(name).alias("dataset"),
            F.explode(F.map_from_arrays(
                F.array(*[F.lit(c) for c in df.columns]), F.array(*[col(c) for c in df.columns])
            )).alias("column", "values"),
        )
        counted = one if counted is None else counted.unionByName(one)
    return counted.groupBy("column").agg(
        F.array_sort(F.collect_list("dataset")).alias("datasets"),
        F.count("*").alias("n_datasets"),
        F.sum("values").alias("n_values"),
    )


def separate_cases(*tables: DataFrame) -> list:
    """The tables with names that differ in case only numbered (``id``, ``Id_2``); the first spelling keeps its name.

    Spark resolves names without regard to case and would take such columns for one.
    """
    spelled, renamed = {}, {}
    for df in tables:
        for c in df.columns:
            spelled.setdefault(c.lower(), c)
    for df in tables:
        for c in df.columns:
            if spelled[c.lower()] != c and c not in renamed:
                n = 2
                while f"{c}_{n}".lower() in spelled:
                    n += 1
                renamed[c] = spelled[f"{c}_{n}".lower()] = f"{c}_{n}"
    return [df.toDF(*[renamed.get(c, c) for c in df.columns]) if renamed else df for df in tables]


def align(a: DataFrame, b: DataFrame) -> tuple:
    """Both tables with the same columns, sorted by name; absent ones are NULL."""
    a, b = separate_cases(a, b)
    names = sorted(set(a.columns) | set(b.columns))

    def widen(df, other):
        have = set(df.columns)
        return df.select(*[
            col(c) if c in have else F.lit(None).cast(dtype_of(other, c)).alias(c) for c in names
        ])

    return widen(a, b), widen(b, a)


def suffix_clashes(a: DataFrame, b: DataFrame, keep=(), suffix: str = "_b") -> DataFrame:
    """Rename B's columns that also occur in A, except ``keep``; a further clash is numbered."""
    taken = set(a.columns) | (set(b.columns) - set(a.columns))
    out = []
    for c in b.columns:
        if c in a.columns and c not in keep:
            new, n = c + suffix, 2
            while new in taken:
                new, n = f"{c}{suffix}{n}", n + 1
            taken.add(new)
            c = new
        out.append(c)
    return b.toDF(*out)


def drop_duplicate_names(df: DataFrame) -> DataFrame:
    """Keep the first column of every repeated name."""
    seen, keep = set(), []
    for i, c in enumerate(df.columns):
        if c not in seen:
            seen.add(c)
            keep.append((i, c))
    by_position = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return by_position.select(*[F.col(f"c{i}").alias(c) for i, c in keep])


def with_source(df: DataFrame, name: str, column: str = "_source_dataset") -> DataFrame:
    return df.withColumn(column, F.lit(name))


def same_kind(a: DataFrame, b: DataFrame, name: str) -> bool:
    """Both numeric or both not."""
    return is_numeric(dtype_of(a, name)) == is_numeric(dtype_of(b, name))


def to_common_types(a: DataFrame, b: DataFrame) -> tuple:
    """Cast common columns whose types cannot be unioned to text on both sides."""
    a, b = separate_cases(a, b)
    clash = []
    for c in common_columns(a, b):
        ta, tb = dtype_of(a, c), dtype_of(b, c)
        if ta != tb and not (is_numeric(ta) and is_numeric(tb)) and not (is_string(ta) and is_string(tb)):
            clash.append(c)

    def text(df):
        return df.select(*[col(c).cast("string").alias(c) if c in clash else col(c) for c in df.columns])

    return (text(a), text(b)) if clash else (a, b)
