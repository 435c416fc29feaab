"""Columns whose cells differ in type, as VARIANT: kinds of values, merged types, and consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import VARIANT, col, string_names
from ..functions.values import percent
from ..session import agg_row, local_table

# What the type name of a cell begins with, and the kind it stands for.
KIND_OF = {
    "TINYINT": "integer", "SMALLINT": "integer", "INT": "integer", "BIGINT": "integer", "DECIMAL": "number", "DOUBLE": "number",
    "FLOAT": "number", "STRING": "text", "BOOLEAN": "boolean", "OBJECT": "object", "ARRAY": "array", "DATE": "date",
    "TIMESTAMP": "timestamp", "TIMESTAMP_NTZ": "timestamp", "BINARY": "binary",
}


def variant_names(df: DataFrame) -> list:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, VARIANT)]


def to_variant(df: DataFrame, columns=None) -> DataFrame:
    """Columns as VARIANT: text that is JSON becomes its value, other text stays text, other types are kept. NULL stays NULL.

    A JSON document with a repeated key, or nested too deeply, is not readable JSON and stays text, so no cell is lost.
    """
    names = string_names(df) if columns is None else list(columns)
    texts = set(string_names(df))
    out = {}
    for c in names:
        out[c] = F.coalesce(F.try_parse_json(col(c)), col(c).cast(T.VariantType())) if c in texts else col(c).cast(T.VariantType())
    return df.withColumns(out)


def cell_type(value: Column) -> Column:
    """SQL type of one cell, such as ``BIGINT`` or ``OBJECT<a: STRING>``; NULL for NULL and JSON null."""
    name = F.schema_of_variant(value)
    return F.when(name != "VOID", name)


def cell_kind(value: Column) -> Column:
    """integer, number, text, boolean, object, array, date, timestamp or binary; NULL for NULL and JSON null.

    A number without decimals is an integer however long it is.
    """
    name = cell_type(value)
    kinds = F.create_map(*[F.lit(x) for pair in KIND_OF.items() for x in pair])
    return F.when(name.rlike(r"^DECIMAL\([0-9]+,0\)$"), F.lit("integer")).otherwise(kinds[F.regexp_extract(name, "^[A-Z_]+", 0)])


def value_kinds(df: DataFrame, columns=None) -> DataFrame:
    """Rows (column, kind, n, percent of the values) of VARIANT columns. One scan; one row per column and kind is shuffled."""
    names = variant_names(df) if columns is None else list(columns)
    if not names:
        return local_table(df.sparkSession, [], "column string, kind string, n bigint, percent double")
    cells = [x for c in names for x in (F.lit(c), cell_kind(col(c)))]
    counts = df.select(F.stack(F.lit(len(names)), *cells).alias("column", "kind")).where("kind is not null").groupBy("column", "kind").agg(
        F.count("*").alias("n"))
    totals = counts.groupBy("column").agg(F.sum("n").alias("_all"))
    return counts.join(F.broadcast(totals), "column").select("column", "kind", "n", percent(F.col("n"), F.col("_all")).alias("percent"))


def merged_types(df: DataFrame, columns=None) -> DataFrame:
    """Rows (column, type): the narrowest SQL type that holds every cell, ``VARIANT`` where there is none. One scan."""
    names = variant_names(df) if columns is None else list(columns)
    seen = agg_row(df, {c: F.schema_of_variant_agg(col(c)) for c in names}) if names else {}
    return local_table(df.sparkSession, [(c, seen[c]) for c in names], "column string, type string")


def mixed_variants(df: DataFrame) -> list:
    """VARIANT columns that hold values of more than one kind, in one scan."""
    found = value_kinds(df).groupBy("column").agg(F.count("*").alias("kinds")).where("kinds > 1").collect()  # one row per column
    mixed = {r["column"] for r in found}
    return [c for c in variant_names(df) if c in mixed]

