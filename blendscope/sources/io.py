"""Reading, previewing, sizing and writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import NESTED, VARIANT, col, is_string
from ..functions.values import NUMBER_PATTERN, size_text
from ..session import agg_row, local_table

# Text that means "no value" in a delimited file.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

INTEGER_PATTERN = r"^[+-]?[0-9]+$"
INFINITE_PATTERN = r"(?i)^[+-]?inf(inity)?$"
EXACT_DIGITS = r"^[+-]?0*[0-9]{1,15}$"  # integers that a double holds exactly


def read_csv(spark: SparkSession, path, schema=None, na_tokens=None, multi_line: bool = False, strict: bool = False) -> DataFrame:
    """Read delimited text with a header; every NA token becomes NULL and types follow the values.

    Give ``schema`` on large data: it saves the inference pass. ``multi_line`` allows line breaks inside quotes, at the
    price that a file is no longer split. A cell that does not fit its type in ``schema`` is read as NULL; with ``strict`` it
    fails the read.
    """
    tokens = NA_TOKENS if na_tokens is None else list(na_tokens)
    raw = spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"', multiLine=multi_line)
    text = raw.select(*[
        F.when(~col(c).isin(tokens), col(c)).alias(c) for c in raw.columns
    ])
    if schema is not None:
        want = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

        def typed(f):
            cell = F.trim(col(f.name))
            return (cell.cast(f.dataType) if strict else cell.try_cast(f.dataType)).alias(f.name)

        return text.select(*[col(f.name) if is_string(f.dataType) else typed(f) for f in want.fields])
    return infer_types(text)


def infer_types(text: DataFrame) -> DataFrame:
    """Give each text column the narrowest of bigint, double, boolean, string that loses nothing.

    A column with an integer beyond bigint, or with longer integers than a double holds among fractions, stays text.
    """
    tests = {}
    for c in text.columns:
        v = F.trim(col(c))
        tests[c, "n"] = F.count(col(c))
        whole = v.rlike(INTEGER_PATTERN)
        tests[c, "bigint"] = F.count_if(whole & v.try_cast("bigint").isNotNull())
        tests[c, "double"] = F.count_if((v.rlike(NUMBER_PATTERN) | v.rlike(INFINITE_PATTERN)) & (~whole | v.rlike(EXACT_DIGITS)))
        tests[c, "boolean"] = F.count_if(F.lower(v).isin("true", "false"))
    found = agg_row(text, tests)
    out = []
    for c in text.columns:
        n = found[c, "n"]
        fits = [k for k in ("bigint", "double", "boolean") if n > 0 and found[c, k] == n]
        # A column without any value is numeric, as a reader of untyped text would make it.
        kind = fits[0] if fits else ("double" if n == 0 else None)
        out.append((F.trim(col(c)).cast(kind) if kind else col(c)).alias(c))
    return text.select(*out)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Float NaN and NULL mean the same from here on; columns of no type become text, VARIANT its JSON (JSON null is NULL)."""
    out = []
    for f in df.schema.fields:
        c = col(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.nanvl(c, F.lit(None).cast(f.dataType)).alias(f.name)
        elif isinstance(f.dataType, T.NullType):
            c = c.cast("string").alias(f.name)
        elif isinstance(f.dataType, VARIANT):
            c = F.when(~F.is_variant_null(c), F.to_json(c)).alias(f.name)
        out.append(c)
    return df.select(*out)


def normalize(df: DataFrame, nested_to_json: bool = False) -> DataFrame:
    """Entry check of every data operator: flat columns only, NaN as NULL."""
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, NESTED)]
    if nested and not nested_to_json:
        raise ValueError(f"nested columns are not supported: {', '.join(nested)}")
    if nested:
        df = df.select(*[F.to_json(col(c)).alias(c) if c in nested else col(c) for c in df.columns])
    return nan_to_null(df)


def preview(df: DataFrame, n: int = 5, order_by=None, as_text: bool = True) -> DataFrame:
    """First ``n`` rows; with ``as_text`` every cell is text and NULL is an empty cell."""
    head = nan_to_null(df)
    head = (head.orderBy(*order_by) if order_by else head).limit(n)
    if not as_text:
        return head
    return head.select(*[F.coalesce(col(c).cast("string"), F.lit("")).alias(c) for c in head.columns])


def source_files(df: DataFrame) -> DataFrame:
    """One row per file behind ``df``: path, size, modification time. Files are listed; no row is read."""
    files = df.inputFiles()
    if not files:
        return local_table(df.sparkSession, [], "path string, size_bytes bigint, modified timestamp")
    return list_files(df.sparkSession, files)


def list_files(spark: SparkSession, paths) -> DataFrame:
    """One row per file at or below ``paths``: path, size, modification time. Hidden files are left out, nothing is read."""
    return spark.read.format("binaryFile").load(paths).select(
        "path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def source_size(df: DataFrame) -> DataFrame:
    """Total bytes of the files behind ``df`` and the same as text."""
    total = source_files(df).agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size_bytes"))
    return total.withColumn("size_text", size_text(F.col("size_bytes")))


def export(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite", unix_millis: bool = False) -> str:
    """Write ``df`` as a folder of part files: ``csv`` with a header or ``json`` lines with NULLs kept."""
    if fmt == "csv":
        df.write.mode(mode).csv(path, header=True, quote='"', escape='"')
    elif fmt == "json":
        if unix_millis:
            df = df.select(*[
                F.unix_millis(col(f.name).cast("timestamp")).alias(f.name)
                if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) else col(f.name)
                for f in df.schema.fields
            ])
        df.write.mode(mode).json(path, ignoreNullFields=False)
    elif fmt == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"unknown export format: {fmt}")
    return path
