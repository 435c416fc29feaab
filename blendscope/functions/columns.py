"""Column references and type tests shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)
NESTED = (T.ArrayType, T.MapType, T.StructType)
VARIANT = (T.VariantType,)


def col(name: str) -> Column:
    """Reference a column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, INTEGRAL + FRACTIONAL)


def is_string(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def numeric_names(df: DataFrame) -> list:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def string_names(df: DataFrame) -> list:
    return [f.name for f in df.schema.fields if is_string(f.dataType)]


def as_double(name: str) -> Column:
    return col(name).cast("double")
