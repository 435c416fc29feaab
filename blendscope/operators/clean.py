"""Dropping useless columns and rows, filling missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_double, col, is_numeric, is_string
from ..session import agg_row, local_table
from ..sources.io import normalize
from .profile import distinct_and_mode
from .rowindex import exact_quantiles

UNKNOWN = "Unknown"  # fixed value: filler for text without a mode


def _filled(df: DataFrame) -> dict:
    return agg_row(df, {"*": F.count(F.lit(1)), **{(c,): F.count(col(c)) for c in df.columns}})


def _keep(df: DataFrame, names: list) -> DataFrame:
    return df.select(*[col(c) for c in names])


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns without any value."""
    df = normalize(df)
    seen = _filled(df)
    return _keep(df, [c for c in df.columns if seen[c,] > 0])


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Drop rows without any value."""
    return normalize(df).na.drop(how="all")


def _constants(df: DataFrame) -> set:
    seen = agg_row(df, {(c, f): getattr(F, f)(col(c)) for c in df.columns for f in ("min", "max", "count")})
    return {c for c in df.columns if seen[c, "count"] > 0 and seen[c, "min"] == seen[c, "max"]}


def drop_constant_columns(df: DataFrame) -> DataFrame:
    """Drop columns with a single distinct value, unless the table has only one column."""
    df = normalize(df)
    if len(df.columns) < 2:
        return df
    flat = _constants(df)
    return _keep(df, [c for c in df.columns if c not in flat])


def drop_sparse_columns(df: DataFrame, limit: float = 0.5) -> DataFrame:
    """Drop columns whose share of NULLs exceeds ``limit``."""
    df = normalize(df)
    seen = _filled(df)
    n = seen["*"]
    return _keep(df, [c for c in df.columns if n == 0 or (n - seen[c,]) / n <= limit])


def clean_dataset(df: DataFrame) -> tuple:
    """Drop empty columns, empty rows, then constant columns: (cleaned table, one row of counts).

    One scan settles all three: leaving out rows without values changes no column's minimum or maximum.
    """
    df = normalize(df)
    some = F.coalesce(*[F.when(col(c).isNotNull(), F.lit(1)) for c in df.columns])
    seen = agg_row(df, {
        "*": F.count(F.lit(1)), "some": F.count(some),
        **{(c, f): getattr(F, f)(col(c)) for c in df.columns for f in ("min", "max", "count")},
    })
    keep = [c for c in df.columns if seen[c, "count"] > 0]
    if not keep:
        raise ValueError("no valid columns found in this dataset")
    if len(keep) > 1:
        keep = [c for c in keep if seen[c, "min"] != seen[c, "max"]]
    if not keep or seen["some"] == 0:
        raise ValueError("the dataset has no valid columns after cleaning")
    width = len(df.columns)
    counts = local_table(df.sparkSession, [(
        seen["*"], width, seen["some"], len(keep), seen["*"] - seen["some"], width - len(keep),
    )], "original_rows bigint, original_columns int, n_rows bigint, n_columns int, "
        "rows_removed bigint, columns_removed int")
    return _keep(df.where(some.isNotNull()), keep), counts


def fill_values(df: DataFrame, numeric: str = "mean", categorical: str = "mode") -> dict:
    """``{column: filler}`` for the columns of ``df`` with NULLs; None where a column has no mean or median."""
    types = {f.name: f.dataType for f in df.schema.fields}
    nums = [c for c in df.columns if is_numeric(types[c])]
    seen = agg_row(df, {"*": F.count(F.lit(1)), **{(c, "n"): F.count(col(c)) for c in df.columns},
                        **({(c, "mean"): F.avg(as_double(c)) for c in nums} if numeric == "mean" else {})})
    gaps = [c for c in df.columns if seen[c, "n"] < seen["*"]]
    num_gaps, other_gaps = [c for c in gaps if c in nums], [c for c in gaps if c not in nums]
    if numeric == "mean":
        out = {c: seen[c, "mean"] for c in num_gaps}
    elif numeric == "median":
        out = {c: v[0] for c, v in exact_quantiles(df, num_gaps, [0.5]).items()} if num_gaps else {}
    else:
        out = {c: 0.0 for c in num_gaps}
    modes = {}
    if categorical == "mode" and other_gaps:
        modes = {r["ordinal"]: r["mode"] for r in distinct_and_mode(df, other_gaps).collect()}  # one per column
    out.update({c: modes.get(i, UNKNOWN) for i, c in enumerate(other_gaps)})
    return out


def impute(df: DataFrame, numeric: str = "mean", categorical: str = "mode") -> DataFrame:
    """Fill NULLs: numbers by ``mean``, ``median`` or else 0, the rest by ``mode`` or else ``Unknown``.

    The smallest of equally frequent values is the mode. Whole numbers with gaps become double.
    """
    df = normalize(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    fill = fill_values(df, numeric, categorical)
    out = []
    for c in df.columns:
        if c not in fill:
            out.append(col(c))
        elif is_numeric(types[c]):
            out.append(F.coalesce(as_double(c), F.lit(fill[c]).cast("double")).alias(c))
        elif is_string(types[c]) or fill[c] == UNKNOWN:
            out.append(F.coalesce(col(c).cast("string"), F.lit(fill[c])).alias(c))
        else:
            out.append(F.coalesce(col(c), F.lit(fill[c]).cast(types[c])).alias(c))
    return df.select(*out)


def target_rows(df: DataFrame, target: str) -> DataFrame:
    """Rows with a value in ``target``."""
    return normalize(df).na.drop(subset=[target])


__all__ = ["clean_dataset", "drop_constant_columns", "drop_empty_columns", "drop_empty_rows",
           "drop_sparse_columns", "fill_values", "impute", "target_rows"]
