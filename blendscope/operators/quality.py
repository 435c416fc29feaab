"""The two quality scores of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, numeric_names, string_names
from ..functions.values import clamp, number, percent, ratio
from ..session import agg_row, together
from ..sources.io import normalize
from .profile import column_profile, duplicate_rows
from .variant import mixed_variants, variant_names

# Share of each component in the quality score.
QUALITY_WEIGHTS = {
    "missing_values": 0.20,
    "duplicate_rows": 0.15,
    "data_completeness": 0.15,
    "feature_diversity": 0.15,
    "outlier_ratio": 0.15,
    "data_consistency": 0.10,
    "data_type_validity": 0.10,
}


def weighted(weights: dict = None, prefix: str = "") -> Column:
    """Weighted sum of the component columns."""
    weights = QUALITY_WEIGHTS if weights is None else weights
    if abs(sum(weights.values()) - 1.0) > 1e-9:
        raise ValueError("quality weights must add up to 1")
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + F.lit(float(w)) * F.col(prefix + name)
    return total


def mixed_columns(df: DataFrame) -> int:
    """Text columns holding both numbers and other text."""
    names = string_names(df)
    seen = agg_row(df, {
        key: value for c in names for key, value in (
            ((c, "all"), F.count(col(c))), ((c, "num"), F.count(number(col(c)))))
    }) if names else {}
    return sum(1 for c in names if 0 < seen[c, "num"] < seen[c, "all"])


def invalid_columns(df: DataFrame, expected_types: dict) -> int:
    """Columns with a value that the expected numeric type cannot hold."""
    seen = agg_row(df, {
        c: F.count_if(col(c).isNotNull() & col(c).try_cast(t).isNull()) for c, t in expected_types.items()
    }) if expected_types else {}
    return sum(1 for v in seen.values() if v > 0)


def components_of(columns: DataFrame, duplicates: int, mixed: int = 0, invalid: int = 0) -> DataFrame:
    """The seven 0-100 components from a column profile and the table-level counts."""
    width, rows = F.count("*"), F.max("n_rows")
    cells = width * rows

    def score(bad: Column, all_: Column) -> Column:
        return F.greatest(F.lit(0.0), 100.0 - percent(bad, all_))

    flat = F.count_if(F.col("unique_count") <= 1)
    id_like = F.count_if((F.col("type") == "Categorical") & (F.col("unique_count") == F.col("n_rows")))
    return columns.agg(
        score(F.sum("null_count"), cells).alias("missing_values"),
        score(F.lit(duplicates), rows).alias("duplicate_rows"),
        percent(F.count_if(F.col("null_count") == 0), width).alias("data_completeness"),
        score(flat + id_like, width).alias("feature_diversity"),
        score(F.sum("outlier_count"), cells).alias("outlier_ratio"),
        score(F.lit(mixed), width).alias("data_consistency"),
        score(F.lit(invalid), width).alias("data_type_validity"),
    )


def components(df: DataFrame, consistency: str = "types", expected_types: dict = None,
               approx_distinct: bool = False, digest: bool = False) -> DataFrame:
    """One row with the seven components of ``df``.

    A Spark column has one type, so consistency counts VARIANT columns that hold values of several kinds; ``content`` also
    looks for text columns that mix numbers with other text. Validity counts raw values failing ``expected_types``.
    """
    raw, df = df, normalize(df)
    columns, duplicates, variants = together(
        df.sparkSession, lambda: column_profile(df, approx_distinct),
        lambda: duplicate_rows(df, digest).first()["duplicate_rows"], lambda: mixed_variants(raw) if variant_names(raw) else [])
    plain = [col(c) for c in df.columns if c not in variant_names(raw)]
    mixed = len(variants) + (mixed_columns(df.select(*plain)) if consistency == "content" and plain else 0)
    return components_of(columns, duplicates, mixed, invalid_columns(df, expected_types or {}))


def score(df: DataFrame, weights: dict = None, **options) -> DataFrame:
    """One row: the components and the weighted quality score, unrounded."""
    return components(df, **options).withColumn("quality_score", weighted(weights))


def score_v2(df: DataFrame) -> DataFrame:
    """One row with the second score: missing share, few rows, much text, enough numbers."""
    df = normalize(df)
    width, text, nums = len(df.columns), len(string_names(df)), len(numeric_names(df))
    filled = F.lit(0)
    for c in df.columns:
        filled = filled + F.when(col(c).isNotNull(), 1).otherwise(0)
    totals = df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(filled), F.lit(0)).alias("filled"))
    cells = F.col("n_rows") * width
    missing = F.coalesce(ratio(cells - F.col("filled"), cells), F.lit(0.0))
    few = F.when(F.col("n_rows") < 50, 30.0).when(F.col("n_rows") < 100, 15.0).otherwise(0.0)
    tilt = (10.0 if nums / width > 0.3 else 0.0) - (20.0 if text / width > 0.5 else 0.0)
    return totals.select("n_rows", missing.alias("missing_ratio"),
                         clamp(100.0 - missing * 50.0 - few + tilt).alias("quality_score"))
