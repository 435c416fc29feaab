"""The tables behind a report: rows of (label, value ...) per pair of datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import metric_label
from .quality import QUALITY_WEIGHTS

GOOD_QUALITY = 70.0  # fixed value: scores from here on count as good

# Labels and explanations of the report tables.
OVERVIEW = {
    "Number of Rows": "n_rows", "Number of Columns": "n_cols", "File Size": "size_text",
    "Duplicate Rows": "duplicate_count", "Quality Score": "quality_score",
}
COMPATIBILITY = {
    "schema_similarity": ("Schema Similarity", "Jaccard overlap of column headers"),
    "column_name_similarity": ("Header Name Matching", "Fuzzy header matching coefficient"),
    "dtype_compatibility": ("Data Type Compatibility", "Type matches on overlapping headers"),
    "common_columns_ratio": ("Common Column Ratio", "Overlap relative to total dimensions"),
    "unique_feature_gain": ("Unique Feature Gain", "New features B would introduce to A"),
    "row_overlap": ("Row Key Overlap", None),
    "correlation_similarity": ("Correlation Similarity", "Statistical correlation structures overlap"),
    "missing_value_overlap": ("Missing Value Alignment", "Null locations Jaccard correlation"),
}


def _score(c) -> Column:
    return F.round(c, 2).cast("string")


def _sides(profiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs with the profile row of each side as the structs ``a`` and ``b``."""
    row = F.struct(*profiles.columns)
    left = profiles.select(F.col("dataset").alias("dataset_a"), row.alias("a"))
    right = profiles.select(F.col("dataset").alias("dataset_b"), row.alias("b"))
    return pairs.select("dataset_a", "dataset_b").join(left, "dataset_a").join(right, "dataset_b")


def _long(df: DataFrame, keys: list, rows: list, names: list) -> DataFrame:
    cells = [c for r in rows for c in r]
    return df.select(*keys, F.stack(F.lit(len(rows)), *cells).alias(*names))


def overview(profiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """Side-by-side rows (metric, value_a, value_b); a missing figure reads ``N/A``."""
    rows = []
    for label, c in OVERVIEW.items():
        if c in profiles.columns:
            def shown(side, c=c):
                value = F.col(f"{side}.{c}")
                text = F.concat(_score(value), F.lit("/100")) if c == "quality_score" else value.cast("string")
                return F.coalesce(text, F.lit("N/A"))

            rows.append((F.lit(label), shown("a"), shown("b")))
    return _long(_sides(profiles, pairs), ["dataset_a", "dataset_b"], rows, ["metric", "value_a", "value_b"])


def quality(profiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows (metric, weight, value_a, value_b) of the quality components; one missing in B reads 0.0."""
    rows = [
        (metric_label(F.lit(name)), F.format_string("%.0f%%", F.lit(w * 100.0)),
         F.concat(_score(F.col(f"a.{name}")), F.lit("/100")),
         F.concat(_score(F.coalesce(F.col(f"b.{name}"), F.lit(0.0))), F.lit("/100")))
        for name, w in QUALITY_WEIGHTS.items()
    ]
    return _long(_sides(profiles, pairs), ["dataset_a", "dataset_b"], rows, ["metric", "weight", "value_a", "value_b"])


def compat(compared: DataFrame) -> DataFrame:
    """Rows (attribute, score, detail) of a comparison."""
    rows = [
        (F.lit(label), F.concat(_score(F.col(name)), F.lit("%")), F.lit(detail) if detail else F.col("key_info"))
        for name, (label, detail) in COMPATIBILITY.items()
    ]
    return _long(compared, ["dataset_a", "dataset_b"], rows, ["attribute", "score", "detail"])


def fusion(stats: DataFrame, keys=()) -> DataFrame:
    """Rows (attribute, value, notes) of fusion statistics."""
    def text(c):
        return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")

    def delta(after, before):
        return F.concat(F.lit("Delta: "), text(F.col(f"{after}") - F.greatest(f"{before}_a", f"{before}_b")))

    rows = [
        ("Applied Strategy", F.upper("strategy"), F.concat(
            F.lit("Primary key: "), F.coalesce(F.col("primary_key"), F.lit("None (Concat/Union)")))),
        ("Initial Rows", F.concat(F.lit("A: "), text("rows_before_a"), F.lit(" | B: "), text("rows_before_b")),
         F.concat(F.lit("Total raw: "), text(F.col("rows_before_a") + F.col("rows_before_b")))),
        ("Resulting Rows", text("rows_after"), delta("rows_after", "rows_before")),
        ("Initial Columns", F.concat(F.lit("A: "), text("cols_before_a"), F.lit(" | B: "), text("cols_before_b")),
         F.lit("")),
        ("Resulting Columns", text("cols_after"), delta("cols_after", "cols_before")),
        ("Duplicates Cleaned", text("duplicate_rows"), F.lit("Exact row duplicates removed during fusion")),
        ("Missing Cells Ratio", F.concat(text("missing_cells"), F.lit(" ("), _score("missing_ratio"), F.lit("%)")),
         F.lit("Null values in merged structure")),
    ]
    return _long(stats, list(keys), [(F.lit(label), value, note) for label, value, note in rows],
                 ["attribute", "value", "notes"])


def action(recommendations: DataFrame) -> DataFrame:
    """Add the action text and whether each side's quality counts as good."""
    act = F.col("recommendation")
    return recommendations.withColumn(
        "action_text", F.when(act == "FUSE", "FUSE DATASETS").otherwise(F.concat(F.lit("USE "), F.right(act, F.lit(1))))
    ).withColumn("quality_band_a", F.when(F.col("q_a") >= GOOD_QUALITY, "good").otherwise("fair")
                 ).withColumn("quality_band_b", F.when(F.col("q_b") >= GOOD_QUALITY, "good").otherwise("fair"))
