"""Whole analyses: what a user asks for in one call."""

from __future__ import annotations

import warnings
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..operators import clean, compat, fuse, ml, profile, quality, recommend, types
from ..operators.clean import impute
from ..operators.schema import clean_names
from ..session import agg_row, local_table, materialize, together
from ..sources import io

PROFILE = (
    "dataset string, n_rows bigint, n_cols int, null_cells bigint, duplicate_count bigint, columns array<string>, "
    "size_bytes bigint, size_text string, missing_values double, duplicate_rows double, data_completeness double, "
    "feature_diversity double, outlier_ratio double, data_consistency double, data_type_validity double, "
    "quality_score double"
)


def profile_table(df: DataFrame, name: str = "dataset", target: str = None, order_by=None, weights: dict = None,
                  approx_distinct: bool = False, digest: bool = False, source: DataFrame = None) -> dict:
    """Everything known about one table, as tables:

    ``profile`` (one row), ``columns``, ``components``, ``correlation``, and on request ``null_heatmap``
    (needs ``order_by``) and ``class_balance`` (needs ``target``). ``source`` is the frame as read, whose
    files give the size.
    """
    df = io.normalize(df)
    known = profile.table_facts(df)
    (row, columns), matrix = together(
        df.sparkSession, lambda: _profile(df, name, weights, approx_distinct, digest, source, known),
        lambda: profile.correlation(df, known))
    scored = row.first()
    out = {
        "profile": row,
        "columns": columns.select(F.lit(name).alias("dataset"), "*"),
        "components": local_table(df.sparkSession, [
            (name, k, scored[k], w) for k, w in (weights or quality.QUALITY_WEIGHTS).items()
        ], "dataset string, component string, score double, weight double"),
        "correlation": matrix,
    }
    if order_by:
        out["null_heatmap"] = profile.null_heatmap(df, order_by)
    if target and target in df.columns:
        out["class_balance"] = profile.class_balance(df, target)
    return out


def _profile(df: DataFrame, name: str, weights=None, approx_distinct=False, digest=False, source=None,
             known=None) -> tuple:
    """(one-row profile, column profile)."""
    columns, counts = together(
        df.sparkSession, lambda: profile.column_profile(df, approx_distinct, known),
        lambda: profile.duplicate_rows(df, digest).first())
    scored = quality.components_of(columns, counts["duplicate_rows"]).withColumn(
        "quality_score", quality.weighted(weights)).first()
    nulls = columns.agg(F.sum("null_count")).first()[0]
    size = io.source_size(source).first() if source is not None else (None, None)
    row = (name, counts["n_rows"], len(df.columns), nulls, counts["duplicate_rows"], df.columns, size[0], size[1],
           *scored)
    return local_table(df.sparkSession, [row], PROFILE), columns


def profile_row(df: DataFrame, name: str) -> DataFrame:
    """Only the one-row profile, which is what comparisons need."""
    return _profile(io.normalize(df), name)[0]


def metadata(df: DataFrame, name: str = "dataset", source: DataFrame = None) -> DataFrame:
    """One row: shape, names, labels, numeric and categorical names, duplicates, size."""
    df = io.normalize(df)
    labels = types.rich_label_dict(df)
    counts = profile.duplicate_rows(df).first()
    size = io.source_size(source).first() if source is not None else (None, None)
    row = (name, counts["n_rows"], len(df.columns), df.columns, [labels[c] for c in df.columns],
           [c for c in df.columns if labels[c] in ("Integer", "Float")],
           [c for c in df.columns if labels[c] in ("Categorical/String", "Boolean")],
           counts["duplicate_rows"], size[0], size[1])
    return local_table(df.sparkSession, [row], (
        "dataset string, n_rows bigint, n_cols int, columns array<string>, labels array<string>, "
        "numeric_columns array<string>, categorical_columns array<string>, duplicate_rows bigint, "
        "size_bytes bigint, size_text string"))


def analyze_table(df: DataFrame, order_by=None) -> dict:
    """The cleaned table and its ``counts``, ``columns`` (type, missing), ``describe`` and ``preview``."""
    cleaned, counts = clean.clean_dataset(df)
    seen = agg_row(cleaned, {c: F.count_if(col(c).isNull()) for c in cleaned.columns})
    kinds = dict(cleaned.dtypes)
    columns = local_table(df.sparkSession, [(i, c, kinds[c], seen[c]) for i, c in enumerate(cleaned.columns)],
                          "ordinal int, column string, data_type string, missing bigint")
    return {
        "cleaned": cleaned, "counts": counts, "columns": columns, "describe": profile.describe(cleaned),
        "preview": io.preview(cleaned, 10, order_by, as_text=False),
    }


def recommend_pair(a: DataFrame, b: DataFrame, name_a: str = "a", name_b: str = "b", order_a=None, order_b=None,
                   scorer=recommend.rules) -> DataFrame:
    """Profile both, compare them, and let ``scorer`` (rules, or a model's) recommend: one row."""
    a, b = clean_names(a), clean_names(b)
    left, right, compared = together(
        a.sparkSession, lambda: profile_row(a, name_a), lambda: profile_row(b, name_b),
        lambda: compat.compare(a, b, name_a, name_b, order_a, order_b, rename=False))
    return scorer(recommend.pair_features(left.unionByName(right), compared))


def recommend_all(tables: dict, order_by: dict = None, scorer=recommend.rules) -> DataFrame:
    """Recommendations for all pairs of a catalog; each table is profiled once."""
    tables = {n: clean_names(df) for n, df in tables.items()}
    spark = next(iter(tables.values())).sparkSession
    rows = together(spark, *[lambda n=n, df=df: profile_row(df, n) for n, df in tables.items()])
    profiles = reduce(DataFrame.unionByName, rows)
    return scorer(recommend.pair_features(profiles, compat.compare_all(tables, order_by)))


def fuse_tables(a: DataFrame, b: DataFrame, strategy: str, key: str = None, impute_gaps: bool = False,
                order_a=None, order_b=None, export_to: str = None, name: str = None, warn_above: float = None) -> tuple:
    """Fuse two tables: (fused table, one row of statistics, {format: path}).

    With ``warn_above`` a join is first estimated from its keys, and a warning given if it would have more than so many times the
    rows of the larger table.

    Names are cleaned, the strategy applied, types standardised, gaps filled on request. The combined
    rows are written once; types and fillers are projections over that, read by statistics and exports.
    """
    if strategy not in fuse.STRATEGIES:
        raise ValueError(f"invalid fusion strategy: {strategy}")
    a, b = clean_names(a), clean_names(b)
    if strategy in fuse.JOINS and not key:
        key = compat.find_key(a, b)
        if not key:
            raise ValueError(f"no common key column found for {strategy}; choose concat or union")
    if strategy == "union":
        raw = fuse.union(a, b)
    elif strategy == "concat":
        raw = fuse.concat(a, b, order_a, order_b)
    else:
        if warn_above is not None:
            warn_of_blow_up(a, b, key, fuse.JOINS[strategy], warn_above)
        raw = fuse.join(a, b, key, fuse.JOINS[strategy])
    fused = types.standardize(materialize(raw, "fused-raw"))
    if impute_gaps:
        fused = impute(fused)
    stats = fuse.stats(a, b, fused, strategy, key)
    paths = {}
    if export_to:
        base = f"{export_to.rstrip('/')}/{name or 'fused_' + strategy}"
        paths = {fmt: io.export(fused, f"{base}_{fmt}", fmt) for fmt in ("csv", "json")}
    return fused, stats, paths


def warn_of_blow_up(a: DataFrame, b: DataFrame, key: str, how: str, limit: float) -> None:
    """Warn when a join gives more than ``limit`` times the rows of the larger table."""
    size, n_a, n_b = together(a.sparkSession, lambda: fuse.estimate(a, b, key, how).first(), a.count, b.count)
    if size["n_rows"] > limit * max(n_a, n_b):
        warnings.warn(f"the {how} join on {key!r} gives {size['n_rows']} rows of tables of {n_a} and {n_b}; "
                      f"key {size['largest_key']!r} alone gives {size['largest_key_rows']}", stacklevel=3)


def study_fusion(tables: dict, order_by: dict, target: str = None, regressor=None, sample: int = None) -> dict:
    """N-table study: ``quality`` per table, ``pairs`` (overlap, complementarity, lift), ``overall``.

    ``sample`` bounds the rows of each table in the model test only; by default all rows take part.
    """
    if len(tables) < 2:
        raise ValueError("need at least 2 datasets for fusion analysis")
    spark = next(iter(tables.values())).sparkSession
    # Each table is scored and prepared once, whatever the number of its partners; then the pairs run side by side.
    found = together(spark, *[lambda df=df: quality.score_v2(df).first() for df in tables.values()],
                     *[lambda df=df: ml.prepared(ml.stable_sample(df, sample) if sample else df) for df in tables.values()])
    scores = [(n, float(row["quality_score"])) for n, row in zip(tables, found)]
    ready = dict(zip(tables, found[len(tables):]))

    def pair(x, y):
        over = compat.feature_overlap(tables[x], tables[y]).first()
        # The many short jobs of the models leave cores to the sorts and joins.
        comp, lift = together(
            spark, lambda: compat.complementarity(tables[x], tables[y], order_by[x], order_by[y]).first(),
            lambda: ml.lift_summary(ml.fusion_lift(ready[x], ready[y], target, regressor, ready=True)).first())
        return (x, y, over["overlap_percentage"], over["type_match_percentage"], comp["complementarity_score"],
                lift["r2_a"], lift["r2_b"], lift["r2_fused"], lift["improvement_vs_a"], lift["improvement_vs_b"])

    rows = together(spark, *[lambda x=x, y=y: pair(x, y) for x, y in combinations(tables, 2)])
    pairs = local_table(spark, rows, (
        "dataset_a string, dataset_b string, overlap_percentage double, type_match_percentage double, "
        "complementarity_score double, r2_a double, r2_b double, r2_fused double, improvement_vs_a double, "
        "improvement_vs_b double"))
    per_table = local_table(spark, scores, "dataset string, quality_score double")
    averages = pairs.agg(
        F.avg("overlap_percentage").alias("avg_overlap"), F.avg("complementarity_score").alias("avg_complementarity"),
        F.coalesce(F.avg("improvement_vs_a"), F.lit(0.0)).alias("avg_improvement"),
    ).withColumn("avg_quality", F.lit(sum(s for _, s in scores) / len(scores)))
    return {"quality": per_table, "pairs": pairs, "overall": recommend.overall_v2(averages)}
