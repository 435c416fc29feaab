"""Use one table or fuse both: rules as column expressions over a table of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import clamp, ratio
from .quality import QUALITY_WEIGHTS

# The feature vector of a pair, in model order.
FEATURES = [
    "q_a", "q_b", "schema_similarity", "column_name_similarity", "dtype_compatibility", "common_columns_ratio",
    "unique_feature_gain", "row_overlap", "correlation_similarity", "has_primary_key", "comp_score",
    "missing_score_a", "missing_score_b", "dup_score_a", "dup_score_b", "completeness_a", "completeness_b",
    "num_rows_a", "num_rows_b", "num_cols_a", "num_cols_b",
]

# What an absent feature counts as.
FEATURE_DEFAULTS = {
    "missing_score_a": 100.0, "missing_score_b": 100.0, "dup_score_a": 100.0, "dup_score_b": 100.0,
    "completeness_a": 100.0, "completeness_b": 100.0,
    "num_rows_a": 1000.0, "num_rows_b": 1000.0, "num_cols_a": 10.0, "num_cols_b": 10.0,
}

# Sentences of the rule recommendation.
RULE_TEXT = {
    "use_a": "Dataset A has a higher quality score (%s) compared to Dataset B (%s).",
    "use_a_why": "Compatibility between datasets is extremely low, meaning a fusion would introduce "
                 "excessive missing values (sparsity).",
    "use_b": "Dataset B has a higher quality score (%s) compared to Dataset A (%s).",
    "use_b_why": "Compatibility between datasets is too low for a successful fusion.",
    "fuse": "Fusion strategy '%s' is recommended.",
    "union": "High schema similarity (%s%%) allows row concatenation without major structural loss.",
    "union_rows": "Fusing increases row count from %s (A) and %s (B) to an estimated %s rows.",
    "key": "Identified matching primary key '%s' allowing a relational merge.",
    "key_columns": "Adding columns from Dataset B expands features from %s to %.0f features.",
    "concat": "Fusing side-by-side (horizontal concatenation) combines distinct feature domains.",
    "gain": "Fusing yields a positive quality gain of +%s points, improving completeness and overall coverage.",
    "loss": "Warning: Fusing results in a slight quality score change of %s points due to induced missing "
            "cells, but provides a richer column layout.",
    "quality": "Quality comparison: Dataset A (%s/100) vs Dataset B (%s/100).",
    "score": "Compatibility score is %s/100 based on schema and data type alignments.",
}

STRATEGIES = ["union", "inner_join", "left_join", "right_join", "outer_join", "concat"]


def pair_features(profiles: DataFrame, compat: DataFrame, digits: int = 2) -> DataFrame:
    """Join the profile of each side to every compared pair: the input of all recommenders.

    ``profiles`` has one row per dataset, ``compat`` one per pair, so both joins are small beside the
    data they describe. Scores are rounded to ``digits`` as stored ones are; None keeps them whole.
    """
    def shown(name):
        return F.col(name) if digits is None else F.round(F.col(name), digits)

    def side(s):
        return profiles.select(
            F.col("dataset").alias(f"dataset_{s}"), shown("quality_score").alias(f"q_{s}"),
            shown("missing_values").alias(f"missing_score_{s}"), shown("duplicate_rows").alias(f"dup_score_{s}"),
            shown("data_completeness").alias(f"completeness_{s}"), shown("feature_diversity").alias(f"diversity_{s}"),
            shown("outlier_ratio").alias(f"outlier_score_{s}"), F.col("n_rows").alias(f"num_rows_{s}"),
            F.col("n_cols").alias(f"num_cols_{s}"), F.col("null_cells").alias(f"null_cells_{s}"),
            F.col("columns").alias(f"columns_{s}"))

    joined = compat.join(side("a"), "dataset_a", "left").join(side("b"), "dataset_b", "left")
    kept = ["dataset_a", "dataset_b", "primary_key", "key_info"]
    return joined.select(
        *kept, *[shown(c).alias(c) for c in (
            "schema_similarity", "column_name_similarity", "dtype_compatibility", "common_columns_ratio",
            "unique_feature_gain", "row_overlap", "correlation_similarity", "missing_value_overlap")],
        F.col("primary_key").isNotNull().cast("double").alias("has_primary_key"),
        shown("compatibility_score").alias("comp_score"),
        *[f"{c}_{s}" for s in "ab" for c in (
            "q", "missing_score", "dup_score", "completeness", "diversity", "outlier_score", "num_rows", "num_cols",
            "null_cells")],
        F.size(F.array_except("columns_a", "columns_b")).alias("only_a"),
        F.size(F.array_except("columns_b", "columns_a")).alias("only_b"),
        F.size(F.array_union("columns_a", "columns_b")).alias("all_columns"),
    )


def features(pairs: DataFrame) -> DataFrame:
    """The 21 model features as doubles, defaults for what is absent, other columns kept."""
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(FEATURE_DEFAULTS.get(c, 0.0))) for c in FEATURES}
    return pairs.withColumns(filled)


# ---------------------------------------------------------------- the estimate

def _num(name: str) -> Column:
    return F.col(name).cast("double")


def overlap_rows() -> Column:
    """Rows both sides are taken to share; with a key never less than a tenth of the smaller side."""
    smaller = F.least(_num("num_rows_a"), _num("num_rows_b"))
    shared = F.floor(smaller * (_num("row_overlap") / 100.0))
    tenth = F.when(F.col("primary_key").isNotNull(), F.floor(smaller * 0.1)).otherwise(0)
    return F.coalesce(F.nullif(shared, F.lit(0)), tenth).cast("double")


def null_ratio(strategy: Column, shared: Column) -> Column:
    """Simulated share of NULL cells after fusing by ``strategy``."""
    rows_a, rows_b, cols_a, cols_b = (_num(c) for c in ("num_rows_a", "num_rows_b", "num_cols_a", "num_cols_b"))
    nulls_a, nulls_b = _num("null_cells_a"), _num("null_cells_b")
    joined_cols = cols_a + cols_b - F.col("primary_key").isNotNull().cast("double")
    stacked = rows_a + rows_b - shared
    lone_a, lone_b = rows_a - shared, rows_b - shared
    ratios = {
        "union": F.when(stacked > 0, ratio(
            nulls_a + nulls_b + _num("only_b") * rows_a + _num("only_a") * rows_b,
            stacked * _num("all_columns"))).otherwise(0.0),
        "inner_join": (ratio(nulls_a, rows_a * cols_a) + ratio(nulls_b, rows_b * cols_b)) / 2.0,
        "left_join": ratio(nulls_a + ratio(nulls_b, rows_b) * shared + (cols_b - 1) * lone_a, rows_a * joined_cols),
        "right_join": ratio(nulls_b + ratio(nulls_a, rows_a) * shared + (cols_a - 1) * lone_b, rows_b * joined_cols),
        "outer_join": ratio(nulls_a + nulls_b + (cols_a - 1) * lone_b + (cols_b - 1) * lone_a, stacked * joined_cols),
    }
    padding = F.abs(rows_a - rows_b) * F.when(rows_a < rows_b, cols_a).otherwise(cols_b)
    side_by_side = ratio(nulls_a + nulls_b + padding, F.greatest(rows_a, rows_b) * (cols_a + cols_b))
    out = None
    for name, expr in ratios.items():
        out = F.when(strategy == name, expr) if out is None else out.when(strategy == name, expr)
    return out.otherwise(side_by_side)


def with_estimate(pairs: DataFrame, strategy: str, name: str = "estimated_quality") -> DataFrame:
    """Add the quality score expected of the table fused by the strategy in column ``strategy``.

    The shared rows and the NULL share are columns of their own, so that each is worked out once per pair.
    """
    staged = pairs.withColumn("_shared", overlap_rows()).withColumn(
        "_nulls", null_ratio(F.col(strategy), F.col("_shared")))
    parts = {
        "missing_values": F.greatest(F.lit(0.0), 100.0 * (1.0 - F.col("_nulls"))),
        "duplicate_rows": F.lit(100.0),
        "data_completeness": F.greatest(F.lit(0.0), 100.0 * (1.0 - F.col("_nulls") * 1.5)),
        "feature_diversity": F.least(F.lit(100.0), F.greatest(_num("diversity_a"), _num("diversity_b")) + 5.0),
        "outlier_ratio": (_num("outlier_score_a") + _num("outlier_score_b")) / 2.0,
        "data_consistency": F.lit(95.0),
        "data_type_validity": F.lit(95.0),
    }
    total = F.lit(0.0)
    for part, value in parts.items():
        total = total + F.lit(QUALITY_WEIGHTS[part]) * value
    return staged.withColumn(name, total).drop("_shared", "_nulls")


def estimate_all(pairs: DataFrame) -> DataFrame:
    """One row per pair and strategy with the estimated quality."""
    return with_estimate(pairs.withColumn(
        "strategy", F.explode(F.array(*[F.lit(s) for s in STRATEGIES]))), "strategy")


# ---------------------------------------------------------------- the rules

def strategy() -> Column:
    """The strategy the rules suggest for a pair."""
    overlap = F.coalesce(_num("row_overlap"), F.lit(0.0))
    return (
        F.when(F.coalesce(_num("schema_similarity"), F.lit(0.0)) > 80.0, "union")
        .when(F.col("primary_key").isNull(), "concat")
        .when(overlap > 75.0, "inner_join")
        .when(overlap > 20.0, "left_join")
        .otherwise("outer_join")
    )


def with_gain(pairs: DataFrame, digits: int = 2) -> DataFrame:
    """Add the estimated quality under ``suggested_strategy`` and the gain over the better side."""
    def shown(c):
        return c if digits is None else F.round(c, digits)

    out = with_estimate(pairs, "suggested_strategy", "estimated_fused_quality")
    out = out.withColumn("estimated_fused_quality", shown(F.col("estimated_fused_quality")))
    return out.withColumn(
        "fusion_gain_score", shown(F.col("estimated_fused_quality") - F.greatest("q_a", "q_b")))


def _text(c, digits: int = 2) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits).cast("string")


def say(template: str, *parts) -> Column:
    return F.format_string(template, *parts)


def rules(pairs: DataFrame, digits: int = 2) -> DataFrame:
    """Recommendation, confidence, reasons, gain, estimate and strategy for every pair."""
    out = with_gain(pairs.withColumn("suggested_strategy", strategy()), digits)
    gain, score = F.col("fusion_gain_score"), _num("comp_score")
    apart = (score < 30.0) & (gain < 0)
    action = F.when(apart & (F.col("q_a") >= F.col("q_b")), "USE_A").when(apart, "USE_B").otherwise("FUSE")
    sure = F.when(apart, F.least(F.lit(95.0), 60.0 + F.abs(F.col("q_a") - F.col("q_b")) + (40.0 - score))).otherwise(
        F.least(F.lit(98.0), 50.0 + score * 0.4 + F.greatest(F.lit(0.0), gain) * 2.0))
    out = out.withColumn("recommendation", action).withColumn(
        "confidence_score", sure if digits is None else F.round(sure, 1))
    return out.withColumn("reasoning", reasons())


def reasons() -> Column:
    """The sentences behind a rule recommendation, in order."""
    t = RULE_TEXT
    act, plan = F.col("recommendation"), F.col("suggested_strategy")
    fuse, union = act == "FUSE", plan == "union"
    keyed = fuse & ~union & F.col("primary_key").isNotNull()
    rows_a, rows_b = F.col("num_rows_a").cast("bigint"), F.col("num_rows_b").cast("bigint")
    shared = F.floor(F.least(rows_a, rows_b) * (_num("row_overlap") / 100.0)).cast("bigint")
    wider = _num("num_cols_a") + _num("unique_feature_gain") / 100.0 * _num("num_cols_a")
    gain = F.col("fusion_gain_score")
    lines = [
        F.when(act == "USE_A", say(t["use_a"], _text("q_a"), _text("q_b"))),
        F.when(act == "USE_A", F.lit(t["use_a_why"])),
        F.when(act == "USE_B", say(t["use_b"], _text("q_b"), _text("q_a"))),
        F.when(act == "USE_B", F.lit(t["use_b_why"])),
        F.when(fuse, say(t["fuse"], F.upper(plan))),
        F.when(fuse & union, say(t["union"], _text("schema_similarity"))),
        F.when(fuse & union, say(t["union_rows"], rows_a.cast("string"), rows_b.cast("string"),
                                 (rows_a + rows_b - shared).cast("string"))),
        F.when(keyed, say(t["key"], F.col("primary_key"))),
        F.when(keyed, say(t["key_columns"], F.col("num_cols_a").cast("bigint").cast("string"), wider)),
        F.when(fuse & ~union & F.col("primary_key").isNull(), F.lit(t["concat"])),
        F.when(fuse & (gain > 0), say(t["gain"], _text(gain))),
        F.when(fuse & (gain <= 0), say(t["loss"], _text(gain))),
        say(t["quality"], _text("q_a"), _text("q_b")),
        say(t["score"], _text("comp_score")),
    ]
    return F.filter(F.array(*lines), lambda x: x.isNotNull())


# ---------------------------------------------------------------- synthetic pairs

# Ranges of the synthetic pairs. "both" is drawn for either side, "pair" for every pair;
# a scenario overrides what it names. "key" is (name, probability).
SYNTHETIC = {
    "both": {
        "num_rows": (100, 10000), "num_cols": (5, 50), "q": (60, 100), "missing_score": (80, 100),
        "dup_score": (90, 100), "completeness": (80, 100), "diversity": (80, 100), "outlier_score": (80, 100),
    },
    "pair": {"unique_feature_gain": (10, 100)},
    "scenarios": {
        "highly_compatible": {
            "schema_similarity": (85, 100), "column_name_similarity": (90, 100), "dtype_compatibility": (90, 100),
            "common_columns_ratio": (80, 100), "comp_score": (85, 100)},
        "partially_overlapping": {
            "schema_similarity": (30, 70), "column_name_similarity": (40, 80), "dtype_compatibility": (60, 100),
            "key": ("id", 0.7), "row_overlap": (20, 80), "comp_score": (50, 80)},
        "incompatible": {
            "schema_similarity": (0, 20), "column_name_similarity": (0, 30), "dtype_compatibility": (0, 40),
            "row_overlap": (0, 10), "q_a": (40, 80), "q_b": (40, 80), "comp_score": (0, 30)},
        "noisy": {
            "schema_similarity": (40, 80), "key": ("id", 1.0), "row_overlap": (40, 90), "q_b": (20, 50),
            "missing_score_b": (10, 40), "comp_score": (40, 70)},
        "different_schemas": {
            "schema_similarity": (0, 10), "column_name_similarity": (0, 10), "comp_score": (0, 20)},
        "fk_relationship": {
            "schema_similarity": (10, 30), "key": ("user_id", 1.0), "row_overlap": (80, 100), "comp_score": (60, 90)},
    },
}


def synthetic_pairs(spark: SparkSession, n: int = 3000, seed: int = 42) -> DataFrame:
    """``n`` random pairs over six scenarios, to train a recommender before real pairs exist."""
    kinds = SYNTHETIC["scenarios"]
    base = {f"{k}_{s}": r for k, r in SYNTHETIC["both"].items() for s in "ab"}
    base.update(SYNTHETIC["pair"])
    similarities = ["schema_similarity", "column_name_similarity", "dtype_compatibility", "common_columns_ratio",
                    "row_overlap", "correlation_similarity", "comp_score"]
    columns = [*base, *similarities]
    draws = {f"_r{i}": F.rand(seed + 1 + i) for i in range(len(columns))}
    names = F.array(*[F.lit(k) for k in kinds])
    out = spark.range(n).withColumn("scenario", F.element_at(names, (F.rand(seed) * len(kinds)).cast("int") + 1))
    out = out.withColumns(draws).withColumn("_key", F.rand(seed + 1 + len(columns)))

    def between(r, draw, whole):
        low, high = r
        return F.floor(low + draw * (high - low + 1)).cast("double") if whole else low + draw * float(high - low)

    made = {}
    for i, c in enumerate(columns):
        whole = c.startswith(("num_rows", "num_cols"))
        value = between(base[c], F.col(f"_r{i}"), whole) if c in base else F.lit(0.0)
        for kind, ranges in kinds.items():
            if c in ranges:
                value = F.when(F.col("scenario") == kind, between(ranges[c], F.col(f"_r{i}"), whole)).otherwise(value)
        made[c] = value
    key = F.lit(None).cast("string")
    for kind, ranges in kinds.items():
        if "key" in ranges:
            name, chance = ranges["key"]
            key = F.when((F.col("scenario") == kind) & (F.col("_key") < chance), F.lit(name)).otherwise(key)
    out = out.withColumns(made).withColumn("primary_key", key)
    # Column names of a side are numbered from 0, so the narrower side's names are all on the wider one.
    return out.drop(*draws, "_key").withColumns({
        "has_primary_key": F.col("primary_key").isNotNull().cast("double"),
        "null_cells_a": F.lit(0.0), "null_cells_b": F.lit(0.0),
        "only_a": F.greatest(F.lit(0.0), F.col("num_cols_a") - F.col("num_cols_b")),
        "only_b": F.greatest(F.lit(0.0), F.col("num_cols_b") - F.col("num_cols_a")),
        "all_columns": F.greatest("num_cols_a", "num_cols_b"),
    })


# ---------------------------------------------------------------- the second score

# Weights and bounds of the overall fusion score, and its sentences.
OVERALL_WEIGHTS = {"quality": 0.25, "overlap": 0.15, "complementarity": 0.30, "improvement": 0.30}
OVERALL_LIMIT = 65.0
OVERALL_TEXT = {
    "quality_good": "✅ Datasets have good quality (avg score: %.1f%%)",
    "quality_bad": "⚠️ Datasets need cleaning (avg score: %.1f%%)",
    "overlap_good": "✅ Good feature overlap (%.1f%%) - complementary information",
    "overlap_high": "⚠️ High feature overlap (%.1f%%) - may be redundant",
    "overlap_low": "⚠️ Low feature overlap (%.1f%%) - may be incompatible",
    "complementarity_good": "✅ Strong complementarity (%.1f%%)",
    "complementarity_bad": "⚠️ Weak complementarity (%.1f%%)",
    "improvement_good": "✅ Model accuracy improves by %.1f%% with fusion",
    "improvement_some": "📈 Model shows slight improvement (%.1f%%)",
    "improvement_none": "📉 Model may not improve with fusion (%.1f%%)",
    "yes": "🎯 Overall: FUSION RECOMMENDED for your project!",
    "no": "⚠️ Overall: FUSION NOT RECOMMENDED - consider different datasets",
}


def overall_v2(averages: DataFrame) -> DataFrame:
    """Score, decision and reasons from rows (avg_quality, avg_overlap, avg_complementarity, avg_improvement)."""
    q, o, c, i = (F.coalesce(_num(f"avg_{k}"), F.lit(0.0)) for k in (
        "quality", "overlap", "complementarity", "improvement"))
    w, t = OVERALL_WEIGHTS, OVERALL_TEXT
    score = clamp(q * w["quality"] + (100.0 - F.abs(50.0 - o)) * w["overlap"] + c * w["complementarity"]
                  + clamp(50.0 + i) * w["improvement"])
    out = averages.withColumn("overall_score", score).withColumn("recommended", F.col("overall_score") >= OVERALL_LIMIT)
    lines = F.array(
        F.when(q > 70, say(t["quality_good"], q)).otherwise(say(t["quality_bad"], q)),
        F.when(o.between(30, 70), say(t["overlap_good"], o)).when(o > 70, say(t["overlap_high"], o))
        .otherwise(say(t["overlap_low"], o)),
        F.when(c > 50, say(t["complementarity_good"], c)).otherwise(say(t["complementarity_bad"], c)),
        F.when(i > 10, say(t["improvement_good"], i)).when(i > 0, say(t["improvement_some"], i))
        .otherwise(say(t["improvement_none"], i)),
        F.when(F.col("recommended"), F.lit(t["yes"])).otherwise(F.lit(t["no"])),
    )
    return out.withColumn("reasons", lines)
