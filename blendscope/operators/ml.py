"""Sampling, splitting, encoding, scaling, and the learned recommender and fusion test."""

from __future__ import annotations

import math
import re

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Bucketizer, IndexToString, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import as_double, col, is_numeric, numeric_names, string_names
from ..functions.values import ratio
from ..session import agg_row, local_table, materialize, together
from . import forest
from .clean import drop_sparse_columns, impute, target_rows
from .profile import deviation, number_facts
from .recommend import FEATURES, features, rules, with_gain
from .rowindex import indexed
from .schema import common_columns, to_common_types

BROADCAST_BYTES = 32 << 20  # of all dictionaries of a call that go to every executor; the others are shuffled
COPY_CHUNK = 10_000  # copies of a row dealt out at once


# ---------------------------------------------------------------- samples and splits

def row_hash(columns, seed: int = 42) -> Column:
    """Repeatable hex digest of a row, independent of partitioning."""
    return F.md5(F.concat_ws("|", *[col(c).cast("string") for c in columns], F.lit(str(seed))))


def numbered_copies(df: DataFrame, name: str = "_copy", chunk: int = COPY_CHUNK) -> DataFrame:
    """``df`` with a number 1, 2, ... for the copies of equal rows: they are counted before the shuffle, then dealt out again.

    More than ``chunk`` copies are dealt out in chunks of so many, spread over all tasks.
    """
    counted = df.groupBy(*[col(c) for c in df.columns]).agg(F.count("*").alias("_copies"))
    few = counted.where(F.col("_copies") <= chunk).withColumn("_first", F.lit(1).cast("bigint"))
    many = counted.where(F.col("_copies") > chunk).withColumn(
        "_first", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"), F.lit(chunk).cast("bigint"))))
    # A number of partitions that is given is not made smaller for the few bytes of the chunks.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = many.repartition(tasks, row_hash(df.columns), "_first")
    last = F.least(F.col("_copies"), F.col("_first") + (chunk - 1))
    return few.unionByName(many).withColumn(name, F.explode(F.sequence("_first", last))).drop("_copies", "_first")


def copy_hash(columns, seed: int, copy: str = "_copy") -> Column:
    """Digest of a row and its copy number; the first copy has the digest of the row."""
    again = F.md5(F.concat_ws("|", row_hash(columns, seed), F.col(copy).cast("string")))
    return F.when(F.col(copy) == 1, row_hash(columns, seed)).otherwise(again)


def stable_sample(df: DataFrame, n: int = 1000, seed: int = 42, key=None) -> DataFrame:
    """``n`` rows chosen by digest. Each task keeps only its best ``n``.

    Without ``key`` rows are chosen, each copy of a row by itself; with ``key``, all rows of a key stand or fall together
    up to the limit.
    """
    if key:
        return df.orderBy(row_hash(key, seed)).limit(n)
    return numbered_copies(df).orderBy(copy_hash(df.columns, seed)).limit(n).drop("_copy")


def file_sample(df: DataFrame, n: int = 1000, seed: int = 42) -> DataFrame:
    """``n`` rows of a frame read from Parquet files, each row with the same chance, chosen by its file and its place there.

    No row is shuffled or grouped: a task keeps the ``n`` of its rows with the smallest digests, the driver's plan merges these. Copies of a row
    are rows of their own. The sample stays the same as long as the files do.
    """
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    marked = df.withColumn("_place", F.to_json(place))
    return marked.orderBy(F.md5(F.concat_ws("|", "_place", F.lit(str(seed)))), "_place").limit(n).drop("_place")


def split_bucket(digest: Column, buckets: int = 10000) -> Column:
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(buckets))


def in_train(digest: Column, share: float) -> Column:
    return split_bucket(digest) < int(round(share * 10000))


TRAIN_MARK = "_falls_to_train"


def marked(df: DataFrame, share: float = 0.8, seed: int = 42) -> DataFrame:
    """``df`` with the side each copy of a row falls to, which ``split`` then goes by: written, it is worked out once."""
    return numbered_copies(df).withColumn(TRAIN_MARK, in_train(copy_hash(df.columns, seed), share)).drop("_copy")


def split(df: DataFrame, share: float = 0.8, seed: int = 42, key=None) -> tuple:
    """(train, test) by digest, the same in every run. Without ``key`` each copy of a row falls by itself."""
    if TRAIN_MARK in df.columns:
        return df.where(col(TRAIN_MARK)).drop(TRAIN_MARK), df.where(~col(TRAIN_MARK)).drop(TRAIN_MARK)
    rows = df if key else numbered_copies(df)
    first = in_train(row_hash(key, seed) if key else copy_hash(df.columns, seed), share)
    return rows.where(first).drop("_copy"), rows.where(~first).drop("_copy")


# ---------------------------------------------------------------- preparation

def label_codes(df: DataFrame, columns) -> tuple:
    """(dictionary rows (ordinal, value, code), bytes per ordinal): codes 0..k-1 in sorted order.

    Distinct values of all columns are ranked together by a distributed sort, so that a column whose
    values are all different is not gathered in one task.
    """
    cells = [x for i, c in enumerate(columns) for x in (F.lit(i), col(c).cast("string"))]
    values = df.select(F.stack(F.lit(len(columns)), *cells).alias("ordinal", "value")).where(
        "value is not null").distinct()
    placed, _ = indexed(values, ["ordinal", "value"], "_rank")
    groups = placed.groupBy("ordinal").agg(
        F.min("_rank").alias("_first"), F.sum(F.octet_length("value") + 16).alias("bytes")).collect()  # one per column
    first = local_table(df.sparkSession, [(g["ordinal"], g["_first"]) for g in groups], "ordinal int, _first bigint")
    codes = placed.join(F.broadcast(first), "ordinal").select(
        "ordinal", "value", (F.col("_rank") - F.col("_first")).alias("code"))
    return codes, {g["ordinal"]: g["bytes"] for g in groups}


def encode_with(df: DataFrame, columns, codes: DataFrame, sizes: dict) -> DataFrame:
    """Replace each column's values by their codes; broadcast dictionaries stay below ``BROADCAST_BYTES`` together."""
    out, sent = df, 0
    for i, c in enumerate(columns):
        words = codes.where(F.col("ordinal") == i).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
        if sent + sizes.get(i, 0) <= BROADCAST_BYTES:
            words = F.broadcast(words)
            sent += sizes.get(i, 0)
        order = [col(x) if x != c else F.col("_code").alias(c) for x in out.columns]
        out = out.join(words, col(c).cast("string") == F.col("_value"), "left").select(*order)
    return out


def label_encode(df: DataFrame, columns=None, other: DataFrame = None):
    """Text columns as codes 0..k-1 in sorted order, fitted on ``df``.

    With ``other`` the codes are fitted on both tables, so that they agree: returns both encoded.
    """
    names = string_names(df) if columns is None else list(columns)
    if not names:
        return df if other is None else (df, other)
    pick = [col(c).cast("string").alias(c) for c in names]
    fit = df.select(*pick) if other is None else df.select(*pick).unionByName(other.select(*pick))
    codes, sizes = label_codes(fit, names)
    encoded = encode_with(df, names, codes, sizes)
    return encoded if other is None else (encoded, encode_with(other, names, codes, sizes))


def standard_scale(df: DataFrame, columns=None, fit_on: DataFrame = None) -> DataFrame:
    """Columns minus mean over population deviation, both from ``fit_on``; a constant becomes 0."""
    names = numeric_names(df) if columns is None else list(columns)
    base = df if fit_on is None else fit_on
    facts, means, _ = number_facts(base, names)
    squares = agg_row(base, {c: deviation(c, means[c]) for c in names if facts[c][0]})
    scaled = {}
    for c in names:
        n, low, high = facts[c]
        if n:
            width = (squares[c] / n) ** 0.5 if low != high else 1.0
            scaled[c] = (as_double(c) - means[c]) / width if low != high else as_double(c) - F.lit(low).cast("double")
    return df.withColumns(scaled)


def preprocess(df: DataFrame) -> DataFrame:
    """Drop sparse columns, fill by median and mode, encode everything that is not a number."""
    filled = impute(drop_sparse_columns(df, 0.5), "median", "mode")
    return label_encode(filled, [f.name for f in filled.schema.fields if not is_numeric(f.dataType)])


# ---------------------------------------------------------------- the learned recommender

# Rows of a training partition at least: every level of a forest shuffles the statistics of all its nodes once per partition.
TRAINING_ROWS = 5_000
TRAINING_MB = 1024  # statistics of a level that one pass may hold; levels beyond it take several passes
# Pairs up to which MLlib grows the recommender's forests. Beyond, the shuffled statistics of their nodes outgrow the rows: see ``forest``.
MLLIB_PAIRS = 50_000


def training_frame(df: DataFrame, label: str) -> DataFrame:
    """``df``, written once, spread over all cores or as many as its rows justify: a small table would be read by one task."""
    return dealt(materialize(df, label))


def dealt(stored: DataFrame) -> DataFrame:
    """A written table spread as ``training_frame`` says."""
    parts = max(1, min(stored.sparkSession.sparkContext.defaultParallelism, -(-stored.count() // TRAINING_ROWS)))
    return stored.repartition(parts, *[col(c) for c in stored.columns if not isinstance(stored.schema[c].dataType, VectorUDT)])


def _forest(label: str, trees: int, depth: int, seed: int) -> Pipeline:
    return Pipeline(stages=[
        StringIndexer(inputCol=label, outputCol=f"{label}_index", stringOrderType="alphabetAsc"),
        VectorAssembler(inputCols=FEATURES, outputCol=f"{label}_features"),
        RandomForestClassifier(
            labelCol=f"{label}_index", featuresCol=f"{label}_features", predictionCol=f"{label}_prediction",
            probabilityCol=f"{label}_probability", rawPredictionCol=f"{label}_raw", numTrees=trees,
            maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed, maxMemoryInMB=TRAINING_MB,
            # Rows keep their node in each tree: otherwise every level sends all trees and walks each row down from the roots again.
            cacheNodeIds=True),
    ])


def train_recommender(pairs: DataFrame, trees: int = 100, depth: int = 30, seed: int = 42) -> dict:
    """Two forests, one for the action and one for the strategy, taught by the rules on ``pairs``.

    ``depth`` is the largest that MLlib's trees take.
    """
    labelled = rules(features(pairs)).select(
        *FEATURES, F.col("recommendation").alias("action"), F.col("suggested_strategy").alias("plan"))
    stored = materialize(labelled, "training-pairs")
    if stored.count() > MLLIB_PAIRS:
        return forest.fit(stored, FEATURES, ("action", "plan"), trees, depth, seed)
    labelled = dealt(stored)
    fitted = together(pairs.sparkSession, *[
        lambda label=label: _forest(label, trees, depth, seed).fit(labelled) for label in ("action", "plan")])
    return dict(zip(("action", "plan"), fitted))


def save(models: dict, path: str) -> None:
    for label, model in models.items():
        if isinstance(model, forest.Forest):
            model.save(f"{path}/{label}")
        else:
            model.write().overwrite().save(f"{path}/{label}")


def load(path: str) -> dict:
    def one(place):
        try:
            return PipelineModel.load(place)
        except Exception:
            return forest.Forest.load(SparkSession.active(), place)

    try:
        return {label: one(f"{path}/{label}") for label in ("action", "plan")}
    except Exception as error:
        raise FileNotFoundError(f"no recommender models in {path}; train and save them first") from error


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores: two forests cost far more per row than a shuffle, and a small file is read by one task."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def predict(models: dict, pairs: DataFrame) -> DataFrame:
    """Add ``recommendation``, ``suggested_strategy`` and ``confidence_score`` from the two forests."""
    out = features(spread(pairs))
    for label, target in (("action", "recommendation"), ("plan", "suggested_strategy")):
        model = models[label]
        if isinstance(model, forest.Forest):
            out = model.predict(out, target, f"{label}_probability")
        else:
            out = IndexToString(inputCol=f"{label}_prediction", outputCol=target,
                                labels=model.stages[0].labels).transform(model.transform(out))
            out = out.withColumn(f"{label}_probability", vector_to_array(f"{label}_probability"))
    sure = F.array_max("action_probability") * 100.0
    made = [f"{label}_{x}" for label in ("action", "plan")
            for x in ("index", "features", "prediction", "probability", "raw")]
    return out.withColumn("confidence_score", F.round(sure, 1)).drop(*made)


def recommend(models: dict, pairs: DataFrame) -> DataFrame:
    """Prediction, estimate and gain under the predicted strategy, and the driving features."""
    model = models["action"]
    shares = (model if isinstance(model, forest.Forest) else model.stages[-1]).featureImportances.toArray().tolist()
    return explain(with_gain(predict(models, pairs)), dict(zip(FEATURES, shares)))


# Sentences of the model recommendation.
MODEL_TEXT = {
    "action": "ML Model Recommendation: %s (Confidence: %.1f%%)",
    "strategy": "Suggested strategy: %s",
    "drivers": "Top driving factors for this decision:",
    "q_a": " - Dataset A has a high quality score (%s).",
    "q_b": " - Dataset B has a high quality score (%s).",
    "schema_similarity": " - Schema similarity is %s%%.",
    "comp_score": " - Overall compatibility score is %s/100.",
    "row_overlap": " - Row overlap between datasets is %s%%.",
    "unique_feature_gain": " - Fusing adds unique features (Gain: %s%%).",
    "has_primary_key": " - A primary key ('%s') was identified for joining.",
    "other": " - Metric '%s' significantly influenced the model.",
    "gain": "Fusing yields a positive quality gain of +%s points.",
    "loss": "Warning: Fusing results in a %s point change in overall dataset quality.",
}


def top_features(pairs: DataFrame, importances: dict, n: int = 3) -> DataFrame:
    """Add ``top_features``: the ``n`` largest importance x normalised value, ties by model order."""
    parts = []
    for i, c in enumerate(FEATURES):
        bound = 100.0 if any(k in c for k in ("score", "ratio", "similarity")) else 10000.0
        parts.append(F.struct((-(F.col(c).cast("double") / bound * F.lit(float(importances.get(c, 0.0))))).alias("w"),
                              F.lit(i).alias("i"), F.lit(c).alias("name")))
    ranked = F.slice(F.sort_array(F.array(*parts)), 1, n)
    return pairs.withColumn("top_features", F.transform(ranked, lambda x: x["name"]))


def explain(pairs: DataFrame, importances: dict) -> DataFrame:
    """Add ``top_features`` and the sentences ``reasoning`` to predicted pairs."""
    t = MODEL_TEXT
    ranked = top_features(pairs, importances)
    shown = {c: F.round(c, 2).cast("string") for c in (
        "q_a", "q_b", "schema_similarity", "comp_score", "row_overlap", "unique_feature_gain")}
    shown["has_primary_key"] = F.coalesce(F.col("primary_key"), F.lit("None"))

    def line(name):
        out = F.format_string(t["other"], name)
        for c, value in shown.items():
            out = F.when(name == c, F.format_string(t[c], value)).otherwise(out)
        return out

    gain, fuse = F.col("fusion_gain_score"), F.col("recommendation") == "FUSE"
    head = F.array(
        F.format_string(t["action"], "recommendation", "confidence_score"),
        F.format_string(t["strategy"], F.upper("suggested_strategy")), F.lit(t["drivers"]))
    tail = F.filter(F.array(
        F.when(fuse & (gain > 0), F.format_string(t["gain"], F.round(gain, 2).cast("string"))),
        F.when(fuse & (gain <= 0), F.format_string(t["loss"], F.round(gain, 2).cast("string"))),
    ), lambda x: x.isNotNull())
    return ranked.withColumn("reasoning", F.concat(head, F.transform("top_features", line), tail))


# ---------------------------------------------------------------- evaluation

def confusion(predictions: DataFrame, label: str, prediction: str) -> DataFrame:
    """Rows (label, prediction, n)."""
    return predictions.groupBy(col(label).alias("label"), col(prediction).alias("prediction")).agg(
        F.count("*").alias("n"))


def evaluate(predictions: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: accuracy and support-weighted precision, recall and F1; a class never predicted scores 0."""
    cells = confusion(predictions, label, prediction)
    side = cells.select(F.explode(F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("guessed"),
                 F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("actual"),
                 F.col("n").alias("guessed"), F.lit(0).cast("bigint").alias("hit")))).alias("x")).select("x.*")
    per_class = side.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("actual", "guessed", "hit")])
    precision = F.coalesce(ratio(F.col("hit"), F.col("guessed")), F.lit(0.0))
    recall = F.coalesce(ratio(F.col("hit"), F.col("actual")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2.0 * precision * recall, precision + recall), F.lit(0.0))

    def weighted(c):
        return ratio(F.sum(c * F.col("actual")), F.sum("actual"))

    return per_class.agg(
        ratio(F.sum("hit"), F.sum("actual")).alias("accuracy"), weighted(precision).alias("precision"),
        weighted(recall).alias("recall"), weighted(f1).alias("f1"), F.sum("actual").alias("n"))


# ---------------------------------------------------------------- does fusing help a model?

MIN_ROWS = 10  # fixed value: fewer rows than this plus one give no score
LIFT = ("arm string, r2_score double, mse double, samples bigint, common_features int, target_column string")


def fused_training_set(a: DataFrame, b: DataFrame, target: str) -> DataFrame:
    """Rows of both over their common columns and the target, where the target is known."""
    shared = [c for c in common_columns(a, b) if c != target]
    a, b = to_common_types(a, b)

    def side(df, other):
        goal = col(target) if target in df.columns else F.lit(None).cast(other.schema[target].dataType).alias(target)
        return df.select(*[col(c) for c in shared], goal)

    return target_rows(side(a, b).unionByName(side(b, a)), target)


def score_arm(df: DataFrame, target: str, regressor=None, seed: int = 42, scale: bool = False):
    """(r2, mse, training rows) of a regressor on an 80/20 split, or None below the minimum of rows or with an empty side."""
    names = [c for c in df.columns if c != target]
    if not names:
        return None
    data = df.select(*[as_double(c).alias(c) for c in names], as_double(target).alias(target))
    # Rows are numbered, hashed and written in one pass; everything below reads what was written.
    both = materialize(marked(data, 0.8, seed), "arm")
    train, test = split(both, 0.8, seed)
    learned, kept = train.count(), test.count()
    if learned + kept <= MIN_ROWS or not (learned and kept):
        return None
    if scale:
        train, test = split(standard_scale(both, names, fit_on=train), 0.8, seed)
    ready = VectorAssembler(inputCols=names, outputCol="_features", handleInvalid="keep")

    def vectors(x):
        return ready.transform(x).select("_features", col(target).alias("_label"), F.xxhash64(*[col(c) for c in names]).alias("_place"))

    model = (regressor or boosted_trees()).copy()
    model = model.setFeaturesCol("_features").setLabelCol("_label").setPredictionCol("_guess")
    frame = training_frame(vectors(train), "arm-train")
    cuts = candidate_cuts(frame, train, names, model) if sums_up(model) else None
    cells = binned_cells(train, target, cuts) if cuts else None
    if cells:
        model, frame = model.setWeightCol("_n").setMaxBins(CELL_BINS), training_frame(ready.transform(cells), "arm-cells")
        test = binned(test, cuts)
    guessed = model.fit(frame).transform(vectors(test)).select("_label", "_guess")
    # One scan of the test rows gives both scores.
    seen = agg_row(guessed, {"mse": F.avg((F.col("_label") - F.col("_guess")) ** 2), "spread": F.regr_sxx("_label", "_label") / F.count("*")})
    r2 = 1.0 - seen["mse"] / seen["spread"] if seen["spread"] else float("nan")
    return r2, seen["mse"], learned


CELL_BINS = 1024
CELLS = CELL_BINS ** 2  # so many rows a tree reads whole for its cut points, with so many bins
FEW_VALUES = 24  # by a sketch: so many values have a bin each


def sums_up(model) -> bool:
    """Whether ``model`` sees of rows in equal bins only their number and the mean of their labels."""
    return (isinstance(model, GBTRegressor) and model.getLossType() == "squared" and model.getSubsamplingRate() == 1.0
            and model.getMinInstancesPerNode() == 1 and not model.isSet("weightCol") and not model.isSet("validationIndicatorCol"))


def candidate_cuts(frame: DataFrame, train: DataFrame, names, model) -> dict | None:
    """``{feature: thresholds}`` that ``model`` would try on ``frame``; None where they cannot be read off.

    MLlib draws them from the rows, by seed. A tree that learns a feature from itself, with the same rows, bins and seed, splits at every
    one of them. Only sums per bin leave the tasks, a few times per feature. A feature with a bin for
    each value is learned from its values, with their numbers as weights.
    """
    facts, _, seen = number_facts(train, names, {"*": F.count("*"), **{(c, "values"): F.approx_count_distinct(col(c)) for c in names}})
    cuts = {}
    for i, c in enumerate(names):
        n, low, high = facts[c]
        if n < seen["*"] or not all(map(math.isfinite, (low, high))):
            return None
        # Values far from 0 for their spread would lose it in the squares.
        near = low if 0 < low and high < 2 * low else high if high < 0 and low > 2 * high else 0.0
        tree = DecisionTreeRegressor(featuresCol="_one", labelCol="_value", maxDepth=30, maxBins=model.getMaxBins(), seed=model.getSeed())
        if seen[c, "values"] <= FEW_VALUES:
            values = train.groupBy(col(c).alias("_x")).agg(F.count("*").cast("double").alias("_n"))
            alone, tree = VectorAssembler(inputCols=["_x"], outputCol="_one").transform(values), tree.setWeightCol("_n")
        else:
            alone = VectorSlicer(inputCol="_features", outputCol="_one", indices=[i]).transform(frame)
        tree = tree.fit(alone.withColumn("_value", vector_to_array("_one")[0] - F.lit(float(near))))
        if tree.depth == 30:
            return None
        cuts[c] = sorted({float(x) for x in re.findall(r"<= (\S+)\)", tree.toDebugString)})
    return cuts


def binned(df: DataFrame, cuts: dict) -> DataFrame:
    """Each feature as the number of its bin, from 1; a value on a threshold belongs below it, as in trees."""
    edges = {c: [-math.inf, *(math.nextafter(x, math.inf) for x in xs), math.inf] for c, xs in cuts.items() if xs}
    if not edges:
        return df.withColumns({c: F.lit(1.0) for c in cuts})
    found = {c: f"_bin{i}" for i, c in enumerate(edges)}
    # One binary search a value; a comparison with every threshold took two to five times as long.
    bins = Bucketizer(inputCols=[*edges], outputCols=[*found.values()], splitsArray=[*edges.values()]).transform(df)
    return bins.withColumns({c: F.col(found[c]) + 1.0 if c in found else F.lit(1.0) for c in cuts}).drop(*found.values())


def binned_cells(train: DataFrame, target: str, cuts: dict) -> DataFrame | None:
    """One row per combination of bins: mean ``_label`` and number ``_n`` of its rows; None where there are more than ``CELLS``.

    Trees tell rows apart by bins only. With squared errors the rows of a cell then have one prediction and, up to a constant that falls
    out of every gain, act as their mean with their number as weight.
    """
    cells = materialize(binned(train, cuts).groupBy(*[col(c) for c in cuts]).agg(
        F.avg(col(target)).alias("_label"), F.count("*").cast("double").alias("_n")), "arm-bins")
    return cells if cells.count() <= CELLS else None


def boosted_trees(rounds: int = 100, step: float = 0.1, depth: int = 5, seed: int = 42) -> GBTRegressor:
    return GBTRegressor(maxIter=rounds, stepSize=step, maxDepth=depth, seed=seed)


def prepared(df: DataFrame) -> DataFrame:
    """``preprocess``, written once."""
    return materialize(preprocess(df), "prepared")


def fusion_lift(a: DataFrame, b: DataFrame, target: str = None, regressor=None, seed: int = 42, ready: bool = False) -> DataFrame:
    """Rows (arm, r2, mse, samples) for a model on A alone, on B alone and on the fused common columns.

    Any Spark regressor may be given; boosted trees are the default. The default target is the first
    numeric column of the prepared A. ``ready`` says that both tables are ``prepared`` already.
    """
    ready_a, ready_b = (a, b) if ready else together(a.sparkSession, lambda: prepared(a), lambda: prepared(b))
    target = target or next(iter([*numeric_names(ready_a), *numeric_names(ready_b)]), None)
    if target is None:
        raise ValueError("no numeric target column found")
    shared = [c for c in common_columns(ready_a, ready_b) if c != target]
    arms = {name: (df, None, False) for name, df in (("a_only", ready_a), ("b_only", ready_b)) if target in df.columns}
    if shared:
        arms["fused"] = (fused_training_set(ready_a, ready_b, target), len(shared), True)
    scores = together(a.sparkSession, *[
        lambda df=df, scale=scale: score_arm(df, target, regressor, seed, scale) for df, _, scale in arms.values()])
    rows = [(arm, *got, width, target) for (arm, (_, width, _)), got in zip(arms.items(), scores) if got]
    return local_table(a.sparkSession, rows, LIFT)


def improvement(fused: Column, single: Column) -> Column:
    """Percentage by which the fused r2 beats a single one."""
    return (fused - single) / (F.abs(single) + 0.001) * 100.0


def lift_summary(lift: DataFrame) -> DataFrame:
    """One row: r2 per arm and the improvement of the fused arm over each."""
    def r2(arm):
        return F.max(F.when(F.col("arm") == arm, F.round("r2_score", 4)))

    wide = lift.agg(r2("a_only").alias("r2_a"), r2("b_only").alias("r2_b"), r2("fused").alias("r2_fused"))
    return wide.select("*", F.round(improvement(F.col("r2_fused"), F.col("r2_a")), 2).alias("improvement_vs_a"),
                       F.round(improvement(F.col("r2_fused"), F.col("r2_b")), 2).alias("improvement_vs_b"))

