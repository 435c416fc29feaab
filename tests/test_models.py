"""Model tests prepare their inputs once."""

import math

import numpy as np
import pyarrow as pa
import pytest
from blendscope import ml, plans, recommend
from blendscope.operators import forest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F


def tables(spark, n=3):
    i = F.col("id")
    return {f"t{k}": spark.range(200).select((i * (k + 2) % 17).alias("x"), (i % 5 + k).alias("z"), (i * 2.0 + k).alias("y")) for k in range(n)}


def test_study_prepares_each_table_once(spark, monkeypatch):
    calls, plain = [], ml.prepared
    monkeypatch.setattr(ml, "prepared", lambda df: calls.append(1) or plain(df))
    found = plans.study_fusion(tables(spark), {f"t{k}": ["y"] for k in range(3)}, target="y", regressor=LinearRegression())
    assert len(calls) == 3 and found["pairs"].count() == 3


def test_an_arm_numbers_its_rows_once(spark, monkeypatch):
    calls, plain = [], ml.numbered_copies
    monkeypatch.setattr(ml, "numbered_copies", lambda df: calls.append(1) or plain(df))
    r2, mse, n = ml.score_arm(tables(spark, 1)["t0"], "y", LinearRegression(), scale=True)
    assert calls == [1] and 140 < n < 180 and mse > 0 and r2 < 1


def test_arm_without_spread_or_rows(spark):
    assert ml.score_arm(spark.range(5).select("id", F.lit(1.0).alias("y")), "y") is None
    r2, mse, _ = ml.score_arm(spark.range(100).select("id", F.lit(1.0).alias("y")), "y", LinearRegression())
    assert r2 != r2 and mse < 1e-6


def test_training_frames_use_few_tasks_for_few_rows(spark):
    assert ml.training_frame(spark.range(100).toDF("x"), "t").rdd.getNumPartitions() == 1
    assert ml.training_frame(spark.range(12_000).toDF("x"), "t").rdd.getNumPartitions() == 3


def test_forests_keep_the_nodes_of_rows(spark):
    data = ml.training_frame(recommend.rules(recommend.features(recommend.synthetic_pairs(spark, 400))).select(
        *recommend.FEATURES, F.col("recommendation").alias("action")), "t")
    kept, walked = ml._forest("action", 5, 30, 42), ml._forest("action", 5, 30, 42)
    assert kept.getStages()[-1].getCacheNodeIds()
    walked.getStages()[-1].setCacheNodeIds(False)
    assert kept.fit(data).stages[-1].toDebugString.split("\n", 1)[1] == walked.fit(data).stages[-1].toDebugString.split("\n", 1)[1]


def test_prediction_of_a_small_file_uses_all_cores(spark):
    pairs = recommend.synthetic_pairs(spark, 200)
    models = ml.train_recommender(pairs, trees=2, depth=3)
    assert ml.predict(models, pairs.coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def untidy(spark, n=3000):
    """Features with few, many, tied, far and zero values, and a target that depends on them."""
    i = F.col("id")
    return spark.range(n).select(
        (i * 7919 % 1009 - 300.0).alias("many"), (i % 3).cast("double").alias("few"), F.when(i % 4 > 0, 0.0).otherwise(i * 13 % 97).alias("zeros"),
        (i * 31 % 211 * 1.0 + 1.7e12).alias("far"), (i * 7919 % 1009 * 3.0 + i % 3 * 500 + F.sin(i * 1.0) * 200).alias("y"))


def test_rows_put_together_by_bins_give_the_same_trees(spark, monkeypatch):
    fitted, plain = [], ml.training_frame
    monkeypatch.setattr(ml, "training_frame", lambda df, label: fitted.append((label, df.count())) or plain(df, label))
    data, trees = untidy(spark).select("many", "few", "y"), ml.boosted_trees(rounds=6, step=0.3)
    together = ml.score_arm(data, "y", trees, scale=True)
    assert fitted[-1][0] == "arm-cells" and fitted[-1][1] < together[2] / 20  # before, every row went through every round
    monkeypatch.setattr(ml, "sums_up", lambda model: False)
    by_row = ml.score_arm(data, "y", trees, scale=True)
    assert fitted[-1][0] == "arm-train" and all(abs(x - y) <= 1e-9 * abs(y) for x, y in zip(together, by_row))


def test_cells_with_ties_zeros_and_far_values(spark, monkeypatch):
    trees = ml.boosted_trees(rounds=4, step=0.3)
    together = ml.score_arm(untidy(spark), "y", trees)
    monkeypatch.setattr(ml, "sums_up", lambda model: False)
    assert all(abs(x - y) <= 1e-9 * abs(y) for x, y in zip(together, ml.score_arm(untidy(spark), "y", trees)))


def test_arms_that_stay_with_rows(spark, monkeypatch):
    assert not ml.sums_up(LinearRegression()) and not ml.sums_up(ml.boosted_trees().setSubsamplingRate(0.5))
    assert not ml.sums_up(ml.boosted_trees().setMinInstancesPerNode(2)) and not ml.sums_up(ml.boosted_trees().setLossType("absolute"))
    holes = untidy(spark, 300).withColumn("few", F.when(F.col("few") > 0, F.col("few")))
    endless = untidy(spark, 300).withColumn("few", F.when(F.col("few") > 0, F.col("few")).otherwise(float("inf")))
    trees = ml.boosted_trees(rounds=2)
    assert ml.candidate_cuts(None, holes, ["few"], trees) is None and ml.candidate_cuts(None, endless, ["few"], trees) is None
    monkeypatch.setattr(ml, "CELLS", 10)
    assert ml.score_arm(untidy(spark, 300), "y", trees)[2] > 200


def test_study_learns_from_cells(spark, monkeypatch):
    fitted, plain = [], ml.training_frame
    monkeypatch.setattr(ml, "training_frame", lambda df, label: fitted.append((label, df.count())) or plain(df, label))
    found = plans.study_fusion(tables(spark, 2), {"t0": ["y"], "t1": ["y"]}, target="y", regressor=ml.boosted_trees(rounds=2))
    rows = [n for label, n in fitted if label == "arm-cells"]
    assert found["overall"].count() == 1 and len(rows) == 3 and max(rows) <= 17 * 6  # x and z of both tables


def test_an_arm_numbers_and_scales_its_rows_in_one_pass(spark, monkeypatch):
    written, scaled, plain, scale = [], [], ml.materialize, ml.standard_scale
    monkeypatch.setattr(ml, "materialize", lambda df, label: written.append((label, df._jdf.queryExecution().analyzed().toString())) or plain(df, label))
    monkeypatch.setattr(ml, "standard_scale", lambda *a, **k: scaled.append(1) or scale(*a, **k))
    data = untidy(spark).select("many", "few", "y")
    found = ml.score_arm(data, "y", ml.boosted_trees(rounds=2), scale=True)
    assert found[2] == ml.split(data, 0.8, 42)[0].count()
    arm = dict(written)["arm"]
    assert arm.count("Union") == 1 and scaled == [1]  # before, rows were numbered for each part, and each part was scaled by scans of its own


def test_cuts_of_few_values_come_from_their_numbers(spark, monkeypatch):
    fitted = []

    class Tree(ml.DecisionTreeRegressor):
        def fit(self, rows):
            fitted.append(rows.count())
            return super().fit(rows)

    monkeypatch.setattr(ml, "DecisionTreeRegressor", Tree)
    data, names = untidy(spark), ["many", "few"]
    frame = ml.VectorAssembler(inputCols=names, outputCol="_features").transform(data)
    by_value = ml.candidate_cuts(frame, data, names, ml.boosted_trees())
    assert fitted == [3000, 3] and by_value["few"] == [0.5, 1.5]  # before, every row of each feature
    monkeypatch.setattr(ml, "FEW_VALUES", 0)
    assert ml.candidate_cuts(frame, data, names, ml.boosted_trees()) == by_value


def test_bins_of_values_on_and_beside_thresholds(spark):
    cuts = {"x": [-2.5, -5e-324, 0.0, 1.0, 1e300], "flat": []}
    values = [y for x in cuts["x"] for y in (math.nextafter(x, -math.inf), x, math.nextafter(x, math.inf))] + [-0.0, -1e308, 1e308]
    rows = ml.binned(spark.createDataFrame([(v, v, 7.0) for v in values], "v double, x double, flat double"), cuts)
    assert rows.columns == ["v", "x", "flat"]
    assert all(r.x == 1.0 + sum(r.v > c for c in cuts["x"]) and r.flat == 1.0 for r in rows.collect())
    assert {r.flat for r in ml.binned(rows, {"flat": []}).collect()} == {1.0}


def numbers(spark, models, pairs):
    """Shares of the predicted labels that the rules give as well."""
    wanted = recommend.rules(pairs).select("id", F.col("recommendation").alias("a"), F.col("suggested_strategy").alias("p"))
    got = ml.predict(models, pairs).select("id", "recommendation", "suggested_strategy", "confidence_score")
    return got.join(wanted, "id").agg(
        F.avg((F.col("a") == F.col("recommendation")).cast("int")), F.avg((F.col("p") == F.col("suggested_strategy")).cast("int")),
        F.count("*"), F.min("confidence_score"), F.max("confidence_score")).first()


def test_many_pairs_grow_one_tree_a_task(spark, monkeypatch, tmp_path):
    pairs, fresh = recommend.synthetic_pairs(spark, 3000, seed=1), recommend.synthetic_pairs(spark, 1000, seed=99)
    small = ml.train_recommender(pairs, trees=12, depth=30)
    assert not isinstance(small["action"], ml.forest.Forest)
    monkeypatch.setattr(ml, "MLLIB_PAIRS", 1000)
    monkeypatch.setattr(ml, "_forest", None)  # before, MLlib grew forests of any number of pairs, level by level through a shuffle
    models = ml.train_recommender(pairs, trees=12, depth=30)
    assert [models[c].trees.count() for c in ("action", "plan")] == [12, 12] and sum(models["action"].featureImportances) > 0.999
    assert models["plan"].labels == sorted(models["plan"].labels) == small["plan"].stages[0].labels
    got, as_before = numbers(spark, models, fresh), numbers(spark, small, fresh)
    assert got[2] == 1000 and 0 <= got[3] <= got[4] <= 100
    assert all(a > b - 0.02 for a, b in zip(got[:2], as_before[:2])) and got[0] > 0.9 and got[1] > 0.9
    ml.save(models, str(tmp_path / "kept"))
    again = ml.load(str(tmp_path / "kept"))
    assert ml.recommend(again, fresh).orderBy("id").collect() == ml.recommend(models, fresh).orderBy("id").collect()
    ml.save(small, str(tmp_path / "kept"))
    assert ml.load(str(tmp_path / "kept"))["action"].stages


def plain_best(x, y, w, rows, feats, classes):
    """The best Gini split of a node, cut by cut."""
    def score(some):
        n = [w[some][y[some] == c].sum() for c in range(classes)]
        return sum(v * v for v in map(int, n)) / sum(map(int, n)) if len(some) else 0.0

    found = [(score(rows[x[f, rows] <= c]) + score(rows[x[f, rows] > c]), f, c) for f in feats for c in range(31)
             if 0 < (x[f, rows] <= c).sum() < len(rows)]
    return max(found, default=(-1.0,))[0]


def rows_of_bins(n, width=7, classes=3):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 32, (width, n)).astype(np.uint8)
    x[2] = 4  # one bin only
    y = ((x[0] > 12).astype(int) + (x[1] + x[3] > 40)).astype(np.uint8)
    return x, np.where(rng.random(n) < 0.1, rng.integers(0, classes, n), y).astype(np.uint8), rng.integers(1, 5, n).astype(np.uint8)


def test_splits_are_the_best_ones(monkeypatch):
    x, y, w = rows_of_bins(900)
    sizes = np.array([600, 3, 200, 20, 1, 76])
    rows = np.random.default_rng(6).permutation(900).astype(np.int32)
    mine = np.split(rows, np.cumsum(sizes)[:-1])
    totals = np.stack([np.bincount(y[r], w[r], 3) for r in mine]).astype(np.int64)
    feats = np.array([[0, 2, 5], [1, 3, 6], [2, 3, 4], [6, 5, 4], [0, 1, 2], [2, 0, 1]])
    for step, few in ((1 << 16, 48), (64, 48), (64, 0), (1 << 16, 10_000)):
        monkeypatch.setattr(forest, "STEP_ROWS", step)
        monkeypatch.setattr(forest, "FEW_ROWS", few)
        score, feature, cut, left = forest.best_splits(x.reshape(-1), y, w, rows, sizes, feats, totals)
        for k, r in enumerate(mine):
            assert abs(score[k] - plain_best(x, y, w, r, feats[k], 3)) < 1e-9
            if score[k] >= 0:
                down = r[x[feature[k], r] <= cut[k]]
                assert feature[k] in feats[k] and list(left[k]) == list(np.bincount(y[down], w[down], 3))


def test_a_tree_from_blocks_counts_every_row_of_its_bag():
    x, y, _ = rows_of_bins(5000)

    def blocks():
        for i in range(0, 5000, 700):
            yield i, x.T[i:i + 700], y[i:i + 700]

    for held in (100_000, 600, 50):  # gathered at once; large nodes counted block by block, others gathered in groups
        made = forest.one_tree(blocks, 7, 3, 30, 42, 3, 0, held)
        nodes = [np.frombuffer(made[c], t) for c, t in (("feature", np.uint8), ("cut", np.uint8), ("left", np.int32))]
        counts = np.frombuffer(made["counts"], np.int64).reshape(-1, 3)
        want = np.zeros_like(counts)
        for i, rows, labels in blocks():
            at = -1 - nodes[2][forest.walk(*nodes, rows)]
            np.add.at(want, (at, labels), forest.bag(42, 3, i, len(labels)))
        assert (want == counts).all() and len(counts) > 200
        # Fully grown: a leaf has rows of several classes only where no drawn feature divided them.
        assert (counts.max(1) == counts.sum(1)).mean() > 0.6
    flat = forest.one_tree(blocks, 7, 3, 2, 42, 3, 0, 600)
    assert len(flat["left"]) // 4 <= 7
    assert len(forest.one_tree(lambda: iter([(0, x.T[:9], y[:9] * 0)]), 7, 3, 30, 42, 0, 0, 600)["left"]) == 4  # one class, one leaf


def test_cuts_of_few_tied_and_missing_values(spark):
    i = F.col("id")
    rows = spark.range(2000).select((i % 3).cast("double").alias("few"), (i * 1.0).alias("many"), F.lit(5.0).alias("flat"),
                                    F.when(i % 10 > 0, 0.0).otherwise(i * 1.0).alias("tied"))
    cuts = forest.find_cuts(rows, rows.columns)
    assert cuts["few"] == [0.5, 1.5] and cuts["flat"] == [] and len(cuts["many"]) == 31 and 1 < len(cuts["tied"]) < 31
    for bad in (None, float("nan")):
        with pytest.raises(ValueError, match="few"):
            forest.find_cuts(rows.withColumn("few", F.when(F.col("many") > 0, F.col("few")).otherwise(F.lit(bad).cast("double"))), rows.columns)


def test_predictions_of_a_forest_are_means_over_its_trees(spark, monkeypatch):
    monkeypatch.setattr(ml, "MLLIB_PAIRS", 100)
    pairs = recommend.synthetic_pairs(spark, 500)
    models = ml.train_recommender(pairs, trees=7, depth=4)
    model = models["action"]
    trees = [r.asDict() for r in model.trees.collect()]

    def voted(values):
        bins, votes = [sum(x > c for c in cuts) for x, cuts in zip(values, model.cuts)], [0.0] * len(model.labels)
        for t in trees:
            feature, cut, left, counts = (np.frombuffer(t[c], k) for c, k in (("feature", "u1"), ("cut", "u1"), ("left", "i4"), ("counts", "i8")))
            node = 0
            while left[node] >= 0:
                node = left[node] + (bins[feature[node]] > cut[node])
            leaf = counts.reshape(-1, len(votes))[-1 - left[node]]
            votes = [v + n / leaf.sum() for v, n in zip(votes, leaf)]
        return [v / len(trees) for v in votes]

    wanted = {r["id"]: voted([r[c] for c in recommend.FEATURES]) for r in recommend.features(pairs).collect()}
    rows = ml.recommend(models, pairs).collect()
    assert len(rows) == 500 and {len(r.top_features) for r in rows} == {3}
    for r in rows:
        want = wanted[r["id"]]
        # Before, forests of this many pairs were MLlib's, walked row by row.
        assert r.recommendation == model.labels[want.index(max(want))] and abs(r.confidence_score - 100 * max(want)) < 0.051


def test_batches_are_gathered_before_trees_are_read(monkeypatch):
    monkeypatch.setattr(forest, "PREDICTED_AT_ONCE", 64)
    batches = [pa.StructArray.from_arrays([pa.array(np.arange(n) * 1.0), pa.array(np.arange(n) % 2 * 1.0)], ["a", "b"]) for n in (40, 0, 30, 5)]
    got = list(forest.gathered(batches, [[9.0, 10.0], []]))
    assert [sizes for _, sizes in got] == [[40, 0, 30], [5]] and [len(x) for x, _ in got] == [70, 5]
    assert got[0][0][:12, 0].tolist() == [0] * 10 + [1, 2] and got[0][0][:, 1].max() == 0
    with pytest.raises(ValueError, match="NaN"):
        list(forest.gathered([pa.StructArray.from_arrays([pa.array([1.0, float("nan")])], ["a"])], [[0.5]]))
    monkeypatch.setattr(forest, "WALKED_AT_ONCE", 3)
    nodes = np.array([0, 1, 0, 0, 0], np.uint8), np.array([4, 1, 0, 0, 0], np.uint8), np.array([1, 3, -1, -2, -3], np.int32)
    x = np.array([[4, 1], [5, 0], [0, 2], [9, 9], [4, 2]], np.uint8)
    assert forest.walk(*nodes, x).tolist() == [3, 2, 4, 2, 4]
