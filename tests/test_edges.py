"""Edge cases, brute-force comparisons and properties that must hold for any table."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from blendscope import (catalog, clean, compat, fuse, io, ml, plans, profile, quality, recommend, report, rowindex,
                        schema, types)
from blendscope.functions.names import clean_name, name_ratio
from blendscope.functions.values import metric_label, shorten, size_text
from blendscope.session import local_table, materialize, scratch


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---------------------------------------------------------------- quantiles and positions

QUANTILE_DATA = {
    "ties": [5.0] * 400 + [1.0] * 100 + [9.0, 9.5, 10.0],
    "skewed": [math.exp(i / 12.0) for i in range(600)],
    "negative": [-(i % 37) * 1.25 for i in range(700)],
    "infinite": [float("-inf")] * 3 + [float(i) for i in range(500)] + [float("inf")] * 200,
    "huge": [(-1.0) ** i * 1.7e308 * (i % 50) / 50 for i in range(400)],
    "two": [1.0, 2.0],
    "one": [3.0],
}


@pytest.mark.parametrize("name", sorted(QUANTILE_DATA))
def test_narrowed_quantiles_equal_sorting(spark, name):
    values = QUANTILE_DATA[name]
    random.Random(3).shuffle(values)
    df = local_table(spark, [(v,) for v in values], "x double").repartition(5)
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    found = rowindex.exact_quantiles(df, ["x"], probs, small=0, small_bucket=20)["x"]
    ranked = sorted(values)
    for p, got in zip(probs, found):
        pos = p * (len(ranked) - 1)
        low, high = ranked[math.floor(pos)], ranked[math.ceil(pos)]
        wanted = low if low == high else low + (high - low) * (pos - math.floor(pos))
        assert got == pytest.approx(wanted, rel=1e-12), (name, p)


def test_dense_index_over_many_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("c")).repartition(13)
    got = {r["k"]: r["_idx"] for r in rowindex.dense_index(df, ["k"]).collect()}
    assert got == {i: i for i in range(1000)}


def test_dense_index_with_a_hot_key(spark):
    df = spark.range(900).select((F.col("id") / 600).cast("int").alias("k"), "id")
    got = sorted((r["_idx"], r["k"]) for r in rowindex.dense_index(df, ["k"]).collect())
    assert [i for i, _ in got] == list(range(900))
    assert [k for _, k in got] == sorted(k for _, k in got)


# ---------------------------------------------------------------- profile

def test_profile_of_odd_columns(spark):
    df = local_table(spark, [(1.0, None, None, True), (1.0, None, None, True), (None, None, None, None)],
                     "flat double, empty double, blank string, flag boolean")
    got = {r["column"]: r for r in profile.column_profile(df).collect()}
    assert (got["flat"]["std"], got["flat"]["unique_count"], got["flat"]["outlier_count"]) == (0.0, 1, 0)
    assert (got["empty"]["mean"], got["empty"]["std"], got["empty"]["min"], got["empty"]["unique_count"]) == (0, 0, 0, 0)
    assert (got["blank"]["mode"], got["blank"]["mode_freq"]) == ("N/A", 0)
    assert got["flag"]["type"] == "Categorical" and got["flag"]["mode_freq"] == 2
    assert {r["r"] for r in profile.correlation(df).collect()} == {0.0}


def test_single_row_and_empty_input(spark):
    one = local_table(spark, [(1, "a")], "x bigint, s string")
    row = quality.score(one).first()
    assert row["feature_diversity"] == 0.0  # both constant, and the text also looks like an id
    assert profile.column_profile(one).first()["std"] == 0.0
    with pytest.raises(ValueError):
        quality.score(one.where("x > 1"))
    with pytest.raises(ValueError):
        profile.shape(one.where("x > 1"))


def test_approximate_distinct_and_nan(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 2 == 0, float("nan")).otherwise(1.0).alias("x"))
    got = {r["column"]: r for r in profile.column_profile(df, approx_distinct=True).collect()}
    assert abs(got["id"]["unique_count"] - 1000) < 50
    assert got["x"]["null_count"] == 500


def test_duplicates_by_digest_tell_null_positions_apart(spark):
    df = local_table(spark, [(None, "a"), ("a", None), ("a", None), ("a", "a")], "x string, y string")
    for digest in (False, True):
        row = profile.duplicate_rows(df, digest=digest).first()
        assert (row["n_rows"], row["distinct_rows"], row["duplicate_rows"]) == (4, 3, 1)


def test_heatmap_bins(spark):
    df = spark.range(95).select("id", F.when(F.col("id") >= 90, F.lit(None)).otherwise(F.lit(1)).alias("v"))
    got = {r["bin"]: (r["label"], r["null_percent"]) for r in
           profile.null_heatmap(df, ["id"]).where("column = 'v'").collect()}
    assert len(got) == 40 and got[0] == ("Rows 0-1", 0.0)
    assert got[39][0] == "Rows 78-94" and got[39][1] == pytest.approx(100 * 5 / 17)
    assert profile.null_heatmap(df.limit(3), ["id"]).select("bin").distinct().count() == 3


def test_matrix_products_equal_sums(spark, monkeypatch):
    x = F.col("id")
    df = spark.range(3000).repartition(4).select(
        x.cast("double").alias("a"), (x * x + 1e6).alias("b"), F.when(x % 3 > 0, F.sin(x.cast("double"))).alias("c"),
        F.when(x % 4 > 0, F.rand(1)).alias("d"), F.lit(0.1).alias("flat"),
        F.when(x % 3 == 0, F.lit(5.0)).when(x % 7 == 0, F.lit(6.0)).alias("flat_where_c_is_null"))
    plain = profile.correlation_dict(df)
    monkeypatch.setattr(profile, "MANY_PAIRS", 0)
    by_matrix = profile.correlation_dict(df)
    assert set(plain) == set(by_matrix)
    for pair, r in plain.items():
        assert by_matrix[pair] == pytest.approx(r, abs=1e-9), pair


def test_histogram_fractional_width_and_closed_end(spark):
    ten = spark.range(10).select(F.col("id").cast("double").alias("x"))
    assert [r["n"] for r in profile.histogram(ten, "x").orderBy("bin").collect()] == [3, 3, 3, 1]
    many = spark.range(64).select(F.col("id").cast("double").alias("x"))
    assert sum(r["n"] for r in profile.histogram(many, "x", closed_last=False).collect()) == 63
    assert sum(r["n"] for r in profile.histogram(many, "x", closed_last=True).collect()) == 64
    same = spark.range(10).select(F.lit(2.0).alias("x"))
    assert profile.histogram(same, "x").orderBy("bin").first()["n"] == 10


def test_quality_does_not_depend_on_row_order(spark):
    df = spark.range(500).select((F.col("id") % 17).alias("a"), F.sqrt("id").alias("b"),
                                 F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("c"))
    first, second = (quality.score(x).first() for x in (df, df.orderBy(F.rand(1)).repartition(7)))
    for a, b in zip(first, second):
        assert a == pytest.approx(b, abs=1e-9)


def test_quality_weights_must_add_up(customers):
    with pytest.raises(ValueError):
        quality.weighted({"missing_values": 0.5})


def test_quality_v2_small_tables(spark):
    df = spark.range(60).select("id", F.lit("x").alias("a"), F.lit("y").alias("b"))
    assert quality.score_v2(df).first()["quality_score"] == 100 - 15 - 20 + 10
    assert quality.score_v2(df.limit(10)).first()["quality_score"] == 100 - 30 - 20 + 10


# ---------------------------------------------------------------- names, types, cleaning

def test_clean_names_and_collisions(spark):
    assert clean_name("  Größe (m2) ") == "größe_m2"
    df = local_table(spark, [(1, 2, 3, 4)], "`A b` int, `a_b` int, `a-_b!` int, `a_b_2` int")
    assert schema.clean_names(df).columns == ["a_b", "a_b_3", "a_b_4", "a_b_2"]


def test_name_ratios_match_in_spark_and_on_the_driver(spark):
    a, b = ["id", "name", "signup_date"], ["id", "date", "purchase_amount"]
    df = local_table(spark, [(a, b), ([], b), (a, [])], "names_a array<string>, names_b array<string>")
    got = [r["column_name_similarity"] for r in compat.name_similarity(df).collect()]
    wanted = 100 * sum(max(name_ratio(x, y) for y in b) for x in a) / 3
    assert got == [pytest.approx(wanted), 0.0, 0.0]


def test_read_csv_tokens_and_inference(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        'id,x,flag,name,empty\n1,1.5,True,"a, b",\n2,NA,false,n/a,NULL\n3,2,TRUE,"say ""hi""",NaN\n')
    df = io.read_csv(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"id": "bigint", "x": "double", "flag": "boolean", "name": "string", "empty": "double"}
    assert rows_of(df)[0] == (1, 1.5, True, "a, b", None)
    assert df.where("name = 'say \"hi\"'").count() == 1 and df.where("x is null").count() == 1
    typed = io.read_csv(spark, str(tmp_path / "t.csv"), "id int, x double, flag string, name string, empty string")
    assert typed.where("empty is null").count() == 3 and dict(typed.dtypes)["id"] == "int"


def test_standardize_thresholds(spark):
    n = 100

    def table(bad, good):
        return spark.range(n).select(F.when(F.col("id") < bad, F.lit("1d")).otherwise(F.lit(good)).alias("s"))

    assert dict(types.standardize(table(9, "7")).dtypes)["s"] == "double"
    assert dict(types.standardize(table(10, "7")).dtypes)["s"] == "string"
    assert dict(types.standardize(table(19, "2024-05-06")).dtypes)["s"] == "timestamp_ntz"
    assert dict(types.standardize(table(20, "2024-05-06")).dtypes)["s"] == "string"
    assert types.standardize(table(0, "31/12/2024")).first()["s"].month == 12
    flags = local_table(spark, [(True,), (None,), (False,)], "f boolean")
    assert sorted(r["f"] for r in types.standardize(flags).collect() if r["f"] is not None) == [0.0, 1.0]
    assert dict(types.standardize(flags.na.drop()).dtypes)["f"] == "boolean"


def test_impute_corner_cases(spark):
    df = local_table(spark, [(1, None, "b", None), (2, None, "a", None), (None, None, None, None)],
                     "n bigint, hollow double, s string, blank string")
    row = clean.impute(df).where("s = 'a' and n = 1.5").first()  # mode tie goes to the smaller value
    assert row["n"] == 1.5 and row["hollow"] is None and row["blank"] == "Unknown"
    assert clean.impute(df, "zero", "unknown").where("n = 0.0 and s = 'Unknown'").count() == 1


def test_clean_dataset_errors(spark):
    blank = local_table(spark, [(None, None)], "a string, b double")
    with pytest.raises(ValueError):
        clean.clean_dataset(blank)
    flat = local_table(spark, [(1, 2), (1, 2)], "a int, b int")
    with pytest.raises(ValueError):
        clean.clean_dataset(flat)
    assert clean.clean_dataset(flat.select("a"))[0].count() == 2  # a single column stays


def test_nested_columns_are_refused(spark):
    df = spark.range(1).select(F.array(F.lit(1)).alias("v"))
    with pytest.raises(ValueError, match="nested"):
        profile.column_profile(df)
    assert dict(io.normalize(df, nested_to_json=True).dtypes)["v"] == "string"


def test_text_helpers(spark):
    row = spark.range(1).select(
        size_text(F.lit(2048)).alias("a"), size_text(F.lit(3 << 40)).alias("b"), size_text(F.lit(10)).alias("c"),
        metric_label(F.lit("missing_values")).alias("d"), shorten(F.lit("abcdefghijklmnopq")).alias("e")).first()
    assert tuple(row) == ("2.00 KB", "3072.00 GB", "10.00 B", "Missing Values", "abcdefghijklmno...")


# ---------------------------------------------------------------- fusion

def brute_join(a, b, how):
    out = set()
    for x in a:
        hits = [y for y in b if x[0] == y[0]]
        out |= {(x[0], x[1], y[1]) for y in hits}
        if not hits and how in ("left", "outer"):
            out.add((x[0], x[1], None))
    if how in ("right", "outer"):
        out |= {(y[0], None, y[1]) for y in b if all(x[0] != y[0] for x in a)}
    return sorted(out, key=repr)


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_joins_equal_brute_force(spark, how):
    rng = random.Random(5)
    keys = [None, 1, 1, 1, 2, 3, 4, 5, 6]
    a = [(rng.choice(keys), rng.randrange(4)) for _ in range(60)]
    b = [(rng.choice([*keys, 8, 9]), rng.randrange(4)) for _ in range(50)]
    got = fuse.join(local_table(spark, a, "id bigint, v bigint"), local_table(spark, b, "id int, v bigint"), "id", how)
    assert got.columns == ["id", "v", "v_b"]
    assert rows_of(got) == brute_join(a, b, how)


def test_join_errors_and_suffixes(spark):
    a = local_table(spark, [(1, 2, 3)], "id bigint, v int, v_b int")
    b = local_table(spark, [("1", 5)], "id string, v int")
    with pytest.raises(ValueError, match="bigint"):
        fuse.join(a, b, "id")
    same = b.select(F.col("id").cast("bigint").alias("id"), "v")
    assert fuse.join(a, same, "id").columns == ["id", "v", "v_b", "v_b2"]
    with pytest.raises(ValueError):
        fuse.join(a, same, "nothing")


def test_union_of_mixed_types_and_with_itself(spark, customers):
    a = local_table(spark, [(1,), (1,), (2,)], "x bigint")
    b = local_table(spark, [("1",), ("z",)], "x string")
    assert rows_of(fuse.union(a, b)) == [("1",), ("2",), ("z",)]
    assert rows_of(fuse.union(customers, customers)) == rows_of(customers.select(sorted(customers.columns)).distinct())


def test_concat_pads_the_shorter_side(spark):
    a = local_table(spark, [(3, "c"), (1, "a"), (2, "b")], "id int, s string")
    b = local_table(spark, [(20, "y"), (10, "x")], "id int, t string")
    assert rows_of(fuse.concat(a, b, ["id"], ["id"])) == [
        (1, "a", 10, "x"), (2, "b", 20, "y"), (3, "c", None, None)]


def test_fuse_many_modes(spark):
    a = local_table(spark, [(1, 10)], "id int, x int")
    b = local_table(spark, [(1, 1, 1), (1, 2, 2)], "id int, y int, z int")
    c = local_table(spark, [(7,)], "id int")
    assert fuse.merge_many({"a": a, "b": b}).count() == 2
    assert fuse.merge_many({"a": a, "b": b}, mode="per_column").count() == 4
    assert fuse.merge_many({"a": a, "b": b, "c": c}).count() == 2
    assert fuse.merge_many({"a": a, "b": b, "c": c}, append_rows=True).count() == 3
    lone = local_table(spark, [("q",)], "w string")
    both = fuse.merge_many({"a": a, "lone": lone})
    assert set(both.columns) == {"id", "x", "w", "_source_dataset"} and both.count() == 2
    with pytest.raises(ValueError):
        fuse.merge_many({"a": a})


def test_fuse_tables_strategies(spark, customers, purchases):
    with pytest.raises(ValueError, match="strategy"):
        plans.fuse_tables(customers, purchases, "zip")
    lone = local_table(spark, [("q",)], "w string")
    with pytest.raises(ValueError, match="key"):
        plans.fuse_tables(customers, lone, "inner_join")
    _, stats, _ = plans.fuse_tables(customers, purchases, "concat", order_a=["id"], order_b=["id"])
    assert (stats.first()["rows_after"], stats.first()["cols_after"]) == (10, 8)
    _, stats, _ = plans.fuse_tables(customers, purchases, "union")
    assert stats.first()["rows_after"] == 17 and stats.first()["primary_key"] is None


# ---------------------------------------------------------------- comparison

def test_compare_with_itself(customers):
    row = compat.compare(customers, customers, order_a=["id"], order_b=["id"]).first()
    assert (row["schema_similarity"], row["common_columns_ratio"], row["correlation_similarity"]) == (100, 100, 100)
    assert row["missing_value_overlap"] == 100 and row["row_overlap"] == 100


def test_key_detection(spark):
    a = local_table(spark, [(1, "x", 5), (2, "y", 5)], "user_id int, label string, n int")
    b = local_table(spark, [("x", 5), ("z", 6)], "label string, n int")
    assert compat.find_key(a, b) == "label"  # unique on both sides
    assert compat.find_key(a, a) == "user_id"
    assert compat.find_key(a.select("n"), b.select("n")) is None
    assert compat.key_by_name(["unique", "id_x", "code"]) == "id_x"


def test_overlap_of_keys_of_different_kinds(spark):
    a = local_table(spark, [(1,), (2,)], "id bigint")
    b = local_table(spark, [("1",), ("2",)], "id string")
    assert compat.row_overlap(a, b, "id").first()["row_overlap"] == 0.0
    c = local_table(spark, [(1.0,), (2.5,)], "id double")
    assert compat.row_overlap(a, c, "id").first()["row_overlap"] == pytest.approx(100 / 3)
    empty = a.where("id > 9")
    assert compat.row_overlap(empty, empty, "id").first()["row_overlap"] == 0.0


@pytest.mark.parametrize("n_a, n_b", [(30, 50), (50, 30)])
def test_missing_overlap_equals_brute_force(spark, n_a, n_b):
    rng = np.random.default_rng(n_a)
    null_a, null_b = rng.random(n_a) < 0.4, rng.random(n_b) < 0.4
    a, b = (local_table(spark, [(i, None if x else 1) for i, x in enumerate(f)], "k int, v int")
            for f in (null_a, null_b))
    size = max(n_a, n_b)
    pa, pb = (np.pad(f, (0, size - len(f))) for f in (null_a, null_b))
    for parity in (False, True):
        either = pa | pb
        if parity and n_a < n_b:
            either = either[:n_a]
        got = compat.missing_overlap(a, b, ["k"], ["k"], parity).where("column = 'v'").first()["overlap"]
        assert got == pytest.approx(100 * (pa & pb).sum() / either.sum())


def test_complementarity_with_limit(spark):
    a = spark.range(50).select("id", (F.col("id") * 2.0).alias("x"))
    b = spark.range(70).select("id", (F.col("id") * -3.0).alias("y"))
    row = compat.complementarity(a, b, ["id"], ["id"], limit=20).first()
    # Perfectly correlated pairs give 0; one own column a side gives min(30, 2 / 2 * 50).
    assert row["complementarity_score"] == pytest.approx(30.0) and row["compared_pairs"] == 4


# ---------------------------------------------------------------- recommendation

def test_rules_cover_every_outcome(spark):
    found = recommend.rules(recommend.synthetic_pairs(spark, 2000, seed=7))
    assert {r[0] for r in found.select("recommendation").distinct().collect()} == {"FUSE", "USE_A", "USE_B"}
    plan = {r[0] for r in found.select("suggested_strategy").distinct().collect()}
    assert plan == {"union", "concat", "inner_join", "left_join", "outer_join"} or plan == {
        "union", "concat", "inner_join", "left_join"}
    assert found.where("confidence_score is null or size(reasoning) < 4").count() == 0


def test_synthetic_pairs_stay_in_range(spark):
    df = recommend.synthetic_pairs(spark, 3000, seed=1)
    noisy = df.where("scenario = 'noisy'").agg(F.min("q_b"), F.max("q_b"), F.min("row_overlap"), F.count("*")).first()
    assert 20 <= noisy[0] and noisy[1] <= 50 and noisy[2] >= 40 and 350 < noisy[3] < 650
    assert df.select("scenario").distinct().count() == 6
    keyed = df.where("scenario = 'partially_overlapping'").agg(F.avg("has_primary_key")).first()[0]
    assert 0.6 < keyed < 0.8
    assert df.agg(F.min("num_rows_a"), F.max("num_cols_b")).first()[0] >= 100


def test_recommender_round_trip(spark, tmp_path, customers, purchases):
    with pytest.raises(FileNotFoundError):
        ml.load(str(tmp_path / "none"))
    models = ml.train_recommender(recommend.synthetic_pairs(spark, 900), trees=15, depth=8)
    ml.save(models, str(tmp_path / "models"))
    again = ml.load(str(tmp_path / "models"))
    fresh = recommend.rules(recommend.synthetic_pairs(spark, 300, seed=99))
    judged = ml.predict(again, fresh.withColumnRenamed("recommendation", "wanted").drop("suggested_strategy"))
    score = ml.evaluate(judged, "wanted", "recommendation").first()
    assert score["accuracy"] > 0.85 and score["n"] == 300
    row = plans.recommend_pair(customers, purchases, scorer=lambda pairs: ml.recommend(again, pairs)).first()
    assert row["recommendation"] == "FUSE" and len(row["top_features"]) == 3
    assert row["reasoning"][0].startswith("ML Model Recommendation: FUSE (Confidence: ")
    assert report.action(plans.recommend_pair(customers, purchases)).count() == 1


def test_fusion_lift_and_summary(spark):
    base = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("x"), F.rand(1).alias("noise"))
    a = base.select("x", "noise", (F.col("x") * 3 + 1).alias("y"))
    lift = ml.fusion_lift(a, a.where("x < 15"), target="y", regressor=ml.boosted_trees(rounds=8, step=0.3))
    got = {r["arm"]: r for r in lift.collect()}
    assert set(got) == {"a_only", "b_only", "fused"} and got["a_only"]["r2_score"] > 0.8
    assert got["fused"]["common_features"] == 2
    assert ml.lift_summary(lift).first()["improvement_vs_a"] is not None
    assert ml.fusion_lift(a.limit(5), a.limit(5), target="y").count() == 0


def test_shared_label_codes(spark):
    a = local_table(spark, [("b",), ("a",)], "s string")
    b = local_table(spark, [("c",), ("a",)], "s string")
    assert rows_of(ml.label_encode(b)) == [(0,), (1,)]
    left, right = ml.label_encode(a, other=b)
    assert rows_of(left) == [(0,), (1,)] and rows_of(right) == [(0,), (2,)]


def test_large_dictionaries_are_joined_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ml, "BROADCAST_BYTES", 0)
    df = spark.range(200).select("id", F.concat(F.lit("w"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("s"))
    assert ml.label_encode(df).where("id <> s").count() == 0


# ---------------------------------------------------------------- catalog

def test_history_replaces_in_place(spark):
    cols = "file_a string, file_b string, strategy string, ts int, gain double"
    old = local_table(spark, [("a", "b", "union", 1, 0.5), ("c", "d", "concat", 2, 0.1)], cols)
    once = catalog.upsert_history(old, local_table(spark, [("a", "b", "union", 9, 0.7)], cols))
    listed = [tuple(r)[:5] for r in catalog.recent(once).collect()]
    assert listed == [("c", "d", "concat", 2, 0.1), ("a", "b", "union", 9, 0.7)]
    twice = catalog.upsert_history(once, local_table(spark, [("e", "f", "union", 10, 0.0)], cols))
    assert [r["file_a"] for r in catalog.recent(twice, 2).collect()] == ["e", "c"]


def test_kpis_without_profiles(spark):
    sources = local_table(spark, [("a",)], "dataset string")
    none = local_table(spark, [], "dataset string, quality_score double")
    assert tuple(catalog.kpis(sources, none, none, none).first()) == (1, 0.0, 0, 0)


def test_catalog_recommendation(spark, customers, purchases):
    other = customers.select("id", F.col("age").alias("height"))
    found = plans.recommend_all({"c": customers, "p": purchases, "o": other})
    rows = {(r["dataset_a"], r["dataset_b"]): r for r in found.collect()}
    assert set(rows) == {("c", "p"), ("c", "o"), ("p", "o")}
    assert rows["c", "p"]["suggested_strategy"] == "left_join"
    assert rows["c", "o"]["suggested_strategy"] == "inner_join"


def test_study_of_several_tables(spark):
    a = spark.range(300).select("id", (F.col("id") % 10).cast("double").alias("x"),
                                (F.col("id") % 10 * 2).cast("double").alias("y"))
    found = plans.study_fusion({"a": a, "b": a.where("x < 9")}, {"a": ["id"], "b": ["id"]}, target="y",
                               regressor=ml.boosted_trees(rounds=3))
    row = found["overall"].first()
    assert found["pairs"].first()["overlap_percentage"] == 100.0 and len(row["reasons"]) == 5
    assert 0 <= row["overall_score"] <= 100 and found["quality"].count() == 2
    with pytest.raises(ValueError):
        plans.study_fusion({"a": a}, {"a": ["id"]})


# ---------------------------------------------------------------- rows, copies, ties, cases

def test_sample_and_split_take_rows_not_distinct_values(spark):
    two = local_table(spark, [("a", 1)] * 400 + [("b", 2)] * 100, "x string, y int")
    assert ml.stable_sample(two, 200).count() == 200
    train, test = ml.split(two)
    assert train.count() + test.count() == 500 and 60 < test.count() < 140
    lift = ml.fusion_lift(two, two, target="y", regressor=ml.boosted_trees(rounds=2))
    assert {r.arm for r in lift.collect()} <= {"a_only", "b_only", "fused"}


def test_empty_side_of_a_split_gives_no_score(spark, monkeypatch):
    df = local_table(spark, [(float(i), 1.0) for i in range(30)], "x double, y double")
    monkeypatch.setattr(ml, "split", lambda data, share, seed: (data, data.where("false")))
    assert ml.score_arm(df, "y") is None


def test_new_history_entry_wins_on_equal_time(spark):
    schema = "file_a string, file_b string, strategy string, ts string, gain double"
    old = local_table(spark, [("a", "b", "union", "2026-01-01", 9.0)], schema)
    new = local_table(spark, [("a", "b", "union", "2026-01-01", 0.7)], schema)
    assert catalog.upsert_history(old, new).first()["gain"] == 0.7


def test_null_bins_of_a_constant_key_are_mixed(spark):
    df = local_table(spark, [(1, i, None if i % 2 else float(i)) for i in range(4000)], "k int, i int, x double")
    shares = [r.null_percent for r in profile.null_heatmap(df, ["k"], bins=4).where("column = 'x'").collect()]
    assert len(shares) == 4 and all(40 < s < 60 for s in shares)


def test_names_that_differ_in_case_only(spark):
    a = local_table(spark, [(1, 2.0)], "Id int, v double")
    b = local_table(spark, [("x", 2.0)], "id string, v double")
    merged = fuse.merge_many({"a": a, "b": b})
    assert {c.lower() for c in merged.columns} == {"id", "v", "id_2"}
    assert len(fuse.union(a, b).columns) == 3


def test_long_integers_and_infinities_lose_nothing(spark, tmp_path):
    text = local_table(spark, [("1234567890123456789", "99999999999999999999", "inf", "1.5"),
                               ("1234567890123456788", "1", "-Infinity", "1234567890123456789")], "a string, b string, c string, d string")
    typed = io.infer_types(text)
    assert [t for _, t in typed.dtypes] == ["bigint", "string", "double", "string"]
    assert typed.select("a").distinct().count() == 2


def test_line_breaks_inside_quotes(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\n1,"two\nlines"\n')
    assert io.read_csv(spark, str(tmp_path / "x.csv"), multi_line=True).collect() == [(1, "two\nlines")]


def test_one_rule_for_flat_columns(spark):
    """A column without variance where its partner has values gives 0, whatever the number of columns."""
    rows = [(1e9 if i % 2 else 1e9 + i, float(i) if i % 2 else None, float(i * i)) for i in range(100)]
    few = local_table(spark, rows, "x double, y double, z double")
    wide = few.selectExpr("*", *[f"z * {k} + y as c{k}" for k in range(1, 30)])
    small, large = ({(r.col_x, r.col_y): r.r for r in profile.correlation(df).collect()} for df in (few, wide))
    assert small["x", "y"] == large["x", "y"] == 0.0
    assert small["x", "z"] == pytest.approx(large["x", "z"])


def test_complementarity_reads_all_columns(spark):
    df = local_table(spark, [(i, float(i % 7), float(i % 5), float(i % 3), float(i % 11)) for i in range(50)],
                     "id int, a double, b double, c double, d double")
    assert compat.complementarity(df, df, ["id"], ["id"]).first()["compared_pairs"] == 25
    assert compat.complementarity(df, df, ["id"], ["id"], per_side=3).first()["compared_pairs"] == 9


def test_missing_order_is_the_only_error_compare_forgives(spark, monkeypatch):
    a = local_table(spark, [(1, None), (2, 1.0)], "id int, x double")
    assert compat.compare(a, a).first()["missing_value_overlap"] is None
    def broken(*_, **__):
        raise ValueError("other")
    monkeypatch.setattr(compat, "missing_overlap", broken)
    with pytest.raises(ValueError):
        compat.compare(a, a, order_a=["id"], order_b=["id"])


def test_exported_timestamps_are_read_back(spark, tmp_path):
    stamped = spark.sql("select id, timestamp_ntz'1997-01-15 00:00:00' + make_interval(0, 0, 0, cast(id as int)) as ts from range(20)")
    path = io.export(stamped, str(tmp_path / "out"), "csv")
    back = types.standardize(io.read_csv(spark, path))
    assert back.dtypes == [("id", "bigint"), ("ts", "timestamp_ntz")]
    assert rows_of(back) == rows_of(stamped)


@pytest.mark.parametrize("decades", [1, 60, 300])
def test_scans_for_quantiles_do_not_grow_with_decades(spark, monkeypatch, decades):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, -1.0).otherwise(1.0).alias("s"), "id").select(
        (F.col("s") * F.pow(F.lit(10.0), (F.col("id") % 9973) / 9973.0 * decades - decades / 2.0)).alias("x"))
    scans = []
    monkeypatch.setattr(rowindex, "local_table", lambda *a: scans.append(1) or local_table(*a))
    got = rowindex.exact_quantiles(df, ["x"], [0.1, 0.5, 0.9], small=100, small_bucket=2000)["x"]
    assert len(scans) <= 4
    want = np.quantile(np.array([r.x for r in df.collect()]), [0.1, 0.5, 0.9])
    assert got == pytest.approx(list(want), rel=1e-12)


def test_scratch_block_deletes_what_it_wrote(spark):
    kept = materialize(spark.range(3), "kept")
    with scratch():
        df = materialize(spark.range(5), "gone")
        assert df.count() == 5
        files = df.inputFiles()
    assert files and not [f for f in files if os.path.exists(f.removeprefix("file:").replace("///", "/"))]
    assert kept.count() == 3


def test_many_copies_of_one_row_are_dealt_out_by_many_tasks(spark):
    df = spark.range(400_000).select(F.when(F.col("id") < 350_000, 0).otherwise(F.col("id")).alias("v"))
    numbered = ml.numbered_copies(df).withColumn("task", F.spark_partition_id())
    hot = numbered.where("v = 0").groupBy("task").count().collect()
    assert sum(r["count"] for r in hot) == 350_000 and max(r["count"] for r in hot) < 200_000
    facts = numbered.where("v = 0").agg(F.count_distinct("_copy"), F.min("_copy"), F.max("_copy")).first()
    assert tuple(facts) == (350_000, 1, 350_000) and numbered.count() == 400_000


def test_csv_cells_that_do_not_fit_the_schema(spark, tmp_path):
    path = tmp_path / "cells.csv"
    path.write_text("a,b,c\n1,2.5,x\noops, 3 ,y\n 4 ,,z\n99999999999999999999,1e2,\n")
    schema = "a bigint, b double, c string"
    got = sorted(io.read_csv(spark, str(path), schema=schema).collect(), key=str)
    assert sorted(map(tuple, got), key=str) == sorted([(1, 2.5, "x"), (None, 3.0, "y"), (4, None, "z"), (None, 100.0, None)], key=str)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        io.read_csv(spark, str(path), schema=schema, strict=True).collect()
