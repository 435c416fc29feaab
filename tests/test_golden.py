"""Hand-derived values on the two small integration tables."""

import pytest
from pyspark.sql import functions as F

from blendscope import compat, fuse, plans, profile, quality, recommend, report


def close(value, wanted, digits=6):
    assert value == pytest.approx(wanted, abs=10 ** -digits)


def test_quality_of_customers(customers):
    row = quality.score(customers).first()
    close(row["missing_values"], 95.0)
    close(row["duplicate_rows"], 100.0)
    close(row["data_completeness"], 75.0)
    close(row["feature_diversity"], 50.0)
    close(row["outlier_ratio"], 97.5)
    close(row["quality_score"], 87.375)


def test_quality_of_purchases(purchases):
    row = quality.score(purchases).first()
    close(row["missing_values"], 96.428571)
    close(row["feature_diversity"], 75.0)
    close(row["outlier_ratio"], 100.0)
    close(row["quality_score"], 91.785714)


def test_column_profile(customers):
    rows = {r["column"]: r for r in profile.column_profile(customers).collect()}
    age = rows["age"]
    assert (age["null_count"], age["outlier_count"], age["unique_count"]) == (2, 1, 8)
    close(age["q1"], 27.25)
    close(age["q3"], 32.0)
    close(age["mean"], 30.0)
    assert rows["name"]["mode"] == "Alice" and rows["name"]["mode_freq"] == 1
    assert [r["age"] for r in profile.outlier_rows(customers, "age").collect()] == [40.0]


def test_compare(customers, purchases):
    row = compat.compare(customers, purchases).first()
    close(row["schema_similarity"], 14.285714)
    close(row["column_name_similarity"], 65.119048)
    close(row["dtype_compatibility"], 100)
    close(row["common_columns_ratio"], 25)
    close(row["unique_feature_gain"], 75)
    close(row["row_overlap"], 41.666667)
    close(row["correlation_similarity"], 100)
    close(row["missing_value_overlap"], 100)
    close(row["compatibility_score"], 53.339286)
    assert row["primary_key"] == "id"
    assert row["key_info"] == "Matched primary key 'id' with 5 overlapping records."
    assert row["new_columns"] == ["purchase_amount", "date", "category"]
    ratios = dict(compat.name_matches(customers, purchases))
    for name, wanted in (("id", 1.0), ("name", 0.5), ("age", 0.571429), ("signup_date", 0.533333)):
        close(ratios[name], wanted)


def test_recommend(customers, purchases):
    row = plans.recommend_pair(customers, purchases, "customers", "purchases").first()
    assert row["suggested_strategy"] == "left_join"
    assert row["recommendation"] == "FUSE"
    close(row["estimated_fused_quality"], 79.85)
    close(row["fusion_gain_score"], -11.94)
    close(row["confidence_score"], 71.3)
    assert row["reasoning"][0] == "Fusion strategy 'LEFT_JOIN' is recommended."
    assert row["reasoning"][2] == "Adding columns from Dataset B expands features from 4 to 7 features."
    assert row["reasoning"][-1] == "Compatibility score is 53.34/100 based on schema and data type alignments."


@pytest.mark.parametrize("how, rows", [("inner", 5), ("left", 10), ("right", 7), ("outer", 12)])
def test_join_rows(customers, purchases, how, rows):
    out = fuse.join(customers, purchases, "id", how)
    assert out.count() == rows
    assert out.columns == ["id", "name", "age", "signup_date", "purchase_amount", "date", "category"]
    assert out.where("id is null").count() == 0


def test_union_rows(customers, purchases):
    out = fuse.union(customers, purchases)
    assert out.count() == 17
    assert out.columns == sorted(out.columns)


def test_left_join_statistics(customers, purchases):
    fused, stats, _ = plans.fuse_tables(customers, purchases, "left_join")
    row = stats.first()
    assert (row["rows_after"], row["cols_after"], row["missing_cells"]) == (10, 7, 18)
    assert row["primary_key"] == "id"
    assert dict(fused.dtypes)["signup_date"] == "timestamp_ntz"
    assert dict(fused.dtypes)["date"] == "string"


def test_left_join_imputed(customers, purchases, tmp_path, spark):
    fused, stats, paths = plans.fuse_tables(
        customers, purchases, "left_join", impute_gaps=True, export_to=str(tmp_path))
    row = fused.where("id = 10").first()
    close(row["purchase_amount"], 79.0625)
    assert row["date"] == "2026-01-01" and row["category"] == "Books"
    close(fused.where("id = 3").first()["age"], 30.0)
    assert stats.first()["missing_cells"] == 0
    assert spark.read.csv(paths["csv"], header=True).count() == 10
    assert spark.read.json(paths["json"]).count() == 10


def test_profile_table_and_reports(customers, purchases):
    found = plans.profile_table(customers, "customers", target="name", order_by=["id"])
    assert found["profile"].first()["null_cells"] == 2
    assert found["class_balance"].count() == 10
    assert found["null_heatmap"].where("null_percent > 0").count() == 2
    profiles = found["profile"].unionByName(plans.profile_row(purchases, "purchases"))
    compared = compat.compare(customers, purchases, "customers", "purchases")
    overview = {r["metric"]: (r["value_a"], r["value_b"]) for r in report.overview(profiles, compared).collect()}
    assert overview["Number of Rows"] == ("10", "7")
    assert overview["Quality Score"] == ("87.38/100", "91.79/100")
    assert report.quality(profiles, compared).count() == 7
    detail = {r["attribute"]: (r["score"], r["detail"]) for r in report.compat(compared).collect()}
    assert detail["Row Key Overlap"] == ("41.67%", "Matched primary key 'id' with 5 overlapping records.")
    _, stats, _ = plans.fuse_tables(customers, purchases, "left_join")
    lines = {r["attribute"]: r["value"] for r in report.fusion(stats).collect()}
    assert lines["Resulting Rows"] == "10" and lines["Missing Cells Ratio"] == "18 (25.71%)"
    done = report.action(plans.recommend_pair(customers, purchases)).first()
    assert (done["action_text"], done["quality_band_a"]) == ("FUSE DATASETS", "good")


def test_all_estimates(customers, purchases):
    profiles = plans.profile_row(customers, "a").unionByName(plans.profile_row(purchases, "b"))
    pairs = recommend.pair_features(profiles, compat.compare(customers, purchases))
    found = {r["strategy"]: r["estimated_quality"] for r in recommend.estimate_all(pairs).collect()}
    close(round(found["left_join"], 2), 79.85)
    assert set(found) == set(recommend.STRATEGIES)
    assert pairs.select(F.col("only_a"), F.col("only_b"), F.col("all_columns")).first() == (3, 3, 7)
