"""Stored profiles: equal to fresh ones, and only changed files are read."""

import pytest
from blendscope import plans, profile, quality
from blendscope.operators import rowindex
from blendscope.plans import stored
from pyspark.sql import functions as F


def part(spark, first, n):
    i = F.col("id")
    return spark.range(first, first + n).select(
        (i % 7).cast("int").alias("small"), F.when(i % 5 > 0, (i * 37 % 1000) / 8.0).alias("x"), (i % 3 == 0).alias("flag"),
        F.when(i % 4 > 0, F.concat(F.lit("t"), i % 11)).alias("text"), (i % 13).cast("decimal(12,2)").alias("money"),
        F.lit(None).cast("double").alias("empty"), (1e9 + i % 2).alias("far"))


def same(a, b):
    one, two = ({r["column"]: r.asDict() for r in df.collect()} for df in (a, b))
    assert one.keys() == two.keys()
    for c in one:
        for k, v in one[c].items():
            assert two[c][k] == (pytest.approx(v, rel=1e-9, abs=1e-9) if isinstance(v, float) else v), (c, k)


@pytest.fixture
def places(tmp_path):
    return str(tmp_path / "a folder+more"), str(tmp_path / "store")


def test_appended_file_is_the_only_one_read(spark, places):
    path, store = places
    part(spark, 0, 900).coalesce(1).write.parquet(path)
    assert not plans.is_current(spark, path, store)
    assert plans.refresh(spark, path, store).count() == 1 and plans.is_current(spark, path, store)
    part(spark, 600, 500).coalesce(1).write.mode("append").parquet(path)
    before = {r.path for r in stored.stored_manifest(spark, store).collect()}
    read = plans.refresh(spark, path, store).collect()
    assert len(read) == 1 and read[0].path not in before
    assert plans.refresh(spark, path, store).count() == 0
    df = spark.read.parquet(path)
    same(plans.stored_column_profile(spark, path, store), profile.column_profile(df))
    assert plans.stored_duplicates(spark, store).first() == profile.duplicate_rows(df).first()


def test_unchanged_files_are_not_opened(spark, places, monkeypatch):
    path, store = places
    part(spark, 0, 50).coalesce(1).write.parquet(path)
    plans.refresh(spark, path, store)
    monkeypatch.setattr(stored, "_states", lambda *_: pytest.fail("a file was read again"))
    assert plans.stored_quality(spark, path, store).count() == 1


def test_replaced_and_removed_files(spark, places):
    path, store = places
    part(spark, 0, 400).repartition(3).write.parquet(path)
    plans.refresh(spark, path, store)
    part(spark, 5000, 200).repartition(2).write.mode("overwrite").parquet(path)
    assert not plans.is_current(spark, path, store)
    got, fresh = plans.stored_quality(spark, path, store).first(), quality.score(spark.read.parquet(path)).first()
    assert got.asDict() == pytest.approx(fresh.asDict())


def test_no_store_and_no_rows(spark, places):
    path, store = places
    part(spark, 0, 0).write.parquet(path)
    with pytest.raises(FileNotFoundError):
        plans.stored_column_profile(spark, path, store)
    plans.refresh(spark, path, store)
    with pytest.raises(ValueError, match="empty"):
        plans.stored_column_profile(spark, path, store)


def test_weighted_quantiles_equal_those_of_repeated_rows(spark):
    rows = spark.range(3000).select((F.col("id") * 7919 % 1013 / 4.0).alias("x"))
    counts = rows.groupBy("x").agg(F.count("*").alias("w"))
    facts = {"x": tuple(rows.agg(F.count("x"), F.min("x"), F.max("x")).first())}
    plain = rowindex.exact_quantiles(rows, ["x"], [0.1, 0.25, 0.5, 0.9])
    for small in (0, 50_000):
        assert rowindex.exact_quantiles(counts, ["x"], [0.1, 0.25, 0.5, 0.9], facts, small=small, small_bucket=10, weight="w") == plain
