"""Kinds of values in VARIANT columns."""

import pytest
from blendscope import compat, fuse, profile, quality, variant
from pyspark.sql import functions as F

CELLS = ["1", "-12345678901234567890", "1.5", "1e3", "true", '"x"', "abc", "null", None, '{"b": 1, "a": [2]}', "[1]", "", "2026-01-01", '{"a": 1']


@pytest.fixture(scope="module")
def cells(spark):
    rows = [(i, v, "t" if i % 2 else None) for i, v in enumerate(CELLS)]
    return variant.to_variant(spark.createDataFrame(rows, "i int, v string, plain string"))


def kinds(df, **how):
    return {(r["column"], r["kind"]): r["n"] for r in variant.value_kinds(df, **how).collect()}


def test_no_cell_is_lost(cells):
    got = cells.select(F.to_json("v").alias("j"), F.col("v").isNull().alias("n")).collect()
    assert sum(r.n for r in got) == 1 and [r.j for r in got if r.j and "abc" in r.j] == ['"abc"']


def test_kinds(cells):
    assert kinds(cells, columns=["v"]) == {
        ("v", "integer"): 2, ("v", "number"): 2, ("v", "boolean"): 1, ("v", "text"): 5, ("v", "object"): 1, ("v", "array"): 1}
    assert kinds(cells)["plain", "text"] == 7


def test_merged_types(spark):
    df = variant.to_variant(spark.createDataFrame([("1", '{"a": 1}', None), ("2.5", '{"b": "x"}', None)], "n string, o string, e string"))
    got = {r["column"]: r["type"] for r in variant.merged_types(df).collect()}
    assert got == {"n": "DECIMAL(11,1)", "o": "OBJECT<a: BIGINT, b: STRING>", "e": "VOID"} or got["n"].startswith("DECIMAL")


def test_consistency_counts_mixed_variants(spark):
    df = spark.createDataFrame([("1", "1", 1), ("x", "2", 2), (None, None, 3)], "mixed string, same string, i int")
    scored = quality.components(variant.to_variant(df)).first()
    assert scored["data_consistency"] == pytest.approx(100 * 2 / 3)
    assert quality.components(df, consistency="content").first()["data_consistency"] == pytest.approx(100 * 2 / 3)
    assert scored["missing_values"] == pytest.approx(100 * (1 - 2 / 9))


def test_other_operators_read_variants_as_json(spark):
    df = variant.to_variant(spark.createDataFrame([('{"b":1,"a":2}', 1), ('{"a":2,"b":1}', 1), ("null", 2)], "v string, k int"), ["v"])
    assert profile.duplicate_rows(df).first()["duplicate_rows"] == 1
    row = {r["column"]: r for r in profile.column_profile(df).collect()}["v"]
    assert (row["null_count"], row["unique_count"], row["mode"]) == (1, 1, '{"a":2,"b":1}')
    assert fuse.join(df, df, "k", "inner").count() == 2 and compat.key_overlap(df, df, "v").first()["n_both"] == 1


def test_tables_without_variants_or_rows(spark):
    assert variant.value_kinds(spark.range(3)).count() == variant.merged_types(spark.range(3)).count() == 0
    empty = variant.to_variant(spark.createDataFrame([], "v string"))
    assert variant.value_kinds(empty).count() == 0 and variant.mixed_variants(empty) == []
