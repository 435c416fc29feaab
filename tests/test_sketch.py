"""Set sketches: exact when small, merged without the rows, bounds that hold."""

import pytest
from pyspark.sql import functions as F

from blendscope import sketch
from blendscope.session import local_table


def found(df):
    return {(r["column"], r["family"]): (r["n"], r["low"], r["high"]) for r in df.collect()}


def test_small_sets_are_exact(spark):
    df = local_table(spark, [(1, 1.0, "", "x"), (1, 2.5, "a", None), (None, float("nan"), "a", None), (3, -0.0, None, None), (4, 0.0, "", "x")],
                     "i int, d double, t string, `odd.name` string")
    assert found(sketch.distinct(sketch.states(df))) == {
        ("i", "whole"): (3, 3, 3), ("d", "real"): (3, 3, 3), ("t", "text"): (2, 2, 2), ("odd.name", "text"): (1, 1, 1)}
    assert sketch.states(df, ["t"]).count() == 1 and sketch.states(df, []).count() == 0


def test_empty_table_and_all_null(spark):
    df = local_table(spark, [(None, None)], "i bigint, t string")
    for x in (df, df.where("false")):
        assert {k: v for k, v in found(sketch.distinct(sketch.states(x))).items() if v[0]} == {}
        full = local_table(spark, [(1, "a")], "i bigint, t string")
        assert all(r["n_both"] == r["low"] == r["high"] == 0 and r["jaccard"] == 0.0
                   for r in sketch.overlap(sketch.states(x), sketch.states(full)).collect())


@pytest.mark.parametrize("lg", [6, 10])
def test_bounds_hold_and_parts_merge(spark, lg):
    df = spark.range(60000, numPartitions=5).select(
        (F.col("id") % 30000).alias("a"), F.concat(F.lit("v"), F.col("id")).alias("b"), (F.col("id") % 40).alias("c"),
        (F.col("id") / 4).alias("d"))
    want = {("a", "whole"): 30000, ("b", "text"): 60000, ("c", "whole"): 40, ("d", "real"): 60000}
    parts = [sketch.states(df.where(F.col("d") * 4 % 3 == k), lg=lg) for k in range(3)]
    for got in (sketch.states(df, lg=lg), sketch.merge(parts[0].unionByName(parts[1]).unionByName(parts[2]), lg)):
        seen = found(sketch.distinct(got))
        assert seen.keys() == want.keys()
        assert all(low <= want[k] <= high for k, (_, low, high) in seen.items())
        assert seen["c", "whole"] == (40, 40, 40)
        assert seen["b", "text"][1] < seen["b", "text"][2]


def test_merge_of_whole_and_fraction_and_of_two_accuracies(spark):
    whole, real = local_table(spark, [(1,), (2,)], "x int"), local_table(spark, [(2.0,), (2.5,)], "x double")
    both = sketch.merge(sketch.states(whole, lg=12).unionByName(sketch.states(real, lg=8)))
    assert found(sketch.distinct(both)) == {("x", "real"): (3, 3, 3)}
    assert [r["lg"] for r in both.collect()] == [8]
    text = sketch.merge(sketch.states(whole).unionByName(sketch.states(whole.select(F.col("x").cast("string")))))
    assert found(sketch.distinct(text)) == {("x", "whole"): (2, 2, 2), ("x", "text"): (2, 2, 2)}


def test_overlap_by_kind(spark):
    a = local_table(spark, [(1, 1, "p"), (2, 2, "q")], "w int, m int, k string")
    b = local_table(spark, [(2, 2.0, 7), (3, 2.5, 8)], "w bigint, m double, k int")
    got = {r["column"]: r for r in sketch.overlap(sketch.states(a), sketch.states(b)).collect()}
    assert set(got) == {"w", "m"}  # a number never equals a text
    assert (got["w"]["family"], got["w"]["n_both"]) == ("whole", 1) and (got["m"]["family"], got["m"]["n_both"]) == ("real", 1)
    assert got["w"]["jaccard"] == pytest.approx(1 / 3)


@pytest.mark.parametrize("shared", [0, 30, 3000, 20000])
def test_overlap_bounds(spark, shared):
    a = spark.range(20000).select(F.col("id").alias("k"))
    b = spark.range(20000 - shared, 70000 - shared).select(F.col("id").alias("k"))
    r = sketch.overlap(sketch.states(a, lg=10), sketch.states(b, lg=10)).first()
    assert r["low"] <= shared <= r["high"] <= 23000


def test_catalog_pairs_read_each_table_once(spark):
    tables = {n: spark.range(k, k + 500).select(F.col("id").alias("k"), F.lit(n).alias("t")) for n, k in (("z", 0), ("b", 100), ("a", 400))}
    df = sketch.catalog_overlap(tables)
    got = {(r["dataset_a"], r["dataset_b"], r["column"]): r["n_both"] for r in df.collect()}
    assert got == {("z", "b", "k"): 400, ("z", "a", "k"): 100, ("b", "a", "k"): 200, ("z", "b", "t"): 0, ("z", "a", "t"): 0, ("b", "a", "t"): 0}
    plan = df._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "Range (" not in plan
