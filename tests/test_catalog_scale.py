"""One-shuffle catalog comparison, split runs, cross-table Gram matrix, join sizes, against the plain ways."""

import itertools
import math
import random
import warnings

import numpy as np
import pytest
from blendscope import compat, fuse, plans, profile, rowindex
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def catalog(spark):
    i = F.col("id")
    base = spark.range(400)
    return {
        "plain": base.select(i.alias("id"), (i * 3 % 50).alias("amount"), F.when(i % 4 > 0, i * 1.5).alias("price"), F.concat(F.lit("c"), i % 9).alias("city")),
        "real": base.select((i * 2).cast("double").alias("id"), (i % 31).alias("amount"), F.when(i % 3 > 0, i * 0.5).alias("price")),
        "texts": base.select(i.cast("string").alias("id"), F.concat(F.lit("c"), i % 12).alias("city"), (i % 2 == 0).alias("flag")),
        "No Key": base.select((i % 60).alias("Amount"), F.when(i % 5 > 0, i * 2.5).alias("price"), F.lit(None).cast("string").alias("city")),
        "unique": base.select((i + 7).alias("amount"), (i * i % 17).alias("price")),
        "unique too": base.select((i + 300).alias("amount"), F.lit(1.0).alias("price")),
        "apart": base.select(i.alias("other")),
    }


def test_catalog_equals_pair_by_pair(spark, catalog):
    order = {n: [df.columns[0]] for n, df in catalog.items()}
    got = {(r.dataset_a, r.dataset_b): r.asDict() for r in compat.compare_all(catalog, order).collect()}
    assert list(got) == list(itertools.combinations(catalog, 2))
    for (x, y), row in got.items():
        want = compat.compare(catalog[x], catalog[y], x, y, order[x], order[y]).first().asDict()
        for k, v in want.items():
            assert row[k] == (pytest.approx(v, abs=1e-9) if isinstance(v, float) else v), (x, y, k)
    assert got["unique", "unique too"]["primary_key"] == "amount" and got["plain", "No Key"]["primary_key"] is None


def test_values_of_all_pairs_meet_once(spark, catalog, monkeypatch):
    calls = []
    plain = compat.value_index
    monkeypatch.setattr(compat, "value_index", lambda *a: calls.append(1) or plain(*a))
    for name in ("key_overlap", "value_overlap", "find_key", "distinct_counts"):
        monkeypatch.setattr(compat, name, lambda *a, **k: pytest.fail("a job for a single pair"))
    compat.compare_all(catalog)
    assert calls == [1]


def test_more_tables_than_bits_of_a_word(spark):
    tables = {f"t{k}": spark.range(k, k + 3).toDF("v") for k in range(70)}
    shared = compat.shared_values(compat.value_index(tables, {n: ["v"] for n in tables})).collect()
    got = {(r.a, r.b): r.n for r in shared}
    assert got == {(a, b): 3 - (b - a) for a in range(70) for b in range(a, min(70, a + 3))}


def test_large_integers_stay_apart(spark):
    a, b = (spark.createDataFrame([(2**53 + k,)], "v bigint") for k in (0, 1))
    c = spark.createDataFrame([(float(2**53),)], "v double")
    both = {(r.a, r.b, r.family): r.n for r in compat.shared_values(compat.value_index({"a": a, "b": b, "c": c}, {n: ["v"] for n in "abc"})).collect()}
    assert (0, 1, "whole") not in both and both[0, 2, "real"] == 1 and both[1, 2, "real"] == 1


# ---------------------------------------------------------------- runs of equal rows

def sizes(df):
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


@pytest.mark.parametrize("keep", [None, ["v"]])
def test_positions_with_a_third_of_rows_equal(spark, keep):
    i = F.col("id")
    df = spark.range(60_000).select(F.when(i % 3 == 0, F.lit(5)).otherwise(i).alias("k"), F.when(i % 3 == 0, F.lit("run")).otherwise(i.cast("string")).alias("v"))
    placed, total = rowindex.indexed(df, ["k"], keep=keep, chunk=1000)
    assert total == 60_000 and placed.columns == [*(keep or ["k", "v"]), "_idx"]
    rows = placed.orderBy("_idx").collect()
    assert [r._idx for r in rows] == list(range(total))
    keys = sorted((5 if k % 3 == 0 else k) for k in range(60_000))
    assert [5 if r.v == "run" else int(r.v) for r in rows] == keys


def test_a_run_is_spread_over_tasks(spark):
    df = spark.range(80_000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("k"))
    found = sizes(rowindex.indexed(df, ["k"], chunk=500)[0].where("k = 7"))
    assert len(found) == 8 and sum(found) == 40_001 and found[-1] < 2 * found[4]


def test_short_runs_take_the_plain_way(spark):
    df = spark.range(5000).select((F.col("id") % 4).alias("k"))
    assert rowindex.long_runs(df) == [] and len(rowindex.long_runs(df, chunk=100)) == 4
    one, two = (sorted(tuple(r) for r in rowindex.indexed(df, ["k"], chunk=c)[0].collect()) for c in (100, 10_000))
    assert one == two


# ---------------------------------------------------------------- cross-table correlation

def test_cross_correlation_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(1e6, 1, (500, 6))
    x[:, 3] += x[:, 0] - 1e6
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 5] = 2.0
    df = spark.createDataFrame([tuple(None if math.isnan(v) else float(v) for v in row) for row in x], ", ".join(f"c{k} double" for k in range(6)))
    got = profile.cross_correlation(df, ["c0", "c1"], ["c2", "c3", "c4", "c5"], {f"c{k}": 1e6 for k in range(6)})
    assert set(got) == {(a, b) for a in ("c0", "c1") for b in ("c2", "c3", "c4")}
    for (a, b), r in got.items():
        u, v = x[:, int(a[1])], x[:, int(b[1])]
        both = ~np.isnan(u) & ~np.isnan(v)
        assert r == pytest.approx(np.corrcoef(u[both], v[both])[0, 1], abs=1e-8)


def test_many_columns_take_one_pass(spark, monkeypatch):
    wide = spark.range(200).select("id", *[(F.col("id") * (k + 3) % 97 + F.lit(0.5)).alias(f"m{k}") for k in range(60)])
    other = wide.toDF("id", *[f"n{k}" for k in range(60)])
    calls = []
    plain = compat.agg_row
    monkeypatch.setattr(compat, "agg_row", lambda *a, **k: calls.append(1) or plain(*a, **k))
    row = compat.complementarity(wide, other, ["id"], ["id"]).first()
    assert len(calls) == 2 and row.compared_pairs == 61 * 61


# ---------------------------------------------------------------- join sizes

@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
@pytest.mark.parametrize("distinct", [True, False])
def test_estimate_equals_the_join(spark, how, distinct):
    rng = random.Random(5)
    a = spark.createDataFrame([(rng.choice([None, 1, 1, 2, 3]), rng.choice([None, 1.0, 2.0]), rng.choice("xy")) for _ in range(40)], "k int, v double, w string")
    b = spark.createDataFrame([(rng.choice([None, 1, 3, 4]), rng.choice([None, "p", "q"])) for _ in range(30)], "k bigint, v string")
    real = fuse.join(a, b, "k", how, distinct)
    rows = real.collect()
    got = fuse.estimate(a, b, "k", how, distinct).first()
    assert (got.n_rows, got.null_cells) == (len(rows), sum(v is None for r in rows for v in r))
    per_key = {}
    for r in rows:
        per_key[r.k] = per_key.get(r.k, 0) + 1
    assert got.largest_key_rows == max(per_key.values())


def test_estimate_beyond_64_bits(spark):
    big = spark.range(1).select(F.lit(1).alias("k"), F.lit(None).cast("string").alias("v"))
    assert fuse.estimate(big, big.where("k = 2"), "k").first().n_rows == 0
    with pytest.raises(ValueError, match="unknown join type"):
        fuse.estimate(big, big, "k", "cross")


def test_fuse_warns_of_a_blow_up(spark):
    a = spark.range(60).select(F.lit(1).alias("id"), F.col("id").alias("x"))
    b = spark.range(60).select(F.lit(1).alias("id"), F.col("id").alias("y"))
    with pytest.warns(UserWarning, match="3600 rows"):
        plans.fuse_tables(a, b, "inner_join", key="id", warn_above=10)
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        plans.fuse_tables(a, b, "inner_join", key="id", warn_above=100)
