"""Best name ratios with few comparisons, and samples by place in files."""

import random
import runpy
import sys
from pathlib import Path

import pytest
from blendscope import ml
from blendscope.functions import names
from blendscope.session import arrow_uri
from pyspark.sql import functions as F

PARTS = ["id", "customer", "order", "date", "total", "price", "name", "x", "é", "_", "2"]


def schema(rng, n):
    return ["_".join(rng.choice(PARTS) for _ in range(rng.randint(1, 4))) + rng.choice(["", "s", "id"]) for _ in range(n)]


def test_best_ratios_equal_the_cross_product():
    rng = random.Random(1)
    for _ in range(60):
        a, b = schema(rng, rng.randint(0, 25)), schema(rng, rng.randint(0, 25))
        want = [max((names.name_ratio(x, y) for y in b), default=0.0) for x in a]
        assert names.best_of(a, b) == want
    assert names.best_of(["", "a"], ["", "b"]) == [1.0, 0.0] and names.best_of([], ["a"]) == []


def test_wide_schemas_need_few_exact_ratios():
    rng = random.Random(2)
    a, b = (sorted(set(schema(rng, 1000))) for _ in range(2))
    calls = []

    def counted(x, y):
        calls.append(1)
        return names.name_ratio(x, y)

    names.best_of(a, b, counted)
    assert len(calls) < len(a) * len(b) / 5


def test_long_names_stay_below_the_bound(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choice("ab_c") for _ in range(rng.randint(0, 260))), "".join(rng.choice("abd") for _ in range(rng.randint(0, 260)))) for _ in range(60)]
    got = spark.createDataFrame(rows, "x string, y string").select("x", "y", names.ratio_bound(F.col("x"), F.col("y")).alias("b")).collect()
    assert all(names.name_ratio(r.x, r.y) <= r.b + 1e-12 for r in got)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sample") / "rows")
    spark.range(4000).select((F.col("id") % 4).alias("k")).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


def test_file_sample_is_even_among_repeated_rows(stored):
    rows = ml.file_sample(stored, 800).collect()
    assert len(rows) == 800 and stored.columns == ["k"]
    assert all(150 < sum(r.k == k for r in rows) < 250 for k in range(4))
    assert ml.file_sample(stored, 800).collect() == rows != ml.file_sample(stored, 800, seed=1).collect()
    assert ml.file_sample(stored, 10_000).count() == 4000


def test_file_sample_moves_no_rows(stored):
    plan = ml.file_sample(stored, 10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_hadoop_names_of_s3():
    assert [arrow_uri(p) for p in ("s3a://b/x", "S3N://b", "s3://b/x", "/tmp/x", "file:///x", "hdfs://h/x")] == [
        "s3://b/x", "s3://b", "s3://b/x", "/tmp/x", "file:///x", "hdfs://h/x"]


def test_entry_without_what_the_training_operators_need(monkeypatch):
    entry = Path(__file__).resolve().parents[1] / "__spark_entry__.py"
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("blendscope.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)  # importing it raises ImportError
    with pytest.warns(UserWarning, match="not registered"):
        left = runpy.run_path(str(entry))["queries"]()
    assert "q8_lineitem_quality" in left and not [n for n in left if n.startswith("op") or n == "pipeline"]
