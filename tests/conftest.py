import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from blendscope.session import local_table  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("blendscope-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def customers(spark):
    names = ["Alice", "Bob", "Charlie", "David", "Eva", "Frank", "Grace", "Henry", "Ivy", "Jack"]
    ages = [25.0, 30.0, None, 22.0, 28.0, 35.0, 40.0, None, 29.0, 31.0]
    rows = [(i + 1, names[i], ages[i], f"2026-01-{i + 1:02d}") for i in range(10)]
    return local_table(spark, rows, "id bigint, name string, age double, signup_date string")


@pytest.fixture(scope="session")
def purchases(spark):
    rows = [
        (1, 100.5, "2026-01-01", "Electronics"), (2, 20.0, "2026-01-02", "Books"), (3, None, "2026-01-03", "Clothing"),
        (4, 150.75, "2026-01-04", "Electronics"), (5, 45.0, "2026-01-05", "Books"),
        (11, 200.0, "2026-01-11", "Clothing"), (12, 85.2, "2026-01-12", "Home"),
    ]
    return local_table(spark, rows, "id bigint, purchase_amount double, date string, category string")
