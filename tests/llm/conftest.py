import pytest
from pyspark.sql import functions as F

from blendscope.llm.queries import prepare

VERY_LONG = "word other " * 20_000


@pytest.fixture(autouse=True, scope="session")
def prepared(spark):
    prepare(spark)


@pytest.fixture(scope="session")
def frame(spark):
    """A table from tuples and a schema in DDL."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def hard_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns that clash with results."""
    rows = [
        (1, None, None, None, 7), (2, "", "en", "a", 7), (3, VERY_LONG, "en", "a", 7), (4, " \t\n\x0b ", "de", None, 7),
        (5, "one two three four", "en", "b", 7), (6, "one two three four", "en", "b", 7), (6, "one two three four", "en", "b", 7),
        (None, "a text whose id is missing, mail x@y.zz", "en", "b", 7), (None, None, None, None, None),
        (7, "日本語 テキスト \U0001f600 é ́x <|endoftext|> it's", "ja", "c", 7), (8, "x" * 70_000 + "@", "en", "a", 7),
    ]
    schema = "doc_id bigint, text string, lang string, source string, start int"
    return spark.createDataFrame(rows, schema).withColumns({"n_chars": F.length("text").cast("bigint"), "key": F.lit("k")})
