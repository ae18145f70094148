import duckdb
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000 + "end"
#: Nulls in every column, empty and very long texts, ties and repeated rows.
ODD = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n ", None, None, None), (None, "alone here", "en", "b", 10),
    (5, "one two three four five six seven eight nine ten eleven", "en", "b", 5), (6, "one two three four five six seven eight nine ten eleven", "en", "b", 5),
    (6, "one two three four five six seven eight nine ten eleven", "en", "b", 5), (7, LONG, "en", None, 1), (8, "ÀÉ wörter ΣΣ 数字 z", "de", "c", 3),
    (9, "single", "en", "c", 3), (None, None, None, None, None),
]
EXTRA = ["size", "fp", "shard", "target", "row_id", "mask", "key", "text_hash", "window", "score"]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with extra columns whose names the operators use themselves."""
    rows = spark.createDataFrame(ODD, SCHEMA)
    return rows.select("*", *[F.lit("x").alias(name) for name in EXTRA])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def duck():
    base = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels"):
        base.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return base
