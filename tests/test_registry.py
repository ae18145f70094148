"""The registered queries against their SQL, on the smallest tables."""

import duckdb
import pytest

from check import TABLES, canonical
from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "scan_reviews", "column_profile", "duplicate_groups", "dedup_reviews", "normalize_brands", "clean_text",
    "detect_language", "stage_counts", "platform_sentiment_share", "classification_report", "stratified_split",
    "tfidf_weights", "topic_coherence", "merge_topic_step", "representative_docs",
)


def test_every_sql_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_runs(spark):
    assert entry(spark).columns == ["sentiment", "word", "n", "rank"]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    base = duckdb.connect()
    for table in TABLES:
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got, want = queries()[name](spark, SF).toPandas(), base.execute(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
