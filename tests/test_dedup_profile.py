import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reviewmill.config import PRESETS
from reviewmill.operators import dedup, labels, profile
from reviewmill.session import literal_table
from reviewmill.sources import reviews as sources

LONG = " ".join(f"w{i}" for i in range(15))
SHORT = " ".join(f"w{i}" for i in range(14))


def table(spark, rows):
    return literal_table(spark, rows, "id bigint, text string")


def test_keep_first_long_copy_only(spark):
    rows = table(spark, [(7, LONG), (3, LONG), (9, LONG), (1, SHORT), (2, SHORT), (4, LONG.upper()), (5, None), (6, None)])
    kept = sorted(r["id"] for r in dedup.dedup_reviews(rows, "text", "id").collect())
    assert kept == [1, 2, 3, 4, 5, 6]
    assert sorted(r["id"] for r in dedup.dedup_long(rows, "text", "id").collect()) == [3, 4]


def test_members_and_groups(spark):
    rows = table(spark, [(7, LONG), (3, LONG), (2_000_009, LONG), (1, SHORT), (2, SHORT), (5, None), (6, None), (8, "x")])
    raw = {r["id"]: r["n_copies"] for r in dedup.raw_duplicates(rows, "text", "id").collect()}
    assert raw == {7: 3, 3: 3, 2_000_009: 3, 1: 2, 2: 2, 5: 2, 6: 2}
    far = 1 << 40  # ids as given per partition lie far apart; a group stays whole
    rows = rows.withColumn("id", F.when(F.col("id") == 7, far).otherwise(F.col("id")))
    groups = dedup.duplicate_groups(rows, "text", "id").orderBy("id").collect()
    assert [(g["group_id"], g["id"], g["n_copies"]) for g in groups] == [(3, 3, 3), (3, 2_000_009, 3), (3, far, 3)]


def test_hot_group(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit(LONG)).otherwise(F.col("id").cast("string")).alias("text"))
    members = dedup.duplicate_members(rows, "text", "id").collect()
    assert len(members) == 1000 and {(r["group_id"], r["n_copies"]) for r in members} == {(0, 1000)}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from([LONG, LONG + " x", SHORT, ""]), min_size=1, max_size=12))
def test_dedup_is_idempotent_and_unique(spark, texts):
    rows = table(spark, list(enumerate(texts)))
    once = dedup.dedup_reviews(rows, "text", "id")
    kept = [(r["id"], r["text"]) for r in once.collect()]
    again = [(r["id"], r["text"]) for r in dedup.dedup_reviews(once, "text", "id").collect()]
    assert sorted(kept) == sorted(again)
    long_texts = [text for _, text in kept if len(text.split()) >= 15]
    assert len(long_texts) == len(set(long_texts))
    assert sum(len(t.split()) < 15 for _, t in kept) == sum(len(t.split()) < 15 for t in texts)


def test_profile(spark):
    rows = table(spark, [(1, "a"), (2, None), (3, "a"), (4, "b")])
    assert {r["column_name"]: (r["data_type"], r["non_null"]) for r in profile.column_profile(rows).collect()} == {
        "id": ("bigint", 4), "text": ("string", 3),
    }
    assert {r["column_name"]: r["n_null"] for r in profile.null_counts(rows).collect()} == {"id": 0, "text": 1}
    assert [tuple(r) for r in profile.value_counts(rows, "text").collect()] == [("a", 2), ("b", 1)]
    assert [r["id"] for r in profile.head_rows(rows, "id", 2).collect()] == [1, 2]
    assert [r["id"] for r in profile.tail_rows(rows, "id", 2).collect()] == [4, 3]
    stages = profile.stage_counts(rows, [("text", F.col("text").isNotNull()), ("a", F.col("text") == "a")]).collect()
    assert [(r["stage"], r["n_before"], r["n_after"], r["n_removed"]) for r in stages] == [("text", 4, 3, 1), ("a", 3, 2, 1)]


@pytest.mark.parametrize("platform,expected,unmapped", [
    ("threads", ["negative", "positive", None, None, None], {"NEUTRAL", "Positive ", None}),
    ("twitter", ["negative", None, None, None, None], {"positive", "NEUTRAL", "Positive "}),
])
def test_label_maps(spark, platform, expected, unmapped):
    config = PRESETS[platform]
    rows = literal_table(
        spark, [(0, "Negative"), (1, "positive"), (2, "NEUTRAL"), (3, None), (4, "Positive ")], "id int, sentiment_true string"
    )
    mapped = labels.standardize_labels(rows, "sentiment_true", config.label_map).orderBy("id").collect()
    assert [r["sentiment_true_clean"] for r in mapped] == expected
    audit = labels.unmapped_labels(rows, "sentiment_true", config.label_map, config.unmapped_includes_null)
    assert {r[0] for r in audit.collect()} == unmapped


def test_csv_round_trip(spark, tmp_path):
    rows = table(spark, [(1, 'says "hi",\nthen leaves '), (2, " blank "), (3, "a\\b")])
    sources.write_csv(rows, str(tmp_path / "csv"))
    back = sources.read_csv(spark, str(tmp_path / "csv"), "text string, id bigint")
    assert sorted((r["id"], r["text"]) for r in back.collect()) == sorted((r["id"], r["text"]) for r in rows.collect())
    assert sources.with_review_id(back).select("review_id").distinct().count() == 3
    inferred = sources.read_csv(spark, str(tmp_path / "csv"))
    assert dict(inferred.dtypes) == {"id": "int", "text": "string"}


def test_row_numbers_have_no_gaps(spark):
    rows = literal_table(spark, [(i, "hot" if i % 3 else None) for i in range(500)], "id bigint, name string").repartition(7)
    got = sorted(sources.with_row_numbers(rows, "name", "id").collect(), key=lambda r: r["row_number"])
    assert [r["row_number"] for r in got] == list(range(1, 501))
    assert [(r["name"], r["id"]) for r in got] == [(None, i) for i in range(0, 500, 3)] + [("hot", i) for i in range(500) if i % 3]
    assert sources.with_row_numbers(rows.filter("id < 0"), "id").count() == 0
