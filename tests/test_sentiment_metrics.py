import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reviewmill.config import IDIOMS
from reviewmill.operators import metrics, sentiment, split, words
from reviewmill.operators.language import LanguageModel, language_profiles
from reviewmill.operators.sentiment import Lexicon
from reviewmill.session import literal_table

LEXICON = Lexicon(
    [("good", 1.9), ("bad", -2.5), ("no", -1.2), ("kind", 2.4), ("ass", -2.5), ("heart", 0.5), ("broken", -2.1)],
    [("really", 0.293), ("barely", -0.293)],
    [("not",), ("never",), ("without",)],
    IDIOMS,
)


def score(spark, texts, lexicon=LEXICON):
    rows = literal_table(spark, [(i, t.split()) for i, t in enumerate(texts)], "id int, tokens array<string>")
    return [r["compound"] for r in sentiment.compound_scores(rows, "id", "tokens", lexicon).orderBy("id").collect()]


def compound(total):
    return round(total / math.sqrt(total * total + 15), 4)


def test_scoring_rules(spark):
    cases = {
        "good": 1.9,
        "really good": 1.9 + 0.293,
        "barely bad": -2.5 + 0.293,
        "not good": 1.9 * -0.74,
        "not really good": (1.9 + 0.293) * -0.74,
        "really x good": 1.9 + 0.293 * 0.95,
        "really x y good": 1.9 + 0.293 * 0.9,
        "good bad": 1.9 - 2.5,
        "hit": 0.0,
        "": 0.0,
        "no good": 1.9 * -0.74,
        "no x good": -1.2 + 1.9 * -0.74,
        "least good": 1.9 * -0.74,
        "at least good": 1.9,
        "never so good": 1.9 * 1.25,
        "without doubt good": 1.9,
        "kind of good": 1.9,
        "x y z bad ass": 1.5 + 1.5,
        "x broken heart": -2.1 + 0.5,
        "x y broken heart": -2.1 - 2.9,
    }
    assert score(spark, list(cases)) == [compound(total) for total in cases.values()]


def test_lexicon_as_tables(spark):
    tables = Lexicon(
        literal_table(spark, list(LEXICON.valences), "term string, valence double"),
        literal_table(spark, list(LEXICON.boosters), "term string, increment double"),
        literal_table(spark, list(LEXICON.negators), "term string"),
    )
    texts = ["not really good", "bad", "x"]
    assert score(spark, texts, tables) == score(spark, texts)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from("good bad really not no x".split()), max_size=40).map(" ".join), min_size=1, max_size=8))
def test_compound_is_bounded(spark, texts):
    assert all(-1.0 <= value <= 1.0 for value in score(spark, texts))


def test_kmeans_and_labels(spark):
    values = [-0.9, -0.8, -0.85, 0.0, 0.01, -0.02, 0.7, 0.8, 0.75, 0.9]
    rows = literal_table(spark, list(enumerate(values)), "id int, compound double")
    centres = sentiment.kmeans_centroids(rows)
    assert np.allclose(centres, [-0.85, -0.01 / 3, 0.7875])
    labelled = [r["sentiment"] for r in sentiment.label_sentiment(rows).orderBy("compound").collect()]
    assert labelled == ["negative"] * 3 + ["neutral"] * 3 + ["positive"] * 4


def test_split_quotas_are_exact(spark):
    rows = [(i, "a") for i in range(10)] + [(i, "b") for i in range(10, 17)] + [(i, "c") for i in range(17, 20)]
    parts = split.stratified_split(literal_table(spark, rows, "id bigint, label string"), "id", "label").collect()
    assert len(parts) == 20 and len({r["id"] for r in parts}) == 20
    test = [r for r in parts if r["part"] == "test"]
    assert len(test) == 4
    assert {label: sum(r["label"] == label for r in test) for label in "abc"} == {"a": 2, "b": 1, "c": 1}


def test_split_takes_the_smallest_keys_of_a_large_class(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 4 == 0, "hot").otherwise("rest").alias("label"))
    parts = split.stratified_split(rows, "id", "label", seed=7).withColumn("key", split.shuffle_key(F.col("id"), 7))
    edges = parts.groupBy("label").agg(
        F.max(F.when(F.col("part") == "test", F.col("key"))).alias("last"),
        F.min(F.when(F.col("part") == "train", F.col("key"))).alias("first"),
        F.count_if(F.col("part") == "test").alias("n"),
    ).collect()
    assert {r["label"]: r["n"] for r in edges} == {"hot": 1000, "rest": 3000}
    assert all(r["last"] < r["first"] for r in edges)


def test_metrics_with_unseen_and_unpredicted_classes(spark):
    pairs = [("negative", "negative"), ("negative", "positive"), ("neutral", "negative"), ("neutral", "negative"), ("negative", "negative")]
    rows = literal_table(spark, pairs, "t string, p string")
    overall = metrics.overall_scores(rows, "t", "p").first()
    assert overall["accuracy"] == pytest.approx(0.4)
    assert overall["precision_macro"] == pytest.approx((0.5 + 0 + 0) / 3)
    assert overall["recall_macro"] == pytest.approx((2 / 3 + 0 + 0) / 3)
    report = {r["label"]: r for r in metrics.classification_report(rows, "t", "p").collect()}
    assert report["negative"]["f1"] == pytest.approx(4 / 7)
    assert report["positive"]["support"] == 0
    assert report["weighted avg"]["recall"] == pytest.approx(0.4)
    matrix = {r["true_label"]: (r["negative"], r["neutral"], r["positive"]) for r in metrics.confusion_counts(rows, "t", "p").collect()}
    assert matrix == {"negative": (2, 0, 1), "neutral": (2, 0, 0), "positive": (0, 0, 0)}
    pct = {r["true_label"]: r["negative"] for r in metrics.confusion_row_pct(rows, "t", "p").collect()}
    assert pct["neutral"] == 100.0 and pct["positive"] is None


def test_word_counts(spark):
    rows = literal_table(spark, [("p", ["a", "b", "a"]), ("q", ["b", "c"]), ("q", [])], "g string, t array<string>")
    assert [tuple(r) for r in words.top_words(rows, "t", 2).collect()] == [("a", 2), ("b", 2)]
    top = {(r["g"], r["word"]): r["rank"] for r in words.top_words_by(rows, "t", ("g",), 1).collect()}
    assert top == {("p", "a"): 1, ("q", "b"): 1}
    plan = words.top_words_by(rows, "t", ("g",), 1)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_box_stats(spark):
    rows = literal_table(spark, [("g", v) for v in (0.1, 0.2, 0.3, 0.4, 5.0)], "g string, v double")
    box = words.box_stats(rows, "v", "g").first()
    assert (box["q1"], box["median"], box["q3"]) == (0.2, 0.3, 0.4)
    assert (box["whisker_low"], box["whisker_high"], box["n_outliers"]) == (0.1, 0.4, 1)


def test_language_guards_and_accuracy(spark):
    train = literal_table(
        spark,
        [("en", "the weather is nice and the house is warm"), ("de", "das wetter ist gut und das haus ist warm")] * 3,
        "lang string, text string",
    )
    model = LanguageModel(language_profiles(train, "text", "lang"))
    texts = [(0, "the house is nice"), (1, "das haus ist gut"), (2, "the house"), (3, "the houses"), (4, "12345678901"), (5, None)]
    got = model.detect(literal_table(spark, texts, "id int, text string"), "id", "text").collect()
    assert {r["id"]: r["detected_lang"] for r in got} == {0: "en", 1: "de", 2: "unknown", 3: "en", 4: "unknown", 5: "unknown"}
