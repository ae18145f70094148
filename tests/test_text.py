import pytest
from pyspark.sql import functions as F

from reviewmill.config import PRESETS
from reviewmill.functions import text as tx
from reviewmill.operators.lemma import lemma_map, lemmatize
from reviewmill.session import literal_table, with_once

CONFIG = PRESETS["threads"].with_(stop_words=("is", "than", "the"))


def apply(spark, values, expression):
    rows = literal_table(spark, list(enumerate(values)), "i int, text string")
    out = with_once(rows, out=expression(F.col("text"))).orderBy("i")
    return [row["out"] for row in out.collect()]


def test_brands_rewrite_whole_words_in_rule_order(spark):
    got = apply(
        spark,
        ["X is better than Twt", "fb/meta", "thread threads treads", "xbox", "éx"],
        lambda text: tx.normalize_brands(text, CONFIG.brand_rules),
    )
    assert got == ["twitter is better than twitter", "facebook/facebook", "threads threads threads", "xbox", "éx"]


def test_emoji_join_and_specials_separate(spark):
    got = apply(
        spark,
        ["good😀bad", "good-bad", "keycap 1️⃣ ok ❤️ 👍🏽x", "★y", "a👨‍👩‍👧b"],
        lambda text: tx.clean_text(text, CONFIG.with_(brand_rules=())),
    )
    assert got == ["goodbad", "good bad", "keycap ok x", "y", "ab"]


def test_urls_go_without_a_word_boundary(spark):
    got = apply(spark, ["awwwesome", "see http://x.com now", "www.a.b\nhttps://c d"], tx.strip_urls)
    assert got == ["a", "see  now", "\n d"]


def test_contractions_split_and_apostrophes_vanish(spark):
    got = apply(spark, ["cannot don't gonna lemmey cannots", None, "  "], lambda text: tx.clean_tokens(text, CONFIG))
    assert got == [["can", "not", "don", "t", "gon", "na", "lemmey", "cannots"], [], []]


def test_negations_survive_the_stop_list(spark):
    config = PRESETS["twitter"]
    got = apply(spark, ["this is not a good app, no never"], lambda text: tx.clean_text(text, config))
    assert got == ["not good no never"]


@pytest.mark.parametrize("words,expected", [(14, False), (15, True), (16, True)])
def test_long_review_boundary(spark, words, expected):
    text = "\t " + "  ".join(f"w{i}" for i in range(words)) + " \n"
    assert apply(spark, [text], tx.has_min_words) == [expected]


def test_long_review_edge_inputs(spark):
    assert apply(spark, [None, "", "   "], tx.has_min_words) == [False, False, False]
    assert apply(spark, ["a b", "a"], lambda t: tx.has_min_words(t, 1)) == [True, True]


def test_topic_tokens(spark):
    got = apply(spark, ["Ünïcode café_x a _skip 12ab34 " + "z" * 16], tx.topic_tokens)
    assert got == [["unicode", "cafe_x", "ab"]]


def test_ngrams(spark):
    rows = literal_table(spark, [(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    got = [r[0] for r in rows.select(tx.word_ngrams(F.col("t"), 1, 2)).collect()]
    assert got == [["a", "b", "c", "a b", "b c"], ["a"], []]


def test_noun_lemmas(spark):
    words = literal_table(
        spark, [(w,) for w in ("cats", "churches", "wolves", "berries", "men", "news", "went", "boxes")], "word string"
    )
    known = literal_table(
        spark, [(w,) for w in ("cat", "church", "wolf", "berry", "man", "news", "go", "box")], "lemma string"
    )
    irregular = literal_table(spark, [("went", "go")], "word string, lemma string")
    got = {r["word"]: r["lemma"] for r in lemma_map(words, known, irregular).collect()}
    assert got == {
        "cats": "cat", "churches": "church", "wolves": "wolf", "berries": "berry", "men": "man", "went": "go", "boxes": "box",
    }


def test_lemmatize_keeps_order_and_empty_rows(spark):
    rows = literal_table(spark, [(1, ["cats", "see", "cat", "cats"]), (2, [])], "id bigint, tokens array<string>")
    got = {r["id"]: r["tokens"] for r in lemmatize(rows, "id", "tokens").collect()}
    assert got == {1: ["cat", "see", "cat", "cat"], 2: []}


def test_costly_column_is_evaluated_once(spark):
    rows = spark.range(3).select(F.col("id"), F.concat(F.lit("a b "), F.col("id").cast("string")).alias("text"))
    out = with_once(rows, tokens=tx.clean_tokens(F.col("text"), CONFIG))
    plan = out.filter(F.size("tokens") > 0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
