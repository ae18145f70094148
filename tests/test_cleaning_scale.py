"""Steps of the cleaned and scored tables: only what can matter becomes a row."""

import contextlib
import io
from collections import Counter

from pyspark.sql import functions as F

from reviewmill.config import NOUN_ENDINGS
from reviewmill.functions import text as tx
from reviewmill.operators import features, language, lemma, sentiment
from reviewmill.session import literal_table

TEXTS = [
    "the cat and the hat", "der hund und die katze", "un perro y el gato", "", "  ", "a", "12 34", "ab", None,
    "Ünï cödé ñandú, 漢字 かな", "x\U0001d400y \U0001d401", "\U0001d402\U0001d403\U0001d404 z", "a-b--c  d", "the the the the the",
]


def plan_of(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("simple")
    return text.getvalue()


def _texts(spark):
    langs = ["en", "de", "es", None]
    rows = [(i, text, langs[i % 4]) for i, text in enumerate(TEXTS)] + [(0, "die katze und der hat", "de"), (None, "the hund", "en")]
    return literal_table(spark, rows, "id bigint, text string, lang string")


def _grams(spark):
    """(lang, gram) of every trigram, by the regular expression."""
    lettered = language._lettered(_texts(spark), "text", "lang")
    return [(r["lang"], r["gram"]) for r in language._gram_rows(lettered, "lang").collect()]


def test_profiles_count_every_gram(spark, monkeypatch):
    want = Counter(_grams(spark))
    assert any("?" in gram for _, gram in want) and any(lang is None for lang, _ in want)
    for size in (7, 1_000_000):
        monkeypatch.setattr(language, "COUNTED", size)
        profiles = language.language_profiles(_texts(spark).coalesce(1), "text", "lang")
        assert {(r["lang"], r["gram"]): r["n"] for r in profiles.collect()} == want
    assert "regexp_extract_all" not in plan_of(profiles)  # was a row for every trigram


def test_models_in_tasks_and_joined_models_agree(spark, monkeypatch):
    monkeypatch.setattr(language, "SUMMED", 9)
    model = language.LanguageModel(language.language_profiles(_texts(spark), "text", "lang"))
    found = model.detect(_texts(spark), "id", "text")
    assert model.in_tasks and "regexp_extract_all" not in plan_of(found)  # was a row for every trigram
    monkeypatch.setattr(language, "GAINS_IN_TASKS", 10)
    joined = language.LanguageModel(language.language_profiles(_texts(spark), "text", "lang"))
    assert not joined.in_tasks
    rows = sorted(map(str, found.collect()))
    assert rows == sorted(map(str, joined.detect(_texts(spark), "id", "text").collect())) and len(rows) == len(TEXTS) + 2


def test_a_model_without_languages_detects_nothing(spark):
    empty = literal_table(spark, [], "lang string, gram string, n bigint")
    found = language.LanguageModel(empty).detect(_texts(spark), "id", "text")
    assert {r["detected_lang"] for r in found.collect()} == {language.UNKNOWN}


def test_only_words_with_an_ending_are_looked_up(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(lemma, "materialize", lambda df, name, real=lemma.materialize: plans.append(plan_of(df)) or real(df, name))
    words = ["cat", "cats", "boxes", "box", "men", "man", "wolves", "wolf", "ses", "s", "cities", "city", "gas", "x"]
    docs = literal_table(spark, [(1, words), (2, []), (3, None), (None, ["cats", None])], "id bigint, tokens array<string>")
    out = lemma.lemmatize(docs, "id", "tokens")
    got = {r["id"]: r["tokens"] for r in out.collect()}
    assert got[1] == ["cat", "cat", "box", "box", "men", "man", "wolf", "wolf", "s", "s", "city", "city", "gas", "x"]
    assert got[2] == [] and got[3] is None and got[None] == ["cats", None]
    assert plan_of(out).count("EndsWith") >= len(NOUN_ENDINGS)  # was every word of every text
    odd = literal_table(spark, [("cat", "feline")], "word string, lemma string")
    assert {r["id"]: r["tokens"] for r in lemma.lemmatize(docs, "id", "tokens", exceptions=odd).collect()}[1][:2] == ["feline", "cat"]


def test_only_words_with_a_valence_become_rows(spark):
    rows = [(1, ["a", "good", "very", "good", None, "bad"]), (2, ["x"]), (3, []), (4, None), (1, ["good"])]
    docs = literal_table(spark, rows, "id bigint, tokens array<string>")
    literal = sentiment.Lexicon([("good", 1.9), ("bad", -2.5), ("very", 1.0)], [("very", 0.293)], [("not",)])
    scoring = literal_table(spark, [("good", 1.9), ("bad", -2.5)], "w0 string, v double")
    hits = sentiment._hits(docs, "id", "tokens", scoring, ["good", "bad"])
    assert sorted((r["id"], r["w0"], r["p1"]) for r in hits.select("id", "w0", F.coalesce("p1", F.lit("-")).alias("p1")).collect()) == [
        (1, "bad", "-"), (1, "good", "-"), (1, "good", "a"), (1, "good", "very"),
    ]
    tables = sentiment.Lexicon(literal_table(spark, literal.valences, "term string, valence double"), literal.boosters, literal.negators)
    scores = [sorted((r["id"], r["compound"]) for r in sentiment.compound_scores(docs, "id", "tokens", x).collect()) for x in (literal, tables)]
    assert scores[0] == scores[1]
    assert " IN (good,bad,very)" in plan_of(sentiment.compound_scores(docs, "id", "tokens", literal))  # was a row for every token


def test_brands_keep_their_meaning(spark):
    rules = (("th", "the"), ("nd", "and"), ("und", "and"), ("nt", "not"), ("a.b", "x"))
    texts = ["th nd und nt", "xth th1 _th thx", "und undund und.nd", "éth th\U0001d400 \U0001d400th 9nd", "a.b aab a.b.c", "th", "", None, "nd und"]
    rows = literal_table(spark, list(enumerate(texts)), "i int, text string")
    got = [r["out"] for r in rows.select("i", tx.normalize_brands(F.col("text"), rules).alias("out")).orderBy("i").collect()]
    # The plain way: what is in front is looked at first, word by word.
    plain = F.lower("text")
    for words, target in (("th", "the"), ("nd|und", "and"), ("nt", "not"), (r"a\.b", "x")):
        plain = F.regexp_replace(plain, rf"(?<![\p{{L}}\p{{N}}_])(?:{words})(?![\p{{L}}\p{{N}}_])", target)
    assert got == [r["out"] for r in rows.select("i", plain.alias("out")).orderBy("i").collect()]
    assert got[0] == "the and and not"


def test_terms_are_counted_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(features, "TASK_TOKENS", 10)
    rows = [(i, ["aa", "bb", "aa", "bb"]) for i in range(60)] + [(0, ["aa"]), (None, ["aa"]), (None, ["aa"]), (70, []), (71, None)]
    docs = literal_table(spark, rows, "id bigint, tokens array<string>").coalesce(1)
    counts = features.Tfidf("id", "tokens", (1, 2))._counts(docs)
    assert "REPARTITION_BY_NUM" in plan_of(counts) and "hashpartitioning(id#" in plan_of(counts)
    assert counts.rdd.getNumPartitions() >= 24  # was joined up to a few tasks, whatever they count
    got = {(r["id"], r["term"]): r["tf"] for r in counts.collect()}
    assert got[0, "aa"] == 3 and got[None, "aa"] == 2 and got[5, "aa bb"] == 2 and got[5, "bb aa"] == 1 and len(got) == 60 * 4 + 1
