"""Steps whose work must grow with the rows, not with their square."""

import contextlib
import io
import threading
import time

import numpy as np
from pyspark.sql import functions as F

from reviewmill.functions import text as tx
from reviewmill.operators import classify, density, doc_vectors, lda, phrases, svd
from reviewmill.operators.language import LanguageModel, language_profiles
from reviewmill.session import literal_table


def plan_of(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("simple")
    return text.getvalue()


def test_splice_makes_its_values_once(spark):
    n = 16_000
    rows = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i.cast("string")).alias("t"), F.sequence(F.lit(0), F.lit(n - 2), F.lit(2)).alias("at"))
    joined = F.transform("at", lambda i: F.concat(F.get("t", i), F.lit("_"), F.get("t", i + 1)))
    began = time.monotonic()
    got = rows.select(tx.splice(F.col("t"), F.col("at"), joined, 2).alias("out")).first()["out"]
    assert got == [f"{i}_{i + 1}" for i in range(1, n, 2)]
    assert time.monotonic() - began < 10  # was 64 million evaluations


def test_collapse_keeps_its_meaning(spark):
    texts = ["a  b", " a-b ", "é", "a b", "a - b\n\nc", "x", "", "   ", "a_b", "a 9", " a b  "]
    rows = literal_table(spark, list(enumerate(texts)), "i int, text string")
    got = [r["out"] for r in rows.select("i", tx.collapse_to_words(F.col("text")).alias("out")).orderBy("i").collect()]
    assert got == ["a b", "a b", "", "a b", "a b c", "x", "", "", "a b", "a 9", "a b"]


def test_detection_shuffles_no_text_and_no_gram(spark):
    texts = literal_table(spark, [(0, "the cat and the hat", "en"), (1, "der hund und die katze", "de")], "id int, text string, lang string")
    model = LanguageModel(language_profiles(texts, "text", "lang"))
    found = model.detect(texts, "id", "text")
    assert {r["id"]: r["detected_lang"] for r in found.collect()} == {0: "en", 1: "de"}
    moved = [line for line in plan_of(found).splitlines() if "hashpartitioning" in line]
    assert moved and not any("gram" in line for line in moved)
    keys = [line for line in plan_of(found).splitlines() if "HashAggregate(keys" in line]
    assert keys and not any("gram" in line.split("functions")[0] for line in keys)


def test_lda_updates_do_not_grow_with_the_corpus(spark, monkeypatch):
    rows = literal_table(spark, [(i, ["a", "b", "c"][: 1 + i % 3]) for i in range(30)], "id int, tokens array<string>")
    topics = lda.LdaTopics(rows, "id", "tokens", no_below=1, no_above=1.0)
    asked = []

    class Asked:
        def __init__(self, **settings):
            asked.append((settings["maxIter"], settings["subsamplingRate"]))

        def fit(self, df):
            return None

    monkeypatch.setattr(lda, "LDA", Asked)
    for topics.n_docs in (1_000, 20_000, 1_000_000):
        topics.fit(2)
    topics.fit(2, chunk=50_000)
    assert asked == [(10, 1.0), (100, 0.1), (100, 0.1), (200, 0.05)]


def test_products_over_blocks_equal_the_matrix(spark):
    made = np.random.default_rng(3)
    x = made.random((12, 7)) * (made.random((12, 7)) < 0.6)
    rows = [(None if i == 5 else i, f"t{j}", float(x[i, j])) for i in range(12) for j in range(7) if x[i, j]]
    table = literal_table(spark, rows, "id bigint, term string, x double")
    blocks = svd.packed(table, "id", entries=9)
    assert blocks.rows.count() > 1 and blocks.texts == len({r[0] for r in rows})
    h = made.random((7, 2))
    factor = literal_table(spark, [(f"t{j}", h[j].tolist()) for j in range(7)], "term string, f array<double>")
    sums, products = svd.there_and_back(blocks, factor, 2, lambda f: f, "sums")
    w, named = x @ h, np.arange(12) != 5  # a text without an id is no row of the transpose's product
    assert np.allclose(products, w.T @ w)
    got = np.array([r["f"] for r in sums.orderBy("term").collect()])
    assert np.allclose(got, (x[named].T @ w[named])[(x != 0).any(axis=0)])
    found = {r["id"]: r["f"] for r in svd.images(blocks, factor, 2, lambda f: f).collect()}
    assert all(np.allclose(found[None if i == 5 else i], w[i]) for i in range(12) if x[i].any())


def test_leaf_meets_its_visitors_in_parts(spark, monkeypatch):
    monkeypatch.setattr(density, "VISITORS", 40)
    v = np.random.default_rng(5).random((150, 3)).round(3)
    points = literal_table(spark, [(i, v[i].tolist()) for i in range(150)], "node bigint, v array<double>")
    near = density.nearest_neighbours(points, 4, leaf_rows=40)
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2)) + np.diag(np.full(150, np.inf))
    got = {}
    for r in near.collect():
        got.setdefault(r["node"], []).append(r["d"])
    assert all(np.allclose(sorted(got[i]), np.sort(d[i])[:4]) for i in range(150))


def test_trials_run_side_by_side_and_keep_their_order(spark, monkeypatch):
    both = threading.Barrier(2, timeout=20)  # broken if the trials come one after the other

    class Fitted:
        def __init__(self, **settings):
            pass

        def getParam(self, name):  # noqa: N802
            return name

        def fit(self, df, settings):
            both.wait()
            return type("Model", (), {"transform": lambda _, valid: settings["regParam"]})()

    monkeypatch.setattr(classify, "LogisticRegression", Fitted)
    monkeypatch.setattr(classify, "MulticlassClassificationEvaluator", lambda **settings: type("Loss", (), {"evaluate": lambda _, x: x})())
    tried = classify.tune_logistic(spark.range(1), spark.range(1), "label", n_trials=4, parallelism=2)
    assert len(tried) == 4 and all(trial["regParam"] == loss for trial, loss in tried)
    assert [trial for trial, _ in tried] == classify.random_trials({"regParam": (1e-5, 1.0), "elasticNetParam": (1e-3, 1.0), "tol": (1e-7, 1e-3)}, 4)


def test_blocks_of_leaves_meet_exactly(spark, monkeypatch):
    """A point moves once for every block, whatever the number of leaves it is near to."""
    moved = []
    monkeypatch.setattr(density, "HELD", 50)
    monkeypatch.setattr(density, "VISITORS", 80)
    monkeypatch.setattr(density, "materialize", lambda df, name, real=density.materialize: moved.append((name, plan_of(df))) or real(df, name))
    v = np.unique(np.random.default_rng(6).normal(size=(400, 12)).round(1), axis=0)
    points = literal_table(spark, [(1000 - i, x.tolist()) for i, x in enumerate(v)], "node bigint, v array<double>")
    got = {(r["node"], r["other"], r["d"]) for r in density.nearest_neighbours(points, 5, leaf_rows=25).collect()}
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2)) + np.diag(np.full(len(v), np.inf))
    ids = 1000 - np.arange(len(v))
    want = {(ids[i], ids[j], d[i, j]) for i in range(len(v)) for j in np.lexsort((ids, d[i]))[:5]}
    assert got == want
    last = dict(moved)["neighbours"]
    assert "MapInPandas" not in last  # was a row for every leaf that a point visits


def test_document_vectors_move_no_sums(spark):
    rows = [(i, [f"w{i % 7}", f"w{i % 3}", "x"] if i else []) for i in range(30)]
    docs = literal_table(spark, rows, "id bigint, tokens array<string>")
    fitted = doc_vectors.DocumentVectors("id", "tokens", size=70).fit(docs)
    out = fitted.transform(docs)
    # The plain way: weights of unit length against the signs of the terms.
    signs = fitted.tfidf.vocabulary.select("term", doc_vectors.term_signs(F.col("term"), 70).alias("signs"))
    signs = {r["term"]: np.array(r["signs"]) for r in signs.collect()}
    want = {i: np.zeros(70) for i, _ in rows}
    for r in fitted.tfidf.weights(docs).collect():
        want[r["id"]] = want[r["id"]] + r["weight"] * signs[r["term"]]
    got = {r["id"]: r["vector"] for r in out.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i], atol=1e-12) for i in want)
    assert "Window" not in plan_of(out)
    exchanges = [line for line in plan_of(out).splitlines() if "Exchange hashpartitioning(id" in line]
    assert any("REPARTITION_BY_COL" in line for line in exchanges)  # was one number a dimension for every term of a text


def test_pairs_are_counted_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(phrases, "TASK_TOKENS", 10)
    rows = [(["a", "b", "a", "b"],)] * 60 + [([],), (None,)]
    docs = literal_table(spark, rows, "tokens array<string>").coalesce(1)
    assert "RoundRobin" not in plan_of(phrases.gram_counts(docs, "tokens"))
    assert phrases.spread(docs, "tokens").rdd.getNumPartitions() >= 24  # was one task a file
    got = {(r["a"], r["b"]): r["n"] for r in phrases.gram_counts(docs, "tokens").collect()}
    assert got == {("a", None): 120, ("b", None): 120, ("a", "b"): 120, ("b", "a"): 60}
