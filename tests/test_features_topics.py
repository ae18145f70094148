import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewmill.operators import classify, coherence, doc_vectors, embedding_topics, lda, nmf, phrases, svd, vocab
from reviewmill.operators.features import Tfidf
from reviewmill.operators.lemma import lemmatize
from reviewmill.session import literal_table, materialize


def docs(spark, texts):
    return literal_table(spark, [(i, t.split()) for i, t in enumerate(texts)], "id bigint, tokens array<string>")


def test_tfidf_by_hand(spark):
    rows = docs(spark, ["a1 b1", "a1", "a1 c1"])
    fitted = Tfidf("id", "tokens").fit(rows)
    idf = {r["term"]: r["idf"] for r in fitted.vocabulary.collect()}
    assert idf["a1"] == pytest.approx(1.0) and idf["b1"] == pytest.approx(math.log(2) + 1)
    got = {(r["id"], r["term"]): r["weight"] for r in fitted.weights(rows).collect()}
    length = math.hypot(1.0, idf["b1"])
    assert got == pytest.approx({
        (0, "a1"): 1 / length, (0, "b1"): idf["b1"] / length, (1, "a1"): 1.0, (2, "a1"): 1 / length, (2, "c1"): idf["b1"] / length,
    })
    vectors = {r["id"]: r["features"].toArray() for r in fitted.vectors(rows).collect()}
    assert vectors[0] == pytest.approx([1 / length, idf["b1"] / length, 0.0])


def test_tfidf_limits_and_bigrams(spark):
    rows = docs(spark, ["aa bb", "aa bb", "aa x cc", ""])
    fitted = Tfidf("id", "tokens", (1, 2), min_df=2, max_features=2, stop_words=("cc",)).fit(rows)
    assert [r["term"] for r in fitted.vocabulary.orderBy(F.desc("corpus_tf"), "term").collect()] == ["aa", "aa bb"]


def test_phrase_threshold_and_greedy_merge(spark):
    filler = [f"f{i} g{i}" for i in range(40)]
    rows = docs(spark, ["p q"] * 10 + ["r s"] * 11 + filler)
    found = {(r["a"], r["b"]): (r["n"], r["score"]) for r in phrases.phrase_scores(rows, "tokens", threshold=0.0).collect()}
    size = 4 + 80 + 2 + 40
    assert found == {("r", "s"): (11, pytest.approx(1 / 11 / 11 * size))}
    merged = phrases.merge_phrases(
        docs(spark, ["a b b c a b", "a a b", "b b b b", "", "z"]), "id", "tokens",
        literal_table(spark, [("a", "b"), ("b", "b"), ("b", "c")], "a string, b string"),
    )
    assert [r["tokens"] for r in merged.orderBy("id").collect()] == [["a_b", "b_c", "a_b"], ["a", "a_b"], ["b_b", "b_b"], [], ["z"]]


def test_dictionary_and_bag(spark):
    rows = docs(spark, ["a b b", "a c", "a b", "d"])
    found = vocab.vocabulary(rows, "tokens", no_below=2, no_above=0.5)
    assert [(r["term_id"], r["term"], r["df"]) for r in found.collect()] == [(0, "b", 2)]
    bag = vocab.bag_of_words(rows, "id", "tokens", found)
    assert {(r["id"], r["term"], r["n"]) for r in bag.collect()} == {(0, "b", 2), (2, "b", 1)}


def brute_force_coherence(texts, topics, window):
    """c_v over explicit windows."""
    wanted = {w for listed in topics.values() for w in listed}
    windows = []
    for text in texts:
        if wanted & set(text):
            windows += [set(text[s : s + window]) for s in range(max(len(text) - window + 1, 1))]
    share = lambda *ws: sum(all(w in win for w in ws) for win in windows) / len(windows)
    out = {}
    for topic, listed in topics.items():
        m = np.zeros((len(listed), len(listed)))
        for (i, a), (j, b) in itertools.product(enumerate(listed), enumerate(listed)):
            if share(a) and share(b):
                m[i, j] = math.log((share(a, b) + 1e-12) / (share(a) * share(b))) / -math.log(share(a, b) + 1e-12)
        total = m.sum(axis=0)
        norms = np.linalg.norm(m, axis=1) * np.linalg.norm(total)
        out[topic] = float(np.mean([row @ total / n if n else 0.0 for row, n in zip(m, norms)]))
    return out


@pytest.mark.parametrize("window", [2, 3, 7, 110])
def test_coherence_matches_brute_force(spark, window):
    rng = np.random.default_rng(window)
    texts = [list(rng.choice(list("abcdefgh"), size=size)) for size in (1, 2, 5, 9, 30, 111, 130)] + [["x"] * 9]
    topics = {0: ["a", "b", "c"], 1: ["b", "d", "nowhere"]}
    rows = literal_table(spark, [(i, t) for i, t in enumerate(texts)], "id bigint, tokens array<string>")
    listed = literal_table(spark, [(t, w) for t, ws in topics.items() for w in ws], "topic int, word string")
    got = {r["topic"]: r["coherence"] for r in coherence.topic_coherence(rows, "id", "tokens", listed, window).collect()}
    assert got == pytest.approx(brute_force_coherence(texts, topics, window), abs=1e-9)
    assert all(value <= 1.0 for value in got.values())


def test_window_count_of_a_111_token_text(spark):
    rows = docs(spark, ["a " + "z " * 109 + "b"])
    listed = literal_table(spark, [(0, "a"), (0, "b")], "topic int, word string")
    counts, total = coherence.window_counts(rows, "id", "tokens", listed)
    assert total == 2
    assert {(r["a"], r["b"]): r["n_any"] for r in counts.collect()} == {("a", "a"): 1, ("b", "b"): 1, ("a", "b"): 2}


def test_best_topic_count_takes_the_smallest_on_a_tie():
    assert coherence.best_topic_count([(5, 0.4), (3, 0.4), (4, 0.1)]) == 3


def planted(spark, n=60):
    rng = np.random.default_rng(1)
    pools = [["cat", "dog", "cow", "hen"], ["red", "blue", "green", "pink"]]
    rows = [(i, [str(w) for w in rng.choice(pools[i % 2], size=8)]) for i in range(n)]
    return materialize(literal_table(spark, rows, "id bigint, tokens array<string>"), "planted"), pools


def test_lda_finds_planted_topics(spark):
    rows, pools = planted(spark)
    topics = lda.LdaTopics(rows, "id", "tokens", no_below=2, no_above=0.9)
    model = topics.fit(2, passes=20)
    found = topics.topic_words(model, 4).collect()
    sets = [{r["word"] for r in found if r["topic"] == t} for t in (0, 1)]
    assert sorted(map(sorted, sets)) == sorted(map(sorted, pools))
    assert topics.doc_topics(model).filter(F.col("id") % 2 == 0).select("topic").distinct().count() == 1


def test_nmf_recovers_a_rank_two_matrix(spark):
    rng = np.random.default_rng(3)
    x = rng.random((6, 2)) @ rng.random((2, 5))
    rows = [(i, f"t{j}", float(x[i, j])) for i in range(6) for j in range(5)]
    model = nmf.fit_nmf(literal_table(spark, rows, "id bigint, term string, weight double"), "id", 2, max_iter=12, tol=0.0)
    assert all(later <= earlier + 1e-9 for earlier, later in zip(model.losses, model.losses[1:]))
    w = {r["id"]: r["w"] for r in model.w.collect()}
    h = {r["term"]: r["h"] for r in model.h.collect()}
    assert min(min(v) for v in [*w.values(), *h.values()]) >= 0
    fitted = np.array([[np.dot(w[i], h[f"t{j}"]) for j in range(5)] for i in range(6)])
    error = float(((fitted - x) ** 2).sum())
    assert error < 0.01 * float((x**2).sum())


def test_nmf_finds_planted_topics(spark):
    rows, pools = planted(spark)
    weights = Tfidf("id", "tokens").fit(rows).weights(rows)
    model = nmf.fit_nmf(weights, "id", 2, max_iter=6)
    found = model.topic_words(4).collect()
    sets = [{r["word"] for r in found if r["topic"] == t} for t in (0, 1)]
    assert sorted(map(sorted, sets)) == sorted(map(sorted, pools))


def test_logistic_and_batch_scoring(spark):
    rows, _ = planted(spark)
    labelled = rows.withColumn("kind", F.when(F.col("id") % 2 == 0, "animal").otherwise("colour"))
    model = classify.TfidfLogistic(Tfidf("id", "tokens"), "kind", max_iter=50).fit(labelled)
    predicted = model.predict(labelled, keep=("kind",))
    assert predicted.filter("kind = predicted").count() == 60
    scores = classify.score_batches(labelled, ("id",), lambda b: np.stack([b["id"] % 2, 1 - b["id"] % 2], axis=1), ("id",))
    classes = scores.select("id", classify.argmax(F.col("scores")).alias("c")).collect()
    assert all(r["c"] == (0 if r["id"] % 2 else 1) for r in classes)
    assert classify.random_trials({"a": (1e-3, 1.0)}, 3) == classify.random_trials({"a": (1e-3, 1.0)}, 3)


def blobs(spark):
    rng = np.random.default_rng(5)
    rows = []
    for blob, (centre, size) in enumerate([((0, 0, 0), 50), ((20, 0, 0), 50), ((0, 20, 0), 50), ((40, 40, 40), 10)]):
        rows += [(len(rows) + i, blob, [float(x) for x in rng.normal(centre, 0.5)]) for i in range(size)]
    return materialize(literal_table(spark, rows, "id bigint, blob int, vector array<double>"), "blobs")


def test_clusters_below_the_minimum_size_are_outliers(spark):
    rows = blobs(spark)
    placed = embedding_topics.cluster_vectors(rows, "id", "vector", k=4, min_topic_size=20, spread=9.0).join(rows, "id")
    by_blob = {b: set() for b in range(4)}
    for r in placed.collect():
        by_blob[r["blob"]].add(r["topic"])
    assert by_blob[3] == {-1}
    assert sorted(t for b in range(3) for t in by_blob[b]) == [0, 1, 2]
    near = embedding_topics.representative_docs(placed, "id", "topic", "vector").collect()
    assert len(near) == 9 and {r["rank"] for r in near} == {1, 2, 3}


def test_membership_sums_to_one(spark):
    rows = blobs(spark)
    means = embedding_topics.centroids(rows, "blob", "vector")
    sums = embedding_topics.topic_membership(rows, "id", "vector", means).groupBy("id").agg(F.sum("probability").alias("p"))
    assert all(r["p"] == pytest.approx(1.0) for r in sums.collect())


def test_topic_merging_joins_the_most_similar(spark):
    texts = [(0, ["a", "b"] * 6), (1, ["a", "b", "b"] * 2), (2, ["c", "d"] * 5), (-1, ["a", "z"])]
    rows = literal_table(spark, [(i, t, w) for i, (t, w) in enumerate(texts)], "id bigint, topic int, tokens array<string>")
    counts = materialize(embedding_topics.class_term_counts(rows, "topic", "tokens"), "counts")
    step = embedding_topics.nearest_topic(counts).first()
    assert (step["merged"], step["into"]) == (1, 0)
    final = embedding_topics.reduce_topics(rows, "tokens", target=2)
    assert {r["id"]: r["topic"] for r in final.collect()} == {0: 0, 1: 0, 2: 2, 3: -1}


def test_long_text_is_merged_and_lemmatised_in_place(spark):
    rng = np.random.default_rng(2)
    words = [str(w) for w in rng.choice(["a", "b", "c", "dogs", "dog"], size=20_000)]
    rows = literal_table(spark, [(1, words)], "id bigint, tokens array<string>")
    pairs = {("a", "b"), ("b", "b"), ("b", "c")}
    merged, i = [], 0
    while i < len(words):
        taken = tuple(words[i : i + 2]) in pairs
        merged.append("_".join(words[i : i + 2]) if taken else words[i])
        i += 1 + taken
    got = phrases.merge_phrases(rows, "id", "tokens", literal_table(spark, sorted(pairs), "a string, b string"))
    assert got.first()["tokens"] == merged
    assert lemmatize(rows, "id", "tokens").first()["tokens"] == ["dog" if w == "dogs" else w for w in words]


def test_coherence_shuffles_no_text(spark):
    rows = docs(spark, ["a b c", "a d"])
    topics = literal_table(spark, [(0, "a"), (0, "b")], "topic int, word string")
    plan = coherence.window_counts(rows, "id", "tokens", topics)[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "__t" not in plan


def test_reassign_goes_to_the_nearest_mean(spark):
    rows = literal_table(spark, [(1, 0, [0.0, 0.0]), (2, 0, [2.0, 0.0]), (3, 1, [9.0, 0.0]), (4, -1, [8.0, 0.0]), (5, 0, [8.5, 0.0])], "id bigint, topic int, vector array<double>")
    got = {r["id"]: r["topic"] for r in embedding_topics.reassign(rows, "id", "vector").collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 1, 5: 1}


def test_document_vectors(spark):
    rows = docs(spark, ["aa bb", "aa bb", "cc dd", ""])
    got = {r["id"]: r["vector"] for r in doc_vectors.document_vectors(rows, "id", "tokens", size=200).collect()}
    assert got[0] == got[1] and got[3] == [0.0] * 200 and len(got[2]) == 200
    assert {round(abs(x), 6) for x in got[0]} == {0.0, round(math.sqrt(2), 6)}


def sparse(draw, n_rows, n_terms, density=0.4):
    x = draw.random((n_rows, n_terms)) * (draw.random((n_rows, n_terms)) < density)
    return x, [(i, f"t{j:03d}", float(x[i, j])) for i, j in zip(*np.nonzero(x))]


def test_truncated_svd_and_nmf_start(spark):
    """Against a dense decomposition; the start is the same whatever signs the vectors have."""
    x, rows = sparse(np.random.default_rng(3), 60, 30)
    found = svd.truncated_svd(literal_table(spark, rows, "id bigint, term string, x double"), "id", 5, tol=1e-7)
    u, s, vt = np.linalg.svd(x)
    assert np.allclose(found.sigma, s[:5], rtol=1e-5)
    assert found.shares()[0] == pytest.approx(s[0] ** 2 / (x**2).sum())
    right = np.array([r["f"] for r in sorted(found.v.collect())])
    left = np.array([r["f"] for r in sorted(found.u.collect())])
    assert np.abs(left.T @ left - np.eye(5)).max() < 1e-8 and np.allclose(x.T @ left, right * found.sigma, atol=1e-9)
    got = np.array([r["h"] for r in sorted(svd.nmf_start(found, 5).collect())]).T
    want = [np.sqrt(s[0]) * np.abs(vt[0])]
    for t in range(1, 5):
        sides = [(np.maximum(g * u[:, t], 0), np.maximum(g * vt[t], 0)) for g in (1, -1)]
        a, b = max(sides, key=lambda p: np.linalg.norm(p[0]) * np.linalg.norm(p[1]))
        want.append(np.sqrt(s[t] * np.linalg.norm(a) * np.linalg.norm(b)) * b / np.linalg.norm(b))
    assert np.allclose(got, np.where(np.array(want) > 0, want, x.mean()), atol=0.02)


def test_nmf_runs_until_it_stands(spark):
    x, rows = sparse(np.random.default_rng(4), 50, 20)
    model = nmf.fit_nmf(literal_table(spark, rows, "id bigint, term string, weight double"), "id", 3)
    assert all(a >= b - 1e-9 for a, b in zip(model.losses, model.losses[1:]))
    assert len(model.losses) > 2 and model.losses[-2] - model.losses[-1] < 1e-4 * model.losses[0]
    best = ((x - (lambda d: (d[0][:, :3] * d[1][:3]) @ d[2][:3])(np.linalg.svd(x))) ** 2).sum()
    assert best <= model.losses[-1] <= 1.25 * best
