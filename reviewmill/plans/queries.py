"""The registered queries: every operator on the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill.functions import text as tx
from reviewmill.operators import classify, coherence, dedup, embedding_topics, features, labels, language, lemma
from reviewmill.operators import density
from reviewmill.operators import doc_vectors as doc_vecs
from reviewmill.operators import lda, metrics, nmf, phrases, profile, sentiment, split, svd, vocab, words
from reviewmill.plans import fixtures as fx
from reviewmill.plans import reviews
from reviewmill.session import literal_table, materialize, shared_folder
from reviewmill.sources import reviews as sources

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DOC, TALK = fx.DOCUMENTS, fx.CONVERSATIONS
TEXT = F.col


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    for name in cols:
        df = df.withColumn(name, F.round(name, digits))
    return df


# --- shared inputs ----------------------------------------------------------


_STORED: dict[tuple[str, str, str], DataFrame] = {}


def shared_table(make: Query) -> Query:
    """The stored result of ``make``, made once per application and input folder."""

    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, make.__name__)
        if key not in _STORED:
            _STORED[key] = materialize(make(spark, sf_dir), make.__name__)
        return _STORED[key]

    return get


@shared_table
def tokenised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its clean tokens, digest and length flag: the one pass over the texts."""
    return reviews.narrow_reviews(fx.documents(spark, sf_dir), DOC, "lang")


def stored_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenised(spark, sf_dir).select("doc_id", "tokens")


@shared_table
def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """De-duplicated, cleaned, lemmatised, non-empty documents in the wanted languages: what all later steps read."""
    model = language_model(spark, sf_dir)
    docs = fx.documents(spark, sf_dir).select("doc_id", "text")
    return reviews.clean_reviews(docs, DOC, model, use_lemmas=True, with_text=False, narrow=tokenised(spark, sf_dir))


@shared_table
def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.score_reviews(cleaned(spark, sf_dir), DOC, fx.lexicon())


def scored_and_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, tokens, compound, sentiment, sentiment_true, sentiment_true_clean)."""
    both = scored(spark, sf_dir).join(fx.human_labels(spark, sf_dir), "doc_id", "left")
    return reviews.label_reviews(both, DOC)


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.gold_rows(scored_and_labelled(spark, sf_dir))


def both_platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = materialize(reviews.clean_reviews(fx.turns(spark, sf_dir), TALK, with_text=False), "cleaned_talk")
    return reviews.combine_platforms(
        [(DOC, scored(spark, sf_dir)), (TALK, reviews.score_reviews(talk, TALK, fx.lexicon()))]
    )


def training_part() -> Column:
    """Half of the documents, by a hash of the id: language profiles are trained on these only."""
    return F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) < "8"


@shared_table
def trained_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles trained on the training part of the documents, once."""
    return language.language_profiles(clean_texts(spark, sf_dir).filter(training_part()), "clean", "lang")


def language_model(spark: SparkSession, sf_dir: str) -> language.LanguageModel:
    return language.LanguageModel(trained_profiles(spark, sf_dir))


def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, clean) of every document."""
    return tokenised(spark, sf_dir).select("doc_id", "lang", F.array_join("tokens", " ").alias("clean"))


@shared_table
def topic_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned documents with merged phrases, stored once for all fits."""
    texts = cleaned(spark, sf_dir).select("doc_id", "review_cleaned")
    return phrases.topic_model_tokens(texts, "doc_id", "review_cleaned", out="topic_tokens").select("doc_id", "topic_tokens")


# --- sources and profiling --------------------------------------------------


@query
def scan_reviews(spark, sf_dir):
    """A CSV with quotes and line breaks in its texts, written and read back."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    sources.write_csv(fx.documents(spark, sf_dir).select("doc_id", "source", "text"), path)
    return sources.read_csv(spark, path, "doc_id bigint, source string, text string")


@query
def row_numbers(spark, sf_dir):
    """Documents numbered without gaps by source, then id."""
    numbered = sources.with_row_numbers(fx.documents(spark, sf_dir).select("doc_id", "source"), "source", "doc_id")
    return numbered.select("doc_id", "source", "row_number")


@query
def head_rows(spark, sf_dir):
    return profile.head_rows(fx.documents(spark, sf_dir).select("doc_id", "source", "text"), "doc_id", 5)


@query
def tail_rows(spark, sf_dir):
    return profile.tail_rows(fx.documents(spark, sf_dir).select("doc_id", "source", "text"), "doc_id", 5)


@query
def column_profile(spark, sf_dir):
    return profile.column_profile(fx.labelled_documents(spark, sf_dir))


@query
def null_counts(spark, sf_dir):
    return profile.null_counts(fx.labelled_documents(spark, sf_dir))


@query
def source_counts(spark, sf_dir):
    return profile.value_counts(fx.documents(spark, sf_dir), "source")


@query
def stage_counts(spark, sf_dir):
    docs = fx.documents(spark, sf_dir)
    return reviews.cleaning_audit(docs, DOC, narrow=tokenised(spark, sf_dir), detected=_detected(spark, sf_dir))


@query
def clean_reviews(spark, sf_dir):
    """The cleaned table: every filter and cleaning step of the documents."""
    return cleaned(spark, sf_dir).select("doc_id", "review_cleaned", "detected_lang")


# --- duplicates -------------------------------------------------------------


@query
def long_short_split(spark, sf_dir):
    return dedup.with_is_long(fx.documents(spark, sf_dir), "text").select("doc_id", "is_long")


@query
def raw_duplicates(spark, sf_dir):
    return dedup.raw_duplicates(fx.documents(spark, sf_dir).select("doc_id", "text"), "text", "doc_id")


@query
def long_duplicates(spark, sf_dir):
    return dedup.raw_duplicates(fx.documents(spark, sf_dir).select("doc_id", "text"), "text", "doc_id", 15)


@query
def duplicate_groups(spark, sf_dir):
    return dedup.duplicate_groups(fx.documents(spark, sf_dir), "text", "doc_id")


@query
def dedup_long(spark, sf_dir):
    return dedup.dedup_long(fx.documents(spark, sf_dir).select("doc_id", "text"), "text", "doc_id")


@query
def dedup_reviews(spark, sf_dir):
    return dedup.dedup_reviews(fx.documents(spark, sf_dir).select("doc_id", "text"), "text", "doc_id")


# --- text -------------------------------------------------------------------


@query
def normalize_brands(spark, sf_dir):
    return fx.documents(spark, sf_dir).select("doc_id", tx.normalize_brands(TEXT("text"), fx.BRANDS).alias("text_out"))


@query
def strip_emoji(spark, sf_dir):
    """Emoji put in place of the commas of each text, then stripped."""
    with_emoji = F.replace(F.replace(TEXT("text"), F.lit(", "), F.lit("\U0001F44D\U0001F3FD")), F.lit("."), F.lit("❤️"))
    return fx.documents(spark, sf_dir).select("doc_id", tx.strip_emoji(with_emoji).alias("text_out"))


@query
def strip_urls(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").select("page_id", tx.strip_urls(TEXT("html")).alias("text_out"))


@query
def tokenize(spark, sf_dir):
    tokens = tx.word_tokens(tx.collapse_to_words(tx.lower_text(TEXT("text"))))
    return fx.documents(spark, sf_dir).select("doc_id", F.array_join(tokens, "|").alias("tokens"), F.size(tokens).alias("n_tokens"))


@query
def remove_stopwords(spark, sf_dir):
    tokens = tx.word_tokens(tx.collapse_to_words(tx.lower_text(TEXT("text"))))
    kept = tx.drop_words(tokens, fx.STOP_WORDS)
    return fx.documents(spark, sf_dir).select("doc_id", F.array_join(kept, "|").alias("tokens"))


@query
def lemmatize_tokens(spark, sf_dir):
    """The (word, lemma) changes over the corpus vocabulary."""
    found = materialize(tokenised(spark, sf_dir).select(F.explode("tokens").alias("word")).distinct(), "words")
    return lemma.lemma_map(found, found.select(F.col("word").alias("lemma")))


@query
def clean_text(spark, sf_dir):
    """All cleaning steps with lemmas, as one text."""
    out = lemma.lemmatize(stored_tokens(spark, sf_dir), "doc_id", "tokens")
    return out.select("doc_id", F.array_join("tokens", " ").alias("review_cleaned"))


@query
def drop_empty(spark, sf_dir):
    texts = tokenised(spark, sf_dir).select("doc_id", F.array_join("tokens", " ").alias("review_cleaned"))
    return texts.filter(~tx.is_blank(F.col("review_cleaned"))).select("doc_id")


@query
def topic_tokens(spark, sf_dir):
    tokens = tx.topic_tokens(TEXT("text"))
    return fx.documents(spark, sf_dir).select("doc_id", F.array_join(tokens, "|").alias("tokens"), F.size(tokens).alias("n_tokens"))


@query
def language_profiles(spark, sf_dir):
    return trained_profiles(spark, sf_dir)


@shared_table
def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, found once for all queries that ask for it."""
    return language_model(spark, sf_dir).detect(clean_texts(spark, sf_dir), "doc_id", "clean")


@query
def detect_language(spark, sf_dir):
    return _detected(spark, sf_dir)


@query
def language_counts(spark, sf_dir):
    return profile.value_counts(_detected(spark, sf_dir), "detected_lang")


@query
def language_filter(spark, sf_dir):
    return language.language_filter(_detected(spark, sf_dir), "detected_lang", DOC.removed_languages)


# --- words ------------------------------------------------------------------


@query
def top_words(spark, sf_dir):
    return words.top_words(cleaned(spark, sf_dir), "tokens", 20)


@query
def top_words_by_sentiment(spark, sf_dir):
    return words.top_words_by(scored(spark, sf_dir), "tokens", ("sentiment",), 10)


@query
def word_weights(spark, sf_dir):
    return rounded(words.word_weights(scored(spark, sf_dir), "tokens", ("sentiment",), 200), "weight")


@query
def compound_box_stats(spark, sf_dir):
    stats = words.box_stats(scored(spark, sf_dir), "compound", "sentiment")
    return rounded(stats, "q1", "median", "q3", "whisker_low", "whisker_high")


@query
def platform_sentiment_share(spark, sf_dir):
    return rounded(reviews.platform_sentiment_share(both_platforms(spark, sf_dir)), "share")


@query
def platform_top_words(spark, sf_dir):
    return reviews.platform_top_words(both_platforms(spark, sf_dir), 20)


# --- sentiment and labels ---------------------------------------------------


@query
def sentiment_compound(spark, sf_dir):
    return sentiment.compound_scores(cleaned(spark, sf_dir), "doc_id", "tokens", fx.lexicon())


@query
def kmeans_centroids(spark, sf_dir):
    scores = materialize(sentiment_compound(spark, sf_dir), "scores")
    values = sentiment.kmeans_centroids(scores)
    rows = F.array(*[F.struct(F.lit(name).alias("sentiment"), F.lit(round(value, 6)).alias("centroid"))
                     for name, value in zip(("negative", "neutral", "positive"), values)])
    sizes = sentiment.label_sentiment(scores).groupBy("sentiment").agg(F.count(F.lit(1)).alias("n"))
    return spark.range(1).select(F.inline(rows)).join(sizes, "sentiment", "left").na.fill(0, ["n"])


@query
def sentiment_label(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", "compound", "sentiment")


@query
def sentiment_counts(spark, sf_dir):
    return profile.value_counts(scored(spark, sf_dir), "sentiment")


@query
def sentiment_subsets(spark, sf_dir):
    """Size and word total of every (platform, sentiment) subset."""
    sizes = both_platforms(spark, sf_dir).groupBy("platform", "sentiment")
    return sizes.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("tokens")).alias("n_words"))


@query
def standardize_labels(spark, sf_dir):
    both = fx.labelled_documents(spark, sf_dir)
    mapped = labels.standardize_labels(both, "sentiment_true", DOC.label_map)
    mapped = labels.standardize_labels(mapped, "sentiment_true", TALK.label_map, "strict_clean")
    return mapped.select("doc_id", "sentiment_true", "sentiment_true_clean", "strict_clean")


@query
def unmapped_labels(spark, sf_dir):
    both = fx.labelled_documents(spark, sf_dir)
    loose = labels.unmapped_labels(both, "sentiment_true", DOC.label_map, True).withColumn("preset", F.lit("loose"))
    strict = labels.unmapped_labels(both, "sentiment_true", TALK.label_map, False).withColumn("preset", F.lit("strict"))
    return loose.unionByName(strict)


@query
def gold_rows(spark, sf_dir):
    mapped = labels.standardize_labels(fx.labelled_documents(spark, sf_dir), "sentiment_true", DOC.label_map)
    return labels.gold_rows(mapped).select("doc_id", "sentiment_true_clean")


@query
def label_totals(spark, sf_dir):
    mapped = labels.standardize_labels(fx.labelled_documents(spark, sf_dir), "sentiment_true", TALK.label_map)
    return labels.label_totals(mapped)


@query
def stratified_split(spark, sf_dir):
    return split.stratified_split(gold_rows(spark, sf_dir), "doc_id", "sentiment_true_clean")


@query
def split_by_human_label(spark, sf_dir):
    """The route of a platform whose hand-labelled rows are split by their label."""
    parts = reviews.split_reviews(scored_and_labelled(spark, sf_dir), DOC)
    return parts.select("doc_id", "sentiment_true_clean", "part")


@query
def split_by_derived_label(spark, sf_dir):
    """The route of a platform whose rows are all split by the derived label."""
    return reviews.split_reviews(scored(spark, sf_dir), DOC.with_(split_on_gold=False)).select("doc_id", "sentiment", "part")


@query
def split_distribution(spark, sf_dir):
    parts = split.stratified_split(fx.documents(spark, sf_dir).select("doc_id", "lang"), "doc_id", "lang")
    return split.split_distribution(parts, "lang")


@query
def label_index(spark, sf_dir):
    return labels.label_index(gold_rows(spark, sf_dir), "sentiment_true_clean")


@query
def class_weights(spark, sf_dir):
    return rounded(labels.class_weights(gold_rows(spark, sf_dir), "sentiment_true_clean"), "class_weight")


# --- evaluation -------------------------------------------------------------


@query
def eval_overall(spark, sf_dir):
    scores = metrics.overall_scores(gold(spark, sf_dir), "sentiment_true_clean", "sentiment")
    return rounded(scores, "accuracy", "precision_macro", "recall_macro", "f1_macro")


@query
def classification_report(spark, sf_dir):
    report = metrics.classification_report(gold(spark, sf_dir), "sentiment_true_clean", "sentiment")
    return rounded(report, "precision", "recall", "f1")


@query
def confusion_counts(spark, sf_dir):
    return metrics.confusion_counts(gold(spark, sf_dir), "sentiment_true_clean", "sentiment")


@query
def confusion_row_pct(spark, sf_dir):
    pct = metrics.confusion_row_pct(gold(spark, sf_dir), "sentiment_true_clean", "sentiment")
    return rounded(pct, "negative", "neutral", "positive")


# --- features and classifiers -----------------------------------------------


def _classifier_tfidf() -> features.Tfidf:
    return features.Tfidf("doc_id", "tokens", (1, 2), min_df=3, max_features=5000, stop_words=("no", "not", "or"))


@query
def tfidf_vocab(spark, sf_dir):
    fitted = _classifier_tfidf().fit(stored_tokens(spark, sf_dir))
    return rounded(fitted.vocabulary, "idf")


@query
def tfidf_weights(spark, sf_dir):
    docs = stored_tokens(spark, sf_dir)
    return rounded(_classifier_tfidf().fit(docs).weights(docs), "weight")


@query
def tfidf_nmf_weights(spark, sf_dir):
    docs = stored_tokens(spark, sf_dir)
    fitted = features.Tfidf("doc_id", "tokens", (1, 1), min_df=10, max_df=0.95).fit(docs)
    return rounded(fitted.weights(docs), "weight")


def _parts(spark, sf_dir, label: str = "sentiment") -> tuple[DataFrame, DataFrame]:
    rows = scored(spark, sf_dir).select("doc_id", "tokens", label)
    parts = materialize(split.stratified_split(rows, "doc_id", label), "parts")
    return parts.filter("part = 'train'"), parts.filter("part = 'test'")


@query
def logreg_predictions(spark, sf_dir):
    train, test = _parts(spark, sf_dir)
    return classify.TfidfLogistic(_classifier_tfidf(), "sentiment").fit(train).predict(test, keep=("sentiment",))


@query
def mlp_predictions(spark, sf_dir):
    """Raw text, first 128 tokens; target is the derived sentiment."""
    raw = fx.documents(spark, sf_dir).select("doc_id", "text")
    rows = materialize(scored(spark, sf_dir).select("doc_id", "sentiment").join(raw, "doc_id"), "raw_text")
    parts = split.stratified_split(rows, "doc_id", "sentiment")
    model = classify.TextNetwork("doc_id", "text", "sentiment").fit(parts.filter("part = 'train'"))
    return model.predict(parts.filter("part = 'test'"), keep=("sentiment",))


@query
def tune_logreg(spark, sf_dir):
    """Twenty trials; terms, labels and fits come from the inner training part, losses from the other."""
    train, _ = _parts(spark, sf_dir)
    inner = materialize(split.stratified_split(train.drop("part"), "doc_id", "sentiment", seed=7), "inner_parts")
    seen, valid = inner.filter("part = 'train'"), inner.filter("part = 'test'")
    tfidf = _classifier_tfidf().fit(seen)
    indexed, indexer = classify.index_labels(tfidf.vectors(seen, keep=("sentiment",)), "sentiment")
    fitting = materialize(indexed.select("features", "label"), "tuning")
    judging = materialize(indexer.transform(tfidf.vectors(valid, keep=("sentiment",))).select("features", "label"), "judging")
    return classify.trial_table(classify.tune_logistic(fitting, judging, "label", n_trials=20), fitting)


@query
def logreg_report(spark, sf_dir):
    """Scores of the classifier's predictions on the test part."""
    predicted = materialize(logreg_predictions(spark, sf_dir), "predicted")
    return rounded(metrics.classification_report(predicted, "sentiment", "predicted"), "precision", "recall", "f1")


def _linear_scores(batch: pd.DataFrame) -> np.ndarray:
    matrix = np.stack(batch["embedding"].to_numpy()).astype(float)
    return matrix[:, : fx.N_SCORES] - 0.5 * matrix[:, fx.N_SCORES : 2 * fx.N_SCORES]


@query
def argmax_class(spark, sf_dir):
    vectors = fx.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    scores = classify.score_batches(vectors, ("embedding",), _linear_scores, ("vec_id",))
    return scores.select("vec_id", classify.argmax(F.col("scores")).alias("predicted"))


# --- topic models -----------------------------------------------------------


@query
def phrase_scores(spark, sf_dir):
    tokens = cleaned(spark, sf_dir).select("doc_id", tx.topic_tokens(TEXT("review_cleaned")).alias("topic_tokens"))
    return rounded(phrases.phrase_scores(materialize(tokens.select("topic_tokens"), "phrase_tokens"), "topic_tokens"), "score")


@query
def merge_phrases(spark, sf_dir):
    return topic_inputs(spark, sf_dir).select("doc_id", F.array_join("topic_tokens", " ").alias("merged"))


@query
def vocabulary(spark, sf_dir):
    return vocab.vocabulary(stored_tokens(spark, sf_dir), "tokens")


@query
def bag_of_words(spark, sf_dir):
    docs = stored_tokens(spark, sf_dir)
    return vocab.bag_of_words(docs, "doc_id", "tokens", vocab.fixed_vocabulary(docs, "tokens"))


@query
def topic_coherence(spark, sf_dir):
    rows = [(topic, word) for topic, listed in fx.COHERENCE_TOPICS for word in listed]
    topics = literal_table(spark, rows, "topic int, word string")
    return rounded(coherence.topic_coherence(stored_tokens(spark, sf_dir), "doc_id", "tokens", topics), "coherence")


@query
def lda_topics(spark, sf_dir):
    topics = lda.LdaTopics(topic_inputs(spark, sf_dir), "doc_id", "topic_tokens")
    return topics.topic_words(topics.fit(4, chunk=lda.CHUNK), 15)


@query
def doc_topics(spark, sf_dir):
    topics = lda.LdaTopics(topic_inputs(spark, sf_dir), "doc_id", "topic_tokens")
    return topics.doc_topics(topics.fit(4, chunk=lda.CHUNK))


@query
def lda_best_k(spark, sf_dir):
    topics = lda.LdaTopics(topic_inputs(spark, sf_dir), "doc_id", "topic_tokens")
    return _sweep_table(spark, topics.sweep(range(3, 7), chunk=lda.CHUNK))


def _sweep_table(spark: SparkSession, scores: list[tuple[int, float]]) -> DataFrame:
    best = coherence.best_topic_count(scores)
    return literal_table(
        spark, [(k, value, k == best) for k, value in scores], "k int, coherence double, is_best boolean"
    )


@query
def lda_by_sentiment(spark, sf_dir):
    sentiments = scored(spark, sf_dir).select("doc_id", "sentiment", F.array_join("tokens", " ").alias("text"))
    tokens = phrases.topic_model_tokens(sentiments, "doc_id", "text", out="topic_tokens")
    stored = materialize(tokens.select("doc_id", "sentiment", "topic_tokens"), "by_sentiment")
    groups = [{"sentiment": name} for name in ("negative", "neutral", "positive")]
    return lda.topics_by_group(stored, "doc_id", "topic_tokens", groups, k=3, chunk=lda.CHUNK)


def _nmf_inputs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = topic_inputs(spark, sf_dir)
    weights = features.Tfidf("doc_id", "topic_tokens", (1, 1), min_df=10, max_df=0.95).fit(docs).weights(docs)
    return docs, materialize(weights.select("doc_id", "term", "weight"), "nmf_weights")


@query
def nmf_topics(spark, sf_dir):
    _, weights = _nmf_inputs(spark, sf_dir)
    return nmf.fit_nmf(weights, "doc_id", 4).topic_words(15)


@query
def nmf_best_k(spark, sf_dir):
    docs, weights = _nmf_inputs(spark, sf_dir)
    dictionary = vocab.fixed_vocabulary(docs, "topic_tokens")
    return _sweep_table(spark, nmf.sweep(docs, "doc_id", "topic_tokens", weights, dictionary))


@query
def nmf_doc_topics(spark, sf_dir):
    """The dominant topic of every text and its weight."""
    _, weights = _nmf_inputs(spark, sf_dir)
    return nmf.fit_nmf(weights, "doc_id", 4).doc_topics("doc_id")


@query
def tfidf_svd(spark, sf_dir):
    """Singular values of the TF-IDF table and the share of its squares they capture."""
    _, weights = _nmf_inputs(spark, sf_dir)
    found = svd.truncated_svd(nmf.stored_weights(weights, "doc_id"), "doc_id", 9, tol=1e-4)
    rows = [(i + 1, s, share) for i, (s, share) in enumerate(zip(found.sigma, found.shares(), strict=True))]
    return literal_table(spark, rows, "component int, sigma double, share double")


@query
def doc_vectors(spark, sf_dir):
    """Every document, every dimension."""
    vectors = doc_vecs.document_vectors(stored_tokens(spark, sf_dir), "doc_id", "tokens", size=16)
    return rounded(vectors.select("doc_id", F.posexplode("vector").alias("dimension", "value")), "value")


@query
def reduce_vectors(spark, sf_dir):
    reduced = embedding_topics.reduce_vectors(fx.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 5)
    return reduced.select("vec_id", *[F.col("reduced")[i].alias(f"pc{i + 1}") for i in range(5)])


@query
def embedding_topic_model(spark, sf_dir):
    docs = stored_tokens(spark, sf_dir)
    ready = materialize(docs.join(doc_vecs.document_vectors(docs, "doc_id", "tokens"), "doc_id"), "with_vectors")
    assigned = embedding_topics.embedding_topics(ready, "doc_id", "tokens", "vector")
    return assigned.select("doc_id", "topic")


@shared_table
def reachability(spark, sf_dir):
    """Mutual reachability of the ten nearest among all different document vectors, entries rounded to six digits."""
    vectors = doc_vecs.document_vectors(stored_tokens(spark, sf_dir), "doc_id", "tokens", size=16)
    vectors = vectors.select("doc_id", F.transform("vector", lambda x: F.round(x, 6) + F.lit(0.0)).alias("v"))
    points = vectors.groupBy("v").agg(F.min("doc_id").alias("node"), F.count("*").alias("weight"))
    points = materialize(points, "points")
    return density.reachability_edges(points, density.nearest_neighbours(points, 10), 5)


@query
def reachability_graph(spark, sf_dir):
    return rounded(reachability(spark, sf_dir), "w")


@query
def reachability_components(spark, sf_dir):
    """Components of the edges of at most the mean weight in the spanning forest, which has those of the graph."""
    edges = reachability(spark, sf_dir)
    border = edges.agg(F.avg("w").alias("border"))  # one row
    forest = density.spanning_forest(edges).join(F.broadcast(border), F.col("w") <= F.col("border"))
    return density.forest_roots(materialize(forest.select("a", "b"), "below_mean"))


@query
def density_topics(spark, sf_dir):
    """Topics whose number comes from the data: reduced document vectors, clusters of 20 or more, outliers -1."""
    docs = stored_tokens(spark, sf_dir)
    vectors = materialize(doc_vecs.document_vectors(docs, "doc_id", "tokens"), "vectors")  # read twice below
    reduced = embedding_topics.reduce_vectors(vectors, "doc_id", "vector", 5)
    return density.density_clusters(reduced, "doc_id", "reduced", min_size=20, min_samples=10, levels=16)


def _topic_term_counts(spark, sf_dir) -> DataFrame:
    docs = fx.documents_with_topics(spark, sf_dir).select("doc_id", "topic").join(stored_tokens(spark, sf_dir), "doc_id")
    return materialize(embedding_topics.class_term_counts(docs, "topic", "tokens"), "class_counts")


@query
def class_tfidf_words(spark, sf_dir):
    return rounded(embedding_topics.class_tfidf_words(_topic_term_counts(spark, sf_dir), 15), "weight")


@query
def merge_topic_step(spark, sf_dir):
    return rounded(embedding_topics.nearest_topic(_topic_term_counts(spark, sf_dir)), "similarity")


@query
def topic_sizes(spark, sf_dir):
    return embedding_topics.topic_sizes(fx.documents_with_topics(spark, sf_dir))


@query
def representative_docs(spark, sf_dir):
    docs = fx.documents_with_topics(spark, sf_dir)
    vectors = materialize(doc_vecs.document_vectors(stored_tokens(spark, sf_dir), "doc_id", "tokens", size=16), "vectors")  # read three times below
    return embedding_topics.representative_docs(docs.join(vectors, "doc_id"), "doc_id", "topic", "vector", "text")


@query
def embedding_coherence(spark, sf_dir):
    """Coherence of the best words of topics that come from vectors."""
    topics = materialize(embedding_topics.class_tfidf_words(_topic_term_counts(spark, sf_dir), 8), "topic_words")
    topics = topics.select("topic", F.col("term").alias("word"))
    return rounded(coherence.topic_coherence(stored_tokens(spark, sf_dir), "doc_id", "tokens", topics), "coherence")


@query
def reassign_topics(spark, sf_dir):
    """Every document, outliers too, to the topic whose mean vector is nearest."""
    vectors = doc_vecs.document_vectors(stored_tokens(spark, sf_dir), "doc_id", "tokens", size=16)
    docs = materialize(fx.documents_with_topics(spark, sf_dir).select("doc_id", "topic").join(vectors, "doc_id"), "topic_vectors")
    return embedding_topics.reassign(docs, "doc_id", "vector").select("doc_id", "topic")


@query
def embedding_topic_report(spark, sf_dir):
    """The whole pipeline on one sentiment: topics with their words, weights, sizes and coherence."""
    docs = scored(spark, sf_dir).filter("sentiment = 'positive'").select("doc_id", "tokens")
    docs = materialize(docs, "positive")
    ready = materialize(docs.join(doc_vecs.document_vectors(docs, "doc_id", "tokens"), "doc_id"), "with_vectors")
    return embedding_topics.topic_report(ready, "doc_id", "tokens", "vector")


@query
def topic_membership(spark, sf_dir):
    vectors = fx.table(spark, sf_dir, "embeddings")
    means = embedding_topics.centroids(vectors, "label", "embedding")
    return rounded(embedding_topics.topic_membership(vectors, "vec_id", "embedding", means), "probability")
