"""TF-IDF over word n-grams, as a long table and as ML vectors."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.functions.text import drop_words, word_ngrams
from reviewmill.session import exploded, materialize, with_once

MIN_TOKEN_CHARS = 2
TASK_TOKENS = 1_000_000  # tokens whose terms one task counts, about


def term_arrays(
    df: DataFrame,
    id_col: str,
    tokens_col: str,
    ngrams: tuple[int, int] = (1, 1),
    stop_words: tuple[str, ...] = (),
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(id, terms): n-grams over tokens of two or more characters, stop words out first."""
    kept = F.filter(F.col(tokens_col), lambda word: F.length(word) >= MIN_TOKEN_CHARS)
    words = with_once(df.select(id_col, *keep, tokens_col), __words=drop_words(kept, stop_words))
    return words.select(id_col, *keep, word_ngrams(F.col("__words"), *ngrams).alias("terms"))


def term_counts(terms: DataFrame, id_col: str) -> DataFrame:
    """(id, term, tf).  Texts move once, whole and by id; counting is then local."""
    placed = terms.select(id_col, "terms").repartition(F.col(id_col))
    return exploded(placed, F.col("terms"), "term", id_col).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf_vocabulary(
    counts: DataFrame,
    id_col: str,
    n_docs: int,
    min_df: int = 1,
    max_df: float = 1.0,
    max_features: int | None = None,
) -> DataFrame:
    """(term, df, corpus_tf, idf) with idf = ln((1+n)/(1+df)) + 1."""
    vocab = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("corpus_tf"))
    vocab = vocab.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    if max_features is not None:
        vocab = vocab.orderBy(F.desc("corpus_tf"), F.asc("term")).limit(max_features)
    return vocab.withColumn("idf", F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0)


class Tfidf:
    """Fit on one table, weigh any other.

    The vocabulary is written out once.  ``weights`` joins it by its real size
    and works for any vocabulary; ``vectors`` needs the term positions on the driver,
    so a large vocabulary wants ``max_features`` or ``weights``.
    """

    def __init__(
        self,
        id_col: str,
        tokens_col: str,
        ngrams: tuple[int, int] = (1, 1),
        min_df: int = 1,
        max_df: float = 1.0,
        max_features: int | None = None,
        stop_words: tuple[str, ...] = (),
    ):
        self.id_col, self.tokens_col, self.ngrams = id_col, tokens_col, ngrams
        self.min_df, self.max_df, self.max_features = min_df, max_df, max_features
        self.stop_words = stop_words
        self.vocabulary: DataFrame | None = None
        self._fitted: tuple[DataFrame | None, DataFrame | None] = (None, None)

    def _terms(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        return term_arrays(df, self.id_col, self.tokens_col, self.ngrams, self.stop_words, keep)

    def _counts(self, df: DataFrame) -> DataFrame:
        """(id, term, tf).  Tokens move once, by id; n-grams are made and counted where they are.

        Nearly every n-gram of a task is an entry of its hash table, so texts are dealt by ``TASK_TOKENS``.
        """
        n_tokens = df.agg(F.sum(F.size(self.tokens_col)).alias("n")).first()["n"] or 0
        parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-n_tokens // TASK_TOKENS))
        placed = df.select(self.id_col, self.tokens_col).repartition(parts, F.col(self.id_col))
        terms = exploded(self._terms(placed), F.col("terms"), "term", self.id_col)
        return terms.groupBy(self.id_col, "term").agg(F.count(F.lit(1)).alias("tf"))

    def fit(self, df: DataFrame) -> Tfidf:
        """The counts are stored: the vocabulary and the weights of the same table come from them."""
        counts = materialize(self._counts(df), "term_counts")
        self._fitted = (df, counts)
        vocab = tfidf_vocabulary(counts, self.id_col, df.count(), self.min_df, self.max_df, self.max_features)
        self.vocabulary = materialize(vocab, "tfidf_vocabulary")
        return self

    def counts(self, df: DataFrame) -> DataFrame:
        """(id, term, tf): the stored counts of the table it was fitted to, or those of any other."""
        fitted, stored = self._fitted
        return stored if df is fitted else self._counts(df)

    def weights(self, df: DataFrame) -> DataFrame:
        """(id, term, tf, weight): tf * idf, scaled to unit length per text."""
        raw = self.counts(df).join(self.vocabulary.select("term", "idf"), "term").withColumn("w", F.col("tf") * F.col("idf"))
        norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(self.id_col)))
        return raw.select(self.id_col, "term", "tf", (F.col("w") / norm).alias("weight"))

    def vectors(
        self, df: DataFrame, keep: tuple[str, ...] = (), out: str = "features"
    ) -> DataFrame:
        """(id, *keep, features): the same weights as sparse vectors, row by row in the JVM."""
        rows = self.vocabulary.select("term", "idf").orderBy("term").collect()
        if not rows:
            raise ValueError("vectors need a term at least")
        counter = CountVectorizerModel.from_vocabulary([r["term"] for r in rows], inputCol="terms", outputCol="__tf")
        scaler = ElementwiseProduct(
            scalingVec=Vectors.dense([r["idf"] for r in rows]), inputCol="__tf", outputCol="__tfidf"
        )
        normalizer = Normalizer(p=2.0, inputCol="__tfidf", outputCol=out)
        counted = counter.transform(self._terms(df, keep))
        return normalizer.transform(scaler.transform(counted)).select(self.id_col, *keep, out)
