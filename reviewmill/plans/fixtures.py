"""How the operators are set up on the given tables.

``documents`` and the turns of ``conversations`` stand for the review tables
of two platforms; ``labels`` for the hand-made labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill.config import THREADS_LABELS, TWITTER_LABELS, PlatformConfig
from reviewmill.operators.sentiment import Lexicon

# Lookups that fit the invented prose of the tables (fixed values).
BRANDS = (("th", "the"), ("nd", "and"), ("und", "and"), ("nt", "not"))
STOP_WORDS = (
    "the", "a", "of", "and", "to", "in", "is", "that", "it", "for",
    "was", "on", "with", "be", "by", "as", "this", "are", "at", "from",
)
CUSTOM_STOP_WORDS = ("he", "re")
VALENCES = (
    ("idiot", -2.3), ("scum", -2.6), ("clown", -1.1), ("worthless", -1.9), ("moron", -2.4),
    ("pathetic", -2.1), ("loser", -2.4), ("disgusting", -2.4), ("stupid", -2.4), ("trash", -1.6),
    ("no", -1.2), ("tion", 1.9), ("ing", 2.3), ("ly", 1.4), ("ble", 2.7),
)
BOOSTERS = (("ed", 0.293), ("er", -0.293))
NEGATORS = ("nicht", "not")
COHERENCE_TOPICS = (
    (0, ("trash", "scum", "idiot", "moron", "stupid")),
    (1, ("tion", "ing", "ly", "ble")),
    (2, ("ed", "er", "en", "nothere")),
)
N_SCORES = 10  # classes of the scoring example

DOCUMENTS = PlatformConfig(
    name="documents",
    text_col="text",
    id_col="doc_id",
    brand_rules=BRANDS,
    stop_words=STOP_WORDS,
    negations=(),
    custom_stop_words=CUSTOM_STOP_WORDS,
    removed_languages=("es",),
    label_map=THREADS_LABELS,
)
CONVERSATIONS = DOCUMENTS.with_(
    name="conversations", id_col="turn_id", label_map=TWITTER_LABELS, unmapped_includes_null=False, split_on_gold=False
)


def lexicon() -> Lexicon:
    return Lexicon(list(VALENCES), list(BOOSTERS), [(word,) for word in NEGATORS])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "text")


def human_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, sentiment_true) in the mixed spelling of a hand-labelled column."""
    label = (
        F.when(F.col("toxic") == 1, "Negative")
        .when(F.col("quality") == 1, "positive")
        .when(F.col("quality") == 0, "Neutral")
    )
    return table(spark, sf_dir, "labels").select("doc_id", label.alias("sentiment_true"))


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).join(human_labels(spark, sf_dir), "doc_id", "left")


def documents_with_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, with the last digit of its source's number as topic; 9 stands for outliers."""
    digit = F.right(F.col("source"), F.lit(1)).cast("int")
    return documents(spark, sf_dir).withColumn("topic", F.when(digit == 9, -1).otherwise(digit))
