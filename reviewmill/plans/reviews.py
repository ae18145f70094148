"""End-to-end plans: from a raw review table to labelled, comparable reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.config import PlatformConfig
from reviewmill.functions.text import clean_tokens, has_min_words, is_blank
from reviewmill.operators.dedup import text_key
from reviewmill.operators.labels import standardize_labels
from reviewmill.operators.language import LanguageModel
from reviewmill.operators.lemma import lemmatize
from reviewmill.operators.profile import stage_counts
from reviewmill.operators.sentiment import Lexicon, compound_scores, label_sentiment
from reviewmill.operators.split import stratified_split

from reviewmill.operators.words import top_words_by, value_share
from reviewmill.session import materialize, with_once


def with_clean_tokens(df: DataFrame, config: PlatformConfig, out: str = "tokens") -> DataFrame:
    """Add the cleaned token list of the text column (without lemmas)."""
    return with_once(df, **{out: clean_tokens(F.col(config.text_col), config)})


def narrow_reviews(df: DataFrame, config: PlatformConfig, *extra: str) -> DataFrame:
    """(id, *extra, __key, is_long, tokens): all that later steps need of the texts, in one pass over them."""
    text = F.col(config.text_col)
    narrow = df.select(config.id_col, *extra, text_key(text).alias("__key"), has_min_words(text, config.min_words).alias("is_long"), config.text_col)
    return with_clean_tokens(narrow, config).drop(config.text_col)


def marked_reviews(
    df: DataFrame,
    config: PlatformConfig,
    languages: LanguageModel | None = None,
    lemmas: DataFrame | None = None,
    use_lemmas: bool = False,
    narrow: DataFrame | None = None,
    detected: DataFrame | None = None,
) -> DataFrame:
    """(id, is_long, is_repeat, tokens, review_cleaned[, detected_lang]) of every input row.

    One narrow pass over the texts makes digest, length flag and tokens and is stored;
    first ids, lemmas and languages are found from it and meet it on the id. Filtering
    on the flags gives the cleaned table, counting them the stage audit. A stored result of
    ``narrow_reviews`` or of the detection (id, detected_lang) is taken instead of made anew.
    """
    key = config.id_col
    stored = materialize(narrow_reviews(df, config), "narrow") if narrow is None else narrow.select(key, "__key", "is_long", "tokens")
    first = stored.filter("is_long").groupBy("__key").agg(F.min(key).alias(key)).select(key, F.lit(True).alias("__first"))
    marked = stored.drop("__key").join(first, key, "left")
    marked = marked.withColumn("is_repeat", F.col("is_long") & F.col("__first").isNull()).drop("__first")
    tokens = stored.select(key, "tokens")
    if use_lemmas:
        tokens = materialize(lemmatize(tokens, key, "tokens", lemmas), "lemmas")
        marked = marked.drop("tokens").join(tokens, key)
    marked = marked.withColumn("review_cleaned", F.array_join("tokens", " "))
    if detected is not None:
        marked = marked.join(detected.select(key, "detected_lang"), key)
    elif languages is not None:
        texts = tokens.select(key, F.array_join("tokens", " ").alias("review_cleaned"))
        marked = marked.join(languages.detect(texts, key, "review_cleaned"), key)
    return marked


def _keepers(marked: DataFrame, config: PlatformConfig) -> list[tuple[str, object]]:
    stages = [("long_duplicates", ~F.col("is_repeat")), ("empty_text", ~is_blank(F.col("review_cleaned")))]
    if "detected_lang" in marked.columns and config.removed_languages:
        stages.append(("language", ~F.col("detected_lang").isin(*config.removed_languages)))
    return stages


def clean_reviews(
    df: DataFrame,
    config: PlatformConfig,
    languages: LanguageModel | None = None,
    lemmas: DataFrame | None = None,
    use_lemmas: bool = False,
    with_text: bool = True,
    narrow: DataFrame | None = None,
) -> DataFrame:
    """De-duplicated, cleaned, non-empty reviews in the wanted languages.

    Adds tokens, review_cleaned and, with a language model, detected_lang to the
    columns of ``df``, without the raw text unless ``with_text``.
    """
    marked = marked_reviews(df, config, languages, lemmas, use_lemmas, narrow)
    for _, keep in _keepers(marked, config):
        marked = marked.filter(keep)
    kept = marked.drop("is_long", "is_repeat")
    again = df.columns if with_text else [c for c in df.columns if c != config.text_col]
    return kept if again == [config.id_col] else df.select(*again).join(kept, config.id_col)


def cleaning_audit(
    df: DataFrame, config: PlatformConfig, languages: LanguageModel | None = None,
    narrow: DataFrame | None = None, detected: DataFrame | None = None,
) -> DataFrame:
    """Rows before, after and removed for each cleaning filter."""
    marked = marked_reviews(df, config, languages, narrow=narrow, detected=detected)
    return stage_counts(marked, _keepers(marked, config))


def score_reviews(cleaned: DataFrame, config: PlatformConfig, lexicon: Lexicon) -> DataFrame:
    """Add compound and sentiment.

    The scores (an id and a number a row) are stored: the thresholds are found
    from all of them before the first row can be labelled.
    """
    scores = materialize(compound_scores(cleaned, config.id_col, "tokens", lexicon), "scores")
    return cleaned.join(label_sentiment(scores), config.id_col)


def label_reviews(scored: DataFrame, config: PlatformConfig) -> DataFrame:
    """Add the standardised human label."""
    return standardize_labels(scored, config.label_col, config.label_map)


def split_reviews(labelled: DataFrame, config: PlatformConfig) -> DataFrame:
    """Train and test parts: hand-labelled rows by human label, or all rows by derived label."""
    label = "sentiment_true_clean" if config.split_on_gold else "sentiment"
    rows = labelled.filter(F.col(label).isNotNull()) if config.split_on_gold else labelled
    return stratified_split(rows, config.id_col, label, config.test_fraction, config.seed)


def combine_platforms(parts: list[tuple[PlatformConfig, DataFrame]]) -> DataFrame:
    """(platform, id, sentiment, tokens) of several scored tables."""
    out = None
    for config, scored in parts:
        part = scored.select(
            F.lit(config.name).alias("platform"), F.col(config.id_col).alias("id"), "sentiment", "tokens"
        )
        out = part if out is None else out.unionByName(part)
    return out


def platform_sentiment_share(combined: DataFrame) -> DataFrame:
    return value_share(combined, "platform", "sentiment")


def platform_top_words(combined: DataFrame, n: int = 20) -> DataFrame:
    return top_words_by(combined, "tokens", ("platform",), n)
