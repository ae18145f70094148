"""Per-platform settings and the fixed values they are made of."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import lru_cache

# --- Fixed values -----------------------------------------------------------
# These must be exactly as written for results to be right.

SENTIMENTS = ("negative", "neutral", "positive")

BRAND_RULES = (
    ("twitter", "twitter"),
    ("twt", "twitter"),
    ("twit", "twitter"),
    ("twwitter", "twitter"),
    ("twiter", "twitter"),
    ("x", "twitter"),
    ("threads", "threads"),
    ("thread", "threads"),
    ("tread", "threads"),
    ("treads", "threads"),
    ("threds", "threads"),
    ("instagram", "instagram"),
    ("insta", "instagram"),
    ("instgram", "instagram"),
    ("instragram", "instagram"),
    ("facebook", "facebook"),
    ("facebok", "facebook"),
    ("fb", "facebook"),
    ("meta", "facebook"),
)

NEGATIONS = ("no", "not", "nor", "dont", "can't", "cannot", "never")

THREADS_STOP_WORDS = ("app", "apps", "application", "applications", "threads", "experience", "im", "account")
TWITTER_STOP_WORDS = ("app", "apps", "application", "applications", "twitter", "im", "account")

THREADS_REMOVED_LANGUAGES = ("vi", "tr", "sw", "sq", "so", "pt", "lv", "lt", "id", "hr", "et", "es")
TWITTER_REMOVED_LANGUAGES = (
    "vi", "tr", "tl", "sw", "sq", "so", "sl", "pl", "pt", "lv",
    "lt", "id", "hr", "es", "ca", "cy", "de", "fi", "hu",
)

THREADS_LABELS = (
    ("negative", "negative"),
    ("positive", "positive"),
    ("neutral", "neutral"),
    ("Negative", "negative"),
    ("Positive", "positive"),
    ("Neutral", "neutral"),
)
TWITTER_LABELS = (
    ("Negative", "negative"),
    ("negative", "negative"),
    ("Positive", "positive"),
    ("Neutral", "neutral"),
)

# Contractions a treebank tokeniser splits even without an apostrophe.
CONTRACTIONS = (
    ("can", "not"),
    ("gim", "me"),
    ("gon", "na"),
    ("got", "ta"),
    ("lem", "me"),
    ("wan", "na"),
)

# Noun endings of the WordNet morphology: (ending, replacement).
NOUN_ENDINGS = (
    ("s", ""),
    ("ses", "s"),
    ("ves", "f"),
    ("xes", "x"),
    ("zes", "z"),
    ("ches", "ch"),
    ("shes", "sh"),
    ("men", "man"),
    ("ies", "y"),
)

# Multi-word or compound expressions with a valence of their own.
IDIOMS = (
    ("the shit", 3.0),
    ("the bomb", 3.0),
    ("bad ass", 1.5),
    ("badass", 1.5),
    ("bus stop", 0.0),
    ("yeah right", -2.0),
    ("kiss of death", -1.5),
    ("to die for", 3.0),
    ("beating heart", 3.1),
    ("broken heart", -2.9),
)

# A small starter lexicon; pass a full one as a DataFrame (term, valence).
STARTER_LEXICON = (
    ("good", 1.9), ("nice", 1.8), ("great", 3.1), ("better", 1.9), ("best", 3.2),
    ("love", 3.2), ("like", 1.5), ("easy", 1.9), ("fun", 2.3), ("amazing", 2.8),
    ("bad", -2.5), ("worse", -2.1), ("worst", -3.1), ("hate", -2.7), ("terrible", -2.1),
    ("awful", -2.0), ("useless", -1.8), ("annoying", -1.7), ("broken", -2.1), ("no", -1.2),
)
STARTER_BOOSTERS = (
    ("really", 0.293), ("very", 0.293), ("so", 0.293), ("extremely", 0.293), ("totally", 0.293),
    ("barely", -0.293), ("hardly", -0.293), ("slightly", -0.293), ("somewhat", -0.293),
)
STARTER_NEGATORS = ("not", "never", "cannot", "dont", "isnt", "wasnt", "nothing", "neither", "without", "none")


@dataclass(frozen=True)
class PlatformConfig:
    """Everything that differs between two review tables."""

    name: str
    text_col: str
    id_col: str = "review_id"
    label_col: str = "sentiment_true"
    min_words: int = 15
    brand_rules: tuple[tuple[str, str], ...] = BRAND_RULES
    stop_words: tuple[str, ...] | None = None  # None: Spark's built-in English list
    negations: tuple[str, ...] = NEGATIONS
    custom_stop_words: tuple[str, ...] = ()
    removed_languages: tuple[str, ...] = ()
    label_map: tuple[tuple[str, str], ...] = THREADS_LABELS
    unmapped_includes_null: bool = True
    split_on_gold: bool = True  # split only hand-labelled rows, by the human label
    test_fraction: float = 0.2
    seed: int = 42

    def stop_list(self) -> tuple[str, ...]:
        base = self.stop_words if self.stop_words is not None else english_stop_words()
        kept = set(self.negations)
        return tuple(word for word in base if word not in kept)

    def with_(self, **changes: object) -> PlatformConfig:
        return replace(self, **changes)


@lru_cache(maxsize=1)
def english_stop_words() -> tuple[str, ...]:
    """Spark's own English stop list (needs a running session)."""
    from pyspark.ml.feature import StopWordsRemover

    return tuple(StopWordsRemover.loadDefaultStopWords("english"))


PRESETS = {
    "threads": PlatformConfig(
        name="threads",
        text_col="review_description",
        custom_stop_words=THREADS_STOP_WORDS,
        removed_languages=THREADS_REMOVED_LANGUAGES,
        label_map=THREADS_LABELS,
        unmapped_includes_null=True,
        split_on_gold=True,
    ),
    "twitter": PlatformConfig(
        name="twitter",
        text_col="review_text",
        custom_stop_words=TWITTER_STOP_WORDS,
        removed_languages=TWITTER_REMOVED_LANGUAGES,
        label_map=TWITTER_LABELS,
        unmapped_includes_null=False,
        split_on_gold=False,
    ),
}
