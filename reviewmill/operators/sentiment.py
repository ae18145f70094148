"""Lexicon sentiment, one-column k-means, labels.

The scorer follows the published rule-based valence method (Hutto & Gilbert,
2014) for text that is already lower-case and free of punctuation.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill.config import SENTIMENTS, STARTER_BOOSTERS, STARTER_LEXICON, STARTER_NEGATORS
from reviewmill.session import exploded, literal_table, lookup, materialize

# Constants of the published method (fixed values).
NEGATED = -0.74
NORMALIZER = 15.0
DAMPING = (1.0, 0.95, 0.9)
NEVER_SO = 1.25


@dataclass(frozen=True)
class Lexicon:
    """Word tables of the scorer: DataFrames, or literal rows for small ones."""

    valences: DataFrame | list[tuple[str, float]]  # term, valence
    boosters: DataFrame | list[tuple[str, float]]  # term, increment
    negators: DataFrame | list[tuple[str]]  # term
    idioms: tuple[tuple[str, float], ...] = ()

    def table(self, spark: SparkSession) -> DataFrame:
        """One lookup row per term: valence, booster increment, negation flag.

        Word lists are merged here; with a DataFrame among them the merged table
        is stored, so its size decides how it is joined.
        """
        given = (self.valences, self.boosters, self.negators)
        if not any(isinstance(words, DataFrame) for words in given):
            values, steps, negates = dict(self.valences), dict(self.boosters), {row[0] for row in self.negators}
            terms = dict.fromkeys([*values, *steps, *negates])
            rows = [(term, values.get(term), steps.get(term), term in negates) for term in terms]
            return literal_table(spark, rows, "term string, valence double, increment double, negates boolean")
        parts = [
            lookup(spark, self.valences, "term string, valence double").select(
                "term", "valence", F.lit(None).cast("double").alias("increment"), F.lit(False).alias("negates")
            ),
            lookup(spark, self.boosters, "term string, increment double").select(
                "term", F.lit(None).cast("double").alias("valence"), "increment", F.lit(False).alias("negates")
            ),
            lookup(spark, self.negators, "term string").select(
                "term",
                F.lit(None).cast("double").alias("valence"),
                F.lit(None).cast("double").alias("increment"),
                F.lit(True).alias("negates"),
            ),
        ]
        merged = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("term").agg(
            F.max("valence").alias("valence"), F.max("increment").alias("increment"), F.max("negates").alias("negates")
        )
        return materialize(merged, "lexicon")


def starter_lexicon() -> Lexicon:
    from reviewmill.config import IDIOMS

    return Lexicon(list(STARTER_LEXICON), list(STARTER_BOOSTERS), [(word,) for word in STARTER_NEGATORS], IDIOMS)


def _hits(df: DataFrame, id_col: str, tokens_col: str, scoring: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """One row per scoring token with the tokens around it.

    A token carries its five neighbours, not its text, so the rows stay small
    whichever way the lexicon is joined. With ``terms`` only those tokens become rows.
    """
    offsets = {"p1": -1, "p2": -2, "p3": -3, "n1": 1, "n2": 2}
    token = F.col(tokens_col)

    def place(w: Column, i: Column) -> Column:
        made = F.struct(w.alias("w0"), *[F.get(token, i + step).alias(name) for name, step in offsets.items()])
        return made if terms is None else F.when(w.isin(*terms), made)

    around = F.transform(token, place)
    if terms is not None:
        around = F.filter(around, lambda at: at.isNotNull())
    words = exploded(df, around, "__w", id_col).select(id_col, "__w.*")
    return words.join(scoring, "w0").select(id_col, "w0", "v", *offsets)


def _boosted(value: Column, step: int) -> Column:
    """Add the increment of the word ``step`` places back, against the sign of a negative value."""
    increment = F.coalesce(F.col(f"i{step}"), F.lit(0.0)) * DAMPING[step - 1]
    return value + F.when(value < 0, -increment).otherwise(increment)


def _negated(value: Column, step: int) -> Column:
    """Flip or strengthen by the word ``step`` places back."""
    flips = F.coalesce(F.col(f"g{step}"), F.lit(False))
    plain = F.when(flips, value * NEGATED).otherwise(value)
    if step == 1:
        return plain
    emphatic = ("so", "this")
    if step == 2:
        never = (F.col("p2") == "never") & F.col("p1").isin(*emphatic)
        doubt = (F.col("p2") == "without") & (F.col("p1") == "doubt")
    else:
        never = ((F.col("p3") == "never") & F.col("p2").isin(*emphatic)) | F.col("p1").isin(*emphatic)
        doubt = (F.col("p3") == "without") & ((F.col("p2") == "doubt") | (F.col("p1") == "doubt"))
    return F.when(never, value * NEVER_SO).when(doubt, value).otherwise(plain)


def _idiomatic(value: Column, idioms: tuple[tuple[str, float], ...]) -> Column:
    if not idioms:
        return value
    table = F.create_map(*[F.lit(part) for pair in idioms for part in pair])
    phrases = [
        ("w0", "n1", "n2"), ("w0", "n1"),
        ("p1", "w0"), ("p2", "p1", "w0"), ("p2", "p1"), ("p3", "p2", "p1"), ("p3", "p2"),
    ]

    def valence(words: tuple[str, ...]) -> Column:
        phrase = F.when(F.col(words[-1]).isNotNull(), F.concat_ws(" ", *words))
        return F.try_element_at(table, phrase)

    return F.coalesce(*[valence(phrase) for phrase in phrases], value)


def compound_scores(df: DataFrame, id_col: str, tokens_col: str, lexicon: Lexicon) -> DataFrame:
    """(id, compound): sentiment of each token list in [-1, 1], four decimals.

    Tokens meet the lexicon where they were exploded (hash joins against one
    small table) and are summed map-side, so the shuffle moves one number per
    review, not its words.
    """
    table = lexicon.table(df.sparkSession)

    def neighbour(step: int) -> DataFrame:
        return table.select(
            F.col("term").alias(f"p{step}"),
            F.col("valence").isNotNull().alias(f"k{step}"),
            F.col("increment").alias(f"i{step}"),
            F.col("negates").alias(f"g{step}"),
        )

    here = table.select(F.col("term").alias("w0"), F.col("valence").alias("v"), F.col("increment").alias("i0"))
    after = table.filter("valence is not null").select(F.col("term").alias("n1"), F.lit(True).alias("kn"))
    # Only tokens that carry a valence can score; a booster in the lexicon scores 0.
    terms = None if isinstance(lexicon.valences, DataFrame) else [term for term, _ in lexicon.valences]
    hits = (
        _hits(df, id_col, tokens_col, here.filter("v is not null and i0 is null").drop("i0"), terms)
        .filter(~((F.col("w0") == "kind") & F.coalesce(F.col("n1") == "of", F.lit(False))))
        .join(neighbour(1), "p1", "left")
        .join(neighbour(2), "p2", "left")
        .join(neighbour(3), "p3", "left")
        .join(after, "n1", "left")
    )
    is_no = [F.coalesce(F.col(f"p{d}") == "no", F.lit(False)) for d in (1, 2, 3)]
    after_no = is_no[0] | is_no[1] | (is_no[2] & F.coalesce(F.col("p1").isin("or", "nor"), F.lit(False)))
    before_known = (F.col("w0") == "no") & F.coalesce(F.col("kn"), F.lit(False))
    start = F.when(after_no, F.col("v") * NEGATED).when(before_known, 0.0).otherwise(F.col("v"))

    def counts(step: int) -> Column:
        """The word ``step`` places back exists and has no valence of its own."""
        return F.col(f"p{step}").isNotNull() & ~F.coalesce(F.col(f"k{step}"), F.lit(False))

    scored = hits.withColumn("s", start)
    for step in (1, 2, 3):
        scored = scored.withColumn("s", F.when(counts(step), _boosted(F.col("s"), step)).otherwise(F.col("s")))
        changed = _negated(F.col("s"), step)
        if step == 3:
            changed = _idiomatic(changed, lexicon.idioms)
        scored = scored.withColumn("s", F.when(counts(step), changed).otherwise(F.col("s")))
    least = counts(1) & (F.col("p1") == "least") & ~F.coalesce(F.col("p2").isin("at", "very"), F.lit(False))
    scored = scored.withColumn("s", F.when(least, F.col("s") * NEGATED).otherwise(F.col("s")))
    sums = scored.groupBy(id_col).agg(F.sum("s").alias("s"))
    raw = F.col("s") / F.sqrt(F.col("s") * F.col("s") + NORMALIZER)
    compound = F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)), 4)
    scores = sums.select(id_col, compound.alias("compound"))
    return df.select(id_col).join(scores, id_col, "left").select(
        id_col, F.coalesce("compound", F.lit(0.0)).alias("compound")
    )


def score_histogram(df: DataFrame, col: str = "compound") -> DataFrame:
    """Rows per score.  Four decimals in [-1, 1]: at most 20,001 rows."""
    return df.select(F.round(col, 4).alias("x")).filter("x is not null").groupBy("x").agg(F.count(F.lit(1)).alias("n"))


def kmeans_centroids(df: DataFrame, col: str = "compound", max_iter: int = 300) -> list[float]:
    """Centroids of one-column k-means with k = 3, ascending.

    Spark reduces the table to its score histogram; since that is bounded by
    20,001 rows for any table size, the few Lloyd steps run on the driver from
    fixed starts (minimum, median, maximum).
    """
    bars = sorted((row["x"], row["n"]) for row in score_histogram(df, col).collect())
    if not bars:
        raise ValueError("no scores to cluster")
    x = np.array([bar[0] for bar in bars], dtype=float)
    n = np.array([bar[1] for bar in bars], dtype=float)
    median = x[np.searchsorted(np.cumsum(n), n.sum() / 2.0)]
    centres = np.array([x[0], median, x[-1]])
    for _ in range(max_iter):
        cluster = np.searchsorted((centres[:-1] + centres[1:]) / 2.0, x, side="left")
        weight = np.bincount(cluster, weights=n, minlength=3)
        total = np.bincount(cluster, weights=n * x, minlength=3)
        moved = np.where(weight > 0, total / np.maximum(weight, 1.0), centres)
        if np.array_equal(moved, centres):
            break
        centres = moved
    return [float(value) for value in centres]


def sentiment_label(compound: Column, centroids: list[float]) -> Column:
    """Name of the nearest of the three ascending centroids."""
    low, high = (centroids[0] + centroids[1]) / 2.0, (centroids[1] + centroids[2]) / 2.0
    return (
        F.when(compound <= low, SENTIMENTS[0]).when(compound <= high, SENTIMENTS[1]).when(compound > high, SENTIMENTS[2])
    )


def label_sentiment(df: DataFrame, col: str = "compound", out: str = "sentiment") -> DataFrame:
    return df.withColumn(out, sentiment_label(F.col(col), kmeans_centroids(df, col)))
