"""Word counts over token arrays, overall and per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def word_counts(df: DataFrame, tokens_col: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Occurrences per (group, word); counted map-side before the shuffle."""
    words = df.select(*by, F.explode(tokens_col).alias("word"))
    return words.groupBy(*by, "word").agg(F.count(F.lit(1)).alias("n"))


def top_words(df: DataFrame, tokens_col: str, n: int = 20) -> DataFrame:
    """Most frequent words, ties in alphabetical order."""
    return word_counts(df, tokens_col).orderBy(F.desc("n"), F.asc("word")).limit(n)


def top_words_by(df: DataFrame, tokens_col: str, by: tuple[str, ...], n: int = 10) -> DataFrame:
    """The ``n`` most frequent words of each group.

    Each task keeps its own best ``n`` per group (WindowGroupLimit), so no task
    receives a group's whole vocabulary.
    """
    order = Window.partitionBy(*by).orderBy(F.desc("n"), F.asc("word"))
    ranked = word_counts(df, tokens_col, by).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= n)


def word_weights(df: DataFrame, tokens_col: str, by: tuple[str, ...], n: int = 200) -> DataFrame:
    """Word-cloud input: top words with their count relative to the group's largest."""
    top = top_words_by(df, tokens_col, by, n)
    largest = F.max("n").over(Window.partitionBy(*by))
    return top.withColumn("weight", F.col("n") / largest)


def value_share(df: DataFrame, by: str, value: str) -> DataFrame:
    """Rows per (group, value) and their share of the group."""
    counts = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by)))


def box_stats(df: DataFrame, value_col: str, by: str) -> DataFrame:
    """Box-plot numbers per group: quartiles, whiskers, outliers.

    Equal values are counted first, so the exact percentiles and the fences come
    from a histogram instead of from all rows.
    """
    value = F.col(value_col)
    bars = df.select(F.col(by), value.alias("v")).groupBy(by, "v").agg(F.count(F.lit(1)).alias("n"))
    quartiles = bars.groupBy(by).agg(
        F.sum("n").alias("n_rows"),
        F.expr("percentile(v, array(0.25D, 0.5D, 0.75D), n)").alias("q"),
    )
    boxed = quartiles.select(
        by,
        "n_rows",
        F.col("q")[0].alias("q1"),
        F.col("q")[1].alias("median"),
        F.col("q")[2].alias("q3"),
    ).withColumn("iqr", F.col("q3") - F.col("q1"))
    inside = (F.col("v") >= F.col("q1") - 1.5 * F.col("iqr")) & (F.col("v") <= F.col("q3") + 1.5 * F.col("iqr"))
    return (
        bars.join(boxed, by)
        .groupBy(by, "n_rows", "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
            F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("n_outliers"),
        )
    )
