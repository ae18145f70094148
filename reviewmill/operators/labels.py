"""Human labels: standardising, auditing, subsetting, encoding, weighting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.config import SENTIMENTS


def mapped(value: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    """Value looked up in a small literal map; anything else becomes null."""
    table = F.create_map(*[F.lit(part) for pair in pairs for part in pair])
    return F.try_element_at(table, value)


def standardize_labels(
    df: DataFrame, label_col: str, pairs: tuple[tuple[str, str], ...], out: str = "sentiment_true_clean"
) -> DataFrame:
    return df.withColumn(out, mapped(F.col(label_col), pairs))


def unmapped_labels(
    df: DataFrame, label_col: str, pairs: tuple[tuple[str, str], ...], include_null: bool = True
) -> DataFrame:
    """Distinct labels the map does not know."""
    unknown = df.select(label_col).filter(mapped(F.col(label_col), pairs).isNull())
    if not include_null:
        unknown = unknown.filter(F.col(label_col).isNotNull())
    return unknown.distinct()


def gold_rows(df: DataFrame, clean_label_col: str = "sentiment_true_clean") -> DataFrame:
    return df.filter(F.col(clean_label_col).isNotNull())


def label_totals(df: DataFrame, clean_label_col: str = "sentiment_true_clean") -> DataFrame:
    label = F.col(clean_label_col)
    return df.agg(
        F.count(label).alias("n_labelled"),
        *[F.count_if(label == name).alias(f"n_{name}") for name in SENTIMENTS],
    )


def label_index(df: DataFrame, label_col: str) -> DataFrame:
    """Label -> position in alphabetical order.

    Ranking runs on the distinct labels, a table as small as the label set.
    """
    names = df.select(F.col(label_col).alias("label")).filter("label is not null").distinct()
    ordered = names.agg(F.sort_array(F.collect_list("label")).alias("names"))
    return ordered.select(F.posexplode("names").alias("label_id", "label")).select("label", "label_id")


def class_weights(df: DataFrame, label_col: str) -> DataFrame:
    """Balanced weight n / (k * n_c) per class."""
    counts = df.filter(F.col(label_col).isNotNull()).groupBy(label_col).agg(F.count(F.lit(1)).alias("n_rows"))
    all_classes = Window.partitionBy()  # one row per class
    total, classes = F.sum("n_rows").over(all_classes), F.count(F.lit(1)).over(all_classes)
    return counts.select(
        F.col(label_col).alias("label"), "n_rows", (total / (classes * F.col("n_rows"))).alias("class_weight")
    )
