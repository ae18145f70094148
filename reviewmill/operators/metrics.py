"""Agreement of two label columns.

The table is reduced to one row per (true, predicted) pair first; everything
after that works on at most labels x labels rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.config import SENTIMENTS
from reviewmill.session import literal_table, materialize


def confusion_long(df: DataFrame, true_col: str, pred_col: str) -> DataFrame:
    pairs = df.select(F.col(true_col).alias("true_label"), F.col(pred_col).alias("pred_label"))
    return pairs.groupBy("true_label", "pred_label").agg(F.count(F.lit(1)).alias("n"))


def _ratio(top: str, bottom: str):
    return F.coalesce(F.try_divide(F.col(top), F.col(bottom)), F.lit(0.0))


def _per_class(df: DataFrame, true_col: str, pred_col: str) -> DataFrame:
    """One row per label seen on either side, with its scores and support."""
    hit = F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0)
    sides = confusion_long(df, true_col, pred_col).select(
        F.inline(
            F.array(
                F.struct(
                    F.col("true_label").alias("label"), hit.alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")
                ),
                F.struct(
                    F.col("pred_label").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")
                ),
            )
        )
    )
    sums = sides.groupBy("label").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted")
    )
    scored = sums.withColumn("precision", _ratio("tp", "predicted")).withColumn("recall", _ratio("tp", "support"))
    f1 = F.coalesce(
        F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)
    )
    return scored.withColumn("f1", f1)


def overall_scores(df: DataFrame, true_col: str, pred_col: str) -> DataFrame:
    """Accuracy and macro precision, recall, F1; a zero division counts as 0."""
    return _per_class(df, true_col, pred_col).agg(
        F.coalesce(F.try_divide(F.sum("tp"), F.sum("support")), F.lit(0.0)).alias("accuracy"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
        F.sum("support").alias("n_rows"),
    )


def classification_report(df: DataFrame, true_col: str, pred_col: str) -> DataFrame:
    """Scores per class, then accuracy, macro and support-weighted averages."""
    # One row per label: stored, so the labelled rows behind it are read once for both parts.
    classes = materialize(_per_class(df, true_col, pred_col), "per_class")
    measures = ("precision", "recall", "f1")
    totals = classes.agg(
        F.sum("support").alias("support"),
        F.coalesce(F.try_divide(F.sum("tp"), F.sum("support")), F.lit(0.0)).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[
            F.coalesce(F.try_divide(F.sum(F.col(m) * F.col("support")), F.sum("support")), F.lit(0.0)).alias(f"weighted_{m}")
            for m in measures
        ],
    )

    def average_row(label: str, columns: list[str]):
        return F.struct(
            F.lit(label).alias("label"),
            *[F.col(c).alias(m) for c, m in zip(columns, measures)],
            F.col("support"),
        )

    averages = totals.select(
        F.inline(
            F.array(
                average_row("accuracy", ["accuracy"] * 3),
                average_row("macro avg", [f"macro_{m}" for m in measures]),
                average_row("weighted avg", [f"weighted_{m}" for m in measures]),
            )
        )
    )
    return classes.select("label", *measures, "support").unionByName(averages)


def confusion_counts(
    df: DataFrame, true_col: str, pred_col: str, labels: tuple[str, ...] = SENTIMENTS
) -> DataFrame:
    """Matrix in a fixed label order: a row per true label, a column per prediction."""
    counts = confusion_long(df, true_col, pred_col)
    wide = counts.groupBy("true_label").agg(
        *[F.sum(F.when(F.col("pred_label") == name, F.col("n")).otherwise(0)).alias(name) for name in labels]
    )
    rows = literal_table(df.sparkSession, [(i, name) for i, name in enumerate(labels)], "position int, true_label string")
    filled = rows.join(wide, "true_label", "left").na.fill(0, list(labels))
    return filled.select("position", "true_label", *labels)


def confusion_row_pct(
    df: DataFrame, true_col: str, pred_col: str, labels: tuple[str, ...] = SENTIMENTS
) -> DataFrame:
    """Each row of the matrix as percentages; null where a label never occurs."""
    counts = confusion_counts(df, true_col, pred_col, labels)
    total = sum((F.col(name) for name in labels[1:]), F.col(labels[0]))
    return counts.select(
        "position", "true_label", *[(F.try_divide(F.col(name), total) * 100).alias(name) for name in labels]
    )
