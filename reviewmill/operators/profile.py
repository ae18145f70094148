"""Table profiling: schema, nulls, heads and tails, value counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def head_rows(df: DataFrame, id_col: str, n: int = 5) -> DataFrame:
    """First ``n`` rows by id: a top-n per task, never a full sort."""
    return df.orderBy(F.col(id_col)).limit(n)


def tail_rows(df: DataFrame, id_col: str, n: int = 5) -> DataFrame:
    """Last ``n`` rows by id."""
    return df.orderBy(F.col(id_col).desc()).limit(n)


def _unpivot_counts(counts: DataFrame, names: list[str], name_col: str, value_col: str) -> DataFrame:
    pairs = [F.struct(F.lit(name).alias(name_col), F.col(f"c{i}").alias(value_col)) for i, name in enumerate(names)]
    return counts.select(F.inline(F.array(*pairs)))


def column_profile(df: DataFrame) -> DataFrame:
    """Type and non-null count per column, in one pass over the table."""
    counts = df.agg(*[F.count(F.col(f"`{name}`")).alias(f"c{i}") for i, name in enumerate(df.columns)])
    kinds = F.create_map(*[F.lit(part) for pair in df.dtypes for part in pair])
    long = _unpivot_counts(counts, df.columns, "column_name", "non_null")
    return long.select("column_name", kinds[F.col("column_name")].alias("data_type"), "non_null")


def null_counts(df: DataFrame) -> DataFrame:
    """Missing values per column, in one pass over the table."""
    counts = df.agg(*[F.count_if(F.col(f"`{name}`").isNull()).alias(f"c{i}") for i, name in enumerate(df.columns)])
    return _unpivot_counts(counts, df.columns, "column_name", "n_null")


def value_counts(df: DataFrame, col: str | Column, name: str | None = None) -> DataFrame:
    """Rows per non-null value, most frequent first."""
    key = F.col(col) if isinstance(col, str) else col
    label = name or (col if isinstance(col, str) else "value")
    keyed = df.select(key.alias(label)).filter(F.col(label).isNotNull())
    return keyed.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(label))


def stage_counts(df: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """Rows before and after each filter of a chain, in one pass.

    ``stages`` are (name, keep) pairs over columns of ``df``.  A row reaches a
    stage when it passed all earlier ones.
    """
    alive: Column = F.lit(True)
    aggregates = [F.count(F.lit(1)).alias("c0")]
    for i, (_, keep) in enumerate(stages, 1):
        alive = alive & F.coalesce(keep, F.lit(False))
        aggregates.append(F.count_if(alive).alias(f"c{i}"))
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(name).alias("stage"),
            F.col(f"c{i - 1}").alias("n_before"),
            F.col(f"c{i}").alias("n_after"),
            (F.col(f"c{i - 1}") - F.col(f"c{i}")).alias("n_removed"),
        )
        for i, (name, _) in enumerate(stages, 1)
    ]
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))
