"""Reading and writing review tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewmill.session import literal_table, materialize

# Columns of the two review files that any operator looks at.
THREADS_SCHEMA = "source string, review_description string, sentiment_true string"
TWITTER_SCHEMA = "review_text string, sentiment_true string"


def read_csv(
    spark: SparkSession, path: str, schema: str | T.StructType | None = None, multi_line: bool = True
) -> DataFrame:
    """Read CSV with a header row, by column name.

    With a ``schema`` the data is read once; without one Spark infers types, a
    second pass.  ``multi_line`` lets quoted fields hold line breaks, at the price
    of one task per file: keep large inputs in many files, or turn it off when
    no field spans lines.
    """
    reader = spark.read.options(header=True, multiLine=multi_line, quote='"', escape='"')
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    as_text = reader.csv(path)
    return as_text.select(*[F.col(f"`{field.name}`").cast(field.dataType).alias(field.name) for field in wanted])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV that ``read_csv`` reads back unchanged, blanks and line breaks included."""
    df.write.options(
        header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def with_review_id(df: DataFrame, id_col: str = "review_id") -> DataFrame:
    """Give rows without a key a unique one that follows file order.

    Ids rise within a partition and from one partition to the next, so "first"
    means first in the file, without sorting or counting anything. The table is
    stored with its ids: later plans join on them and must not make them anew.
    """
    return materialize(df.withColumn(id_col, F.monotonically_increasing_id()), "with_ids")


def with_row_numbers(df: DataFrame, *order: str, out: str = "row_number") -> DataFrame:
    """Number the rows from 1 without gaps, in ``order`` (nulls first; ties in any order).

    Rows are dealt by ranges of ``order`` and stored with their place in their partition;
    the few sizes of the partitions give where each begins. No task sees more than its range, and
    what is stored can't be numbered anew. A hot value is split if ``order`` ends in a key.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The lower 33 bits count the rows of a partition, the upper ones the partitions.
    placed = placed.withColumn("__at", F.monotonically_increasing_id())
    stored = materialize(placed.withColumn("__part", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))), "placed")
    sizes = stored.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # a row per partition
    begins, total = [], 0
    for part, n in sizes.orderBy("__part").collect():
        begins.append((part, total))
        total += n
    starts = literal_table(df.sparkSession, begins, "__part bigint, __before bigint")
    number = (F.col("__before") + F.col("__at") + 1).alias(out)
    return stored.join(F.broadcast(starts), "__part").select(*[F.col(f"`{c}`") for c in df.columns], number)


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
