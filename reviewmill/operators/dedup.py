"""Exact duplicates of review text.

Text is compared by its SHA-256 digest, so the shuffles that look for copies
carry 32 bytes and an id per review instead of whole texts.  No step sends all
copies of one text to one task: counts and first ids are aggregated before the
shuffle, and where every member row is needed adaptive execution splits the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.functions.text import has_min_words

_KEY = "__key"


def text_key(text: Column) -> Column:
    """256-bit identity of a text; null texts count as equal to each other."""
    return F.coalesce(F.unhex(F.sha2(text.cast("string"), 256)), F.lit(b""))


def with_is_long(df: DataFrame, text_col: str, min_words: int = 15) -> DataFrame:
    return df.withColumn("is_long", has_min_words(F.col(text_col), min_words))


def long_short_counts(df: DataFrame, text_col: str, min_words: int = 15) -> DataFrame:
    flagged = df.select(has_min_words(F.col(text_col), min_words).alias("is_long"))
    return flagged.groupBy("is_long").agg(F.count(F.lit(1)).alias("n"))


def duplicate_members(df: DataFrame, text_col: str, id_col: str, min_words: int = 0) -> DataFrame:
    """Every row whose text occurs more than once, with ``n_copies`` and ``group_id``.

    Counts and smallest ids are aggregated map-side, so a text that makes up a third
    of the table is one row a task. The join back on the digest may meet a hot text;
    it is a plain equi-join, which adaptive execution splits.
    """
    rows = df.filter(has_min_words(F.col(text_col), min_words)) if min_words > 0 else df
    keyed = rows.withColumn(_KEY, text_key(F.col(text_col)))
    copies = keyed.groupBy(_KEY).agg(F.count(F.lit(1)).alias("n_copies"), F.min(id_col).alias("group_id"))
    return keyed.join(copies.filter(F.col("n_copies") > 1), _KEY)


def raw_duplicates(df: DataFrame, text_col: str, id_col: str, min_words: int = 0) -> DataFrame:
    """All members of duplicate groups (``min_words`` > 0: among long reviews only)."""
    members = duplicate_members(df, text_col, id_col, min_words)
    return members.select(*df.columns, "n_copies")


def duplicate_groups(df: DataFrame, text_col: str, id_col: str, min_words: int = 15) -> DataFrame:
    """Members of each group of equal long texts: (group_id, id, n_copies), a row each.

    A group's id is its smallest row id. Members are rows, not a list, so no group
    grows with its copies.
    """
    return duplicate_members(df.select(id_col, text_col), text_col, id_col, min_words).select("group_id", id_col, "n_copies")


def first_ids(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Smallest id of each distinct text: one partial aggregate, 40 bytes a row."""
    keyed = df.select(text_key(F.col(text_col)).alias(_KEY), F.col(id_col))
    return keyed.groupBy(_KEY).agg(F.min(id_col).alias(id_col)).select(id_col)


def dedup_long(df: DataFrame, text_col: str, id_col: str, min_words: int = 15) -> DataFrame:
    """Long reviews, first of each group of copies."""
    long_rows = df.filter(has_min_words(F.col(text_col), min_words))
    return long_rows.join(first_ids(long_rows, text_col, id_col), id_col, "left_semi")


def mark_repeats(df: DataFrame, text_col: str, id_col: str, min_words: int = 15) -> DataFrame:
    """Add ``is_long`` and ``is_repeat`` (a long review that is not its text's first).

    The join back is on the unique id, so it is balanced whatever the copies are.
    """
    flagged = with_is_long(df, text_col, min_words)
    kept = first_ids(flagged.filter("is_long"), text_col, id_col).withColumn("__first", F.lit(True))
    joined = flagged.join(kept, id_col, "left")
    return joined.withColumn("is_repeat", F.col("is_long") & F.col("__first").isNull()).drop("__first")


def dedup_reviews(df: DataFrame, text_col: str, id_col: str, min_words: int = 15) -> DataFrame:
    """Short reviews untouched, long reviews once each."""
    marked = mark_repeats(df, text_col, id_col, min_words)
    return marked.filter(~F.col("is_repeat")).select(*df.columns)
