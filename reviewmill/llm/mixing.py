"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a word budget from its weight. Whole epochs of the source come
first; what is left of the budget is filled without replacement in the order of
exponential keys ``-ln(u) / quality weight``, so better documents come earlier.

No source is sorted in one task: keys fall into fixed buckets, the sums of the
buckets give the prefix at which each begins, and rows are ranked within a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reviewmill.llm.common import n_words, table
from reviewmill.session import materialize

BUCKETS = 65_536  # per source; a bucket's rows are ranked in one task


def quality_weight(size: Column, chars: Column) -> Column:
    """1 for a usual mean word length, 0.5 for very short or very long words."""
    return F.when(chars.between(4 * size, 12 * size), 1.0).otherwise(0.5)


def uniform(key: Column, seed: int) -> Column:
    """In (0, 1), from the md5 of seed and key: the same on every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """(source, source_size) to (source, source_size, target), one row per source.

    ``weights`` go to the sources by code point, null last, and repeat. A target
    stops at ``max_epochs`` times its source; the rest is shared again by weight,
    which ends at one level for all sources below their limit.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_limit = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = (
        sizes.withColumn("rank", F.row_number().over(by_name) - 1)
        .withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("level", F.col("cap") / F.col("w"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("all_w", F.sum("w").over(everything))
        .withColumn("reach", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
        .withColumn("final", F.max(F.when(F.col("level") >= F.col("reach"), F.col("reach"))).over(everything))
    )
    return ranked.select("source", "source_size", F.coalesce(F.least("cap", F.col("final") * F.col("w")), F.col("cap")).alias("target"))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: float = 2,
    seed: int = 7,
    weight: Column | None = None,
) -> DataFrame:
    """One row per document: doc_id, text_hash, size, source_size, target, taken.

    ``taken`` counts the words the mix takes of the document: its size for each
    whole epoch, and in the last, fractional epoch its size again if its key comes
    before the budget ends; the document at the end of the budget gives its first
    words only. ``weight`` may be any positive column of ``docs``.

    Null and empty texts have size 0 and give nothing. A null source is a source
    (last). Rows with one id share a key and are ordered by their text's hash;
    equal rows are interchangeable. An empty table gives an empty table.
    """
    text = F.col(f"`{text_col}`")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), n_words(text).alias("size"),
        F.coalesce(F.length(text), F.lit(0)).alias("chars"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"),
        (weight if weight is not None else F.lit(None).cast("double")).alias("given"),
    )
    key = -F.ln(uniform(F.col("doc_id"), seed)) / F.coalesce("given", quality_weight(F.col("size"), F.col("chars")))
    rows = rows.withColumn("key", key).withColumn("bucket", F.floor(F.col("key") / (1 + F.col("key")) * BUCKETS).cast("int"))
    rows = materialize(rows.drop("chars", "given"), "mix")

    totals = materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    goals = materialize(source_targets(totals, weights, share, max_epochs), "targets")
    so_far = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = (
        rows.groupBy("source", "bucket").agg(F.sum("size").alias("filled"))
        .withColumn("begins", F.coalesce(F.sum("filled").over(so_far), F.lit(0)))
        .join(goals.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .select(F.col("source").alias("of"), F.col("bucket").alias("at"), "begins", "source_size", "target")
    )
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    budget = F.floor(F.col("target") - epochs * F.col("source_size"))
    prefix = F.col("begins") + F.coalesce(F.sum("size").over(within), F.lit(0))
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), budget - prefix))
    return rows.join(begins, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("at"))).select(
        "doc_id", "text_hash", "size", "source_size", "target", taken.cast("long").alias("taken")
    )


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("text_hash")


OP8_SQL = r"""
WITH r AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(length(text), 0) AS chars,
         (('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM documents),
k AS (
  SELECT doc_id, source, size, -ln(u) / CASE WHEN chars BETWEEN 4 * size AND 12 * size THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS key FROM r),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w
  FROM k GROUP BY source),
l AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / w AS level,
         sum(source_size) OVER () * 1.5::DOUBLE AS total, sum(w) OVER () AS all_w FROM s),
p AS (
  SELECT *, (total - coalesce(sum(cap) OVER b, 0)) / (all_w - coalesce(sum(w) OVER b, 0)) AS reach FROM l
  WINDOW b AS (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (
  SELECT source, source_size, least(cap, w * (SELECT max(reach) FROM p WHERE level >= reach)) AS target FROM p),
f AS (
  SELECT k.doc_id, k.size, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS epochs,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prefix
  FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target - epochs * source_size) - prefix)))::BIGINT AS taken
FROM f
"""
