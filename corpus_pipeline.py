"""From raw documents to shards of a training corpus, one operator per stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. ``run`` writes each result and reads it again, so
no stage depends on what an executor keeps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill.llm import decontaminate as winnowing
from reviewmill.llm import mixing, quality, sharding, simhash
from reviewmill.llm.common import table
from reviewmill.session import materialize


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; null and empty texts are scored like any other.

    Without usable labels every score is 0.5, so all stay. Repeated rows stay rows.
    """
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return docs.filter(quality.score_column(spark, model, F.col("text")) >= quality.THRESHOLD)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact or near copies: the smallest id.

    Groups are the components of op1: SimHashes of four-word shingles within four bits. All null, empty and blank texts are one group. Of repeated rows one stays.
    """
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with a benchmark item; texts without words stay."""
    hit = winnowing.decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("contaminated")
    hit = materialize(hit.select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).distinct(), "contaminated")
    # The id is compared too: a 64-bit hash alone would drop documents that share it.
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("hit_hash"))
    return docs.join(hit, same, "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, whole: the one at the end of a budget isn't cut.

    Texts without words aren't taken. Rows that repeat id and text share their turns.
    """
    taken = mixing.mix(docs).filter("taken > 0").withColumn("times", F.ceil(F.col("taken") / F.col("size")))
    taken = taken.groupBy(F.col("doc_id").alias("mix_id"), F.col("text_hash").alias("mix_hash")).agg(F.sum("times").alias("mix_times"))
    taken = materialize(taken, "taken")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.col("doc_id").alias("row_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_hash"), row.alias("row"))
    rows = rows.dropDuplicates(["row_id", "row_hash"])
    same = F.col("row_id").eqNullSafe(F.col("mix_id")) & (F.col("row_hash") == F.col("mix_hash"))
    return rows.join(taken, same).select("row", F.explode(F.sequence(F.lit(1), F.col("mix_times").cast("int")))).select("row.*")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot; of columns with one name, the placement's stands."""
    placed = sharding.reshard(docs, carry=True).drop("text_hash", "old_shard")
    own = [c for c in docs.columns if c not in placed.columns]
    return placed.select(*[F.col("row")[c].alias(c) for c in own], *[c for c in placed.columns if c != "row"])


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", without_near_duplicates),
    ("decontaminate", without_benchmark),
    ("mix", mixed),
    ("shard", sharded),
]

#: A learnt classifier and SimHash components have no SQL form; tests/llm compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
