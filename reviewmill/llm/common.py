"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill.session import materialize

#: A word is a maximal run without ASCII white space (Java and RE2 syntax).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node reachable.

    Alternates large-star and small-star: every step moves links to the smallest
    neighbour known, so a chain shortens by a factor each round. The minimum of a
    node's neighbours is a map-side aggregate, the join back may be split by AQE,
    and each round is a written table, so no lineage grows and nothing is collected
    but one checksum.
    """
    kept = materialize(edges.selectExpr("greatest(a, b) AS a", "least(a, b) AS b").filter("a <> b").distinct(), name)
    seen = None
    while True:
        both = kept.unionByName(kept.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.filter("a <> b").distinct(), name)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        kept = materialize(small.select("e.a", "e.b").filter("a <> b").distinct(), name)
        mark = kept.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen:
            return kept.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                kept.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        seen = mark
