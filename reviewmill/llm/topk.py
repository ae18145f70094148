"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has a bit per dimension, 1 if it is positive, in words of 64 bits. Codes
are indexed by each of their m 16-bit segments. If two codes differ in at most
m (s + 1) - 1 bits, some segment differs in at most s, so looking up all segment values
within s bits of the query's finds every code that near. The segment radius s grows from
0; a query is done once its kth verified distance is within what s covers.

A round looks up all values within s bits and keeps the codes within the covered
distance, few of all candidates; the others come again with the next radius. Lookups of
the last radius are most of all lookups, while candidates kept from round to round would
grow with queries times codes.

A code is found by the first of its segments nearest to the query's and by no other, so
no round finds a pair twice. Equal codes are one entry with their smallest ids, so copies
don't multiply the work.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reviewmill.llm.common import table
from reviewmill.session import materialize

PER_WORD, BITS = 4, 16


def sign_code(vector: str, words: int = 1) -> Column:
    """Struct w0, w1, ... of 64 dimensions each; a bit is set if its dimension is positive. Dimensions a vector lacks count as 0."""
    word = "aggregate(transform(slice(`{v}`, {at}, 64), (x, i) -> if(x > 0, shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)"
    return F.struct(*[F.expr(word.format(v=vector, at=64 * w + 1)).alias(f"w{w}") for w in range(words)])


def _parts(word: Column) -> list[Column]:
    return [F.shiftrightunsigned(word, BITS * j).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int") for j in range(PER_WORD)]


def _segments(code: Column, words: int) -> Column:
    """Array of (segment number, value)."""
    values = [part for w in range(words) for part in _parts(code[f"w{w}"])]
    return F.array(*[F.struct(F.lit(n).alias("segment"), value.alias("value")) for n, value in enumerate(values)])


def nearest_codes(
    rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", is_query: Column | None = None, k: int = 10
) -> DataFrame:
    """(query_id, rank, neighbour_id, distance): the k nearest other rows of every query row, ties by the smaller id.

    ``is_query`` picks the queries (default: ids divisible by 20). All dimensions count.
    Rows without id or vector take no part; a row that repeats id and code counts once,
    and rows with one id and several codes are rows of their own, never neighbours of each
    other. With fewer than k other rows all of them are returned; an empty table gives an
    empty table. Other columns, whatever their names, play no part.
    """
    spark = rows.sparkSession
    is_query = F.col(f"`{id_col}`") % 20 == 0 if is_query is None else is_query
    usable = rows.filter(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{vector_col}`").isNotNull())
    words = max(1, -(-(usable.agg(F.max(F.size(f"`{vector_col}`"))).first()[0] or 0) // 64))
    coded = usable.select(F.col(f"`{id_col}`").alias("id"), sign_code(vector_col, words).alias("code"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    coded = materialize(coded.groupBy("id", "code").agg(F.max("asks").alias("asks")), "codes")
    # The k + 1 smallest ids of a code are enough; Spark limits the ranks before the shuffle too.
    nth = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    kept = materialize(coded.select("code", "id").withColumn("nth", nth).filter(F.col("nth") <= k + 1).select("code", "id"), "kept_ids")
    index = materialize(kept.select("code").distinct().select("code", F.inline(_segments(F.col("code"), words))), "code_index")

    # Of an id with several codes k rows are enough for anyone, and its own queries must do without all of them.
    codes_of = coded.groupBy("id").agg(F.least(F.count("*"), F.lit(k)).alias("own"), F.max("asks").alias("any_asks"))
    wanted = coded.filter("asks").join(codes_of.filter("any_asks"), "id").groupBy(F.col("code").alias("query")).agg((F.max("own") + k).alias("wanted"))
    there = kept.groupBy("id").agg(F.least(F.count("*"), F.lit(k)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    left = materialize(wanted.select("query", F.least("wanted", F.lit(there)).alias("wanted")), "queries")

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    differing = [F.col("query")[f"w{w}"].bitwiseXOR(F.col("code")[f"w{w}"]) for w in range(words)]
    distance = reduce(add, [F.bit_count(bits) for bits in differing])
    # Of a pair's segments the one with the fewest differing bits finds it, the first of equals.
    apart = [F.struct(F.bit_count(part).alias("bits"), F.lit(n).alias("segment")) for n, part in enumerate(p for bits in differing for p in _parts(bits))]
    finder = F.least(*apart)["segment"]
    found, s = None, 0
    while not left.isEmpty():
        flips = [sum(1 << b for b in bits) for turned in range(s + 1) for bits in combinations(range(BITS), turned)]
        flips = F.split(F.lit(",".join(map(str, flips))), ",").cast("array<int>")  # one constant of the plan
        # A query asks for many values: spread the queries before that, not the one small file they are read from.
        probes = left.select("query").repartition(tasks).select("query", F.inline(_segments(F.col("query"), words)))
        probes = probes.select("query", "segment", "value", F.explode(flips).alias("flip"))
        probes = probes.select("query", "segment", F.col("value").bitwiseXOR(F.col("flip")).alias("value"))
        # The planner can't see how many values a query looks up; without the hint it may broadcast them.
        covered = PER_WORD * words * (s + 1) - 1
        near = probes.join(index.hint("shuffle_hash"), ["segment", "value"]).filter((distance <= covered) & (finder == F.col("segment")))
        near = materialize(near.select("query", "code", distance.alias("distance")), "near")
        of_id = near.join(kept, "code").groupBy("query", "id").agg(F.least(F.count("*"), F.lit(k)).alias("n"))
        done = of_id.groupBy("query").agg(F.sum("n").alias("n")).join(left, "query").filter("n >= wanted")
        done = materialize(done.select("query"), "done")
        ready = near.join(done, "query", "left_semi")
        found = ready if found is None else found.unionByName(ready)
        left = materialize(left.join(done, "query", "left_anti"), "left")
        s += 1
    if found is None:
        return coded.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("neighbour_id"), F.lit(0).alias("distance")).limit(0)

    # Per query code the nearest rows, k of an id at most: 2k leave k to every id that asks.
    ordered = Window.partitionBy("query").orderBy("distance", "id")
    of_id = Window.partitionBy("query", "id").orderBy("distance")
    best = found.join(kept, "code").withColumn("nth", F.row_number().over(of_id)).filter(F.col("nth") <= k)
    best = best.withColumn("place", F.row_number().over(ordered)).filter(F.col("place") <= 2 * k)
    best = materialize(best.select("query", F.col("id").alias("neighbour_id"), "distance"), "best")
    asking = coded.filter("asks").select(F.col("id").alias("query_id"), F.col("code").alias("query"))
    pairs = asking.join(best, "query").filter("query_id <> neighbour_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy("distance", "neighbour_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "neighbour_id", F.col("distance").cast("int"))


def op3_nearest_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_codes(table(spark, sf_dir, "embeddings"))
