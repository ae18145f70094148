import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from reviewmill.llm import sharding
from tests.llm.conftest import ODD, SF


def test_flow_moves_the_fewest_bytes():
    draw = random.Random(3)
    for _ in range(50):
        n = draw.randint(1, 6)
        supply = [draw.randint(0, 100) for _ in range(n)]
        capacity = [sum(supply) // n + (i < sum(supply) % n) for i in range(n)]
        flow = sharding.min_cost_flow(supply, capacity, [[int(i != j) for j in range(n)] for i in range(n)])
        assert [sum(row) for row in flow] == supply
        assert [sum(row[j] for row in flow) for j in range(n)] == capacity
        moved = sum(f for i, row in enumerate(flow) for j, f in enumerate(row) if i != j)
        assert moved == sum(max(0, s - c) for s, c in zip(supply, capacity, strict=True))


def test_flow_with_prices():
    # The one cheap way is used to its limit, the rest takes the other.
    assert sharding.min_cost_flow([5, 5], [6, 4], [[0, 9], [1, 3]]) == [[5, 0], [1, 4]]


def test_whole_table(spark, documents):
    rows = sharding.op10_reshard(spark, SF).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in documents.collect()}
    assert len(rows) == len(texts)
    slots, size, shards = defaultdict(list), Counter(), defaultdict(set)
    for r in rows:
        assert (r.size, r.text_crc32) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]))
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 8
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
        shards[texts[r.doc_id]].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shards.values())
    assert max(size.values()) - min(size.values()) < 0.02 * sum(size.values()) / 8
    again = sharding.op10_reshard(spark, SF).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in again) == sorted((r.doc_id, r.shard, r.slot) for r in rows)


def test_a_group_of_a_third_of_all_rows(spark):
    rows = spark.range(6000).selectExpr("id doc_id", "if(id % 3 = 0, 'one hot text of many copies', concat('text number ', id)) text")
    placed = sharding.reshard(rows).collect()
    size = Counter()
    for r in placed:
        size[r.shard] += r.size
    assert len(placed) == 6000 and max(size.values()) < 1.02 * min(size.values())


def test_a_heavy_group_without_ids(spark):
    """Rows of one text and no id, or one id, are cut like others; slots stay gapless."""
    rows = spark.range(6000).selectExpr("if(id % 2 = 0, null, 7) doc_id", "if(id % 3 = 0, concat('text number ', id), 'one hot text of many copies') text")
    placed = sharding.reshard(rows, carry=True).collect()
    size, slots = Counter(), defaultdict(list)
    for r in placed:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert r.size == len(r.row.text) + 1 and r.text_crc32 == zlib.crc32(r.row.text.encode())
    assert len(placed) == 6000 and max(size.values()) < 1.05 * min(size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_odd_rows(spark, odd, empty):
    rows = sharding.reshard(odd).collect()
    assert len(rows) == len(ODD)
    assert sorted(r.size for r in rows if r.text_crc32 == 0) == [1, 1, 1]
    assert sharding.reshard(empty).count() == 0


def test_rewrites_the_affected_folders_only(spark, tmp_path):
    rows = spark.range(400).selectExpr("id doc_id", "concat('text ', id % 150) text", "cast(if(id % 150 < 90, 0, id % 3) as int) old_shard")
    path = str(tmp_path / "shards")
    rows.withColumn("shard", F.col("old_shard")).drop("old_shard").write.partitionBy("shard").parquet(path)
    files = lambda k: sorted(p.name for p in (tmp_path / "shards" / f"shard={k}").glob("*.parquet"))
    before = {k: files(k) for k in range(3)}
    placed = sharding.rewrite_shards(rows, path, n_shards=3)
    moved = {k for r in placed.filter("shard <> old_shard").collect() for k in (r.shard, r.old_shard)}
    assert moved and all((files(k) != before[k]) == (k in moved) for k in range(3))
    got = Counter((r.doc_id, r.text, r.shard) for r in spark.read.parquet(path).collect())
    texts = {r.doc_id: r.text for r in rows.collect()}
    assert got == Counter((r.doc_id, texts[r.doc_id], r.shard) for r in placed.collect())
