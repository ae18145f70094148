"""Resharding by minimum-cost flow.

Documents lie in old shards; the new shards have capacities. Only a bounded table
of block sizes comes to the driver: hash blocks of texts, and one block per group
of equal texts that is large for itself. A minimum-cost flow over the shards says
how many bytes each must give to which other, and whole blocks are picked to carry
them, so equal texts stay together and few bytes move.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reviewmill.llm.common import table
from reviewmill.session import literal_table, materialize

BLOCKS = 1024  # hash blocks per old shard: the driver sees n_shards * BLOCKS sizes
HEAVY = 64  # a group of equal texts over 1/HEAVY of a shard is a block of its own
SLOT_ROWS = 20_000  # rows ranked together when slots are numbered


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Bytes from each old to each new shard at the least cost, by successive shortest paths.

    ``sum(supply) <= sum(capacity)``. Johnson potentials keep reduced costs
    non-negative, so each path is one Dijkstra run over the shards.
    """
    n, m = len(supply), len(capacity)
    start, end = n + m, n + m + 1
    graph: list[list[list]] = [[] for _ in range(n + m + 2)]

    def edge(u: int, v: int, room: int, price: int) -> None:
        graph[u].append([v, room, price, len(graph[v])])
        graph[v].append([u, 0, -price, len(graph[u]) - 1])

    for i in range(n):
        edge(start, i, supply[i], 0)
        for j in range(m):
            edge(i, n + j, supply[i], cost[i][j])
    for j in range(m):
        edge(n + j, end, capacity[j], 0)
    potential = [0] * (n + m + 2)
    while True:
        far = [float("inf")] * (n + m + 2)
        far[start], came, queue = 0, {}, [(0, start)]
        while queue:
            d, u = heapq.heappop(queue)
            if d > far[u]:
                continue
            for k, (v, room, price, _) in enumerate(graph[u]):
                through = d + price + potential[u] - potential[v]
                if room > 0 and through < far[v]:
                    far[v], came[v] = through, (u, k)
                    heapq.heappush(queue, (through, v))
        if end not in came:
            break
        for v, d in enumerate(far):
            potential[v] += d if d < float("inf") else far[end]
        path, v = [], end
        while v != start:
            u, k = came[v]
            path.append(graph[u][k])
            v = u
        amount = min(e[1] for e in path)
        for e in path:
            e[1] -= amount
            graph[e[0]][e[3]][1] += amount
    return [[sum(graph[n + j][e[3]][1] for e in graph[i] if e[0] == n + j) for j in range(m)] for i in range(n)]


def place_blocks(blocks: list[tuple[int, int]], capacity: list[int]) -> list[int]:
    """New shard of each (old shard, bytes) block.

    The flow decides the bytes between shards; blocks are then taken from the
    largest down while they fit. A last pass moves single blocks from the fullest
    to the emptiest shard as long as that brings the two nearer to their capacity.
    """
    n = max([len(capacity), *(old + 1 for old, _ in blocks)])
    supply = [0] * n
    for old, size in blocks:
        supply[old] += size
    flow = min_cost_flow(supply, capacity, [[int(i != j) for j in range(len(capacity))] for i in range(n)])
    target = [old if old < len(capacity) else 0 for old, _ in blocks]
    owed = {i: {j: f for j, f in enumerate(row) if f > 0 and j != i} for i, row in enumerate(flow)}
    for b in sorted(range(len(blocks)), key=lambda b: (-blocks[b][1], b)):
        old, size = blocks[b]
        if not owed[old]:
            continue
        to = max(owed[old], key=lambda j: (owed[old][j], -j))
        if size <= owed[old][to] or old >= len(capacity):
            target[b] = to
            owed[old][to] -= size
    over = [-c for c in capacity]
    inside: list[list[tuple[int, int]]] = [[] for _ in capacity]
    for b, (_, size) in enumerate(blocks):
        over[target[b]] += size
        inside[target[b]].append((size, b))
    for _ in range(4 * len(blocks)):
        full, empty = max(range(len(over)), key=over.__getitem__), min(range(len(over)), key=over.__getitem__)
        gap = over[full] - over[empty]
        fitting = [x for x in inside[full] if 0 < x[0] < gap]
        if not fitting:
            break
        best = min(fitting, key=lambda x: (abs(gap - 2 * x[0]), x[1]))
        inside[full].remove(best)
        inside[empty].append(best)
        target[best[1]] = empty
        over[full] -= best[0]
        over[empty] += best[0]
    return target


def reshard(
    docs: DataFrame,
    *,
    n_shards: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    old_shard: Column | None = None,
    carry: bool = False,
) -> DataFrame:
    """One row per document: doc_id, text_hash, size, text_crc32, law, old_shard, shard, slot, grown_shard.

    The law is ``bytes``: the shards' sizes are as near equal as whole blocks allow.
    ``old_shard`` (0 to n_shards - 1) defaults to where a hash of the text puts the
    document; equal texts share a block, hence a shard, as long as they share an old
    one. A group larger than a shard is cut into pieces by a stored row number, since no
    shard could hold it. With ``carry`` a column ``row`` has the document's own columns.

    A null text counts as empty (size 1, CRC 0). Null ids and repeated rows are
    rows like any other, each with its own slot, and spread like others. Very long texts
    are read for size and hash only. Other columns, whatever their names, appear in
    ``row`` alone. An empty table gives an empty table.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    block = F.pmod("text_hash", F.lit(n_shards * BLOCKS))
    carried = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    whole = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"), F.xxhash64(text).alias("text_hash"),
        (old_shard if old_shard is not None else F.lit(None)).cast("int").alias("given"), *carried,
    )
    whole = whole.withColumn("old_shard", F.coalesce("given", F.floor(block / BLOCKS).cast("int"))).withColumn("block", block).drop("given")
    # Stored, so that a row has one number in all that follows.
    rows = materialize(whole.withColumn("number", F.monotonically_increasing_id()), "sizes")
    total, n_rows = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    if not n_rows:
        return _numbered(rows.withColumn("shard", F.lit(0)).withColumn("part", F.lit(0)), 1, carry)

    # At most n_shards * HEAVY groups pass, whatever the input: their sizes add up to the total at most.
    share = max(1, total // n_shards)
    heavy = rows.groupBy("text_hash").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") * HEAVY > share).collect()
    pieces = [(g.text_hash, 1 if g.bytes <= share else -(-g.bytes * HEAVY // share)) for g in heavy]
    large = literal_table(rows.sparkSession, pieces, "text_hash long, pieces long")

    def in_blocks(frame: DataFrame) -> DataFrame:
        cut = F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("number"), F.col("pieces"))).otherwise(0)
        alone = F.col("pieces").isNotNull()
        return frame.join(F.broadcast(large), "text_hash", "left").withColumn("part", F.when(alone, cut)).withColumn("block", F.when(alone, F.col("text_hash")).otherwise(F.col("block")))

    keys = ["old_shard", "block", "part"]
    sizes = sorted(in_blocks(rows).groupBy(*keys).agg(F.sum("size").alias("bytes")).collect(), key=lambda r: (r.old_shard, r.block, -1 if r.part is None else r.part))
    capacity = [total // n_shards + (i < total % n_shards) for i in range(n_shards)]
    target = place_blocks([(r.old_shard, r.bytes) for r in sizes], capacity)
    plan = literal_table(
        rows.sparkSession, [(r.old_shard, r.block, r.part, t) for r, t in zip(sizes, target, strict=True)],
        "to_old int, to_block long, to_part long, shard int",
    )
    same = (F.col("old_shard") == F.col("to_old")) & (F.col("block") == F.col("to_block")) & F.col("part").eqNullSafe(F.col("to_part"))
    return _numbered(in_blocks(rows).join(F.broadcast(plan), same), max(n_shards, n_rows // SLOT_ROWS), carry)


def _numbered(rows: DataFrame, chunks: int, carry: bool) -> DataFrame:
    """Gapless slots: rows are ranked in chunks, and each chunk starts where those before it end.

    Rows of a heavy group of texts, which may all have one id, go to chunks by number.
    """
    key = F.when(F.col("part").isNull(), F.xxhash64("doc_id", "text_hash")).otherwise(F.xxhash64("number"))
    rows = rows.withColumn("chunk", F.pmod(key, F.lit(chunks)))
    rank = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_hash", "number")) - 1
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.select("shard", "chunk").groupBy("shard", "chunk").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return rows.withColumn("rank", rank).join(starts.drop("n"), ["shard", "chunk"]).select(
        "doc_id", "text_hash", "size", "text_crc32", F.lit("bytes").alias("law"), "old_shard", F.col("shard").cast("int"),
        (F.col("first") + F.col("rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *(["row"] if carry else []),
    )


def rewrite_shards(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 8, files_per_shard: int = 16) -> DataFrame:
    """Write to ``path`` the folders of those shards that gain or lose a document; returns the placement.

    ``docs`` has a column ``old_shard``. A folder ``shard=k`` whose rows stay the
    same isn't touched (dynamic partition overwrite). Rows with one id and one text
    move together.
    """
    placed = materialize(reshard(docs, n_shards=n_shards, id_col=id_col, text_col=text_col, old_shard=F.col("old_shard")), "placement")
    moved = placed.filter("shard <> old_shard")
    touched = moved.select(F.explode(F.array("old_shard", "shard")).alias("touched")).distinct()
    affected = placed.join(F.broadcast(touched), F.col("shard") == F.col("touched"), "left_semi")  # n_shards rows at most
    keys = affected.groupBy(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash"), F.col("old_shard").alias("k_old")).agg(F.min("shard").alias("shard"))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("k_id")) & (F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))) == F.col("k_hash")) & (F.col("old_shard") == F.col("k_old"))
    moving = docs.join(keys, same).drop("k_id", "k_hash", "k_old", "old_shard")
    spread = F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(files_per_shard))
    moving.repartition("shard", spread).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    return placed


def op10_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshard(table(spark, sf_dir, "documents")).drop("text_hash", "old_shard")
