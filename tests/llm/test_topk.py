import random

from pyspark.sql import functions as F

from reviewmill.llm import topk
from tests.llm.conftest import EXTRA, SF


def code(vector):
    return sum(1 << i for i, x in enumerate(vector) if x > 0)


def plain(rows, k=10):
    rows = sorted({(i, code(v)) for i, v in rows if i is not None and v is not None})
    out = []
    for q, c in rows:
        if q % 20 == 0:
            near = sorted(((c ^ d).bit_count(), i) for i, d in rows if i != q)[:k]
            out += [(q, n, i, d) for n, (d, i) in enumerate(near, 1)]
    return sorted(out)


def rows_of(frame):
    return sorted((r.query_id, r.rank, r.neighbour_id, r.distance) for r in frame.collect())


def test_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert rows_of(topk.op3_nearest_codes(spark, SF)) == plain(rows)


def test_copies_ties_and_odd_rows(spark):
    draw = random.Random(1)
    base = [[draw.choice([-1.0, 1.0]) for _ in range(64)] for _ in range(4)]
    rows = [(i, base[0] if i % 3 == 0 else [x * draw.choice([1, 1, 1, -1]) for x in base[i % 4]]) for i in range(120)]
    rows += [(None, base[0]), (200, None), (220, []), (240, base[1][:5]), (0, base[0]), (0, base[0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *[F.lit("x").alias(c) for c in [*EXTRA, "code", "id", "query"]])
    assert rows_of(topk.nearest_codes(frame)) == plain(rows)
    few = frame.filter("vec_id in (0, 1, 2)")
    assert rows_of(topk.nearest_codes(few)) == plain([r for r in rows if r[0] in (0, 1, 2)])
    assert topk.nearest_codes(frame.limit(0)).count() == 0


def test_an_id_with_several_vectors(spark):
    """Its own rows take no places: seven query rows of one id among 18 others get ten each."""
    draw = random.Random(2)
    vector = lambda: [draw.choice([-1.0, 1.0]) for _ in range(8)]
    rows = [(0, vector()) for _ in range(30)] + [(i, vector()) for i in range(1, 19)] + [(40, vector()) for _ in range(3)]
    got = rows_of(topk.nearest_codes(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert got == plain(rows)
    assert len(got) == 10 * len({(i, code(v)) for i, v in rows if i % 20 == 0})


def test_all_dimensions_count(spark):
    draw = random.Random(3)
    base = [draw.choice([-1.0, 1.0]) for _ in range(150)]
    rows = [(i, base[:64] + [x * draw.choice([1, 1, 1, 1, -1]) for x in base[64 : 150 - i % 7]]) for i in range(90)]
    assert rows_of(topk.nearest_codes(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))) == plain(rows)
