import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from reviewmill.llm import neighbours
from tests.llm.conftest import EXTRA, SF


def plain(rows, k=20):
    """Every query's k nearest ids by brute force; an id counts with its best vector."""
    rows = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)})
    if not rows:
        return []
    wide = max(len(v) for _, v in rows)
    vectors = np.array([list(v) + [0.0] * (wide - len(v)) for _, v in rows])
    out = []
    for at, (q, _) in enumerate(rows):
        if q % 20 == 0:
            best = {}
            for (i, _), score in zip(rows, vectors @ vectors[at]):
                if i != q:
                    best[i] = max(best.get(i, -np.inf), score)
            ranked = sorted(best.items(), key=lambda b: (-round(b[1], 9), b[0]))[:k]
            out += [(q, n, i, s) for n, (i, s) in enumerate(ranked, 1)]
    return sorted(out)


def check(frame, rows):
    got = sorted(tuple(r) for r in frame.select("query_id", "rank", "vec_id", "score").collect())
    want = plain(rows)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], atol=1e-9)


def test_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(neighbours.op13_neighbours(spark, SF), rows)


def test_copies_ties_and_odd_rows(spark):
    draw = np.random.default_rng(4)
    base = draw.integers(-4, 5, size=(12, 6)).astype(float)
    rows = [(i, [float(c) for c in (base[0] if i % 3 == 0 else base[i % 12])]) for i in range(1, 150)]
    rows += [rows[19], (40, [1.0, -1.0, 2.0, 0.0, 0.5, 3.0]), (None, rows[1][1]), (300, None), (320, []), (340, [0.0] * 6), (360, [float("nan")] * 6), (380, [1.0, None]), (400, [2.0, -0.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *[F.lit("x").alias(c) for c in [*EXTRA, "node", "vec", "asks", "query", "vector"]])
    check(neighbours.nearest_neighbours(frame), rows)
    few = [r for r in rows if r[0] in (20, 21, 22, 40)]
    check(neighbours.nearest_neighbours(frame.filter("vec_id in (20, 21, 22, 40)")), few)
    assert neighbours.nearest_neighbours(frame.limit(0)).count() == 0
    assert neighbours.nearest_neighbours(frame.filter("vec_id = 20")).count() == 0


@pytest.mark.parametrize("lengths", ["equal", "unequal"])
def test_recall_over_many_blocks(spark, monkeypatch, lengths):
    """Twelve starting blocks, so neighbours must be found by joins; a third of the rows is one dense cluster."""
    monkeypatch.setattr(neighbours, "START", 256)
    monkeypatch.setattr(neighbours, "BLOCK", 256)
    draw = np.random.default_rng(5)
    x = draw.normal(size=(3_000, 16))
    x[:1_000] = x[0] + 0.01 * draw.normal(size=(1_000, 16))
    if lengths == "equal":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]
    got = neighbours.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), beam=128).collect()
    score = x[::20] @ x.T
    score[np.arange(150), np.arange(0, 3_000, 20)] = -np.inf
    kth = np.sort(score, axis=1)[:, -20]
    assert len(got) == 150 * 20
    assert sum(r.score >= kth[r.query_id // 20] - 1e-9 for r in got) / len(got) >= 0.95
    assert all(abs(r.score - x[r.query_id] @ x[r.vec_id]) < 1e-9 for r in got)


def some_rows(spark, n=1_200):
    x = np.random.default_rng(6).normal(size=(n, 8))
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def test_search_rounds_do_not_move_the_links(spark, monkeypatch):
    """Only the requests are shuffled to the home blocks, the links are read from the files of their block."""
    monkeypatch.setattr(neighbours, "BLOCK", 256)
    seen = []
    plain_search = neighbours.graph_search

    def search(links, queries, *, blocks, beam):
        ask = neighbours._requests(blocks, beam, {})
        asked = queries.limit(0).selectExpr("query", "vec", "vec AS vals", "vec AS wanted", "0 AS block").mapInPandas(ask, neighbours.ASKED)
        joined = asked.groupBy("home").cogroup(links.groupBy("home")).applyInPandas(neighbours._answer_queries, neighbours.FOUND)
        seen.append(joined._jdf.queryExecution().executedPlan().toString())
        return plain_search(links, queries, blocks=blocks, beam=beam)

    monkeypatch.setattr(neighbours, "graph_search", search)
    assert neighbours.nearest_neighbours(some_rows(spark)).count() == 60 * 20
    after_links = seen[0][seen[0].index("FlatMapCoGroups") :]
    assert "Bucketed: true" in after_links or "SelectedBucketsCount" in after_links
    assert after_links.count("Exchange hashpartitioning(home") == 1
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("links_")]


def test_much_asked_blocks_are_answered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 256)
    rows = some_rows(spark)
    whole = sorted(map(tuple, neighbours.nearest_neighbours(rows).collect()))
    sizes = []
    plain_requests = neighbours._requests
    monkeypatch.setattr(neighbours, "ANSWERED", 100)
    monkeypatch.setattr(neighbours, "_requests", lambda blocks, beam, parts: sizes.append(parts) or plain_requests(blocks, beam, parts))
    assert sorted(map(tuple, neighbours.nearest_neighbours(rows).collect())) == whole
    assert any(n > 1 for parts in sizes for n in parts.values())


def test_a_block_gets_the_vectors_that_it_asks_for_in_one_row():
    x = np.random.default_rng(7).normal(size=(50, 9)).astype("<f4")
    own = pd.DataFrame({"home": 0, "node": np.arange(50)[::-1], "vec": [v.tobytes() for v in x[::-1]], "worst": np.arange(50, dtype="f4")[::-1]})
    wanted = [np.array([3, 7, 49]), np.array([0])]
    asks = pd.DataFrame({"home": 0, "block": [5, 9], "member": [w.astype("<i8").tobytes() for w in wanted]})
    got = neighbours._answer_block(asks, own)
    assert got["block"].tolist() == [5, 9]
    for row, names in zip(got.itertuples(), wanted):
        codes = np.frombuffer(row.codes, "<i2").reshape(-1, 8) * np.frombuffer(row.scales, "<f4")[:, None]
        assert np.frombuffer(row.names, "<i8").tolist() == names.tolist()
        assert np.allclose(codes, x[names, :8], atol=1e-4) and (np.frombuffer(row.lasts, "<f4") == x[names, 8]).all()
        assert np.frombuffer(row.worst, "<f4").tolist() == names.tolist()


def test_listers_of_a_node_are_drawn_before_they_are_sent():
    """However many nodes list one, a batch sends ``sample`` fresh and as many other ones."""
    v, member = np.repeat([1, 2], [5_000, 3]), np.r_[np.arange(5_000), [1, 2, 3]]
    fresh = np.r_[np.arange(5_000) % 2 == 0, [True, True, False]]
    some = neighbours._drawn(v, member, fresh, 3, 20)
    assert [int(((some[0] == n) & (some[2] == f)).sum()) for n in (1, 2) for f in (True, False)] == [20, 20, 2, 1]
    halves = [neighbours._drawn(v[a:b], member[a:b], fresh[a:b], 3, 20) for a, b in ((0, 2_000), (2_000, 5_003))]
    again = neighbours._drawn(*(np.concatenate(x) for x in zip(*halves)), 3, 20)
    assert all((a == b).all() for a, b in zip(some, again))
