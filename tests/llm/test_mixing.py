from collections import defaultdict

import pytest

from check import canonical
from reviewmill.llm import mixing
from tests.llm.conftest import ODD, SF


def filled(caps, weights, total):
    """Shares by weight; what is above a cap is shared again among the others."""
    target, free = dict.fromkeys(caps, 0.0), set(caps)
    while total > 1e-9 and free:
        per = total / sum(weights[s] for s in free)
        full = {s for s in free if per * weights[s] >= caps[s]}
        for s in full or free:
            target[s] = caps[s] if full else per * weights[s]
        total -= sum(target[s] for s in full) if full else total
        free -= full or free
    return target


def test_matches_sql(spark, duck):
    got, want = mixing.op8_mix_sources(spark, SF).toPandas(), duck.execute(mixing.OP8_SQL).df()
    assert canonical(got) == canonical(want)


def test_targets_and_totals(spark, documents):
    rows = mixing.mix(documents).join(documents.select("doc_id", "source"), "doc_id").collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}
    want = filled({s: 2.0 * n for s, n in sizes.items()}, weights, 1.5 * sum(sizes.values()))
    for r in rows:
        assert r.target == pytest.approx(want[r.source])
    for s, target in want.items():
        assert abs(taken[s] - target) <= 1
    again = mixing.mix(documents).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_whole_epochs_come_first(spark, documents):
    for r in mixing.mix(documents).collect():
        if r.source_size:
            assert r.taken >= int(r.target // r.source_size) * r.size


def test_heavier_documents_come_earlier(spark):
    rows = spark.range(4000).selectExpr("id doc_id", "'a b c d' text", "'s' source", "if(id % 2 = 0, 9.0, 1.0) quality")
    taken = mixing.mix(rows, share=0.5, weight=rows["quality"]).collect()
    even = sum(r.taken for r in taken if r.doc_id % 2 == 0)
    assert sum(r.taken for r in taken) == 8000 and even > 6500


def test_odd_rows(spark, odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD)
    assert all(r.taken == 0 for r in rows if r.size == 0)
    assert sum(r.taken for r in rows) == pytest.approx(1.5 * sum(r.size for r in rows), abs=5)
    assert mixing.mix(empty).count() == 0
