from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from reviewmill.llm import mixing, quality
from tests.llm.conftest import ODD, SF
from tests.llm.test_decontaminate import plain as hits_of
from tests.llm.test_simhash import firsts_of


def test_each_stage_against_plain_versions(spark, documents):
    docs, steps = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        steps[name] = (docs, stage(spark, docs, SF))
        docs = corpus_pipeline.materialize(steps[name][1], name)
    of = {name: (before.collect(), after.collect()) for name, (before, after) in steps.items()}
    assert all(after.columns == documents.columns for name, (_, after) in steps.items() if name != "shard")

    before, after = of["quality"]
    model = quality.learn(documents, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in after} == {r.doc_id for r in before if model.score(r.text) >= 0.3}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [r.doc_id for r in before if labels.get(r.doc_id) == 1]
    assert len({r.doc_id for r in after} & set(good)) >= 0.97 * len(good)

    before, after = of["near_duplicates"]
    assert {r.doc_id for r in after} == firsts_of({r.doc_id: r.text or "" for r in before})
    assert len({r.text for r in after}) == len(after) < len(before)

    before, after = of["decontaminate"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {h[0] for h in hits_of([(r.doc_id, r.text) for r in before], items) if not h[-1]}
    assert Counter(r.doc_id for r in after) == Counter(clean) and len(clean) < len(before)

    before, after = of["mix"]
    taken = {r.doc_id: -(-r.taken // r.size) for r in mixing.mix(steps["mix"][0]).collect() if r.taken}
    assert Counter(r.doc_id for r in after) == Counter(taken)

    before, after = of["shard"]
    assert Counter((r.doc_id, r.text) for r in after) == Counter((r.doc_id, r.text) for r in before)
    slots = Counter((r.shard, r.slot) for r in after)
    assert max(slots.values()) == 1 and all((k, s - 1) in slots for k, s in slots if s)


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "text", "shard", "slot", "size"} <= set(rows.columns)
    assert rows.count() > 50


def test_odd_rows(spark, odd, empty):
    for frame, n in ((odd, len(ODD)), (empty, 0)):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, frame, SF)
            assert name == "shard" or got.columns == frame.columns
            rows = got.collect()
            assert len(rows) <= 2 * n
            if name in ("decontaminate", "shard"):
                assert len(rows) == n
    assert corpus_pipeline.mixed(spark, odd, SF).filter(F.col("text").isNull()).count() == 0
