import zlib

import numpy as np
import pytest

from reviewmill.llm import quality
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in quality.op9_quality(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in rows.items())
    tried = [i for i in labels if i in rows and rows[i].held_out]
    assert len(tried) > 50
    assert sum(rows[i].predicted == labels[i] for i in tried) / len(tried) > 0.97


def test_held_out_labels_are_not_read(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - quality, quality) AS quality")
    a, b = quality.learn(docs, labels, fit_rows=300), quality.learn(docs, turned, fit_rows=300)
    assert (a.weight == b.weight).all() and (a.slope, a.shift) == (b.slope, b.shift)


def test_dual_coordinate_descent_reaches_the_optimum():
    draw = np.random.default_rng(0)
    points, signs = draw.normal(size=(80, 3)), np.where(draw.random(80) < 0.5, -1.0, 1.0)
    rows = [(np.arange(3), p) for p in points]
    w, b = quality.dual_coordinate_descent(rows, signs, 1.0, 400, 1)
    loss = lambda v: 0.5 * v @ v + np.maximum(0, 1 - signs * (np.c_[points, np.ones(80)] @ v)).sum()
    at = np.r_[w[:3], b]
    assert all(loss(at) <= loss(at + step) + 1e-3 for step in draw.normal(scale=0.01, size=(300, 4)))


@pytest.mark.parametrize(("word", "shape"), [("THE!!", "A!"), ("Hello,", "X,"), ("a1b22", "a9a9"), ("I", "X"), ("***", "*"), ("éé", "a")])
def test_word_shape(word, shape):
    assert quality.word_shape(word) == shape


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, 1), (6, 1), (7, 0), (8, None), (None, 1), (9, 0), (99, 0), (9, 7)], "doc_id long, quality int")
    rows = quality.classify(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    alike = {r.score for r in rows if r.doc_id in (1, 2, 3)}
    assert len(alike) == 1
    assert {r.score for r in quality.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(empty, labels).count() == 0
