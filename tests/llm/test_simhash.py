import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from reviewmill.llm import simhash
from tests.llm.conftest import ODD, SF


def plain_fingerprint(text, n=4):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=4):
    """{fingerprint: set of fingerprints reachable}"""
    left, of = set(prints), {}
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            group.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= radius}
            left -= near
            todo += near
        of |= dict.fromkeys(group, group)
    return of


def check(rows, texts, shingle=4, radius=4):
    """rows: (doc_id, fingerprint, component); texts: (doc_id, text)"""
    prints = [(i, plain_fingerprint(t, shingle)) for i, t in texts]
    groups = plain_components({p for _, p in prints}, radius)
    ids = lambda g: [i for i, p in prints if p in g and i is not None]
    want = [(i, f"{p:016x}", min(ids(groups[p]), default=None)) for i, p in prints]
    assert sorted(rows, key=str) == sorted(want, key=str)


def test_spark_and_xxhash_agree(spark):
    got = spark.sql("SELECT xxhash64('four words of text') h").first().h
    assert got % 2**64 == xxhash.xxh64_intdigest(b"four words of text", 42)


@pytest.mark.parametrize("radius", [2, 4, 6])
def test_masks_cover_every_pair(radius):
    draw, masks = random.Random(radius), simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(2000):
        diff = sum(1 << b for b in draw.sample(range(64), radius))
        assert any(diff & m == 0 for m in masks)


def test_whole_table(spark, documents):
    rows = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.op1_simhash(spark, SF).collect()]
    check(rows, [(r.doc_id, r.text) for r in documents.collect()])


def test_large_buckets(spark, monkeypatch):
    """Links over common neighbours are those of the pairwise comparison."""
    draw = random.Random(5)
    base = [draw.getrandbits(64) for _ in range(12)]
    values = {b ^ sum(1 << k for k in draw.sample(range(64), draw.randint(0, 7))) for b in base for _ in range(40)}
    prints = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    found = []
    for size in (2048, 1):
        monkeypatch.setattr(simhash, "COMPARED", size)
        monkeypatch.setattr(simhash, "comb", lambda n, k, size=size: size)
        links = simhash.fingerprint_links(prints, 4).collect()
        roots = simhash.connected_components(spark.createDataFrame([(x.a, x.b) for x in links], "a long, b long"))
        found.append({r.node % 2**64: r.root for r in roots.collect()})
    groups = plain_components(values)
    for of in found:
        assert set(of) == {v for v in values if len(groups[v]) > 1}
        assert all(of[x] == min(simhash._signed(v) for v in groups[x]) for x in of)


def test_odd_rows(spark, odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    check([(r.doc_id, r.fingerprint, r.component_id) for r in rows], [(r[0], r[1]) for r in ODD])
    assert simhash.near_duplicates(empty).count() == 0


def test_long_chain(spark):
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in simhash.connected_components(links).collect()} == {0}


def jaccard(a, b, n=5):
    words = [(t or "").encode().lower().split() for t in (a, b)]
    sets = [{tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set() for w in words]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


def edited(words, n, draw):
    """A copy with n words changed."""
    out = list(words)
    for at in draw.sample(range(len(out)), n):
        out[at] = f"new{draw.randrange(10**6)}"
    return " ".join(out)


def firsts_of(texts):
    """Smallest ids of the components of plain four-word fingerprints within four bits."""
    prints = {i: simhash.simhash(simhash.shingle_hashes(simhash.words_of(t), 4)) for i, t in texts.items()}
    left, firsts = set(texts), set()
    while left:
        first = min(left)
        group, todo = set(), {first}
        while todo:
            x = todo.pop()
            group.add(x)
            todo |= {y for y in left - group if (prints[x] ^ prints[y]).bit_count() <= 4}
        left -= group
        firsts.add(first)
    return firsts


def test_keep_one(spark):
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 9)))
    texts = [[word() for _ in range(draw.randint(60, 300))] for _ in range(80)]
    docs = []
    for words in texts:
        docs.append((len(docs), " ".join(words), "en", "s", 1))
        for k in (0, 1, 2, len(words) // 4):
            docs.append((len(docs), edited(words, k, draw), "en", "s", 1))
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    kept = {r.doc_id for r in simhash.keep_one(frame).collect()}
    assert kept == firsts_of({d[0]: d[1] for d in docs})
    assert not kept & {i for i in range(len(docs)) if i % 5 == 1}  # exact copies
    assert {i for i in range(len(docs)) if i % 5 in (0, 4)} <= kept


def test_keep_one_of_each_component(spark, documents):
    kept = simhash.keep_one(documents)
    assert kept.columns == documents.columns
    assert {r.doc_id for r in kept.collect()} == firsts_of({r.doc_id: r.text or "" for r in documents.collect()})


def test_keep_one_odd_rows(spark, odd, empty):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "5", "7", "8", "9", "None"]
    assert simhash.keep_one(empty).count() == 0
