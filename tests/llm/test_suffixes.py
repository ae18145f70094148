import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from reviewmill.llm import suffixes
from tests.llm.conftest import ODD, SF


def plain(docs, length=100):
    """docs: (id, bytes) in corpus order."""
    seen, out = set(), []
    for i, raw in docs:
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            part = raw[s : s + length]
            if part in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(part)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def rows_of(frame):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in frame.collect()), key=str)


def corpus(seed):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdé") for _ in range(draw.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(draw.randint(15, 60)) for _ in range(6)]
    docs = []
    for i in range(120):
        parts = [text(draw.randint(0, 40))]
        for _ in range(draw.randint(0, 3)):
            s = draw.choice(shared)
            a = draw.randint(0, len(s) // 2)
            parts += [s[a:] if draw.random() < 0.5 else s, text(draw.randint(0, 20))]
        docs.append("".join(parts))
        if draw.random() < 0.15:
            docs.append(docs[draw.randrange(len(docs))])
        if draw.random() < 0.1:
            docs.append(draw.choice(["Des. ", "a", "ab", shared[0][:37]]) * draw.randint(1, 90))
    return docs


@pytest.mark.parametrize(("seed", "chunk", "hot"), [(1, 1 << 20, 64), (2, 300, 2), (3, 1 << 20, 1), (4, 50, 64)])
def test_random_corpora(spark, monkeypatch, seed, chunk, hot):
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    monkeypatch.setattr(suffixes, "HOT", hot)
    docs = list(enumerate(corpus(seed)))
    want = plain([(i, t.encode()) for i, t in docs])
    assert sum(w[2] for w in want) > 5000
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = suffixes.remove_repeats(frame)
    assert rows_of(got) == sorted(want, key=str)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got.collect())


def test_whole_table(spark, documents):
    docs = sorted((r.doc_id, (r.text or "").encode()) for r in documents.collect())
    assert rows_of(suffixes.op7_repeated_strings(spark, SF)) == sorted(plain(docs), key=str)


def test_odd_rows(spark, odd, empty):
    got = rows_of(suffixes.remove_repeats(odd))
    assert len(got) == len(ODD) and Counter(g[0] for g in got) == Counter(r[0] for r in ODD)
    assert suffixes.remove_repeats(empty).count() == 0


def test_ids_that_repeat(spark):
    draw = random.Random(9)
    a, b, c = ("".join(draw.choice("xyz ") for _ in range(400)) for _ in range(3))
    docs = [(1, a), (1, a), (1, b), (2, a[:150] + b[:150]), (None, c), (None, a), (None, c), (3, "short"), (3, "short")]
    hashes = {r.text: r.h for r in spark.createDataFrame(docs, "doc_id long, text string").selectExpr("text", "xxhash64(text) h").collect()}
    order = sorted(docs, key=lambda d: ((d[0], hashes[d[1]]) if d[0] is not None else (1 << 62, hashes[d[1]] & ((1 << 61) - 1))))
    got = suffixes.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"))
    assert rows_of(got) == sorted(plain([(i, t.encode()) for i, t in order]), key=str)


def test_suffix_sort_is_the_order_of_bytes():
    draw = np.random.default_rng(4)
    data = draw.integers(97, 99, 4000).astype(np.uint8)
    suffix = draw.permutation(3800)[:1500]
    segment = np.sort(draw.integers(0, 40, 1500))
    order = suffixes.Suffixes(data, 100).sort(suffix, segment)
    raw = data.tobytes()
    want = sorted(range(1500), key=lambda i: (segment[i], raw[suffix[i] : suffix[i] + 100], i))
    assert order.tolist() == want


def test_colliding_hashes_remove_nothing(monkeypatch):
    """With a hash that calls everything equal, the check of the bytes still decides."""
    data = np.frombuffer(b"".join(bytes([65 + k]) * 50 for k in (0, 1, 0, 2)), np.uint8)
    monkeypatch.setattr(suffixes.Suffixes, "extension", lambda self, p, q: np.full(len(p), self.length))
    got = suffixes.repeated_starts(data, np.array([0, 50, 100, 150]), np.zeros(4, np.int64), 50)
    assert got.tolist() == [False, False, True, False]


def test_anchor_hot_in_one_partition_only(spark):
    """Strings of an anchor that is hot in one task meet those of a task in which it isn't."""
    draw = random.Random(11)
    text = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    line = text(80)
    around = [(text(15), text(15)) for _ in range(300)]
    hot = [(i, text(70) + a + line + b + text(70)) for i, (a, b) in enumerate(around)]
    rare = [(1000 + i, text(70) + a + line + b + text(70)) for i, (a, b) in enumerate(around[::30])]
    want = plain([(i, t.encode()) for i, t in hot + rare])
    assert all(w[2] >= 110 for w in want[300:])
    for parts in ([hot, rare], [rare, hot]):
        docs = spark.sparkContext.parallelize(parts, 2).flatMap(lambda part: part)
        frame = spark.createDataFrame(docs, "doc_id long, text string")
        assert rows_of(suffixes.remove_repeats(frame)) == sorted(want, key=str)
