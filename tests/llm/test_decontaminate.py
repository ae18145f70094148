import hashlib
import random
import re

from check import canonical
from reviewmill.llm import decontaminate
from tests.llm.conftest import ODD, SF

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items):
    out = []
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    for doc, text in docs:
        w, hit, names = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    names |= {str(x) for x in found if x is not None}
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


def rows_of(frame):
    return [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in frame.collect()]


def test_matches_sql(spark, duck):
    got, want = decontaminate.op5_decontaminate(spark, SF).toPandas(), duck.execute(decontaminate.OP5_SQL).df()
    assert canonical(got) == canonical(want) and want["contaminated"].any()


def test_short_items_and_odd_rows(spark, odd, empty):
    items = [(1, "One, TWO three"), (2, "single"), (3, None), (4, ""), (None, "alone HERE"), (2, "single"), (10, "数字"), (5, "four five six seven eight nine ten eleven twelve thirteen"), (6, "word " * 12)]
    tests = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(rows_of(decontaminate.decontaminate(odd, tests)), key=str) == sorted(plain([(r[0], r[1]) for r in ODD], items), key=str)
    assert decontaminate.decontaminate(empty, tests).count() == 0
    assert not any(r[-1] for r in rows_of(decontaminate.decontaminate(odd, tests.limit(0))))


def test_random_spans(spark):
    draw = random.Random(2)
    text = lambda n: " ".join(draw.choice(["a", "B", "c-d", "é", "7"]) for _ in range(n))
    items = [(i, text(draw.randint(0, 16))) for i in range(30)]
    docs = [(i, text(draw.randint(0, 60))) for i in range(60)] + [(100 + i, f"{text(5)} {t} {text(5)}") for i, t in items]
    got = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(rows_of(got)) == sorted(plain(docs, items))
