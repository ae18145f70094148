import hashlib
import re

from reviewmill.llm import pii
from tests.llm.conftest import ODD, SF

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    digits = re.sub(r"\D", "", value, flags=re.ASCII)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def plain(text):
    return {kind: [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(p, text or "") if passes(kind, m[0])] for kind, p in PLAIN.items()}


def check(rows, texts):
    """rows and texts in one order; base spans are exact, and every base span is among all spans."""
    for r, text in zip(rows, texts, strict=True):
        want = plain(text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(want[k]) for k in pii.KINDS], text
        base = [x for k in pii.KINDS for x in want[k]]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), text
        spans = r.spans.split(",") if r.spans else []
        assert set(base) <= set(spans)
        keys = [(pii.KINDS.index(k), int(a), int(b)) for k, a, b in (x.split(":") for x in spans)]
        assert keys == sorted(set(keys)) and all(0 <= a < b <= len(text or "") for _, a, b in keys)


TRICKY = [
    "a@b.c_x@d.e", "a@b.c.%d@e.f", "a@b.c@d.e", "x@y z@w.v.", "@a.b", "a.b@-.-", "é@b.cc ü.a%@b.cc", "1.2.3.4.5.6.7.8", "999.1.2.3 001.002.003.004 1.2.3.256",
    "0004.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111 4", "4111  1111", "5500005555555559x", "call +1 (377) 555-0271.", "+12 3", "+1234567 890 12345 6", "+1 2 +49 30 1234567-",
    "𝕏 mail 𝕏@x.yy me@x.yy 10.0.0.1", "1" * 3000, "a" * 60_000, "1.1." * 3000, "a@" + "b." * 3000 + "c", "+1" + " " * 5000,
]


def test_base_spans_are_exact(spark):
    docs = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    rows = sorted(pii.find_personal_data(docs).collect(), key=lambda r: r.doc_id)
    check(rows, TRICKY)


def test_whole_table(spark, documents):
    rows = {r.doc_id: r for r in pii.op6_personal_data(spark, SF).collect()}
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert set(rows) == set(texts)
    check([rows[k] for k in texts], list(texts.values()))


def test_adds_loose_spans_in_the_format_of_the_corpus(spark):
    texts = [f"write to name.{i}@mail{i % 7}.example.com now" for i in range(300)] + ["write to some.body at mail3.example.com now", "look at example.com now or never"] + ["nothing to see here at all"] * 50
    rows = sorted(pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect(), key=lambda r: r.doc_id)
    check(rows, texts)
    assert rows[300].spans == "email:9:39"
    assert all(not r.spans for r in rows[302:])


def test_finds_ipv6_and_many_obfuscated_emails(spark):
    """Genuine loose spans in any number don't count against themselves."""
    texts = [f"write to {'user' if i % 2 else 'name.'}{i if i % 2 == 0 else ''}@mail{i % 7}.example.com from 10.0.{i % 200}.{i % 90} now" for i in range(280)]
    loose = [f"write to name.{i} at mail{i % 7}.example.com now" for i in range(80)] + ["please write to john at mail3.example.com now"] * 40
    ips = [f"seen 2001:db8:0:0:{i:x}:1a2b:ff00:42 and 2001:0db8:85a3:0000:0000:8a2e:0370:73{i % 90 + 10} there" for i in range(20)]
    neutral = [f"come and look at {'mail3.' * (i % 2)}example.com whenever there is time" for i in range(60)]
    texts += loose + ips + neutral
    rows = sorted(pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect(), key=lambda r: r.doc_id)
    check(rows, texts)
    assert all(r.spans.startswith("email:9:") for r in rows[280:360]) and all(r.spans == "email:16:41" for r in rows[360:400])
    assert all(r.spans.count("ip:") == 2 for r in rows[400:420])
    assert not any(r.spans for r in rows[420:])


def test_boosting_separates_cells():
    cells = {(k, w, 0, u, 0, 0, 0, 0, 0, 0): (100.0, 100.0 if u else 0.0) for k in (0, 1) for w in (0, 1) for u in (0, 1)}
    first, trees = pii.boost(cells)
    for key, (_, good) in cells.items():
        assert (first + sum(pii.tree_value(t, key) for t in trees) > 2) == bool(good)
    assert pii.thresholds(cells, first, trees, 0.98)[2] > 1 > pii.thresholds(cells, first, trees, 0.98)[0]


def test_native(spark, documents):
    plan = pii.find_personal_data(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_odd_rows(spark, odd, empty):
    rows = pii.find_personal_data(odd).collect()
    assert len(rows) == len(ODD) and all(r.spans == "" for r in rows)
    assert pii.find_personal_data(empty).count() == 0
