import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from check import canonical
from reviewmill.llm import conversations as cv
from tests.llm.conftest import EXTRA, LONG, SF


def exhaustive(rows):
    """(cost, audit, turns) by trying every edit of every row with up to two inserts around each."""
    gaps = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    name = {"u": "user", "a": "assistant"}
    best = None
    for between in itertools.product(gaps, repeat=len(rows) + 1):
        for edits in itertools.product(("D", "K", "Ru", "Ra"), repeat=len(rows)):
            cost, audit, turns = 5 * sum(map(len, between)), "", []
            for inserts, row, edit in zip(between, [*rows, None], [*edits, None]):
                audit += "I" * len(inserts)
                turns += [(name[i], "") for i in inserts]
                if row is None:
                    break
                role, text, forced, cut = row
                if forced and edit != "D":
                    cost = None
                    break
                audit += edit[0]
                cost += {"D": 2, "K": 0}.get(edit, 1) + (5 if cut and edit != "D" else 0)
                if edit != "D":
                    turns.append((role if edit == "K" else name[edit[1]], text))
            if cost is not None and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in turns)):
                best = min(best or (cost, audit, turns), (cost, audit, turns))
    return best


def repaired(rows):
    edits, turns = [], []
    repair = cv.Repair(lambda letter, turn: (edits.append(letter), turn and turns.append(turn)))
    for role, text, forced, cut in rows:
        repair.add(role, text, forced=forced, truncated=cut)
    return repair.end(), "".join(edits), turns


def plain(rows):
    """(cost, audit, turns): every state keeps its whole audit."""

    def closed(cells):
        for s in (0, 1, 3, 2, 3):
            if s in cells:
                to, who = cv.NAMED[s]
                c, a, t = cells[s]
                cells[to] = min(cells.get(to, (10**9,)), (c + 5, a + "I", [*t, (who, "")]), key=lambda x: x[:2])
        return cells

    cells = closed({0: (0, "", [])})
    for role, text, forced, cut in rows:
        after = {}
        for s, (c, a, t) in cells.items():
            ways = [(s, c + 2, a + "D", t)]
            if not forced:
                if (s, role[:1]) in cv.KEPT:
                    ways.append((cv.KEPT[s, role[:1]], c + 5 * cut, a + "K", [*t, (role, text)]))
                ways.append((cv.NAMED[s][0], c + 1 + 5 * cut, a + "R", [*t, (cv.NAMED[s][1], text)]))
            for to, *way in ways:
                after[to] = min(after.get(to, (10**9,)), tuple(way), key=lambda x: x[:2])
        cells = closed(after)
    return min((cells[s] for s in (0, 3) if s in cells), key=lambda x: x[:2])


def drawn(draw, n, forced=0.2):
    roles = ["user", "assistant", "system", "tool", " ", "", "u", "ab"]
    return [(draw.choice(roles), f"t{i}", draw.random() < forced, draw.random() < 0.3) for i in range(n)]


def test_short_conversations_against_every_edit():
    draw = random.Random(5)
    for n in (0, 1, 1, 1, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 3, 3):
        rows = drawn(draw, n)
        assert repaired(rows) == exhaustive(rows), rows


def test_long_conversations_against_whole_audits():
    draw = random.Random(6)
    for n in [*range(4, 40)] * 12 + [400]:
        rows = drawn(draw, n, draw.choice([0, 0.2, 0.9]))
        assert repaired(rows) == plain(rows), rows


def held(repair):
    found, open_ = 0, [repair.root]
    while open_:
        node = open_.pop()
        found += 1
        open_ += node.branches
    return found


@pytest.mark.parametrize("kind", ["drawn", "blank"])
def test_what_is_held_stays_small(kind):
    draw = random.Random(7)
    rows = {
        "drawn": drawn(draw, 20_000), "blank": [("system", "s", False, False)] + [("user", "", True, False)] * 20_000,
    }[kind]
    repair, most = cv.Repair(lambda letter, turn: None), 0
    for role, text, forced, cut in rows:
        repair.add(role, text, forced=forced, truncated=cut)
        most = max(most, held(repair))
    assert most < 500
    repair.end()


@pytest.mark.parametrize("role", ["system", "user", "assistant"])
def test_undecided_runs_take_linear_time(role):
    """Two pairings of equal roles stay apart to the end."""
    cost, audit, turns = repaired([(role, "q", False, False)] * 100_001)
    assert cost > 40_000 and len(audit) == 100_001 and len(turns) >= 100_000
    assert repaired([(role, "q", False, False)] * 41) == plain([(role, "q", False, False)] * 41)


def odd_rows():
    draw = random.Random(8)
    texts = ["Hello.", "Why?  \n", "no end", "", "  ", None, "Done!", "a\nb: c.", "ü 数字."]
    rows = [(c, t, draw.choice(["user", "assistant", "system", "tool", None, ""]), draw.choice(texts)) for c in range(40) for t in range(draw.randrange(12))]
    rows += [(50, None, "user", "Hello."), (50, None, "assistant", "Why?"), (50, 3, "user", "Hello."), (50, 9, "user", "Hello."), (50, 9, "user", "Hello.")]
    rows += [(None, 1, "user", "No id."), (None, 2, "assistant", None), (None, None, None, None), (60, 1, "user", LONG), (60, 2, "assistant", LONG + "."), (None, 5, "user", LONG)]
    rows += [(70, t, "user", "same.") for t in range(60)] + [(71, 5, "system", "S.")] * 9
    return rows


def test_odd_rows_against_sql(spark):
    rows = odd_rows()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    base = duckdb.connect()
    base.register("conversations", frame.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    more = frame.select("*", *[F.lit("x").alias(c) for c in [*EXTRA, "nth", "fault", "dropped", "code"]])
    got = cv.digests(cv.damage(more)).toPandas()
    assert canonical(got) == canonical(base.execute(cv.OP12_SQL).df())
    assert len(got) == frame.select("conv_id").distinct().count()
    assert cv.digests(cv.damage(more.limit(0))).count() == 0


def test_whole_table_against_sql(spark):
    base = duckdb.connect()
    base.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    assert canonical(cv.op12_repair(spark, SF).toPandas()) == canonical(base.execute(cv.OP12_SQL).df())


def test_repaired_turns_are_those_of_the_hash(spark):
    damaged = cv.damage(spark.read.parquet(f"{SF}/conversations.parquet"))
    turns = cv.repaired_turns(damaged)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat("role", F.lit(":"), "text").alias("line")))), lambda x: x["line"]), "\n")
    hashes = {r.conv_id: r.h for r in turns.groupBy("conv_id").agg(F.sha2(text, 256).alias("h")).collect()}
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert all(hashes.get(r.conv_id, empty) == r.repaired_sha256 for r in cv.digests(damaged).collect())
    rest = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.left("role", F.lit(1)).alias("i")))), lambda x: x["i"]), "").alias("s"))
    assert rest.filter(~F.col("s").rlike("^s?(ua)+$")).isEmpty()
