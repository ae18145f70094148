"""Repair of a conversation's structure by Viterbi search with survivor coalescence.

A conversation's roles shall read ``s?(ua)+`` or nothing. Four states (nothing yet, after
the system turn, after a user's, after an assistant's turn) each keep their cheapest edits, a
survivor. Survivors are paths in a tree of backpointers whose nodes count what refers to
them: a dropped survivor frees its branch at once, and as soon as the root has a single
branch left, which means that all survivors share that edit, it is emitted and forgotten.
So what a task holds is the unresolved part of one conversation, not the conversation.
Of equally cheap paths into a state the one with the least audit stays. Before inserts all
survivors' audits hold one letter for every turn and end in one, so none begins with another: the first
difference in their whole unresolved suffixes decides for any future. That order of the
survivors is kept from turn to turn, so a comparison of suffixes takes one step, however long they are.
Two survivors that stay apart, such as the two ways to pair a run of equal roles, are held until
they are decided, at worst to the conversation's end.

Rows are dealt by conversation once; duplicates are found by a window that this deal already
satisfies, and sorts spill. A conversation is one stream, since the hash of its repaired text
can only be taken in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reviewmill.llm.common import table

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Where a turn with that initial leads.
KEPT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: Where a user's or an assistant's turn that the repair names leads.
NAMED = {NOTHING: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
LEGAL = ("su", "ua", "au")
DIGEST = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Edit:
    """A node of the backpointer tree; ``times`` equal deletions in a row are one node."""

    __slots__ = ("parent", "letter", "times", "turn", "held", "branches")

    def __init__(self, parent: Edit | None, letter: str, turn: tuple[str, str] | None):
        self.parent, self.letter, self.turn, self.times = parent, letter, turn, 1
        self.held, self.branches = 0, []
        if parent:
            parent.branches.append(self)


class Repair:
    """Streams one conversation's turns to its cheapest edits; ``emit(letter, turn)`` gets every edit once it is certain."""

    def __init__(self, emit: Callable[[str, tuple[str, str] | None], None]):
        self.emit = emit
        self.root = Edit(None, "", None)
        self.root.held = 1
        #: By state: (cost, place in the order of all survivors' audits, path's last edit).
        self.survivors: dict[int, tuple[int, int, Edit]] = {NOTHING: (0, 0, self.root)}
        self._reach()

    def add(self, role: str, text: str, *, forced: bool, truncated: bool) -> None:
        """The next turn; ``forced`` ones are deleted, undeleted ``truncated`` ones cost more."""
        best: dict[int, tuple] = {}
        extra = TRUNCATED if truncated else 0

        def offer(state: int, cost: int, cell: tuple, letter: str, turn: tuple[str, str] | None) -> None:
            _, order, start, inserts = cell
            key = (cost, order, "I" * inserts + letter)
            if state not in best or key < best[state][0]:
                best[state] = key, start, inserts, letter, turn

        for state, cell in self.cells.items():
            offer(state, cell[0] + DELETE, cell, "D", None)
            if not forced:
                if (after := KEPT.get((state, role[:1]))) is not None:
                    offer(after, cell[0] + extra, cell, "K", (role, text))
                after, name = NAMED[state]
                offer(after, cell[0] + REROLE + extra, cell, "R", (name, text))
        old, self.survivors, grown = self.survivors, {}, {}
        for order, (state, won) in enumerate(sorted(best.items(), key=lambda item: item[1][0][1:])):
            (cost, _, _), start, inserts, letter, turn = won
            node = self._inserted(old[start][2], start, inserts, grown)
            node = Edit(node, letter, turn)
            node.held = 1
            self.survivors[state] = cost, order, node
        for _, _, node in old.values():
            self._free(node)
        self._reach()
        self._settle()

    def end(self) -> int:
        """The cost; what is unresolved is emitted."""
        cost, _, start, inserts = min((self.cells[s] for s in (NOTHING, ASSISTANT) if s in self.cells), key=lambda c: c[:2])
        way, node = [], self._inserted(self.survivors[start][2], start, inserts, {})
        while node is not self.root:
            way.append(node)
            node = node.parent
        for node in reversed(way):
            self._out(node)
        return cost

    def _inserted(self, node: Edit, state: int, inserts: int, grown: dict) -> Edit:
        for n in range(inserts):
            state, name = NAMED[state]
            if (node, n) not in grown:
                grown[node, n] = Edit(node, "I", (name, ""))
            node = grown[node, n]
        return node

    def _reach(self) -> None:
        """By state the best (cost, order, survivor's state, inserts) with up to two inserts; survivors that no way on needs go.

        After an assistant's turn every way on from a system turn is open too, and, by deleting one turn, every way on from nothing.
        """
        cells: dict[int, tuple] = {}
        for start, (cost, order, _) in self.survivors.items():
            state = start
            for inserts in range(3):
                if state not in cells or (cost, order) < cells[state][:2]:
                    cells[state] = cost, order, start, inserts
                state, cost = NAMED[state][0], cost + INSERT
        if ASSISTANT in cells:
            for state, spared in ((NOTHING, DELETE), (SYSTEM, 0)):
                if state in cells and cells[state][0] > cells[ASSISTANT][0] + spared:
                    del cells[state]
        self.cells = cells
        needed = {cell[2] for cell in cells.values()}
        for state in [s for s in self.survivors if s not in needed]:
            self._free(self.survivors.pop(state)[2])

    def _free(self, node: Edit) -> None:
        """One reference less; what nothing refers to goes, and so up the tree."""
        node.held -= 1
        while not node.held and not node.branches and node is not self.root:
            parent = node.parent
            parent.branches.remove(node)
            node = parent

    def _settle(self) -> None:
        """Emit what all survivors share; join deletions that nothing branches off between."""
        while not self.root.held and len(self.root.branches) == 1:
            self.root = self.root.branches[0]
            self._out(self.root)
            self.root.parent = None
        for _, _, node in self.survivors.values():
            above = node.parent
            if node.letter == "D" and above and above is not self.root and above.letter == "D" and not above.held and len(above.branches) == 1:
                above.parent.branches.remove(above)
                above.parent.branches.append(node)
                node.times += above.times
                node.parent = above.parent

    def _out(self, node: Edit) -> None:
        for _ in range(node.times):
            self.emit(node.letter, node.turn)


def damage(rows: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, dropped): the rows after damage by crc32 of ``id:turn`` modulo 20.

    Null roles and texts become one space, null ids and turns are one space in the hashed key. Dropped
    rows stay as rows without role and text, so that their conversation isn't lost.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (id_col, turn_col)])
    code = F.crc32(key) % 20
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit(" ")) for c in (role_col, text_col))
    spoilt = F.when(code == 1, "").when(code == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    made = F.struct(
        F.col(f"`{id_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"),
        F.when(code == 0, None).when(code == 4, "user").otherwise(role).alias("role"),
        F.when(code == 0, None).otherwise(spoilt).alias("text"), (code == 0).alias("dropped"),
    )
    return rows.select(F.inline(F.array_repeat(made, F.when(code == 3, 2).otherwise(1))))


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows with their fault, each conversation in one partition and in order: by turn (nulls first), role, text."""
    same = Window.partitionBy("conv_id", "dropped", "role", F.sha2("text", 256)).orderBy(F.col("turn").asc_nulls_first())
    dealt = rows.repartition("conv_id").withColumn("nth", F.row_number().over(same))
    fault: Column = F.when(F.col("dropped"), "dropped").when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank").when(F.col("nth") > 1, "duplicate")
    fault = fault.when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated").otherwise("")
    return dealt.withColumn("fault", fault).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "nth")


class Digest:
    """The summary of one conversation, fed in order."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.written = 0
        self.low = self.high = self.seen = self.initial = None
        self.audit, self.hash = [], hashlib.sha256()
        self.repair = Repair(self.take)

    def take(self, letter: str, turn: tuple[str, str] | None) -> None:
        self.audit.append(letter)
        if turn:
            self.hash.update(("\n" * bool(self.written) + f"{turn[0]}:{turn[1]}").encode())
            self.written += 1

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.blank += fault == "blank"
        self.duplicate += fault == "duplicate"
        self.truncated += fault == "truncated"
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in LEGAL
        self.initial = role[:1]
        self.repair.add(role, text, forced=fault in ("blank", "duplicate"), truncated=fault == "truncated")

    def row(self) -> tuple:
        cost = self.repair.end()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.audit), self.hash.hexdigest()


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, bool, tuple]]:
    """(conversation, whether it is new, turn/role/text/fault) of rows in order; dropped rows have no role."""
    last, began = None, False
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault")]
        for key, *row in zip(*columns, strict=True):
            yield key, not began or key != last, row
            last, began = key, True


def digests(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``damage``'s rows: counts of faults, cost, audit and hash of the repaired turns.

    Turns that tie are taken by role, then text. Rows without a conversation are one conversation, of
    id null. Very long texts are held only while their turn is unresolved. An empty table gives no rows.
    """
    id_type = rows.schema["conv_id"].dataType

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, out = None, []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True)) for row in out], schema=schema)

        owner = None
        for key, new, (turn, role, text, fault) in _conversations(batches):
            if new:
                if state:
                    out.append((owner, *state.row()))
                if len(out) >= 1_000:
                    yield flush()
                    out = []
                state, owner = Digest(), key
            if fault != "dropped":
                state.add(turn, role, text, fault)
        if state:
            out.append((owner, *state.row()))
            yield flush()

    from pyspark.sql.pandas.types import to_arrow_type

    names = ["conv_id", *[part.split()[0] for part in DIGEST.split(", ")]]
    kinds = [to_arrow_type(id_type), *[pa.int64() if part.endswith("long") else pa.string() for part in DIGEST.split(", ")]]
    schema = pa.schema(list(zip(names, kinds, strict=True)))
    return _ordered(rows).select("conv_id", "turn", "role", "text", "fault").mapInArrow(summed, f"conv_id {id_type.simpleString()}, {DIGEST}")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns that ``damage``'s rows are repaired to, numbered from 0 in their conversation.

    Turns leave as soon as they are certain. A conversation that is deleted whole has no rows.
    """
    id_type = rows.schema["conv_id"].dataType

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        schema = pa.schema([("conv_id", to_arrow_type(id_type)), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
        out, place, owner, repair = [], 0, None, None

        def emit(letter: str, turn: tuple[str, str] | None) -> None:
            nonlocal place
            if turn:
                out.append({"conv_id": owner, "place": place, "edit": letter, "role": turn[0], "text": turn[1]})
                place += 1

        for key, new, (_, role, text, fault) in _conversations(batches):
            if new:
                if repair:
                    repair.end()
                place, owner, repair = 0, key, Repair(emit)
            if fault != "dropped":
                repair.add(role, text, forced=fault in ("blank", "duplicate"), truncated=fault == "truncated")
            if len(out) >= 1_000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out.clear()
        if repair:
            repair.end()
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    kind = f"conv_id {id_type.simpleString()}, place long, edit string, role string, text string"
    return _ordered(rows).select("conv_id", "turn", "role", "text", "fault").mapInArrow(turned, kind)


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(damage(table(spark, sf_dir, "conversations")))


#: The same search without coalescence: whole audits and outputs of every state at every turn.
OP12_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), coded AS (
  SELECT *, xor(list_reduce([4294967295::BIGINT] || [ascii(c)::BIGINT for c in string_split(k, '')],
    lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda b, z: CASE WHEN b & 1 = 1 THEN xor(b >> 1, 3988292384::BIGINT) ELSE b >> 1 END)
  ), 4294967295::BIGINT) % 20 AS code FROM keyed
), spoilt AS (
  SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM coded, LATERAL (SELECT unnest(range(CASE code WHEN 3 THEN 2 ELSE 1 END))) WHERE code <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM spoilt
), faulty AS (
  SELECT *, row_number() OVER w AS i, left(role, 1) AS initial, lag(left(role, 1)) OVER w AS before,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault
  FROM numbered WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth)
), edits(letter, state, initial, after, price, says) AS (
  VALUES ('D', 0, NULL, 0, 2, NULL), ('D', 1, NULL, 1, 2, NULL), ('D', 2, NULL, 2, 2, NULL), ('D', 3, NULL, 3, 2, NULL),
         ('K', 0, 's', 1, 0, NULL), ('K', 0, 'u', 2, 0, NULL), ('K', 1, 'u', 2, 0, NULL), ('K', 3, 'u', 2, 0, NULL), ('K', 2, 'a', 3, 0, NULL),
         ('R', 0, NULL, 2, 1, 'user'), ('R', 1, NULL, 2, 1, 'user'), ('R', 3, NULL, 2, 1, 'user'), ('R', 2, NULL, 3, 1, 'assistant')
), inserts(state, after, letters, price, said) AS (
  VALUES (0, 0, '', 0, []::VARCHAR[]), (1, 1, '', 0, []), (2, 2, '', 0, []), (3, 3, '', 0, []), (0, 2, 'I', 5, ['user:']), (1, 2, 'I', 5, ['user:']),
         (3, 2, 'I', 5, ['user:']), (2, 3, 'I', 5, ['assistant:']), (0, 3, 'II', 10, ['user:', 'assistant:']), (1, 3, 'II', 10, ['user:', 'assistant:'])
), paths(conv_id, i, state, cost, audit, said) AS (
  SELECT c.conv_id, 0::BIGINT, n.after, n.price::BIGINT, n.letters, n.said FROM (SELECT DISTINCT conv_id FROM conversations) c, inserts n WHERE n.state = 0
  UNION ALL
  SELECT conv_id, i, state, cost, audit, said FROM (
    SELECT p.conv_id, f.i, n.after AS state, (p.cost + e.price + n.price + CASE WHEN f.fault = 'truncated' AND e.letter <> 'D' THEN 5 ELSE 0 END)::BIGINT AS cost,
           p.audit || e.letter || n.letters AS audit,
           p.said || CASE e.letter WHEN 'D' THEN []::VARCHAR[] ELSE [coalesce(e.says, f.role) || ':' || f.text] END || n.said AS said
    FROM paths p JOIN faulty f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = p.i + 1
    JOIN edits e ON e.state = p.state AND (e.initial IS NULL OR e.initial = f.initial) AND (e.letter = 'D' OR f.fault NOT IN ('blank', 'duplicate'))
    JOIN inserts n ON n.state = e.after
  ) QUALIFY row_number() OVER (PARTITION BY conv_id, i, state ORDER BY cost, audit) = 1
), counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
), ends AS (
  SELECT p.*, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal
  FROM paths p LEFT JOIN counts c ON p.conv_id IS NOT DISTINCT FROM c.conv_id WHERE p.i = coalesce(c.n, 0) AND p.state IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY p.conv_id ORDER BY p.cost, p.audit) = 1
)
SELECT conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, sha256(array_to_string(said, chr(10))) AS repaired_sha256 FROM ends
"""
