"""Repair of a conversation's structure at the least cost, by lazy weighted determinisation.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles: perhaps a
system turn, then users and assistants in turn, ending with an assistant; or
nothing at all. Rows may be kept (0), given another role (2) or deleted (3), empty
turns may be inserted (2); blank rows and rows seen before must go, a truncated row
that stays costs 1 more.

The weighted automaton of these edits has four states. It is determinised as rows
are read: the vector of the least costs of its states, less its smallest entry, is
one state of the deterministic automaton, and what a row of one of nine kinds does
to it is computed once and kept in a table. A state from which no cheapest repair
can go on is dropped from the vector, so there are some dozen vectors however long
conversations are. Reading a conversation is then a walk through the table, which
adds up the cost. A backward walk marks the states that lie on cheapest paths: those
with a tight arc to a marked state, an arc that costs what its ends differ by. It is
a table too. The audit, the ASCII-least string of the initials of cheapest edits
(Delete, Insert, Keep, Rerole), is read off along the marked states.

``verdicts`` shuffles labels instead of texts; ``repaired`` then streams the texts
past their conversation's audit. A task holds some 50 bytes a row of one
conversation, and never its texts, so a conversation of any number of rows that fit
so passes; conversations run side by side.

Rows of a conversation stand in the order of their turn (nulls first), then role,
then label. Null roles and texts count as one space, so such texts are blank. Roles
are judged by their first character, whatever it is. Rows that repeat are
duplicates of the first. A null id is one conversation. Texts are read whole.
Further columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE_SPACE = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

INFINITE = 1 << 40
START, SYSTEM, USER, ASSISTANT = range(4)
#: What a state waits for next: the role and the state that it leads to.
NEXT = {START: ("user", USER), SYSTEM: ("user", USER), ASSISTANT: ("user", USER), USER: ("assistant", ASSISTANT)}
ENDS = (START, ASSISTANT)
INITIALS = "sua"
MUST_DELETE = 8


def kind_of(initial: str, truncated: bool, must_delete: bool) -> int:
    """A row's kind: its initial (s, u, a or another), 4 more if truncated; 8 if it has to go."""
    if must_delete:
        return MUST_DELETE
    known = INITIALS.find(initial) if len(initial) == 1 else -1
    return (known if known >= 0 else 3) + 4 * truncated


def arcs(kind: int) -> list[tuple[int, str, int, int]]:
    """(from, letter, to, cost) of every edit of a row of this kind."""
    out = [(q, "D", q, DELETE) for q in NEXT]
    if kind != MUST_DELETE:
        more, initial = (TRUNCATED if kind >= 4 else 0), "sua-"[kind % 4]
        out += [(q, "R", to, REROLE + more) for q, (_, to) in NEXT.items()]
        out += [(q, "K", to, more) for q, (role, to) in NEXT.items() if role[0] == initial]
        if initial == "s":
            out.append((START, "K", SYSTEM, more))
    return out


ARCS = [arcs(kind) for kind in range(9)]


def _closed(costs: list[int]) -> list[int]:
    """With the inserted turns; without states that cannot be on a cheapest path.

    Whatever follows START can follow ASSISTANT for a deleted system turn more, whatever follows SYSTEM for nothing more.
    """
    costs[USER] = min(costs[USER], min(costs[START], costs[SYSTEM], costs[ASSISTANT]) + INSERT)
    costs[ASSISTANT] = min(costs[ASSISTANT], costs[USER] + INSERT)
    if costs[START] > costs[ASSISTANT] + DELETE:
        costs[START] = INFINITE
    if costs[SYSTEM] > costs[ASSISTANT]:
        costs[SYSTEM] = INFINITE
    return costs


class Repairs:
    """The deterministic automaton, as far as it was met, and the tables of the backward walk."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self._known: dict[tuple[int, ...], int] = {}
        self.next: list[int] = []
        self.added: list[int] = []
        self._marks: dict[tuple[int, int, int], int] = {}
        self._steps: dict[tuple[int, int, int, int], tuple[str, int]] = {}
        self.first = self._state([0, INFINITE, 0 + INSERT, 2 * INSERT])[0]

    def _state(self, costs: list[int]) -> tuple[int, int]:
        """The number of a vector's state, and what was taken off the vector."""
        least = min(costs)
        vector = tuple(INFINITE if c >= INFINITE else c - least for c in costs)
        if vector not in self._known:
            self._known[vector] = len(self.vectors)
            self.vectors.append(vector)
            self.next += [-1] * 9
            self.added += [0] * 9
        return self._known[vector], least

    def _fill(self, state: int, kind: int) -> None:
        costs, vector = [INFINITE] * 4, self.vectors[state]
        for q, _, to, cost in ARCS[kind]:
            if vector[q] < INFINITE:
                costs[to] = min(costs[to], vector[q] + cost)
        self.next[9 * state + kind], self.added[9 * state + kind] = self._state(_closed(costs))

    def scan(self, kinds: bytes | bytearray) -> tuple[int, array]:
        """The least cost of a conversation's repair, and the state before each row and at the end."""
        state, cost, states = self.first, 0, array("H", [self.first])
        ahead, added = self.next, self.added
        for kind in kinds:
            at = 9 * state + kind
            if ahead[at] < 0:
                self._fill(state, kind)
            state = ahead[at]
            cost += added[at]
            states.append(state)
        return cost + min(self.vectors[state][q] for q in ENDS), states

    def _inserts_before(self, vector: tuple[int, ...], marked: int) -> int:
        """``marked`` with the states that a tight insertion leads from to one of them."""
        for q in (USER, START, SYSTEM, ASSISTANT, USER):
            to = NEXT[q][1]
            if marked >> to & 1 and vector[q] < INFINITE and vector[q] + INSERT == vector[to]:
                marked |= 1 << q
        return marked

    def _mark(self, state: int, kind: int, marked: int) -> int:
        """The states before a row that lie on cheapest paths, by those after it."""
        key = (state, kind, marked)
        if key not in self._marks:
            here, there, less = self.vectors[state], self.vectors[self.next[9 * state + kind]], self.added[9 * state + kind]
            found = 0
            for q, _, to, cost in ARCS[kind]:
                if marked >> to & 1 and here[q] < INFINITE and here[q] + cost == there[to] + less:
                    found |= 1 << q
            self._marks[key] = self._inserts_before(here, found)
        return self._marks[key]

    def _last_marks(self, state: int) -> int:
        vector = self.vectors[state]
        best = min(vector[q] for q in ENDS)
        return self._inserts_before(vector, sum(1 << q for q in ENDS if vector[q] == best))

    def _step(self, state: int, kind: int, marked: int, q: int) -> tuple[str, int]:
        """The least letters from ``q`` up to the edit of the next row, and the state after them."""
        key = (state, kind, marked, q)
        if key not in self._steps:
            here, there, less = self.vectors[state], self.vectors[self.next[9 * state + kind]], self.added[9 * state + kind]
            before = self._mark(state, kind, marked)
            letters = ""
            while True:
                tight = {letter: to for p, letter, to, cost in ARCS[kind] if p == q and marked >> to & 1 and here[q] + cost == there[to] + less}
                inserted = NEXT[q][1]
                if before >> inserted & 1 and here[q] + INSERT == here[inserted]:
                    tight["I"] = inserted
                letter = min(tight)
                letters, q = letters + letter, tight[letter]
                if letter != "I":
                    break
            self._steps[key] = letters, q
        return self._steps[key]

    def audit(self, kinds: bytes | bytearray, states: array) -> str:
        """The ASCII-least string of the edits of a cheapest repair."""
        n = len(kinds)
        marks = bytearray(n + 1)
        marks[n] = self._last_marks(states[n])
        for i in range(n - 1, -1, -1):
            marks[i] = self._mark(states[i], kinds[i], marks[i + 1])
        out, q = [], START
        for i in range(n):
            letters, q = self._step(states[i], kinds[i], marks[i + 1], q)
            out.append(letters)
        vector = self.vectors[states[n]]
        while q not in ENDS or vector[q] != min(vector[p] for p in ENDS):
            out.append("I")
            q = NEXT[q][1]
        return "".join(out)


VERDICT = "conv_id {}, n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _placed(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, turn, role, text, label): nulls as one space, and what orders rows of one turn."""
    role, text = (F.coalesce(rows[f"`{c}`"], F.lit(" ")) for c in (role_col, text_col))
    label = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    return rows.select(rows[f"`{id_col}`"].alias("conv_id"), rows[f"`{turn_col}`"].cast("long").alias("turn"), role.alias("role"), text.alias("text"), label.alias("label"))


def _in_order(rows: DataFrame, *before: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *before, "turn", "role", "label")


def _judge(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    repairs = Repairs()
    done: list[dict] = []
    begun, conv, seen, kinds = False, None, set(), bytearray()
    counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    turns, last_turn, low, before = 0, None, None, None

    def closed() -> dict:
        cost, states = repairs.scan(kinds)
        gaps = last_turn - low + 1 - turns if turns else 0
        return {"conv_id": conv, "n_rows": len(kinds), "gaps": gaps, "cost": cost, "audit": repairs.audit(kinds, states)} | counts

    for batch in batches:
        for own, turn, initial, label, blank, truncated in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "initial", "label", "blank", "truncated")), strict=True):
            if not begun or own != conv:
                if begun:
                    done.append(closed())
                begun, conv, seen, kinds = True, own, set(), bytearray()
                counts = dict.fromkeys(counts, 0)
                turns, last_turn, low, before = 0, None, None, None
            if turn is not None and turn != last_turn:
                turns += 1
                low = turn if low is None else low
                last_turn = turn
            again = label in seen
            seen.add(label)
            fault = "blank" if blank else "duplicate" if again else "truncated" if truncated else None
            if fault:
                counts[fault] += 1
            kinds.append(kind_of(initial, fault == "truncated", fault in ("blank", "duplicate")))
            if before is not None and before + initial not in ("su", "ua", "au"):
                counts["illegal"] += 1
            before = initial
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=schema)
            done = []
    if begun:
        yield pa.RecordBatch.from_pylist([closed()], schema=schema)


def _schema_of(rows: DataFrame, ddl: str) -> tuple[str, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    ddl = ddl.format(rows.schema["conv_id"].dataType.simpleString())
    return ddl, to_arrow_schema(rows.sparkSession.createDataFrame([], ddl).schema)


def _last_character_ends(trimmed: Column) -> Column:
    return F.substring(trimmed, -1, 1).isin(".", "!", "?")


def verdicts(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: its faults, the least cost of its repair, and the audit of the edits.

    n_rows, gaps (turns missing between the first and the last), blank, duplicate and truncated (each row's first
    fault), illegal (neighbours whose initials are not su, ua or au), cost, audit.
    """
    placed = _placed(rows, id_col, turn_col, role_col, text_col)
    trimmed = F.rtrim(F.col("text"), F.lit(WHITE_SPACE))
    compact = placed.select(
        "conv_id", "turn", "role", "label", F.substring("role", 1, 1).alias("initial"), (trimmed == "").alias("blank"), (~_last_character_ends(trimmed)).alias("truncated")
    )
    ddl, schema = _schema_of(placed, VERDICT)
    return _in_order(compact).mapInArrow(lambda b: _judge(b, schema), ddl)


def _repair(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    audit, at, q, place = "", 0, START, 0
    begun, conv = False, None
    done: list[dict] = []

    def emit(role: str, text: str, letter: str) -> None:
        nonlocal place
        done.append({"conv_id": conv, "place": place, "role": role, "text": text, "edit": letter})
        place += 1

    def inserted() -> None:
        nonlocal at, q
        while at < len(audit) and audit[at] == "I":
            role, q = NEXT[q]
            emit(role, "", "I")
            at += 1

    for batch in batches:
        for kind, own, role, text, given in zip(*(batch[c].to_pylist() for c in ("kind", "conv_id", "role", "text", "audit")), strict=True):
            if kind == 0:  # a conversation begins with its audit
                if begun:
                    inserted()
                begun, conv, audit, at, q, place = True, own, given, 0, START, 0
                continue
            inserted()
            letter = audit[at]
            at += 1
            if letter == "R":
                role, q = NEXT[q]
            elif letter == "K":
                q = SYSTEM if q == START and role[:1] == "s" else NEXT[q][1]
            if letter != "D":
                emit(role, text, letter)
            if len(done) >= 256:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
                done = []
    if begun:
        inserted()
    yield pa.RecordBatch.from_pylist(done, schema=schema)


REPAIRED = "conv_id {}, place long, role string, text string, edit string"


def repaired(rows: DataFrame, judged: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, place, role, text, edit): the rows of the repaired conversations, with the edit that each comes from.

    ``judged`` are the ``verdicts`` of the same rows. The rows of a conversation lie together, in order of place.
    """
    placed = _placed(rows, id_col, turn_col, role_col, text_col)
    texts = placed.withColumn("kind", F.lit(1)).withColumn("audit", F.lit(None).cast("string"))
    blank = [F.lit(None).cast(t).alias(c) for c, t in placed.dtypes if c != "conv_id"]
    heads = judged.select("conv_id", *blank, F.lit(0).alias("kind"), "audit")
    ddl, schema = _schema_of(placed, REPAIRED)
    return _in_order(texts.unionByName(heads), "kind").mapInArrow(lambda b: _repair(b, schema), ddl)
