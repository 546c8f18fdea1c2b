"""Conversation structure repair by error-correcting Earley parsing.

The grammar of roles is left-linear: a lead of one system turn or none, then pairs of a user's and an
assistant's turn; nothing at all is a conversation as well. Error productions let a terminal be got
from a turn of another role (rerole), from no turn (insert), and let any turn be passed over (delete),
each at its cost. A chart item (rule, dot, origin) holds the least (cost, audit) of its span, where the
audit has the initial of each edit in order; columns are settled in the order of these values, so that
each item is settled once, and the completed start item of the last column gives the repair.

Equal costs are decided by the audit alone: of two audits of one span and cost none is the beginning
of the other (a longer one has more inserts and so a higher cost), so appending to both keeps order.

As every nonterminal stands first in its rule, all items begin at 0 and a completed item only ever meets
an empty span; so a column needs the one before and column 0, has about ten items, and what goes with
an item (the hash of the repaired turns so far) can be carried along. Turns stream through a task in
order: it keeps ten hashes and audits, and sixteen bytes for each different turn seen, but no texts.
Audits are cut at what all items agree on. A conversation is one sequence, as its hash is, so it goes
through one task, however long; `repaired_turns` returns texts and so holds those of one conversation.

Nulls: a null role or text is one space (and blank, for a text); a null turn comes first and counts in
no gap; all rows without a conv_id are one conversation. Rows that repeat a turn are in order of role
and text. Only the named columns are read. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.textkit import map_batches

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
LEGAL = ("su", "ua", "au")
CUT = 256

START, CONVERSATION, TURNS, LEAD = "start", "conversation", "turns", "lead"
SYSTEM, USER, ASSISTANT = "system", "user", "assistant"
GRAMMAR: list[tuple[str, tuple[str, ...]]] = [
    (START, (CONVERSATION,)),
    (CONVERSATION, ()),
    (CONVERSATION, (TURNS,)),
    (TURNS, (LEAD, USER, ASSISTANT)),
    (TURNS, (TURNS, USER, ASSISTANT)),
    (LEAD, ()),
    (LEAD, (SYSTEM,)),
]
RULES = {head: [i for i, (h, _) in enumerate(GRAMMAR) if h == head] for head, _ in GRAMMAR}
if any(s in RULES for _, body in GRAMMAR for s in body[1:]):
    raise ValueError("a nonterminal after the first place of a rule")

Item = tuple[int, int]  # rule and dot; the origin is 0 always
Value = tuple[int, str, object]

REPAIRS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS_OUT = "conv_id long, place int, role string, text string, edit string, turn long"


class Hashed:
    """The SHA-256 of the turns so far, `role:text` joined by newlines."""

    def __init__(self):
        self.sha, self.any = hashlib.sha256(), False

    def then(self, role: str, text: str, edit: str, turn: int | None) -> Hashed:
        out = Hashed.__new__(Hashed)
        out.sha, out.any = self.sha.copy(), True
        out.sha.update((f"\n{role}:" if self.any else f"{role}:").encode())
        out.sha.update(text.encode())
        return out

    def result(self) -> str:
        return self.sha.hexdigest()


class Kept:
    """The turns so far, each linked with those before."""

    def __init__(self, before: Kept | None = None, turn: tuple | None = None):
        self.before, self.turn = before, turn

    def then(self, role: str, text: str, edit: str, turn: int | None) -> Kept:
        return Kept(self, (role, text, edit, turn))

    def result(self) -> list[tuple]:
        out, at = [], self
        while at.before is not None:
            out.append(at.turn)
            at = at.before
        return out[::-1]


class Chart:
    """The parse of one conversation, a column at a time."""

    def __init__(self, state: Hashed | Kept):
        self.done: list[str] = []
        self.first: dict[Item, Value] = {}
        self.column: dict[Item, Value] = {}
        self.rows = 0
        self._settle([(0, "", (rule, 0), lambda: state) for rule in RULES[START]])
        self.first = self.column

    def _settle(self, agenda: list[tuple[int, str, Item, Callable]]) -> None:
        """Predict, complete and insert until the column is closed, least values first."""
        heap = [(cost, audit, n, item, make) for n, (cost, audit, item, make) in enumerate(agenda)]
        heapq.heapify(heap)
        n = len(heap)
        self.column = column = {}
        opening = not self.first
        waiting = column if opening else self.first
        while heap:
            cost, audit, _, item, make = heapq.heappop(heap)
            if item in column:
                continue
            state = make()
            column[item] = cost, audit, state
            (rule, dot), more = item, []
            head, body = GRAMMAR[rule]
            if dot == len(body):  # complete: all that wait for the head in column 0 move on, their span there being empty
                more = [(cost, audit, (r, d + 1), state) for r, d in list(waiting) if d < len(GRAMMAR[r][1]) and GRAMMAR[r][1][d] == head and d == 0]
            elif body[dot] in RULES:
                if opening:  # elsewhere no item expects a nonterminal
                    more = [(cost, audit, (r, 0), state) for r in RULES[body[dot]]]
                    more += [(cost, audit, (rule, dot + 1), state) for r, d in list(column) if GRAMMAR[r][0] == body[dot] and d == len(GRAMMAR[r][1])]
            elif body[dot] != SYSTEM:
                heapq.heappush(heap, (cost + INSERT, audit + "I", n, (rule, dot + 1), lambda state=state, role=body[dot]: state.then(role, "", "I", None)))
                n += 1
            for c, a, i, s in more:
                heapq.heappush(heap, (c, a, n, i, lambda s=s: s))
                n += 1

    def turn(self, role: str, text: str, fault: str, number: int | None = None) -> None:
        """Scan one turn: keep, rerole or delete it in every item that expects a terminal."""
        agenda = []
        extra = TRUNCATED if fault == "truncated" else 0
        usable = fault not in ("blank", "duplicate")
        for (rule, dot), (cost, audit, state) in self.column.items():
            head, body = GRAMMAR[rule]
            if dot == len(body):
                if head == START:
                    agenda.append((cost + DELETE, audit + "D", (rule, dot), lambda s=state: s))
                continue
            want = body[dot]
            if want in RULES:
                continue
            agenda.append((cost + DELETE, audit + "D", (rule, dot), lambda s=state: s))
            if usable and role[:1] == want[0]:
                agenda.append((cost + KEEP + extra, audit + "K", (rule, dot + 1), lambda s=state: s.then(role, text, "K", number)))
            elif usable and want != SYSTEM:
                agenda.append((cost + REROLE + extra, audit + "R", (rule, dot + 1), lambda s=state, want=want: s.then(want, text, "R", number)))
        self._settle(agenda)
        self.rows += 1
        if self.rows % CUT == 0:
            agreed = len(os.path.commonprefix([a for _, a, _ in self.column.values()]))
            if agreed:
                self.done.append(next(iter(self.column.values()))[1][:agreed])
                self.column = {i: (c, a[agreed:], s) for i, (c, a, s) in self.column.items()}

    def end(self) -> tuple[int, str, object]:
        """(cost, audit, what the state gives) of the cheapest repair."""
        cost, audit, state = self.column[RULES[START][0], 1]
        return cost, "".join([*self.done, audit]), state.result()


class Conversation:
    """Faults and repair of one conversation, turn by turn."""

    def __init__(self, state: Hashed | Kept):
        self.chart, self.seen = Chart(state), set()
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.distinct = 0
        self.low = self.high = self.last = None
        self.initial: str | None = None

    def fault(self, role: str, text: str) -> str:
        bare = text.rstrip(SPACE)
        name = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        again = name in self.seen
        self.seen.add(name)
        if not bare:
            return "blank"
        return "duplicate" if again else "" if bare[-1] in ENDS else "truncated"

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.last:  # in order, nulls first
            self.low, self.high, self.last = turn if self.low is None else self.low, turn, turn
            self.distinct += 1
        fault = self.fault(role, text)
        if fault:
            self.counts[fault] += 1
        if self.initial is not None and self.initial + role[:1] not in LEGAL:
            self.illegal += 1
        self.initial = role[:1]
        self.chart.turn(role, text, fault, turn)

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.distinct


def in_order(turns: DataFrame, conv: Column, turn: Column, role: Column, text: Column, times: Column) -> DataFrame:
    """conv_id, turn, role, text, times: conversations whole and in order in their partitions. `times`
    says how often a turn occurs: 0 for one that is lost but whose conversation is to be told of."""
    rows = turns.select(
        conv.cast("long").alias("conv_id"), turn.cast("long").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"), times.cast("int").alias("times")
    )
    return rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch], new: Callable[[], Hashed | Kept]) -> Iterator[tuple[int | None, Conversation]]:
    now, at, begun = None, None, False
    for batch in batches:
        for conv, turn, role, text, times in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "times")), strict=True):
            if not begun or conv != at:
                if begun:
                    yield at, now
                now, at, begun = Conversation(new()), conv, True
            for _ in range(times):
                now.add(turn, role, text)
    if begun:
        yield at, now


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [f for f, _ in fields])


def repairs(ordered: DataFrame) -> DataFrame:
    """A row for each conversation of in_order(): its faults, and cost, audit and hash of its repair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for conv, c in _conversations(batches, Hashed):
            cost, audit, sha = c.chart.end()
            held.append((conv, c.gaps(), c.counts["blank"], c.counts["duplicate"], c.counts["truncated"], c.illegal, cost, audit, sha))
            if len(held) == 1000:
                yield _rows(held, REPAIRS)
                held = []
        if held:
            yield _rows(held, REPAIRS)

    return map_batches(ordered, run, REPAIRS)


def repaired_turns(ordered: DataFrame) -> DataFrame:
    """The repaired conversations: a row for each turn that is left, with the edit that made it (K, R or
    I) and the turn that it was."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, c in _conversations(batches, Kept):
            rows = [(conv, i, *t) for i, t in enumerate(c.chart.end()[2])]
            for i in range(0, len(rows), 1000):
                yield _rows(rows[i : i + 1000], TURNS_OUT)

    return map_batches(ordered, run, TURNS_OUT)


def damaged(rows: DataFrame) -> DataFrame:
    """conversations with a part of the turns lost, emptied, stripped of ends, repeated or given to the user."""
    name = F.concat(F.coalesce(rows["conv_id"].cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(rows["turn"].cast("string"), F.lit(" ")))
    kind = F.crc32(name.cast("binary")) % 20
    text = F.coalesce(rows["text"], F.lit(" "))
    return in_order(
        rows, rows["conv_id"], rows["turn"], F.when(kind == 4, "user").otherwise(rows["role"]),
        F.when(kind <= 1, "").when(kind == 2, F.translate(text, ENDS, "")).otherwise(text), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1),
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13 over conversations; nulls, ties and empty tables as the module says."""
    return repairs(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
