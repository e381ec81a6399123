"""Conversation structure: faults of turns and the cheapest repair into turns of a system, user and assistant.

A repaired conversation is empty or has the role initials ``s?(ua)+``. Keeping, changing the role of, deleting and inserting turns have costs, so a
conversation is read by a weighted automaton of four states: start, after a system turn, after a user's, after an assistant's. It is determinised
lazily: the vector of costs of being in each state, less its minimum, is one state of a deterministic automaton, and
each (vector, kind of turn) met is worked out once and kept in a table. Scanning a conversation by that table gives its
cost. A trace back along the tight arcs, those whose costs add up, marks what lies on a cheapest path; reading
the marked arcs forward, the least letter first, gives the audit.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from statloom.llm.common import small_batches

#: What counts as white space.
BLANKS = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
INF = 1 << 40
#: Costs of edits, and what a kept turn adds that ends without a full stop, exclamation or question mark.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: Kinds of turns: 4 x initial (s, u, a, another) + fault.
INITIALS, FAULTS = "sua", ("", "truncated", "blank", "duplicate")
#: Where a turn with an initial leads from each state.
STEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
INSERTS = [(START, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT)]


class Automaton:
    """The lazily determinised automaton: vectors by number, transitions, and marks of the trace, each worked out once."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.table: dict[tuple[int, int], tuple[int, int, list[tuple[int, str, int]]]] = {}
        self.marks: dict[tuple[int, int, int], int] = {}
        self.start = self._number(self._closed([0, INF, INF, INF]))

    @staticmethod
    def _closed(v: list[int]) -> list[int]:
        """Costs with insertions, without those that a state which can do the same or more undercuts."""
        v[USER] = min(v[USER], v[START] + INSERT, v[SYSTEM] + INSERT, v[ASSISTANT] + INSERT)
        v[ASSISTANT] = min(v[ASSISTANT], v[USER] + INSERT)
        if v[START] > v[ASSISTANT] + DELETE:
            v[START] = INF
        if v[SYSTEM] > v[ASSISTANT]:
            v[SYSTEM] = INF
        return v

    def _number(self, v: list[int]) -> int:
        key = tuple(v)
        if key not in self.number:
            self.number[key] = len(self.vectors)
            self.vectors.append(key)
        return self.number[key]

    def step(self, state: int, kind: int) -> tuple[int, int, list[tuple[int, str, int]]]:
        """Next state, what it costs at least, and the tight arcs (from, letter, to) of a turn."""
        found = self.table.get((state, kind))
        if found is None:
            v, initial, fault = self.vectors[state], (*INITIALS, "")[kind >> 2], FAULTS[kind & 3]
            arcs = [(q, "D", q, DELETE) for q in range(4)]
            if fault not in ("blank", "duplicate"):
                more = TRUNCATED if fault == "truncated" else 0
                arcs += [(q, "K", to, more) for q, to in STEPS.get(initial, {}).items()]
                arcs += [(q, "R", to, REROLE + more) for role in "ua" for q, to in STEPS[role].items()]
            costs = [INF] * 4
            for q, _, to, cost in arcs:
                costs[to] = min(costs[to], v[q] + cost)
            costs = self._closed([min(c, INF) for c in costs])
            least = min(costs)
            tight = [(q, letter, to) for q, letter, to, cost in arcs if v[q] < INF and v[q] + cost == costs[to]]
            found = self._number([c - least if c < INF else INF for c in costs]), least, tight
            self.table[state, kind] = found
        return found

    def inserts(self, state: int) -> list[tuple[int, int]]:
        """The tight insertions (from, to) at a state."""
        v = self.vectors[state]
        return [(q, to) for q, to in INSERTS if v[q] < INF and v[q] + INSERT == v[to]]

    def final(self, state: int) -> tuple[int, int]:
        """What ending here costs, and the marks of the states that a cheapest path ends in."""
        v = self.vectors[state]
        least = min(v[START], v[ASSISTANT])
        return least, self.with_inserts(state, sum(1 << q for q in (START, ASSISTANT) if v[q] == least))

    def with_inserts(self, state: int, mark: int) -> int:
        for _ in range(2):
            for q, to in self.inserts(state):
                mark |= (mark >> to & 1) << q
        return mark

    def back(self, state: int, kind: int, after: int) -> int:
        """Marks before a turn, from those after it."""
        found = self.marks.get((state, kind, after))
        if found is None:
            mark = 0
            for q, _, to in self.step(state, kind)[2]:
                mark |= (after >> to & 1) << q
            found = self.marks[state, kind, after] = self.with_inserts(state, mark)
        return found

    def edits(self, kinds: array, copies: array) -> tuple[int, list[str]]:
        """Cost, and for each run of equal turns the edits' letters up to its last turn; the last string has what is inserted at the end.

        All turns of a run but its first are to be deleted.
        """
        states, cost, state = array("I", [self.start]), 0, self.start
        for kind, n in zip(kinds, copies):
            state, least, _ = self.step(state, kind)
            states.append(state)
            cost += least + DELETE * (n - 1)
        least, mark = self.final(state)
        ends = mark & sum(1 << q for q in (START, ASSISTANT) if self.vectors[state][q] == least)
        marks = bytearray([mark])
        for i in range(len(kinds) - 1, -1, -1):
            mark = self.back(states[i], kinds[i], mark)
            marks.append(mark)
        marks.reverse()
        out, now = [], 1 << START
        for i in range(len(kinds) + 1):
            letters = ""
            while True:
                to: dict[str, int] = {}
                if i < len(kinds):
                    for q, letter, r in self.step(states[i], kinds[i])[2]:
                        if now >> q & 1 and marks[i + 1] >> r & 1:
                            to[letter] = to.get(letter, 0) | 1 << r
                elif now & ends:
                    break
                for q, r in self.inserts(states[i]):
                    if now >> q & 1 and marks[i] >> r & 1:
                        to["I"] = to.get("I", 0) | 1 << r
                letter = min(to)
                now = to[letter]
                letters += letter
                if letter != "I":
                    letters += "D" * (copies[i] - 1)
                    break
            out.append(letters)
        return cost + least, out


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv, turn, role, text, copies) with faults put in by a checksum of conversation and turn; nulls count as one blank, in the checksum too.

    One in twenty each: dropped (copies 0), emptied, without ``.!?``, repeated (copies 2), with the role user.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(name(conv), F.lit(":"), name(turn)).cast("binary")) % 20
    body = F.when(k == 1, "").when(k == 2, F.translate(name(text), ".!?", "")).otherwise(name(text))
    return rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.when(k == 4, "user").otherwise(name(role)).alias("role"), body.alias("text"), F.when(k == 0, 0).when(k == 3, 2).otherwise(1).cast("bigint").alias("copies"))


def turns(rows: DataFrame) -> DataFrame:
    """Distinct turns (conv, turn, role, text, copies, kind) with their fault; a conversation without turns has one row with no copies.

    Repeated rows become one with a count before anything is moved by conversation. A turn is a duplicate if its conversation has its role and
    text at an earlier turn; further copies of one turn are known by the count.
    """
    gone = F.col("copies") == 0
    runs = rows.select("conv", F.when(gone, None).otherwise(F.col("turn")).alias("turn"), F.when(gone, "").otherwise(F.col("role")).alias("role"), F.when(gone, "").otherwise(F.col("text")).alias("text"), "copies")
    runs = runs.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    ending = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    runs = runs.withColumns({"ending": ending, "no_conv": F.col("conv").isNull(), "own": F.coalesce("conv", F.lit(0)), "place": F.struct(F.col("turn").isNotNull().alias("given"), "turn")})
    same = ["no_conv", "own", "role", "text"]
    first = rows.where(~gone).select(F.col("conv").isNull().alias("no_conv"), F.coalesce("conv", F.lit(0)).alias("own"), "role", "text", F.struct(F.col("turn").isNotNull().alias("given"), "turn").alias("place"))
    first = first.groupBy(*same).agg(F.min("place").alias("first"))
    runs = runs.join(first, same, "left")
    fault = F.when(F.col("ending") == "", 2).when(F.col("place") > F.col("first"), 3).when(~F.col("ending").isin(".", "!", "?"), 1).otherwise(0)
    initial = F.substring("role", 1, 1)
    letter = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return runs.select("conv", "turn", "role", "text", "copies", (letter * 4 + fault).cast("int").alias("kind"))


class Conversation:
    """What is known of one conversation while its turns stream by, twice: first without their texts, then with them."""

    def __init__(self, conv) -> None:
        self.conv = conv
        self.kinds, self.copies = array("B"), array("q")
        self.faults = [0, 0, 0, 0]
        self.low = self.high = self.last = None
        self.distinct = self.illegal = 0
        self.before = ""
        self.letters: list[str] | None = None
        self.cost, self.at, self.made, self.expects = 0, 0, 0, "u"
        self.digest, self.empty = hashlib.sha256(), True

    def count(self, turn, kind: int, copies: int) -> None:
        if not copies:
            return
        self.kinds.append(kind)
        self.copies.append(copies)
        self.faults[kind & 3] += 1
        self.faults[2 if kind & 3 == 2 else 3] += copies - 1
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.distinct += self.high is None or turn != self.high
            self.high = turn
        initial = "suax"[kind >> 2]
        self.illegal += bool(self.before) and self.before + initial not in ("su", "ua", "au")
        self.illegal += (copies - 1) * (initial + initial not in ("su", "ua", "au"))
        self.before = initial

    def decide(self, automaton: Automaton) -> None:
        self.cost, self.letters = automaton.edits(self.kinds, self.copies)

    def repaired(self, role: str, text: str, last: bool = False) -> Iterator[tuple[str, str, str]]:
        """The repaired turns (edit, role, text) up to and with this one, or those inserted after the last."""
        for letter in self.letters[self.at]:
            if letter == "D":
                continue
            if letter == "K":
                out = (letter, role, text)
            else:
                out = (letter, "user" if self.expects == "u" else "assistant", "" if letter == "I" else text)
            self.expects = "a" if out[1][:1] == "u" else "u"
            self.made += 1
            yield out
        self.at += 1

    def add(self, role: str, text: str) -> None:
        self.digest.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
        self.empty = False

    def summary(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (self.conv, gaps, self.faults[2], self.faults[3], self.faults[1], self.illegal, self.cost, "".join(self.letters), self.digest.hexdigest())


def _stream(runs: DataFrame, schema: str, done: Callable[[Conversation, bool], Iterator[tuple]]) -> DataFrame:
    """Every conversation's turns twice in a row, first without texts; ``done`` gives rows out of repaired turns and at the end."""
    key = [F.col("conv").isNull().alias("no_conv"), "conv"]
    step = lambda i, text: F.struct(F.lit(i).alias("step"), text.alias("text"))
    both = F.explode(F.array(step(0, F.lit(None).cast("string")), step(1, F.col("text"))))
    twice = runs.select("conv", "turn", "role", F.md5(F.col("text").cast("binary")).alias("order"), "kind", "copies", both.alias("t"))
    twice = twice.select(*key, "t.step", "turn", "role", "order", "kind", "copies", "t.text")
    sorted_rows = twice.repartition("no_conv", "conv").sortWithinPartitions("no_conv", "conv", "step", F.col("turn").asc_nulls_first(), "role", "order")
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, now, out = Automaton(), None, []
        for batch in batches:
            none, conv, step, turn, role, kind, copies, text = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("no_conv", "conv", "step", "turn", "role", "kind", "copies", "text"))
            for i in range(len(step)):
                if now is None or (none[i], conv[i]) != (now.conv is None, now.conv):
                    if now is not None:
                        out.extend(done(now, None))
                    now = Conversation(conv[i])
                if step[i] == 0:
                    now.count(turn[i], kind[i], copies[i])
                    continue
                if now.letters is None:
                    now.decide(automaton)
                if copies[i]:
                    out.extend(done(now, (role[i], text[i])))
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, row)) for row in out], arrow)
                out = []
        if now is not None:
            out.extend(done(now, None))
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, row)) for row in out], arrow)

    with small_batches(runs.sparkSession):
        return sorted_rows.mapInArrow(run, schema)


def repair(rows: DataFrame) -> DataFrame:
    """The repaired conversations: rows (conv, at, edit, role, text), at from 1. Rows in: conv, turn, role, text, copies (as of ``damage``).

    Edits are K (kept), R (another role) and I (put in, without text). Cheapest edits; among these the ASCII-least letters, deletions among them.
    """
    kind = dict(rows.dtypes)["conv"]

    def done(c: Conversation, turn) -> Iterator[tuple]:
        for edit, role, text in c.repaired(*(turn or ("", ""))):
            yield c.conv, c.made, edit, role, text

    return _stream(turns(rows), f"conv {kind}, at bigint, edit string, role string, text string", done)


def audit(rows: DataFrame) -> DataFrame:
    """One row a conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Rows in: conv, turn, role, text, copies.

    Turns are taken in order of ``turn``, nulls first, then of role and the text's MD5; copies of one row follow each other. A turn has one fault at most:
    blank, else duplicate (its role and text came before), else truncated. gaps are turn numbers that are left out, illegal are
    neighbours other than su, ua and au, cost is that of the cheapest repair, audit its letters (D, I, K, R), the
    ASCII-least of the cheapest; repaired_sha256 is of its turns ``role:text``, joined by line breaks. A conversation without turns left has zeros, an
    empty audit and the hash of nothing. Rows with a null conv are one conversation; an empty table gives no rows.

    Equal rows are counted before they move, and the first place of a role and text comes from an aggregation and a join that AQE may split. A conversation then
    streams through one task, since its hash is over all its turns in order: first its kinds of turns, of which a few
    bytes each are kept, then its texts, of which none are.
    """
    kind = dict(rows.dtypes)["conv"]

    def done(c: Conversation, turn) -> Iterator[tuple]:
        for _, role, text in c.repaired(*(turn or ("", ""))):
            c.add(role, text)
        if turn is None:
            yield c.summary()

    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return _stream(turns(rows), f"conv {kind}, " + ", ".join(f"{c} bigint" for c in counts) + ", audit string, repaired_sha256 string", done)


def audit_damaged(rows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """``audit`` of conversations after ``damage``."""
    return audit(damage(rows, conv)).withColumnRenamed("conv", conv)
