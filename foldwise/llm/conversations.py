"""Operator 13: conversation structure repair by a survivor-coalescence Viterbi search.

A repaired conversation's role initials read ``(s?(ua)+)?``.  Rows are kept (0), given the role user or
assistant (1), deleted (2; blank and duplicate rows must be) or preceded by an inserted empty turn (5);
a truncated row that stays adds 5.  The cheapest edits win, ties go to the least string of edit
initials (D, I, K, R in ASCII order).

Rows are sorted by conversation and turn inside Spark's partitions and streamed through the search.
It keeps one survivor per state of the pattern (nothing, after s, after u, after a), each a leaf of
a tree of backpointers with reference counts.  A survivor is dropped once another one can imitate
whatever it still may do for strictly less.  Branches without a survivor are freed at once, and when all survivors
share an ancestor the edits up to it are final: they are emitted and their rows forgotten.  So memory
holds the unresolved rows only, whatever a conversation's length.  Survivors of one state and cost are
compared by their complete unresolved edits, back to where their branches part.  (Two such strings
are never a prefix of one another: with the same rows read, the longer one holds more insertions.)

Which rows are duplicates is a window over (conversation, hash of role and text), so no task
remembers all texts of a conversation.  A conversation is one stream: its repaired text is one
SHA-256, which has no parallel form; the stream is sorted by Spark (spilling) and never held.

Edge cases: a null text or role counts as one space, so such a text is blank; a null conversation id
is a conversation; null turns come first and are left out of the gaps; rows of one turn are ordered
by role, then text; a conversation without rows gives zeros; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.llm.common import partitions, small_batches

KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
SPACE = " \t\n\x0b\x0c\r"
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = {(NOTHING, "s"): AFTER_S, (NOTHING, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A,
        (AFTER_A, "u"): AFTER_U}
ENDS = (NOTHING, AFTER_A)
NAMES = {"u": "user", "a": "assistant"}
# what the row's state pays at most, beyond the column's state, for doing as that one does from here on
IMITATE = {NOTHING: (0, 0, INSERT, 0), AFTER_S: (2 * INSERT + DELETE, 0, INSERT, 2 * INSERT),
           AFTER_U: (INSERT + DELETE, INSERT, 0, INSERT), AFTER_A: (DELETE, 0, INSERT, 0)}


@dataclass(frozen=True)
class Turn:
    """A row as the search sees it; ``fault`` is '', blank, duplicate or truncated."""
    turn: int | None
    role: str
    text: str
    fault: str


@dataclass(eq=False, slots=True)
class Edit:
    """A node of the backpointer tree: one edit.  ``survivors`` and ``children`` are its references."""
    parent: Edit | None
    letter: str = ""
    role: str | None = None           # of the turn that stays or comes in; None if the row is deleted
    row: Turn | None = None
    depth: int = 0
    survivors: int = 0
    children: list = field(default_factory=list)


def _before(a: Edit, b: Edit) -> bool:
    """Whether a's edits since their branches parted sort before b's."""
    left, right = [], []
    while a is not b:
        if a.depth >= b.depth:
            left.append(a.letter)
            a = a.parent
        else:
            right.append(b.letter)
            b = b.parent
    return left[::-1] < right[::-1]


class Repair:
    """Search over one conversation: ``push`` its rows in order, then ``finish``.

    ``emit(edit)`` gets every edit as soon as it is final; ``finish`` returns the cost."""

    def __init__(self, emit: Callable[[Edit], None]):
        self.emit, self.root = emit, Edit(None)
        self.best: dict[int, tuple[int, Edit]] = {}
        self._survive(self._inserted({NOTHING: (0, self.root)}))

    @staticmethod
    def _offer(into: dict, state: int, cost: int, edit: Edit) -> bool:
        now = into.get(state)
        if now and (now[0] < cost or now[0] == cost and not _before(edit, now[1])):
            return False
        into[state] = cost, edit
        return True

    def _inserted(self, states: dict) -> dict:
        """With turns inserted wherever that reaches a state for less, or for as much with lesser edits."""
        todo = list(states)
        while todo:
            state = todo.pop()
            cost, edit = states[state]
            for initial in "ua":
                after = NEXT.get((state, initial))
                if after is not None and self._offer(
                        states, after, cost + INSERT, Edit(edit, "I", NAMES[initial], None, edit.depth + 1)):
                    todo.append(after)
        return states

    def push(self, row: Turn) -> None:
        states: dict[int, tuple[int, Edit]] = {}
        cut = CUT if row.fault == "truncated" else 0
        for state, (cost, edit) in self.best.items():
            deep = edit.depth + 1
            self._offer(states, state, cost + DELETE, Edit(edit, "D", None, row, deep))
            if row.fault in ("blank", "duplicate"):
                continue
            after = NEXT.get((state, row.role[:1]))
            if after is not None:
                self._offer(states, after, cost + KEEP + cut, Edit(edit, "K", row.role, row, deep))
            for initial, name in NAMES.items():
                after = NEXT.get((state, initial))
                if after is not None:
                    self._offer(states, after, cost + REROLE + cut, Edit(edit, "R", name, row, deep))
        self._survive(self._inserted(states))

    def _survive(self, states: dict) -> None:
        """Take over the new survivors, free what only the old ones held, emit what is final."""
        old = [edit for _, edit in self.best.values()]
        self.best = {s: (c, e) for s, (c, e) in states.items()
                     if all(c <= d + IMITATE[t][s] for t, (d, _) in states.items())}
        for _, edit in self.best.values():
            edit.survivors += 1
            while edit.parent is not None and edit not in edit.parent.children:
                edit.parent.children.append(edit)
                edit = edit.parent
        for edit in old:
            edit.survivors -= 1
            self._free(edit)
        self._settle()

    def _free(self, edit: Edit) -> None:
        while edit is not self.root and not edit.survivors and not edit.children:
            edit.parent.children.remove(edit)
            edit = edit.parent

    def _settle(self) -> None:
        while not self.root.survivors and len(self.root.children) == 1:
            self.root = self.root.children[0]
            self.root.parent = None
            self.emit(self.root)

    def finish(self) -> int:
        ends: dict[int, tuple[int, Edit]] = {}
        for state in ENDS:
            if state in self.best:
                self._offer(ends, 0, *self.best[state])
        cost, last = ends[0]
        self._survive({0: (cost, last)})
        return cost

    def unresolved(self) -> int:
        """Edits held in memory."""
        count, todo = 0, [self.root]
        while todo:
            children = todo.pop().children
            count += len(children)
            todo += children
        return count


# ---- Spark --------------------------------------------------------------------------------------

def damage(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) -> the same with ``alive``, damaged by crc32(conv_id:turn) mod 20:
    0 drops the row (not alive), 1 empties its text, 2 removes ``.!?``, 3 repeats it, 4 sets role user.
    Nulls read as one space."""
    def said(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    case = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(case == 1, "").when(case == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    return rows.select(
        "conv_id", "turn", F.when(case == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"),
        (case != 0).alias("alive"), F.explode(F.when(case == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_"),
    ).drop("_")


def with_faults(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, alive) with ``fault``: blank, duplicate, truncated or empty."""
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    order = Window.partitionBy("conv_id", "alive", same).orderBy(F.col("turn").asc_nulls_first())
    end = F.substring(F.rtrim(F.col("text"), F.lit(SPACE)), -1, 1)
    fault = (F.when(end == "", "blank").when(F.row_number().over(order) > 1, "duplicate")
             .when(end.isin(".", "!", "?"), "").otherwise("truncated"))
    return rows.withColumn("fault", fault)


def _streamed(rows: DataFrame, handler, schema: str) -> DataFrame:
    """Rows of each conversation in order through ``handler(conv_id)``, which has ``push(Turn)`` and ``end()``;
    both yield output rows as tuples."""
    spark = rows.sparkSession
    small_batches(spark)
    rows = rows.select("conv_id", "turn", "role", F.when(F.col("alive"), F.col("text")).alias("text"), "alive", "fault")
    dealt = rows.repartition(partitions(spark), "conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", F.col("fault") == "duplicate")
    names = [part.split()[0] for part in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch], target=None) -> Iterator[pa.RecordBatch]:
        now, live, out, size = None, None, [], 0

        def batch_of(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(col, t) for col, t in zip(zip(*found), types)], names)

        for batch in batches:
            for conv, turn, role, text, alive, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if live is None or conv != now:
                    if live is not None:
                        out += live.end()
                    now, live = conv, handler(conv)
                if alive:
                    out += live.push(Turn(turn, role, text, fault))
                size += len(text or "")
                if len(out) >= 4096 or size >= 4 << 20 and out:
                    yield batch_of(out)
                    out, size = [], 0
        if live is not None:
            out += live.end()
        if out:
            yield batch_of(out)

    from pyspark.sql.pandas.types import to_arrow_schema
    types = list(to_arrow_schema(spark.createDataFrame([], schema).schema).types)
    return dealt.mapInArrow(work, schema)


class _Turns:
    """Rows of the repaired conversation and of the deletions, as they become final."""

    def __init__(self, conv):
        self.conv, self.out, self.at = conv, [], 0
        self.search = Repair(self._emit)

    def _emit(self, edit: Edit) -> None:
        row = edit.row
        place = None
        if edit.role is not None:
            place, self.at = self.at, self.at + 1
        self.out.append((self.conv, place, edit.letter, row and row.turn, edit.role,
                         None if edit.role is None else row.text if row else "", row.fault if row else ""))

    def _taken(self) -> list:
        out, self.out = self.out, []
        return out

    def push(self, row: Turn) -> list:
        self.search.push(row)
        return self._taken()

    def end(self) -> list:
        self.search.finish()
        return self._taken()


class _Report:
    """Counts of a damaged conversation, and cost, edits and digest of its repair."""

    def __init__(self, conv):
        self.conv = conv
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated", ""), 0)
        self.first = self.last = None
        self.distinct = self.illegal = 0
        self.before: str | None = None
        self.audit: list[str] = []
        self.digest, self.joined = hashlib.sha256(), False
        self.search = Repair(self._emit)

    def _emit(self, edit: Edit) -> None:
        self.audit.append(edit.letter)
        if edit.role is not None:
            line = f"{edit.role}:{edit.row.text if edit.row else ''}"
            self.digest.update(("\n" + line if self.joined else line).encode())
            self.joined = True

    def push(self, row: Turn) -> list:
        self.faults[row.fault] += 1
        initial = row.role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        if row.turn is not None and row.turn != self.last:
            self.first = row.turn if self.first is None else self.first
            self.last, self.distinct = row.turn, self.distinct + 1
        self.search.push(row)
        return []

    def end(self) -> list:
        cost = self.search.finish()
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return [(self.conv, gaps, self.faults["blank"], self.faults["duplicate"], self.faults["truncated"], self.illegal,
                 cost, "".join(self.audit), self.digest.hexdigest())]


def _kind(rows: DataFrame, name: str) -> str:
    return rows.schema[name].dataType.simpleString()


def repaired_turns(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) -> (conv_id, place, edit, turn, role, text, fault): every edit in order.
    Deleted rows have no place, role and text; inserted ones no turn."""
    rows = with_faults(rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                                   F.coalesce("text", F.lit(" ")).alias("text"), F.lit(True).alias("alive")))
    return _streamed(rows, _Turns, f"conv_id {_kind(rows, 'conv_id')}, place long, edit string, "
                                   f"turn {_kind(rows, 'turn')}, role string, text string, fault string")


def repair_report(rows: DataFrame) -> DataFrame:
    """Damaged rows (see ``damage``) -> one row per conversation: faults, cost and edits of its repair, digest."""
    rows = with_faults(rows)
    return _streamed(rows, _Report, f"conv_id {_kind(rows, 'conv_id')}, gaps long, blank long, duplicate long, "
                                    "truncated long, illegal long, cost long, audit string, repaired_sha256 string")
