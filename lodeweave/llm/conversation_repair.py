"""The cheapest repair of a conversation's order of roles.

The wanted order of role initials is ``(s?(ua)+)?``. Rows are read in order, and for each of the four states that the roles
so far can be in (nothing, after s, after u, after a) the cheapest edits that lead to it survive, of equal costs those whose
initials come first in ASCII order. Survivors are leaves of a tree of edits with a count of references; a branch that no
survivor has is freed, and what all survivors have in common is put out at once, with the rows it is about. So a task holds
the part of a conversation that is not decided yet, however long the conversation is, and ties compare all of that part.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lodeweave.llm.text import slices

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: White space of the checks for blank and truncated texts.
SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_LEGAL = {"su", "ua", "au"}


class Edit:
    """A node of the tree: an edit and the one before it. ``ends`` counts the survivors that end here."""

    __slots__ = ("before", "depth", "ends", "initial", "later")

    def __init__(self, before: Edit | None, initial: str) -> None:
        self.before, self.initial, self.ends = before, initial, 0
        self.depth = before.depth + 1 if before else 0
        self.later: list[Edit] = []
        if before:
            before.later.append(self)


def _following(state: int) -> int:
    """The state after a user's or assistant's row that fits."""
    return ASSISTANT if state == USER else USER


def _fits(state: int, initial: str) -> int | None:
    """The state after a kept row of this initial; none where it doesn't fit."""
    if initial == "s":
        return SYSTEM if state == EMPTY else None
    if initial == ("a" if state == USER else "u"):
        return _following(state)
    return None


def _less(a: tuple[Edit, str], b: tuple[Edit, str]) -> bool:
    """Whether the edits up to ``a`` come before those up to ``b``, by all that is undecided of both."""
    x, y = [a[1]], [b[1]]
    a, b = a[0], b[0]
    while a is not b:
        if a.depth >= b.depth:
            x.append(a.initial)
            a = a.before
        else:
            y.append(b.initial)
            b = b.before
    return x[::-1] < y[::-1]


class Repair:
    """One conversation: ``add`` its rows in order, then ``finish``."""

    def __init__(self) -> None:
        self.root = Edit(None, "")
        self.root.ends = 1
        self.alive = {EMPTY: (0, self.root)}
        self.rows: deque[tuple[str, str]] = deque()
        self.audit: list[str] = []
        self.state, self.digest, self.some = EMPTY, hashlib.sha256(), False
        self.most = 0

    def add(self, role: str, text: str, damaged: bool, truncated: bool) -> None:
        """``damaged`` rows must go; ``truncated`` ones cost more where they stay."""
        self._insert()
        self.rows.append((role, text))
        self.most = max(self.most, len(self.rows))
        found: dict[int, tuple[int, Edit, str]] = {}
        more = TRUNCATED * truncated
        for state, (cost, edit) in self.alive.items():
            self._offer(found, state, cost + DELETE, edit, "D")
            if not damaged:
                kept = _fits(state, role[:1])
                if kept is not None:
                    self._offer(found, kept, cost + more, edit, "K")
                self._offer(found, _following(state), cost + REROLE + more, edit, "R")
        self._forget(found)
        self._survive({state: (cost, Edit(edit, initial)) for state, (cost, edit, initial) in found.items()})
        self._put_out()

    @staticmethod
    def _forget(found: dict[int, tuple[int, Edit, str]]) -> None:
        """Drop what can't win any more: else the survivor that deletes all rows would keep everything undecided.

        Whatever follows no roles or a system's can follow an assistant's as well, at the cost of one deletion more where a
        system's row is kept first; and an assistant's costs one insertion after a user's. Equal costs stay.
        """
        bound = min(found[ASSISTANT][0] if ASSISTANT in found else 1 << 62, found[USER][0] + INSERT if USER in found else 1 << 62)
        for state, more in ((EMPTY, DELETE), (SYSTEM, 0)):
            if state in found and found[state][0] > bound + more:
                del found[state]

    def finish(self) -> int:
        """Decide the rest; the cost of all edits."""
        self._insert()
        best: dict[int, tuple[int, Edit, str]] = {}
        for state in (EMPTY, ASSISTANT):
            if state in self.alive:
                self._offer(best, 0, *self.alive[state], "")
        cost, edit, _ = best[0]
        self._survive({EMPTY: (cost, edit)})
        self._put_out()
        return cost

    @staticmethod
    def _offer(found: dict, state: int, cost: int, edit: Edit, initial: str) -> None:
        now = found.get(state)
        if now is None or cost < now[0] or (cost == now[0] and _less((edit, initial), now[1:])):
            found[state] = (cost, edit, initial)

    def _insert(self) -> None:
        """Survivors that end with inserted rows; after two the roles are back where they were."""
        for _ in range(2):
            found: dict[int, tuple[int, Edit, str]] = {}
            for state, (cost, edit) in self.alive.items():
                self._offer(found, _following(state), cost + INSERT, edit, "I")
            alive = dict(self.alive)
            for state, (cost, edit, initial) in found.items():
                now = alive.get(state)
                if now is None or cost < now[0] or (cost == now[0] and _less((edit, initial), (now[1].before, now[1].initial))):
                    alive[state] = (cost, Edit(edit, initial))
            self._survive(alive)

    def _survive(self, alive: dict[int, tuple[int, Edit]]) -> None:
        for _, edit in alive.values():
            edit.ends += 1
        before, self.alive = self.alive, alive
        for _, edit in before.values():
            edit.ends -= 1
            while not edit.ends and not edit.later and edit.before:
                edit.before.later.remove(edit)
                edit = edit.before

    def _put_out(self) -> None:
        while not self.root.ends and len(self.root.later) == 1:
            self.root = self.root.later[0]
            self.root.before = None
            self._apply(self.root.initial)

    def _apply(self, initial: str) -> None:
        self.audit.append(initial)
        role, text = ("", "") if initial == "I" else self.rows.popleft()
        if initial == "D":
            return
        self.state = _fits(self.state, role[:1]) if initial == "K" else _following(self.state)
        if initial != "K":
            role = "assistant" if self.state == ASSISTANT else "user"
        self.digest.update(f"{chr(10) if self.some else ''}{role}:{text}".encode())
        self.some = True


class _Conversation:
    """What is reported of a conversation while its rows pass."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.repair = conv_id, Repair()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.initial = None

    def add(self, turn, role: str, text: str, repeated: bool) -> None:
        if turn is not None:
            self.turns += turn != self.last
            self.first = turn if self.first is None else self.first
            self.last = turn
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in _LEGAL
        self.initial = role[:1]
        end = text.rstrip(SPACE)[-1:]
        blank, truncated = not end, end not in ".!?"
        self.blank += blank
        self.duplicate += repeated and not blank
        self.truncated += truncated and not blank and not repeated
        self.repair.add(role, text, blank or repeated, truncated and not blank and not repeated)

    def result(self) -> tuple:
        cost = self.repair.finish()
        gaps = 0 if self.last is None else self.last - self.first + 1 - self.turns
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.repair.audit), self.repair.digest.hexdigest()


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copy, gone`` of ``conv_id, turn, role, text``: rows damaged by a hash of their place, null values as one space.

    By crc32 of ``conv_id:turn`` modulo 20: 0 drops the row (it stays as one that is ``gone``), 1 empties its text, 2 takes
    its ends of sentences, 3 repeats it, 4 makes it a user's.
    """
    blank = F.lit(" ")
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(place.cast("binary")) % 20
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    out = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), kind.alias("kind"))
    gone = F.col("kind") == 0
    out = out.select(
        "conv_id", "turn", F.when(gone, "").when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(gone | (F.col("kind") == 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"), gone.alias("gone"),
    )
    return out


def repaired(rows: DataFrame) -> DataFrame:
    """Faults and the cheapest repair of each conversation of ``conv_id, turn, role, text`` (and ``gone``: only its conversation counts).

    Result: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``. Rows are taken by turn, nulls first,
    equal turns by role and text; null roles and texts are one space, rows without id are one conversation. A row that says what an earlier
    one says is found by a window over role and text inside the same partition, so rows are shuffled once. Conversations are
    read as a stream by sorted rows; no task holds a whole one.
    """
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    copy = F.col("copy") if "copy" in rows.columns else F.lit(0)
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), copy.alias("copy"), gone.alias("gone"))
    own = own.repartition("conv_id")
    same = Window.partitionBy("conv_id", "role", "text", "gone").orderBy(F.col("turn").asc_nulls_first(), "copy")
    own = own.withColumn("repeated", F.row_number().over(same) > 1).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in slices(batches, 2000):
            for conv_id, turn, role, text, is_gone, repeated in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone", "repeated")], strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.result())
                    now = _Conversation(conv_id)
                if not is_gone:
                    now.add(turn, role, text, repeated)
            if len(done) >= 1000:
                yield _batch(done)
                done = []
        if now is not None:
            done.append(now.result())
        yield _batch(done)

    return own.select("conv_id", "turn", "role", "text", "gone", "repeated").mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repair of all conversations after they have been damaged."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repaired(damaged(rows.select("conv_id", "turn", "role", "text")))
