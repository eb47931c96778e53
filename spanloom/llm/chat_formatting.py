"""Chat formatting: conversations as marked text with a loss mask, their turn order checked by a finite-state machine.

A template declares, for each role, what stands before and after a turn's text and whether the text counts in the
loss, and the machine: which role may follow in which state, and where a conversation may end. A turn becomes three
segments: mark, text, mark, each with its loss flag. Control strings inside texts get a backslash after their first
character, backslashes are doubled; so a mark in the output is always a turn's own, and reading back is exact.

Rows are sorted by ranges of (conversation, turn), so a conversation that holds a third of all rows is dealt over
many tasks. A task walks its rows once and writes blocks: text, loss spans, and the machine's step as a function from
every state it may be entered in. Functions compose in order, so no block waits for those before it. Conversations
that lie in one block are finished where they are; blocks of the others alone are shuffled. The digest of one
conversation is by its definition one pass over its bytes: such a conversation streams through one task, block by
block, and is never held as a whole.

Defined cases: a null text or role is empty; roles the template does not know are named in the output and
break the order, as a repeated or misplaced role does; everything is formatted, valid or not; rows of one turn follow
each other by role and text, null turns come first, rows that repeat count each; rows without a conversation id form
one conversation; a very long text is a block of its own; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import common as C
from spanloom.scratch import Scratch

#: Code points of a block.
BLOCK = 1 << 20
#: Code points of a text that deal rows of one turn and role to several ranges.
HEAD = 16


@dataclass(frozen=True)
class Mark:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """roles: marks by role; other, name_end: marks of any other role, whose name stands before name_end.
    order: state -> role -> state; start: the first state; ends: states a conversation may end in."""

    roles: dict[str, Mark]
    other: Mark
    name_end: str
    order: dict[str, dict[str, str]]
    start: str
    ends: frozenset[str]
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        marks = [*self.roles.values(), self.other]
        closers = [*(m.after for m in marks), self.name_end]
        controls = sorted({s for m in marks for s in (m.before.strip(), m.after.strip()) if s} | {self.name_end.strip()})
        if not all(c.strip() for c in closers) or not self.other.before.strip() or sum(not m.before for m in marks) > 1:
            raise ValueError("every turn needs a mark after it, and all roles but one a mark before it")
        if any(len(c) < 2 or "\\" in c for c in controls) or any(a != b and b.startswith(a) for a in controls for b in controls):
            raise ValueError("marks have two characters or more, no backslash, and none begins another")
        if any(c[:k] == c[-k:] for c in closers for k in range(1, len(c))):
            raise ValueError("a mark that ends as it begins could be found too early")
        object.__setattr__(self, "controls", tuple(controls))

    @property
    def states(self) -> list[str]:
        """All states; the last one is where a broken order stays."""
        return [*self.order, ""]

    def steps(self) -> dict[str, list[int]]:
        """For each role the state that follows each state."""
        at = {s: i for i, s in enumerate(self.states)}
        return {r: [at[self.order.get(s, {}).get(r, "")] for s in self.states] for r in {r for step in self.order.values() for r in step}}

    def escaping(self) -> re.Pattern:
        return re.compile("|".join([re.escape("\\"), *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.controls)]))

    def segments(self, role: str, text: str, escape=None) -> list[tuple[str, bool]]:
        """The segments of a turn and whether each counts in the loss."""
        safe = lambda s: (escape or self.escaping()).sub(lambda m: m[0] + "\\", s)
        mark = self.roles.get(role)
        if mark:
            return [(mark.before, False), (safe(text), mark.loss), (mark.after, False)]
        return [(self.other.before + safe(role) + self.name_end, False), (safe(text), self.other.loss), (self.other.after, False)]

    def parse(self, text: str) -> Iterator[tuple[str, str]]:
        """Role and text of every turn of a formatted text."""
        known, at = sorted(self.roles.items(), key=lambda r: -len(r[1].before)), 0
        while at < len(text):
            if text.startswith(self.other.before, at):
                at += len(self.other.before)
                end = text.index(self.name_end, at)
                role, mark, at = plain(text[at:end]), self.other, end + len(self.name_end)
            else:
                role, mark = next((r, m) for r, m in known if text.startswith(m.before, at))
                at += len(mark.before)
            end = text.index(mark.after, at)
            yield role, plain(text[at:end])
            at = end + len(mark.after)


_ESCAPED = re.compile(r"\\(\\?)")


def plain(text: str) -> str:
    """The text without escapes."""
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


#: The query's template.
CHAT = Template(
    roles={"system": Mark("<<SYS>>\n", "\n<</SYS>>"), "user": Mark("[INST] ", " [/INST]"), "assistant": Mark("", "</s>\n", loss=True)},
    other=Mark("[ROLE]", "</s>\n"),
    name_end="[/ROLE]",
    order={"start": {"system": "told", "user": "asked"}, "told": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}},
    start="start",
    ends=frozenset({"answered"}),
)

SCHEMA = "conv_id long, part int, piece int, whole boolean, text string, loss array<struct<start:long,stop:long>>, n_turns long, moves array<int>, broken array<long>"
_ARROW = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("piece", pa.int32()), ("whole", pa.bool_()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("n_turns", pa.int64()), ("moves", pa.list_(pa.int32())), ("broken", pa.list_(pa.int64()))])


class Block:
    """Turns of one conversation, formatted, and what they do to the machine from each of its states."""

    def __init__(self, conv_id: int | None, states: int, first: bool) -> None:
        self.conv_id, self.first, self.parts, self.loss, self.size, self.turns = conv_id, first, [], [], 0, 0
        self.moves, self.broken = list(range(states)), [-1] * states

    def add(self, segments: list[tuple[str, bool]], step: list[int] | None) -> None:
        for text, loss in segments:
            if loss:
                self.loss.append({"start": self.size, "stop": self.size + len(text)})
            self.parts.append(text)
            self.size += len(text)
        lost = len(self.moves) - 1
        for s, now in enumerate(self.moves):
            self.moves[s] = step[now] if step else lost
            if self.moves[s] == lost and now != lost:
                self.broken[s] = self.turns
        self.turns += 1


def blocks(turns: DataFrame, template: Template = CHAT) -> DataFrame:
    """The formatted conversations of (conv_id, turn, role, text): blocks in order of (part, piece), with spans of the loss.

    whole: the block is all of its conversation. moves, broken: for each state of the template, the state after the
    block when entered in it, and the first turn of the block that breaks the order then (-1: none).
    """

    def run(batches):
        from pyspark import TaskContext

        part, steps, escape, states = TaskContext.get().partitionId(), template.steps(), template.escaping(), len(template.states)
        done, n, held = [], 0, 0

        def row(block: Block, last: bool, edge: bool):
            nonlocal n, held
            done.append((block.conv_id, part, n, block.first and last and not edge, "".join(block.parts), block.loss, block.turns, block.moves, block.broken))
            n, held = n + 1, held + block.size

        def out():
            nonlocal held
            yield C.batch(_ARROW, *zip(*done))
            done.clear()
            held = 0

        now: Block | None = None
        opening = True  # the first conversation of a task may have begun in the task before
        for b in batches:
            for conv_id, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if now is not None and now.conv_id != conv_id:
                    row(now, True, opening)
                    now, opening = None, False
                elif now is not None and now.size >= BLOCK:
                    row(now, False, opening)
                    now = Block(conv_id, states, False)
                if held >= BLOCK:
                    yield from out()
                now = now or Block(conv_id, states, True)
                now.add(template.segments(role, text, escape), steps.get(role))
        if now is not None:
            row(now, True, True)  # it may go on in the next task
        if done:
            yield from out()

    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    dealt = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, HEAD)).sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, SCHEMA)


class _Reader:
    """Digests of one conversation, block by block."""

    def __init__(self, conv_id: int | None, template: Template) -> None:
        self.conv_id, self.states, self.ends = conv_id, template.states, template.ends
        self.turns, self.loss, self.n, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        self.state, self.broken = self.states.index(template.start), None

    def read(self, template: Template, text: str, loss: list[dict], moves: list[int], broken: list[int]) -> None:
        before = self.n
        for role, said in template.parse(text):
            self.turns.update(f"{role}\n{said}\n".encode())
            self.n += 1
        for span in loss:
            said = plain(text[span["start"] : span["stop"]])
            self.loss.update(said.encode())
            self.loss_chars += len(said)
        self.chars += len(text)
        if broken[self.state] >= 0:
            self.broken = before + broken[self.state]
        self.state = moves[self.state]

    def row(self) -> tuple:
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.states[self.state] in self.ends, self.broken


_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_()), ("broken_at", pa.int64())])


def read_back(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """Digests of what the written blocks say: turns, text under the loss mask, whether the order holds, else the first turn that breaks it (none where only the end is missing)."""

    def run(batches):
        now: _Reader | None = None
        for b in batches:
            done = []
            for i in range(b.num_rows):
                conv_id, text, loss, moves, broken = (b.column(c)[i].as_py() for c in ("conv_id", "text", "loss", "moves", "broken"))
                if now is None or now.conv_id != conv_id:
                    done += [now.row()] if now else []
                    now = _Reader(conv_id, template)
                now.read(template, text, loss, moves, broken)
            if done:
                yield C.batch(_READ, *zip(*done))
        if now is not None:
            yield C.batch(_READ, *zip(*[now.row()]))

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, broken_at long"
    rows = formatted.select("conv_id", "part", "piece", "whole", "text", "loss", "moves", "broken")
    cut = rows.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return rows.where("whole").mapInArrow(run, schema).unionByName(cut.mapInArrow(run, schema))


def op13(spark, sf_dir: str) -> DataFrame:
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    turns = C.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(Scratch(spark, "chat_formatting").save(blocks(turns), "formatted"))


def _oracle(template: Template = CHAT) -> str:
    text = lambda s: "'" + s.replace("'", "''") + "'"
    added = lambda c: " + ".join(f"(length({c}) - length(replace({c}, {text(s)}, ''))) // {len(s)}" for s in ("\\", *template.controls))
    marks = " ".join(f"WHEN {text(r)} THEN {len(m.before + m.after)}" for r, m in template.roles.items())
    after = {to: r for step in template.order.values() for r, to in step.items()}  # here a state is known by the role before it
    allowed = " OR ".join(f"(role = {text(r)} AND {'before IS NULL' if s == template.start else 'before = ' + text(after[s])})" for s, step in template.order.items() for r in step)
    loss = ", ".join(text(r) for r, m in template.roles.items() if m.loss)
    return rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
ordered AS (
  SELECT *, row_number() OVER w - 1 AS i, lag(role) OVER w AS before, lead(role) OVER w IS NULL AS ends FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
sized AS (
  SELECT *, length(text) + {added('text')} + CASE role {marks} ELSE {len(template.other.before + template.name_end + template.other.after)} + length(role) + {added('role')} END AS chars,
    coalesce({allowed}, false) AS fits
  FROM ordered)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role IN ({loss})), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role IN ({loss})), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  bool_and(fits) AND bool_or(ends AND role IN ({", ".join(text(after[s]) for s in sorted(template.ends))})) AS valid,
  CAST(min(i) FILTER (WHERE NOT fits) AS BIGINT) AS broken_at
FROM sized GROUP BY conv_id"""


ORACLE = _oracle()
