"""Conversation repair by a dynamic program with square-root checkpoints.

A repaired conversation has roles whose initials match ``(s?(ua)+)?``. Four states stand
for what has been kept so far: nothing, an opening ``s``, a ``u``, a ``ua``. The cost of
repairing the rest of a conversation from each state follows row by row from the end, and
the cheapest edits are then read off walking forward. Neither the rows nor the costs of a
conversation are ever held as a whole:

1. Rows become entries: equal rows of one turn are one entry with a count, texts are
   digests. Entries learn from an aggregation whether their text was said before.
2. Backward, one task streams the entries of a conversation from the last to the first
   and stores the four costs only at checkpoints, which lie 1, 4, 9, 16, ... entries from
   the end: for n entries about sqrt(n) checkpoints with stretches of about 2 sqrt(n).
3. Forward, checkpoints, entries and texts of a conversation arrive in one sorted stream.
   A stretch is held, its costs are worked out again from the checkpoint at its end, and
   its edits are emitted; the hash of the result takes up the texts as they pass.

A conversation may hold a third of all rows: every step streams over sorted partitions,
and a task holds one stretch. The hash of a conversation is one chain over its text, so
its rows do pass through one task, one after the other.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import inf, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effectspark.llm.tables import text_or_empty
from effectspark.sources.store import Workspace

# Costs of the edits, the kinds of damage and how many rows in MODULUS suffer each.
RELABEL, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
MODULUS, DROP, EMPTY, STRIP, REPEAT, TO_USER = 20, 0, 1, 2, 3, 4

# States, and what may follow each: the states that the initials lead to.
NOTHING, OPENED, ASKED, ANSWERED = range(4)
ON = {NOTHING: {"u": ASKED, "s": OPENED}, OPENED: {"u": ASKED}, ASKED: {"a": ANSWERED}, ANSWERED: {"u": ASKED}}
NEXT = {NOTHING: ASKED, OPENED: ASKED, ASKED: ANSWERED, ANSWERED: ASKED}  # by user or assistant, whichever fits
ROLE = {ASKED: "user", ANSWERED: "assistant"}  # what leads to these states
ENDS = (NOTHING, ANSWERED)
STATES = range(4)

SOUND, BLANK, DUPLICATE, CUT_OFF = range(4)  # faults of an entry
_ORDER = ("turn", "role", "digest")
_CHECKPOINT, _ENTRY, _TEXT = 1, 2, 3

Costs = tuple[float, ...]


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) as the numbered kinds of damage leave them; a NULL is one space."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))
    text = spaced("text")
    kind = F.col("__kind")
    return (
        rows.select("conv_id", "turn", spaced("role").alias("role"), text.alias("text"), F.crc32(key.cast("binary")).alias("__crc"))
        .withColumn("__kind", F.pmod("__crc", F.lit(MODULUS)))
        .filter(kind != DROP)
        .withColumns(
            {
                "role": F.when(kind == TO_USER, "user").otherwise(F.col("role")),
                "text": F.when(kind == EMPTY, "").when(kind == STRIP, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
                "__times": F.explode(F.when(kind == REPEAT, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
            }
        )
        .select("conv_id", "turn", "role", "text")
    )


def repair(rows: DataFrame, ws: Workspace, names: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row per conversation.

    ``rows`` has conv_id, turn, role and text; ``names`` more conv_ids, which may have no
    rows and then give zeros, an empty audit and the hash of nothing. Rows are taken by
    turn, NULLs first; rows of one turn by role and then by the SHA-256 of their text, and
    equal rows stay together. NULL conv_ids are one conversation, NULL roles and texts are
    empty. A role other than system, user and assistant counts by its first letter like
    any. Other columns are ignored; an empty table gives the conversations of ``names``.
    """
    plain = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), text_or_empty("role").alias("role"), text_or_empty().alias("text"))
    entries = ws.save(_entries(plain), "entries").df
    kind = rows.schema["conv_id"].dataType.simpleString()
    marks = ws.save(
        entries.select("conv_id", *_ORDER, "fault", "times", F.substring("role", 1, 1).alias("initial"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", *[F.col(c).desc() for c in _ORDER])
        .mapInArrow(_backward, f"conv_id {kind}, number bigint, costs array<double>"),
        "checkpoints",
    ).df
    digest = F.unhex(F.sha2("text", 256))
    stream = _stream(marks, kind=F.lit(_CHECKPOINT), number="number", costs="costs")
    stream = stream.unionByName(_stream(entries, *_ORDER, kind=F.lit(_ENTRY), fault="fault", times="times"))
    stream = stream.unionByName(_stream(plain.withColumn("digest", digest), *_ORDER, "text", kind=F.lit(_TEXT)))
    all_names = rows.select("conv_id").unionByName(names.select("conv_id")) if names is not None else rows.select("conv_id")
    stream = stream.unionByName(_stream(all_names.distinct(), kind=F.lit(0)))
    dealt = stream.repartition("conv_id").sortWithinPartitions("conv_id", F.col("kind") > _CHECKPOINT, *_ORDER, "kind", "number")
    return dealt.mapInArrow(
        _forward,
        f"conv_id {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint,"
        " audit string, repaired_sha256 string",
    )


def _entries(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, fault, times): equal rows of one turn as one, with the fault of the first."""
    # of several white spaces at its end a text may have very many: a pattern for the last other character would try each
    bare = F.rtrim(F.translate("text", "\t\n\v\f\r", "     "))
    own = F.when(bare == "", BLANK).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), SOUND).otherwise(CUT_OFF)
    light = rows.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), own.alias("own"))
    counted = light.groupBy("conv_id", *_ORDER, "own").agg(F.count(F.lit(1)).alias("times"))
    # a NULL turn comes first, and is less than any number in a struct
    turns = F.struct(F.col("turn"))
    first = counted.groupBy(
        F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")
    ).agg(F.min(turns).alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    again = ~F.col("first.turn").eqNullSafe(F.col("turn"))
    fault = F.when(F.col("own") == BLANK, BLANK).when(again, DUPLICATE).otherwise(F.col("own"))
    return counted.join(first, same).select("conv_id", *_ORDER, fault.cast("int").alias("fault"), "times")


def _stream(df: DataFrame, *columns: str, kind: Column, **named: str) -> DataFrame:
    """One shape for all rows of the forward stream."""
    types = {
        "turn": "bigint", "role": "string", "digest": "binary", "text": "string", "fault": "int", "times": "bigint",
        "number": "bigint", "costs": "array<double>",
    }
    have = {c: F.col(c) for c in columns} | {k: F.col(v) for k, v in named.items()}
    shaped = [have.get(c, F.lit(None)).cast(t).alias(c) for c, t in types.items()]
    return df.select("conv_id", kind.alias("kind"), *shaped)


def _rows(batches: Iterator[pa.RecordBatch]) -> tuple[pa.DataType, Iterator[dict]]:
    """The type of the conversations' names, and the rows one by one."""
    first = next(batches, None)
    if first is None:
        return pa.int64(), iter(())
    slices = (b.slice(k, 256) for b in itertools.chain([first], batches) for k in range(0, b.num_rows, 256))
    return first.schema.field("conv_id").type, itertools.chain.from_iterable(s.to_pylist() for s in slices)


def final_costs() -> Costs:
    """Costs after the last entry."""
    return _closed([0 if s in ENDS else inf for s in STATES])


def costs_before(after: Costs, initial: str, fault: int, times: int) -> Costs:
    """Costs from each state at an entry, from those after it."""
    extra = DELETE * (times - 1)  # all copies but the first are duplicates
    best = [DELETE + extra + after[s] for s in STATES]
    if fault in (SOUND, CUT_OFF):
        more = extra + (TRUNCATED if fault == CUT_OFF else 0)
        for s in STATES:
            if initial in ON[s]:
                best[s] = min(best[s], more + after[ON[s][initial]])
            best[s] = min(best[s], RELABEL + more + after[NEXT[s]])
    return _closed(best)


def _closed(costs: list[float]) -> Costs:
    """With insertions first; two of them reach every state that insertions can."""
    once = [min(costs[s], INSERT + costs[NEXT[s]]) for s in STATES]
    return tuple(min(once[s], INSERT + once[NEXT[s]]) for s in STATES)


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries from last to first; the costs at each square distance from the end, and how many entries there are."""
    out: list[tuple] = []
    kind, entries = _rows(batches)
    fields = {"conv_id": kind, "number": pa.int64(), "costs": pa.list_(pa.float64())}
    for conv, rows in itertools.groupby(entries, key=lambda r: r["conv_id"]):
        costs, n = final_costs(), 0
        for r in rows:
            costs = costs_before(costs, r["initial"], r["fault"], r["times"])
            n += 1
            if isqrt(n) ** 2 == n:
                out.append((conv, n, list(costs)))
        out.append((conv, -n, list(costs)))  # sorts before the checkpoints
        if len(out) > 4096:
            yield _batch(out, fields)
            out = []
    yield _batch(out, fields)


def _batch(rows: list[tuple], fields: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.record_batch([pa.array(list(v), t) for v, t in zip(columns, fields.values())], list(fields))


@dataclass
class Walk:
    """One conversation on the way forward."""

    total: int = 0
    cost: float = 0
    checkpoints: dict[int, Costs] = field(default_factory=dict)
    seen: int = 0
    state: int = NOTHING
    held: list[tuple[str, int, int, str, str]] = field(default_factory=list)
    audit: list[str] = field(default_factory=list)
    counts: np.ndarray = field(default_factory=lambda: np.zeros(4, np.int64))
    illegal: int = 0
    last: str | None = None
    turns: list[int] = field(default_factory=lambda: [0, 0, 0])  # least, greatest, how many
    digest: "hashlib._Hash" = field(default_factory=hashlib.sha256)
    lines: int = 0

    def open(self, row: dict) -> None:
        if row["number"] <= 0:
            self.total, self.cost = -row["number"], row["costs"][NOTHING]
        else:
            self.checkpoints[row["number"]] = tuple(row["costs"])

    def take(self, entry: dict, text: str) -> None:
        """The next entry with its text; the edits of its stretch once that is complete."""
        initial, fault, times = entry["role"][:1], entry["fault"], entry["times"]
        self.counts[fault] += 1
        self.counts[BLANK if fault == BLANK else DUPLICATE] += times - 1
        self.illegal += (times - 1) + (self.last is not None and self.last + initial not in ("su", "ua", "au"))
        self.last = initial
        if entry["turn"] is not None:
            low, high, n = self.turns
            if n == 0:
                self.turns = [entry["turn"], entry["turn"], 1]
            elif entry["turn"] != high:
                self.turns = [low, entry["turn"], n + 1]
        self.held.append((initial, fault, times, entry["role"], text if fault in (SOUND, CUT_OFF) else ""))
        self.seen += 1
        left = self.total - self.seen
        if isqrt(left) ** 2 == left:
            self.walk(self.checkpoints.pop(left) if left else final_costs())

    def walk(self, end: Costs) -> None:
        """The least edits of the held entries; ``end`` has the costs after them."""
        ahead = [end]
        for initial, fault, times, _, _ in reversed(self.held):
            ahead.append(costs_before(ahead[-1], initial, fault, times))
        ahead.reverse()
        for k, (initial, fault, times, role, text) in enumerate(self.held):
            here, after, extra = ahead[k], ahead[k + 1], DELETE * (times - 1)
            more = extra + (TRUNCATED if fault == CUT_OFF else 0)
            while True:  # letters in the order of ASCII: the first that is tight
                now = here[self.state]
                if now == DELETE + extra + after[self.state]:
                    self.audit.append("D" * times)
                    break
                follows = NEXT[self.state]
                if now == INSERT + here[follows]:
                    self.edit("I", follows, ROLE[follows], "")
                    continue
                kept = ON[self.state].get(initial)
                if kept is not None and now == more + after[kept]:
                    self.edit("K", kept, role, text)
                else:
                    self.edit("R", follows, ROLE[follows], text)
                self.audit.append("D" * (times - 1))
                break
        self.held = []

    def edit(self, letter: str, state: int, role: str, text: str) -> None:
        self.audit.append(letter)
        self.state = state
        if self.lines:
            self.digest.update(b"\n")
        self.digest.update(f"{role}:".encode())
        self.digest.update(text.encode())
        self.lines += 1

    def close(self, conv: object) -> tuple:
        while self.state not in ENDS:
            follows = NEXT[self.state]
            self.edit("I", follows, ROLE[follows], "")
        low, high, n = self.turns
        gaps = high - low + 1 - n if n else 0
        blank, duplicate, truncated = (int(self.counts[k]) for k in (BLANK, DUPLICATE, CUT_OFF))
        cost = int(self.cost) if self.total else 0
        return (conv, gaps, blank, duplicate, truncated, self.illegal, cost, "".join(self.audit), self.digest.hexdigest())


_NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    kind, arriving = _rows(batches)
    fields = {"conv_id": kind} | dict.fromkeys(_NUMBERS, pa.int64()) | {"audit": pa.string(), "repaired_sha256": pa.string()}
    for conv, rows in itertools.groupby(arriving, key=lambda r: r["conv_id"]):
        walk, entry = Walk(), None
        for r in rows:
            if r["kind"] == _CHECKPOINT:
                walk.open(r)
            elif r["kind"] == _ENTRY:
                entry = r
            elif r["kind"] == _TEXT and entry is not None:  # the first of equal rows; the others are deleted
                walk.take(entry, r["text"])
                entry = None
        out.append(walk.close(conv))
        if len(out) > 1024:
            yield _batch(out, fields)
            out = []
    yield _batch(out, fields)
