"""Repair of conversation structure: cheapest edits by iterative-deepening A*.

A conversation is legal if the initials of its roles read `(s?(ua)+)?`. Every row is kept, given
another role or deleted, and empty turns may be inserted anywhere; `search` walks the edits depth
first in ASCII order of their initials (Delete, Insert, Keep, Rerole) under a cost bound that rises to
the least cost seen beyond it. A transposition table keeps for each failed state the cost proved
necessary from it. The first accepting path under the least bound is the cheapest, and of the
cheapest the least in ASCII order.

Conversations may be of any length. Rows are ordered by a range sort, so a long conversation is spread
over tasks, and searched in segments: for each pair of states at a segment's ends the cheapest path
between them. Inserts belong to the row behind them, so no path of a segment is the beginning of
another and least paths of segments join to the least path of the whole. One pass over a
conversation's segments from the last to the first picks the paths. What one task holds of a
conversation is the audit it must return; texts stream through the task that hashes them, since a
SHA-256 of their sequence has no parallel form.

Defined cases: null roles and texts are one space, so is a null in `conv_id:turn`; a null conv_id is a
conversation of its own; rows of one turn are ordered by role, then by the text's SHA-256; repeated
rows are duplicates of each other; a role of another initial, or an empty one, is never kept; texts are
equal if their SHA-256 is; a table without rows has no conversations.
"""
import hashlib
from functools import lru_cache, partial
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograil.session import durable

SPACE = " \t\n\x0b\f\r"
BEGIN, SYSTEM, USER, ASSISTANT = range(4)       # states: the initial before; as row codes, BEGIN is any other initial
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)    # faults, in a code's upper bits
NEXT = (USER, USER, ASSISTANT, USER)            # the only user or assistant turn legal after a state
NAMES = {USER: "user", ASSISTANT: "assistant"}
KEPT = {(BEGIN, SYSTEM), (BEGIN, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
DELETE, INSERT, REROLE, CUT_OFF = 3, 2, 2, 1
NEVER = 1 << 40
SEGMENT = 24        # rows of a search
ENDS = (0, 2 * INSERT, INSERT, 0)               # cost of the inserts that end a conversation in each state


def edits(code: int, at: int, state: int):
    """(initial, cost, row, state) of the edits at a row, in ASCII order."""
    role, fault = code & 3, code >> 2
    yield "D", DELETE, at + 1, state
    yield "I", INSERT, at, NEXT[state]
    if fault in (FINE, TRUNCATED):
        more = CUT_OFF if fault == TRUNCATED else 0
        if (state, role) in KEPT:
            yield "K", more, at + 1, role
        yield "R", REROLE + more, at + 1, NEXT[state]


def least_costs(codes: bytes) -> tuple[list[int], list[bool]]:
    """For each suffix: a cost that no repair of it goes below, from any state but the beginning; and
    whether it has a system row that may be kept.

    A row costs what its fault costs; others than user and assistant must change; of k equal user or
    assistant rows in succession at least half, rounded down, need an edit of their own.
    """
    rest, system, run, of = [0], [False], 0, None
    for code in reversed(codes):
        role, fault = code & 3, code >> 2
        cost = rest[-1]
        if fault in (BLANK, DUPLICATE):
            cost += DELETE
        else:
            cost += CUT_OFF if fault == TRUNCATED else 0
            if role in (BEGIN, SYSTEM):
                cost, run, of = cost + REROLE, 0, None
            else:
                run, of = (run + 1 if role == of else 1), role
                cost += 0 if run % 2 else INSERT
        rest.append(cost)
        system.append(system[-1] or (role == SYSTEM and fault in (FINE, TRUNCATED)))
    return rest[::-1], system[::-1]


@lru_cache(maxsize=1 << 16)
def search(codes: bytes, start: int = BEGIN, goal: int | None = None) -> tuple[int, str] | None:
    """Least cost and edits from `start` over all rows to state `goal`; without a goal to a legal end, inserts included."""
    rest, system = least_costs(codes)
    proved: dict[tuple[int, int], int] = {}

    def lower(at: int, state: int) -> int:
        """A cost known to be needed from here."""
        if (at, state) in proved:
            return proved[at, state]
        if goal in (BEGIN, SYSTEM) and state != goal and (goal == BEGIN or state != BEGIN or not system[at]):
            return NEVER
        if at == len(codes):
            return ENDS[state] if goal is None else 0 if state == goal else NEVER
        return rest[at] - (REROLE if state == BEGIN and system[at] else 0)

    def visit(at: int, state: int, left: int) -> str | None:
        if at == len(codes) and lower(at, state) == 0:
            return ""
        options = edits(codes[at], at, state) if at < len(codes) else [("I", INSERT, at, NEXT[state])]
        need = NEVER
        for initial, cost, behind, then in options:
            if lower(behind, then) <= left - cost:
                path = visit(behind, then, left - cost)
                if path is not None:
                    return initial + path
            need = min(need, cost + lower(behind, then))
        proved[at, state] = min(need, NEVER)
        return None

    bound = lower(0, start)
    while bound < NEVER:
        path = visit(0, start, bound)
        if path is not None:
            return bound, path
        bound = lower(0, start)
    return None


@lru_cache(maxsize=1 << 14)
def paths(codes: bytes) -> tuple[tuple[tuple[int, str] | None, ...], ...]:
    """[state before][state behind]: least cost and edits of a segment."""
    return tuple(tuple(search(codes, a, b) for b in range(4)) for a in range(4))


class Chain:
    """Joins a conversation's segments, given from the last to the first."""

    def __init__(self):
        self.costs = list(ENDS)
        self.steps: list[list[tuple[int, str]]] = []

    def add(self, matrix):
        step, costs = [], []
        for row in matrix:
            ways = [(path[0] + self.costs[then], path[1], then) for then, path in enumerate(row) if path]
            cost, path, then = min(ways)
            costs.append(cost)
            step.append((then, path))
        self.costs = costs
        self.steps.append(step)

    def result(self) -> tuple[int, str]:
        state, out = BEGIN, []
        for step in reversed(self.steps):
            state, path = step[state]
            out.append(path)
        return self.costs[BEGIN], "".join(out) + "I" * (ENDS[state] // INSERT)


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: the rows of `turns` after planted damage; a dropped row has no copies."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                        (F.crc32(key.cast("binary")) % 20).alias("kind"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                       F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def _coded(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, code, again, copies: a row for each distinct row; `again` is the code of its further copies.

    A conversation without rows has one row without copies.
    """
    body = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(body == "", BLANK).when(~F.substring(body, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(BEGIN)
    there = lambda c: F.when(F.col("copies") > 0, c)
    each = (rows.select("conv_id", there(F.col("turn")).alias("turn"), there(F.col("role")).alias("role"),
                        there(F.unhex(F.sha2("text", 256))).alias("digest"), there(fault).alias("fault"), there(role).alias("initial"), "copies")
            .groupBy("conv_id", "turn", "role", "digest", "fault", "initial").agg(F.sum("copies").alias("copies")))
    each = durable(each)
    # Only what stands in several turns of a conversation needs to be told which of them is the first.
    first = (each.where((F.col("copies") > 0) & (F.col("fault") != BLANK)).groupBy(F.col("conv_id").alias("of"), F.col("role").alias("by"), F.col("digest").alias("same"))
             .agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first"), F.count("*").alias("turns")).where("turns > 1"))
    on = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("role") == F.col("by")) & (F.col("digest") == F.col("same"))
    marked = each.join(first, on, "left").select(
        "conv_id", "turn", "role", "digest", "initial", "copies",
        F.when(F.col("first.turn").eqNullSafe(F.col("turn")) | F.col("first").isNull() | (F.col("fault") == BLANK), F.col("fault")).otherwise(DUPLICATE).alias("fault"))
    code = lambda fault: (F.col("initial") + 4 * fault).cast("int")
    return marked.select("conv_id", "turn", "role", "digest", code(F.col("fault")).alias("code"),
                         code(F.when(F.col("fault") == BLANK, BLANK).otherwise(DUPLICATE)).alias("again"), "copies")


_PARTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("seq", pa.int64()), ("codes", pa.binary()), ("low", pa.int64()), ("high", pa.int64()),
                    ("turns", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])
PARTS = ("conv_id bigint, part bigint, seq bigint, codes binary, low bigint, high bigint, turns bigint, cost bigint, audit string, "
         "costs array<bigint>, audits array<string>")


def _batches(rows, schema: pa.Schema, size: int = 4096):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*held))), schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*held))), schema=schema)


def _stream(batches, *names: str):
    for batch in batches:
        yield from zip(*(batch.column(name).to_pylist() for name in names))


def _cut(rows):
    """Segments of one conversation's rows in a task: codes, lowest and highest turn, and how many turns begin in it."""
    codes, low, high, turns, before = bytearray(), None, None, 0, None
    for _, turn, code, again, copies in rows:
        if copies and turn is not None:
            low, high, turns, before = turn if low is None else low, turn, turns + (turn != before), turn
        for at in range(copies):
            codes.append(again if at else code)
            if len(codes) == SEGMENT:
                yield bytes(codes), low, high, turns
                codes, low, high, turns = bytearray(), None, None, 0
    yield bytes(codes), low, high, turns


def _segments(batches):
    """Segments of a task's sorted rows with their paths. A conversation that lies inside the task and one segment is repaired at once."""
    part = TaskContext.get().partitionId()

    def found():
        conversations = groupby(_stream(batches, "conv_id", "turn", "code", "again", "copies"), key=lambda r: r[0])
        ahead = next(conversations, None)
        opening = True
        while ahead is not None:
            conv_id, pieces = ahead[0], _cut(ahead[1])
            piece, seq = next(pieces), 0
            while piece is not None:
                following = next(pieces, None)
                if following is None:
                    ahead = next(conversations, None)
                if following is None and seq == 0 and not opening and ahead is not None:
                    yield (conv_id, part, seq, *piece, *search(piece[0]), None, None)
                else:
                    flat = [path for row in paths(piece[0]) for path in row]
                    yield (conv_id, part, seq, *piece, None, None, [p and p[0] for p in flat], [p and p[1] for p in flat])
                piece, seq = following, seq + 1
            opening = False

    return _batches(found(), _PARTS)


_REPAIRS = pa.schema([("conv_id", pa.int64())] + [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string())])
REPAIRS = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


def _joined(batches):
    """Conversations from their segments, which come from the last to the first."""
    def found():
        for conv_id, segments in groupby(_stream(batches, *_PARTS.names), key=lambda r: r[0]):
            chain, repaired = Chain(), None
            faults, illegal, behind, low, high, turns, next_low = [0] * 4, 0, None, None, None, 0, None
            for _, _, _, codes, first, last, fresh, cost, audit, costs, audits in segments:
                for code in codes:
                    faults[code >> 2] += 1
                whole = codes if behind is None else codes + bytes([behind])
                illegal += sum((a & 3, b & 3) not in LEGAL for a, b in zip(whole, whole[1:]))
                behind = codes[0] if codes else behind
                if last is not None:
                    # A turn that goes on in the segment behind has been counted there too.
                    turns += fresh - (last == next_low)
                    low, high, next_low = first, last if high is None else high, first
                if audit is not None:
                    repaired = cost, audit
                else:
                    flat = [None if c is None else (c, a) for c, a in zip(costs, audits)]
                    chain.add([flat[4 * a:4 * a + 4] for a in range(4)])
            cost, audit = repaired or chain.result()
            gaps = 0 if low is None else high - low + 1 - turns
            yield conv_id, gaps, *faults[1:], illegal, cost, audit

    return _batches(found(), _REPAIRS, 512)


_RESULT = pa.schema([*_REPAIRS, ("repaired_sha256", pa.string())])
RESULT = f"{REPAIRS}, repaired_sha256 string"


def _hashed(batches):
    """Each conversation's repair, given before its rows, with the hash of the repaired rows."""
    def found():
        for conv_id, rows in groupby(_stream(batches, *_REPAIRS.names, "role", "text"), key=lambda r: r[0]):
            *repair, _, _ = next(rows)
            audit, at, state, sha, lead = repair[-1], 0, BEGIN, hashlib.sha256(), b""

            def put(line: str):
                nonlocal lead
                sha.update(lead)
                sha.update(line.encode())
                lead = b"\n"

            for *_, role, text in [] if not audit else rows:
                while audit[at] == "I":
                    state, at = NEXT[state], at + 1
                    put(NAMES[state] + ":")
                if audit[at] == "K":
                    state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
                    put(f"{role}:{text}")
                elif audit[at] == "R":
                    state = NEXT[state]
                    put(f"{NAMES[state]}:{text}")
                at += 1
            for _ in audit[at:]:
                state = NEXT[state]
                put(NAMES[state] + ":")
            yield *repair, sha.hexdigest()

    return _batches(found(), _RESULT, 512)


def repair(rows: DataFrame) -> DataFrame:
    """Repairs of all conversations of `rows` (conv_id, turn, role, text, copies; null-free role and text).

    A row for each conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    """
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("digest").asc_nulls_first()]
    coded = durable(_coded(rows))
    parts = coded.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "code", "again", "copies").mapInArrow(_segments, PARTS)
    repairs = (parts.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.desc("part"), F.desc("seq")).mapInArrow(_joined, REPAIRS))
    texts = rows.where("copies > 0").select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), "text",
                                            F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    both = repairs.withColumn("kind", F.lit(0)).unionByName(texts.drop("copy").withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return (both.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "kind", *order[1:])
            .select(*_REPAIRS.names, "role", "text").mapInArrow(_hashed, RESULT))


def repair_damaged(turns: DataFrame) -> DataFrame:
    """The repairs of `turns` (conv_id, turn, role, text) after planted damage."""
    return repair(damaged(turns))
