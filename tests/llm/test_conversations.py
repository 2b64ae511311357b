"""Conversation repair against a plain version: shortest paths over whole conversations, one row after the other."""
import hashlib
import heapq
import random
import re
import zlib

import pytest

from lograil.llm import conversations
from lograil.llm.common import table

COLUMNS = "conv_id bigint, turn bigint, role string, text string"


def plain_damage(rows):
    out = []
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv_id, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """Of one conversation's rows after damage."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
    faults, seen = [], set()
    for _, _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\f\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "fine" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    initials = [r[2][:1] for r in rows]
    turns = {r[1] for r in rows} - {None}
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, emitted, roles = heapq.heappop(heap)
        state = emitted[-1:]
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", emitted):
            break
        for letter in "ua":
            if re.fullmatch("s?(ua)*u?", emitted + letter):
                heapq.heappush(heap, (cost + 2, audit + "I", at, emitted + letter, (*roles, (letter, None))))
        if at < len(rows):
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, emitted, roles))
            if faults[at] in ("fine", "truncated"):
                more = faults[at] == "truncated"
                for letter in "sua":
                    edit = "K" if letter == initials[at] else "R" if letter != "s" else None
                    if edit and re.fullmatch("s?(ua)*u?", emitted + letter):
                        heapq.heappush(heap, (cost + more + 2 * (edit == "R"), audit + edit, at + 1, emitted + letter, (*roles, (letter, at))))
    names = {"u": "user", "a": "assistant"}
    lines = [names[x] + ":" if i is None else (rows[i][2] if x == initials[i] else names[x]) + ":" + rows[i][3] for x, i in roles]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def plain(rows):
    after = {}
    for row in plain_damage(rows):
        after.setdefault(row[0], []).append(row)
    return {conv_id: plain_repair(after.get(conv_id, [])) for conv_id in {r[0] for r in rows}}


def found(df):
    rows = [tuple(r) for r in df.collect()]
    out = {r[0]: r[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_whole_table(spark):
    turns = table(spark, "/root/testdata/sf0.01", "conversations")
    assert found(conversations.repair_damaged(turns)) == plain([(r.conv_id, r.turn, r.role, r.text) for r in turns.collect()])


def odd_rows(seed, size):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Well", "", " \t\n", None, "Why?\x0b", "a.b", "é…", "same.", "same."]
    roles = ["user", "assistant", "system", None, "tool", "", "user", "assistant", "sys"]
    return [(rng.choice([None, 1, 2, 3, 4, 5, *range(6, 40)]), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(size)]


@pytest.mark.parametrize("seed", range(2))
def test_odd_rows(spark, seed):
    """Nulls in every column, repeated rows, rows of one turn, odd roles and blank texts."""
    rows = odd_rows(seed, 500)
    assert found(conversations.repair_damaged(spark.createDataFrame(rows, COLUMNS))) == plain(rows)


def test_long_conversation_over_tasks(spark):
    """Segments over many tasks give the whole conversation's cheapest and least repair."""
    rng = random.Random(3)
    rows = [(7, t, rng.choice(["user", "assistant", "user", "assistant", "tool", "system"]), rng.choice(["a.", "b", "", f"{t}.", f"{t}?", f"{t}"])) for t in range(1500)]
    rows += [(8, 1, "user", "again.")] * 700 + [(9, t, "user", "again.") for t in range(300)]
    df = spark.createDataFrame(rows, COLUMNS).repartition(7)
    assert found(conversations.repair_damaged(df)) == plain(rows)


def test_search_is_cheapest_and_least():
    rng = random.Random(5)
    names = {0: "tool", 1: "system", 2: "user", 3: "assistant"}
    for _ in range(400):
        codes = bytes(rng.randrange(16) for _ in range(rng.randrange(8)))
        rows, seen = [], 0
        for at, code in enumerate(codes):
            fault = code >> 2
            if fault == 2:      # a duplicate needs a row before it
                codes = codes[:at] + bytes([code & 3 | 4]) + codes[at + 1:]
                fault = 1
            rows.append((1, at, names[code & 3], "" if fault == 1 else f"{at}." if fault == 0 else f"{at}"))
        cost, audit = conversations.search(codes)
        assert (cost, audit) == plain_repair(rows)[5:7], codes


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert conversations.repair_damaged(empty).collect() == []
    rows = odd_rows(9, 60)
    clashing = spark.createDataFrame([(*r, 1, "x", b"y", 2) for r in rows], COLUMNS + ", copies int, kind string, digest binary, part int")
    assert found(conversations.repair_damaged(clashing)) == plain(rows)


def test_very_long_text(spark):
    rows = [(1, 0, "user", "a " * 2_000_000 + "."), (1, 1, "assistant", "b" + " " * 1_000_000)]
    assert found(conversations.repair_damaged(spark.createDataFrame(rows, COLUMNS))) == plain(rows)
