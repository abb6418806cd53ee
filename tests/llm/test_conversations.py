"""Conversation repair against a plain search over all edit lists, on random conversations and whole tables."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from loomvec.llm import conversation_repair
from loomvec.llm.queries import queries

SF = "/root/testdata/sf0.01"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def plain(rows, conv):
    """One conversation's result from its (turn, role, text) rows in order, by a memoised search for the least (cost, audit)."""
    fault, seen = [], set()
    for _, role, text in rows:
        solid = WORD.findall(text)
        fault.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    onward = {"": "u", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i, last, inserted):
        """Least (cost, audit, edits) from row i, the last role's initial being ``last``."""
        found = []
        if i == len(rows):
            if last in ("", "a"):
                found.append((0, "", ()))
        else:
            _, role, _ = rows[i]
            c, a, e = best(i + 1, last, 0)
            found.append((3 + c, "D" + a, (("D", ""),) + e))
            if fault[i] not in ("blank", "duplicate"):
                more = fault[i] == "truncated"
                if role[:1] == onward[last] or (last == "" and role[:1] == "s"):
                    c, a, e = best(i + 1, role[0], 0)
                    found.append((more + c, "K" + a, (("K", role),) + e))
                for new in ("user", "assistant"):
                    if new[0] == onward[last]:
                        c, a, e = best(i + 1, new[0], 0)
                        found.append((2 + more + c, "R" + a, (("R", new),) + e))
        if inserted < 3:
            for new in ("user", "assistant"):
                if new[0] == onward[last]:
                    c, a, e = best(i, new[0], inserted + 1)
                    found.append((2 + c, "I" + a, (("I", new),) + e))
        return min(found) if found else (10**9, "", ())

    cost, audit, edits = best(0, "", 0)
    lines, i = [], 0
    for kind, role in edits:
        if kind in "KR":
            lines.append(f"{role}:{rows[i][2]}")
        elif kind == "I":
            lines.append(f"{role}:")
        i += kind != "I"
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    count = [fault.count(f) for f in ("blank", "duplicate", "truncated")]
    return (conv, gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def key(row):
    turn, role, text = row
    return turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def damage(table):
    out = {}
    for conv, turn, role, text in table:
        rows = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            rows += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def order(row):
    return row[0] is not None, row[0] or 0


def check(got, want):
    got = sorted((tuple(r[c] for c in COLUMNS) for r in got), key=order)
    want = sorted((plain(sorted(rows, key=key), conv) for conv, rows in want.items()), key=order)
    assert got == want


def test_random_conversations(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "CELLS", 64)
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "u", "", None]
    texts = ["Yes.", "No!", "Why?", "cut", " \t", "", None, "What. ", "x.\n", "é", ". "]
    table = []
    for conv in [*range(300), None]:
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 7, 12])):
            table.append((conv, rng.choice([None, *range(8)]), rng.choice(roles), rng.choice(texts)))
        for turn in range(rng.choice([0, 2, 3, 9])):
            table.append((conv, turn, roles[turn % 2], f"{rng.choice(['A', 'B'])} {turn if rng.random() < 0.8 else 0}{rng.choice(['.', '.', ''])}"))
    frame = spark.createDataFrame(table, SCHEMA).withColumn("audit", F.lit(1)).withColumn("mark", F.lit("m"))
    want = {}
    for conv, turn, role, text in table:
        want.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    check(conversation_repair.repair(frame).collect(), want)
    with_damage = conversation_repair.repair(conversation_repair.damaged(frame), present_col="present")
    check(with_damage.collect(), damage(table))
    audits = conversation_repair.audit(frame)
    rows = conversation_repair.repaired(frame, audits).orderBy("conv_id", "place").collect()
    found = {}
    for r in rows:
        found.setdefault(r.conv_id, []).append(r)
    for conv, mine in found.items():
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in mine)) and [r.place for r in mine] == list(range(len(mine)))
        assert all(r.text == "" for r in mine if r.edit == "I")


def test_long_and_many_conversations_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "ROWS", 50)
    text = "long words " * 40_000
    table = [(1, t, ("user", "assistant")[(t + t // 50) % 2], f"turn {t}.") for t in range(3000)] + [(2, 0, "user", text + "."), (2, 1, "assistant", text)]
    table += [(c, t, ("user", "assistant")[t % 2], f"{c} {t}.") for c in range(3, 60) for t in range(c % 5)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 40)
    try:
        got = conversation_repair.repair(spark.createDataFrame(table, SCHEMA)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for conv, *row in table:
        want.setdefault(conv, []).append(tuple(row))
    long = {r.conv_id: r for r in got}[1]
    assert long.illegal == 59 and len(long.audit.replace("I", "")) == 3000
    check([r for r in got if r.conv_id != 1], {c: r for c, r in want.items() if c != 1})
    part = want[1][:300]
    check(conversation_repair.repair(spark.createDataFrame([(1, *r) for r in part], SCHEMA)).collect(), {1: part})


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert conversation_repair.repair(none).collect() == []
    assert conversation_repair.repair(conversation_repair.damaged(none), present_col="present").collect() == []
    gone = spark.createDataFrame([(7, 0, "user", "x.")], SCHEMA).withColumn("present", F.lit(False))
    assert [tuple(r) for r in conversation_repair.repair(gone, present_col="present").collect()] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_whole_table(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries()["op13_conversation_repair"](spark, SF)
    assert got.columns[: len(COLUMNS)] == COLUMNS
    check(got.collect(), damage(table))
