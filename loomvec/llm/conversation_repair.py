"""Conversation structure repair: the cheapest edits that make the turns alternate.

The rows of a conversation, in order of turn, are kept, deleted, given another
role, or have rows inserted before or after them, so that the roles' initials
read ``(s?(ua)+)?`` at the least total cost. Keep costs 0; a rerole to user or
assistant 2; an inserted empty row of user or assistant 2; a deletion 3. Blank
rows and repeats must be deleted; a truncated row that stays adds 1. Of equally
cheap edit lists the one whose initials (D, I, K, R) are least in ASCII wins.

``audit``: each row becomes a few bytes (initial of the role, faults, a digest
of role and text) which are shuffled by conversation and sorted. A task deals
its conversations into buckets of like length and computes all of a bucket at
once, time-major: for each turn from the last to the first one array step gives
the least cost of the rest from each of the four states (nothing yet, after
system, after user, after assistant), for all conversations; these backward
costs are stored, and a second sweep over the turns traces the edits forward,
again for all conversations at a time.

``repaired``: the texts are shuffled by conversation behind its audit and
streamed, so no task holds a conversation's texts. What a task holds of one
conversation is some 50 bytes a turn; its audit, one value, is of that length
by definition.

Nulls in role and text count as one space; a null turn sorts first and a null
conversation is one of its own. Rows of one turn go by the MD5 of role and text.
A role other than system, user or assistant can be reroled or deleted, as its
initial says. Very long texts are never cut. Equal rows of a conversation are
repeats of the first. A conversation whose rows are all absent (``present``
false) has zeros, an empty audit and no repaired rows. Extra columns are left
out; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import keep

#: Rows that a task takes at once, and cells of a bucket's cost table.
ROWS = 200_000
CELLS = 1 << 20
SPACE = " \t\n\x0b\f\r"
START, SYSTEM, USER, ASSISTANT = range(4)
_BLANK, _TRUNCATED = 4, 8
#: The state that an inserted or reroled row leads to, from each state.
_ONWARD = np.array([USER, USER, ASSISTANT, USER])
_FAR = 1 << 29
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def faults(rows: DataFrame, role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``rows`` with ``mark`` (a digest of role and text) and ``code`` (initial: s 0, u 1, a 2, other 3; 4 if blank, 8 if truncated)."""
    initial, bare = F.substring(role_col, 1, 1), F.rtrim(F.col(text_col), F.lit(SPACE))
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    code = code + F.when(F.length(bare) == 0, _BLANK).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), _TRUNCATED).otherwise(0)
    mark = F.unhex(F.md5(F.concat(F.length(role_col).cast("string"), F.lit(":"), role_col, text_col)))
    return rows.withColumns({"mark": mark, "code": code})


def _plain(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, present_col: str | None) -> DataFrame:
    there = F.coalesce(F.col(present_col).cast("boolean"), F.lit(False)) if present_col else F.lit(True)
    spaced = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text")))
    return conversations.select(F.col(id_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), *spaced, there.alias("present"))


def backward(initial: np.ndarray, forced: np.ndarray, late: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Least cost of the rest from each turn and state: (turns + 1) x 4 x conversations, from turns x conversations."""
    turns, n = initial.shape
    cost = np.empty((turns + 1, 4, n), np.int32)
    cost[turns] = np.array([0, 4, 2, 0])[:, None]  # nothing, or a whole pair; else the missing rows are inserted
    for t in range(turns - 1, -1, -1):
        after = cost[t + 1]
        stay = np.minimum(_kept(after, initial[t]), after[_ONWARD] + 2) + late[t]
        stay[:, forced[t]] = _FAR
        best = np.minimum(stay, after + 3)
        user, assistant = np.minimum(best[USER], best[ASSISTANT] + 2), np.minimum(best[ASSISTANT], best[USER] + 2)
        best[USER], best[ASSISTANT] = user, assistant
        best[START], best[SYSTEM] = np.minimum(best[START], user + 2), np.minimum(best[SYSTEM], user + 2)
        cost[t] = np.where(there[t], best, after)
    return cost


def _kept(after: np.ndarray, initial: np.ndarray) -> np.ndarray:
    """Cost of the rest if the row is kept, from each state."""
    s, u, a = (np.where(initial == i, after[q], _FAR) for i, q in ((0, SYSTEM), (1, USER), (2, ASSISTANT)))
    return np.stack([np.minimum(s, u), u, a, u])


def forward(cost: np.ndarray, initial: np.ndarray, forced: np.ndarray, late: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inserted rows before each turn (and behind the last), and each turn's edit, as the backward costs say."""
    turns, n = initial.shape
    each, state = np.arange(n), np.zeros(n, np.int64)
    inserted, edit = np.zeros((turns + 1, n), np.int8), np.full((turns, n), ord("D"), np.uint8)

    def insert(t: int, open_: np.ndarray) -> np.ndarray:
        onward = _ONWARD[state]
        moved = open_ & (cost[t][onward, each] + 2 == cost[t][state, each])
        inserted[t] += moved
        state[moved] = onward[moved]
        return moved

    for t in range(turns):
        after, open_ = cost[t + 1], there[t].copy()
        while True:
            deleted = open_ & (after[state, each] + 3 == cost[t][state, each])
            open_ &= ~deleted
            if not insert(t, open_).any():
                break
        kept = open_ & (_kept(after, initial[t])[state, each] + late[t] == cost[t][state, each])
        other = open_ & ~kept
        edit[t, kept], edit[t, other] = ord("K"), ord("R")
        state[kept] = np.array([SYSTEM, USER, ASSISTANT, START])[initial[t, kept]]
        state[other] = _ONWARD[state[other]]
    while insert(turns, cost[turns][state, each] > 0).any():
        pass
    return inserted, edit


def cheapest(initial: np.ndarray, forced: np.ndarray, late: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Cost and audit of each conversation; its rows are first[i] .. first[i + 1] of the arrays."""
    size = np.diff(first)
    costs, audits = np.zeros(len(size), np.int64), [b""] * len(size)
    order = np.argsort(size, kind="stable")
    bucket = np.ceil(np.log2(np.maximum(size[order], 1))).astype(int)
    begin = 0
    while begin < len(order):
        end = min(int(np.searchsorted(bucket, bucket[begin], "right")), begin + max(1, CELLS >> int(bucket[begin])))
        mine, turns = order[begin:end], int(size[order[end - 1]])
        begin = end
        time = np.arange(turns)[:, None]
        there = time < size[mine]
        at = np.where(there, first[mine] + time, 0)
        parts = [np.where(there, x[at], 0) if len(x) else np.zeros(at.shape, x.dtype) for x in (initial, forced, late)]
        parts[1] = parts[1].astype(bool)
        cost = backward(*parts, there)
        inserted, edit = forward(cost, *parts, there)
        costs[mine] = cost[0, START]
        # conversation-major: the inserted rows before each turn, then the turn's edit
        count = inserted + np.vstack([there, np.zeros((1, len(mine)), bool)])
        ends = np.cumsum(count.T.ravel(), dtype=np.int64)
        letters = np.full(int(ends[-1]) if len(ends) else 0, ord("I"), np.uint8)
        letters[ends.reshape(len(mine), -1)[:, :turns][there.T] - 1] = edit.T[there.T]
        cut = np.append(0, ends.reshape(len(mine), -1)[:, -1]) if len(ends) else np.zeros(len(mine) + 1, int)
        raw = letters.tobytes()
        for i, a, b in zip(mine.tolist(), cut[:-1].tolist(), cut[1:].tolist()):
            audits[i] = raw[a:b]
    return costs, audits


def _audited(table: pa.Table) -> pa.RecordBatch:
    """One row for each conversation of whole, sorted conversations."""
    runs = pc.run_end_encode(table.column("conv").combine_chunks())
    ends = runs.run_ends.to_numpy().astype(np.int64)
    there = table.column("present").to_numpy()
    group = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[there]
    code = table.column("code").to_numpy()[there].astype(np.int64)
    marks = table.column("mark").combine_chunks().filter(pa.array(there))
    mark = np.frombuffer(b"".join(marks.to_pylist()), "<u8").reshape(-1, 2)
    n = len(ends)
    first = np.searchsorted(group, np.arange(n + 1))
    order = np.lexsort((np.arange(len(group)), mark[:, 1], mark[:, 0], group))
    seen = np.zeros(len(group), bool)
    same = (group[order[1:]] == group[order[:-1]]) & (mark[order[1:]] == mark[order[:-1]]).all(axis=1)
    seen[order[1:]] = same
    blank = (code & _BLANK) > 0
    seen &= ~blank
    late = ((code & _TRUNCATED) > 0) & ~seen
    initial = code & 3
    cost, audits = cheapest(initial, blank | seen, late, first)
    inside = group[1:] == group[:-1]
    pair = initial[:-1] * 4 + initial[1:]
    illegal = inside & ~np.isin(pair, [0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1])
    turns = table.column("turn").combine_chunks().filter(pa.array(there))
    known = np.asarray(turns.is_valid())
    turn, owner = turns.filter(pa.array(known)).to_numpy(), group[known]
    low, high = np.searchsorted(owner, np.arange(n)), np.searchsorted(owner, np.arange(n), "right") - 1
    new = np.ones(len(turn), bool)
    new[1:] = (turn[1:] != turn[:-1]) | (owner[1:] != owner[:-1])
    some = high >= low
    gaps = np.zeros(n, np.int64)
    gaps[some] = turn[high[some]] - turn[low[some]] + 1 - np.bincount(owner, new, n)[some].astype(np.int64)
    total = lambda x, g=group: pa.array(np.bincount(g, x, n).astype(np.int64))
    columns = [runs.values, pa.array(gaps), total(blank), total(seen), total(late), total(illegal, group[1:]) if len(group) else pa.array(np.zeros(n, np.int64)), pa.array(cost), pa.array([a.decode() for a in audits])]
    return pa.RecordBatch.from_arrays(columns, names=["conv", *COUNTS, "audit"])


def _whole(batches: Iterator[pa.RecordBatch], make: Callable[[pa.Table], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hand on whole conversations, about ROWS rows at once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = pc.run_end_encode(batch.column("conv")).run_ends.to_numpy()
        held.append(batch)
        if sum(b.num_rows for b in held) >= ROWS and (len(ends) > 1 or (len(held) > 1 and batch.column("conv")[0] != held[-2].column("conv")[-1])):
            cut = int(ends[-2]) if len(ends) > 1 else 0
            yield make(pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]))
            held = [batch.slice(cut)]
    if held:
        yield make(pa.Table.from_batches(held))


def audit(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present_col: str | None = None) -> DataFrame:
    """Per conversation: id_col, gaps, blank, duplicate, truncated, illegal, cost, audit.

    Rows whose ``present_col`` is not true name their conversation only.
    """
    rows = faults(_plain(conversations, id_col, turn_col, role_col, text_col, present_col)).select("conv", "turn", "present", "code", "mark")
    placed = rows.repartition("conv").sortWithinPartitions("conv", "turn", "mark")
    out = T.StructType([T.StructField("conv", conversations.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("audit", T.StringType())])
    return placed.mapInArrow(lambda batches: _whole(batches, _audited), out).withColumnRenamed("conv", id_col)


def repaired(conversations: DataFrame, audits: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present_col: str | None = None) -> DataFrame:
    """The rows of the repaired conversations: id_col, place (from 0), edit, role, text; a conversation's rows lie together, in order."""
    rows = faults(_plain(conversations, id_col, turn_col, role_col, text_col, present_col)).filter("present")
    rows = rows.select("conv", F.lit(1).alias("kind"), "turn", "mark", "role", "text", F.lit(None).cast("string").alias("audit"))
    heads = audits.select(F.col(id_col).alias("conv"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("mark"), *(F.lit(None).cast("string").alias(c) for c in ("role", "text")), "audit")
    placed = heads.unionByName(rows).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "mark")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, steps, place, state = None, b"", 0, START
        at = 0
        out: list[tuple] = []

        def put(edit: str, role: str | None, text: str) -> None:
            nonlocal place, state
            if role is None:
                state = int(_ONWARD[state])
                role = "user" if state == USER else "assistant"
            else:
                state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
            out.append((conv, place, edit, role, text))
            place += 1

        def inserts() -> None:
            nonlocal at
            while at < len(steps) and steps[at] == ord("I"):
                put("I", None, "")
                at += 1

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [()] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (id_type, pa.int64(), pa.string(), pa.large_string(), pa.large_string()))], names=["conv", "place", "edit", "role", "text"])

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.column("conv").type
            size = 0
            for c, kind, role, text, steps_ in zip(*(batch.column(x).to_pylist() for x in ("conv", "kind", "role", "text", "audit"))):
                if kind == 0:
                    inserts()  # behind the last row of the conversation before
                    conv, steps, at, place, state = c, (steps_ or "").encode(), 0, 0, START
                    continue
                inserts()
                edit = chr(steps[at])
                at += 1
                if edit != "D":
                    put(edit, role if edit == "K" else None, text)
                    size += len(text)
                if size > 1 << 20:
                    yield batch_of()
                    size = 0
            yield batch_of()
        inserts()
        yield batch_of()

    schema = T.StructType([T.StructField("conv", conversations.schema[id_col].dataType), T.StructField("place", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("edit", "role", "text"))])
    return placed.mapInArrow(walk, schema).withColumnRenamed("conv", id_col)


def digests(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """SHA-256 of each repaired conversation's ``role:text`` lines, taken as the rows stream by in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, found, type_ = None, None, pa.int64()
        for batch in batches:
            type_ = batch.column("conv").type
            done = []
            for c, place, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv", "place", "role", "text"))):
                if place == 0:
                    done += [(conv, found.hexdigest())] if found else []
                    conv, found = c, hashlib.sha256()
                found.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], type_), pa.array([d for _, d in done], pa.string())], names=["conv", "digest"])
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([conv], type_), pa.array([found.hexdigest()])], names=["conv", "digest"])

    schema = T.StructType([T.StructField("conv", rows.schema[id_col].dataType), T.StructField("digest", T.StringType())])
    return rows.withColumnRenamed(id_col, "conv").mapInArrow(run, schema).withColumnRenamed("conv", id_col)


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage, by crc32 of ``conv_id:turn`` modulo 20; dropped rows stay with ``present`` false."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fate = F.crc32(name) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select(
        "conv_id", "turn", F.when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (fate != 0).alias("present"), F.when(fate == 3, 2).otherwise(1).alias("copies"),
    )
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "copy")


def repair(conversations: DataFrame, **columns: str) -> DataFrame:
    """Per conversation: the audit's columns and ``repaired_sha256`` of its repaired rows."""
    id_col = columns.get("id_col", "conv_id")
    found = keep(audit(conversations, **columns), "audits")
    lines = digests(repaired(conversations, found, **columns), id_col).withColumnRenamed(id_col, "_conv")
    empty = hashlib.sha256(b"").hexdigest()
    return found.join(lines, F.col(id_col).eqNullSafe(F.col("_conv")), "left").select(*found.columns, F.coalesce("digest", F.lit(empty)).alias("repaired_sha256"))
