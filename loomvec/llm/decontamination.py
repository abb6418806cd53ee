"""Benchmark decontamination by pigeonhole edit matching.

An item of m normalised characters may occur with up to k = floor(rate * m)
edits. It is cut into k + 1 pieces; whatever the edits, one piece survives
exactly. An Aho-Corasick automaton finds all pieces in each whole text; around
every hit, the text is compared with the item by Myers' bit-parallel distance,
with both text ends free. A document is contaminated by an item if the least
distance is at most k.

Normalisation lower-cases and turns each run of characters other than letters
and digits into one space. Items too short for an edit (k = 0) are matched as
whole words; items without letters or digits never match. Null and empty texts
match nothing; a very long text is searched whole, in time in proportion to it
and to its hits. Repeated items are searched once and each reported, as is each
repeated document. The least distance has no ties to break.

Different item texts are numbered in a table and taken in blocks of bounded
size, one at a time: a block goes to the workers, its hits are written, and the
next one is read. So neither the driver nor a task holds more than a block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import keep

_GAP = re.compile(r"[\W_]+")
BLOCK_BYTES = 16 << 20


def normalise(text: str) -> str:
    return _GAP.sub(" ", text.lower()).strip()


def myers(pattern: str, text: str, limit: int) -> int | None:
    """Least edit distance of the pattern to any part of the text, or None above ``limit``."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | vn
        xh = (((eq & vp) + vp) ^ vp) | eq
        hp = vn | ~(xh | vp) & full
        hn = vp & xh
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = hp << 1 & full  # a free start: nothing is carried in
        hn = hn << 1 & full
        vp = hn | ~(xv | hp) & full
        vn = hp & xv
        if score < best:
            best = score
    return best if best <= limit else None


class Matcher:
    """Pieces of the items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = [(i, normalise(t)) for i, t in items]
        self.budget = [int(rate * len(t)) for _, t in self.items]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text) in enumerate(self.items):
            cuts = [len(text) * j // (self.budget[n] + 1) for j in range(self.budget[n] + 2)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    pieces.setdefault(text[a:b], []).append((n, a))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def find(self, text: str) -> list[tuple[int, int]]:
        """(item number, least distance) of each item that occurs."""
        if self.empty:
            return []
        spans: dict[int, list[int]] = {}
        for last, (size, places) in self.automaton.iter(text):
            for n, offset in places:
                spans.setdefault(n, []).append(last + 1 - size - offset)
        out = []
        for n, starts in spans.items():
            item, k = self.items[n][1], self.budget[n]
            m = len(item)
            if any(s >= 0 and text.startswith(item, s) and (k or (text[s - 1 : s] in ("", " ") and text[s + m : s + m + 1] in ("", " "))) for s in starts):
                out.append((n, 0))
            elif k:
                found, windows = [], []
                for s in sorted(set(starts)):
                    a, b = max(0, s - k), s + m + k
                    if windows and a <= windows[-1][1]:
                        windows[-1][1] = b
                    else:
                        windows.append([a, b])
                for a, b in windows:
                    if (d := myers(item, text[a:b], k)) is not None:
                        found.append(d)
                if found:
                    out.append((n, min(found)))
        return out


def numbered(benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """(item, text): a number for each different item text."""
    texts = benchmark.select(F.col(text_col).cast("string").alias("text")).filter("text is not null").distinct()
    return keep(texts.select(F.monotonically_increasing_id().alias("item"), "text"), "items")


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The numbered items in blocks of about BLOCK_BYTES, each small enough to send to every worker."""
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    count = max(1, -(-size // BLOCK_BYTES))
    for block in range(count):
        rows = items.filter(F.pmod(F.xxhash64("item"), F.lit(count)) == block).toArrow()
        yield sorted(zip(rows.column("item").to_pylist(), rows.column("text").to_pylist()))


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = 0.06, text_col: str = "text", hits_col: str = "hits", item_text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` and ``hits_col``, a new name: array of (item, distance, budget), empty where clean; items by number."""
    return _search(docs, numbered(benchmark, item_text), rate, text_col, hits_col)


def _search(docs: DataFrame, items: DataFrame, rate: float, text_col: str, hits_col: str) -> DataFrame:
    """``docs`` with the hits of the numbered items; each block after the first writes the rows once more."""
    if hits_col in docs.columns:
        raise ValueError(f"{hits_col} is a column of the documents")
    kind = pa.list_(pa.struct([("item", pa.int64()), ("distance", pa.int32()), ("budget", pa.int32())]))
    out, at, schema = docs, docs.columns.index(text_col), docs.schema
    field = T.StructField(hits_col, T.ArrayType(T.StructType([T.StructField("item", T.LongType()), T.StructField("distance", T.IntegerType()), T.StructField("budget", T.IntegerType())])))
    for number, block in enumerate(_blocks(items)):

        def search(batches: Iterator[pa.RecordBatch], block=block, number=number) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, rate)
            for batch in batches:
                hits = []
                for text in batch.column(at).to_pylist():
                    found = matcher.find(normalise(text)) if text else []
                    hits.append([{"item": matcher.items[n][0], "distance": d, "budget": matcher.budget[n]} for n, d in sorted(found)])
                columns = list(batch.columns)
                if number:
                    hits = [a + b for a, b in zip(columns.pop().to_pylist(), hits)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(hits, kind)], names=[*schema.names, hits_col])

        if number:
            out = keep(out, "hits")
        out = out.mapInArrow(search, T.StructType([*schema.fields, field]))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.06, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item that it contains: id_col, item_col, distance, budget."""
    items = numbered(benchmark, item_text)
    ready = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = _search(ready, items, rate, "text", "hits").select("id", F.explode("hits").alias("h"))
    names = items.join(benchmark.select(F.col(item_col).cast("long").alias("name"), F.col(item_text).cast("string").alias("text")), "text").select("item", "name")
    joined = found.select("id", F.col("h.item").alias("item"), "h.distance", "h.budget").join(names, "item")
    return joined.select(F.col("id").alias(id_col), F.col("name").alias(item_col), "distance", "budget")
