"""Exact substring dedup with a count-min prefilter.

A window is ``window`` consecutive words of one document. A word is removed if
it lies in a window whose word sequence also starts in a document of smaller id;
windows are judged on the input.

0. Texts with exact copies under a smaller id need no windows: all their words go
   if they have a window at all. Copies are found by 128 bits of hash; from here
   on each text is seen under its smallest id only.
1. A window is counted under its least ``anchor``-word hash, so neighbouring
   windows share one entry and a key's count is at least that of each window
   under it: the sketch overestimates and never misses. Keys are taken once a
   document and dealt into shards, whose number follows the size of the input.
2. Count-min sketches of the parts of each shard, sparse and of one width, are
   added; what stays of a shard is one bit a cell: whether its count reaches 2.
   A shard's bits go ahead of its keys, which are tested as they stream by; a
   shard with many keys is dealt to several tasks, each with a copy of the bits.
3. Documents with keys estimated repeated in every row of the sketch hash again
   the windows under those keys. Only these windows are grouped, exactly: a
   grouped minimum with map-side combine, joined back to the windows by an image
   of the key, so that the rows of a hot window split.
4. Windows that start in a document of smaller id come back to their document as
   a list of hashes, bounded by its own length, and its words are marked. Only
   documents that may have such windows, by a bounded bitmap, are shuffled.

Windows are equal when 96 bits of hash are: 64 of a hash of the words in order,
32 of an independent one. Two different windows among 10**13 agree with a chance
below 0.002.

Null text has no words. Very long texts are hashed one at a time, by arrays of
about 100 bytes a word. Rows that repeat an id are one document to each other:
they never remove each other's words, and each gets its own result row; lists
travel by id and text, so that rows without an id, or of one id, are never
gathered. Null ids count as larger than all others. Ties need no rule: a result
depends on ids and words alone. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import discard, keep
from .idfilter import IdFilter, may_hold
from .lexing import U, Words, encode_signed, gram_checks, grams, mix, sliding_min, slices, split_words
from .skew import join_back

LAST = 2**63 - 1
SHARD_BYTES = 16 << 20
FLUSH = 400_000
CELLS = 1 << 20
TOGETHER = 1 << 20
KEYS = "shard int, keys binary, ids binary, names binary, n long"
COPY = ["t1", "t2"]
_SALT = U(0x9E3779B97F4A7C15)


def _in_row(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """A value and its row as one number."""
    return values + row.astype(np.uint64) * _SALT


def _window_keys(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window: its exact hash, the key it is counted under, and whether it lies in one document."""
    exact, inside = grams(words, window)
    small, _ = grams(words, anchor)
    return exact, sliding_min(small, window - anchor + 1)[: len(exact)], inside


def _document_keys(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, key) of the windows' keys."""
    small, _ = grams(words, anchor)
    count = len(words.hash) - window + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    key = sliding_min(small, window - anchor + 1)[:count]
    row = words.row[:count]
    new = words.row[window - 1 :] == row
    inside = new.copy()
    new[1:] &= (key[1:] != key[:-1]) | ~inside[:-1] | (row[1:] != row[:-1])
    key, row = key[new], row[new]
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    return row[first], key[first]


def cells(keys: np.ndarray, depth: int, width: int) -> np.ndarray:
    """Cell numbers of each key in each row of the sketch: depth x n, row d at d * width."""
    return np.stack([(mix(keys + U(0x9E3779B97F4A7C15 * (d + 1) % 2**64)) % U(width)).astype(np.int64) + d * width for d in range(depth)])


def _keys(docs: DataFrame, copied: np.ndarray, shards: int, window: int, anchor: int) -> DataFrame:
    """Rows of keys with their documents' ids and names, packed by shard; rows whose ``cell`` the bitmap may hold are left out."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            key, doc, name = (np.concatenate(x) for x in zip(*held))
            held.clear()
            shard = (mix(key) % U(shards)).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            key, doc, name, shard = key[order], doc[order], name[order], shard[order]
            numbers, begin = np.unique(shard, return_index=True)
            spans = list(zip(begin.tolist(), [*begin[1:].tolist(), len(shard)]))
            packed = [pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (key, doc, name)]
            return pa.RecordBatch.from_arrays([pa.array(numbers), *packed, pa.array([b - a for a, b in spans], pa.int64())], names=["shard", "keys", "ids", "names", "n"])

        for batch in batches:
            batch = batch.filter(pa.array(~may_hold(copied, batch.column("cell").to_numpy())))
            for part in slices(batch, "text"):
                row, key = _document_keys(split_words(part.column("text")), window, anchor)
                held.append((key, part.column("id").to_numpy()[row], part.column("name").to_numpy()[row]))
                if sum(len(h[0]) for h in held) >= FLUSH:
                    yield flush()
        if sum(len(h[0]) for h in held):
            yield flush()

    return docs.mapInArrow(gather, KEYS)


def _sketches(keys: DataFrame, depth: int, width: int) -> DataFrame:
    """One row a shard: a bit for each cell whose merged count is 2 or more."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in batch.column("keys").to_pylist():
                cell, count = np.unique(cells(np.frombuffer(raw, np.uint64), depth, width), return_counts=True)
                out.append((cell.astype(np.int32).tobytes(), np.minimum(count, 2).astype(np.uint8).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary())], names=["shard", "cells", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(depth * width, np.uint8)
        for cell, count in zip(table.column("cells").to_pylist(), table.column("counts").to_pylist()):
            at = np.frombuffer(cell, np.int32)
            total[at] = np.minimum(total[at] + np.frombuffer(count, np.uint8), 2)
        bits = np.packbits(total >= 2).tobytes()
        return pa.table({"shard": table.column("shard").slice(0, 1), "bits": pa.array([bits], pa.binary())})

    parts = keys.select("shard", "keys").mapInArrow(part, "shard int, cells binary, counts binary")
    return parts.groupBy("shard").applyInArrow(merge, "shard int, bits binary")


def _repeated(keys: DataFrame, sketches: DataFrame, sizes: DataFrame, depth: int, width: int) -> DataFrame:
    """(id, name, key) for the keys estimated repeated in all rows of the sketch."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("bits")[i].is_valid:
                    bits = np.frombuffer(batch.column("bits")[i].as_py(), np.uint8)
                    continue
                key, doc, name = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("keys", np.uint64), ("ids", np.int64), ("names", np.int32)))
                at = cells(key, depth, width)
                hit = ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)
                if hit.any():
                    yield pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array(name[hit]), pa.array(encode_signed(key[hit]))], names=["id", "name", "key"])

    # each task reads the bits of a shard, then keys of that shard; only shards above TOGETHER keys have more than one place
    places = sizes.select("shard", F.ceil(F.col("n") / TOGETHER).cast("int").alias("places")).filter("places > 1")
    count = F.coalesce("places", F.lit(1))
    own = keys.join(places, "shard", "left").select("shard", F.pmod(F.xxhash64("keys", "ids"), count).cast("int").alias("place"), F.lit(None).cast("binary").alias("bits"), "keys", "ids", "names")
    ahead = sketches.join(places, "shard", "left").select("shard", F.explode(F.sequence(F.lit(0), count - 1)).alias("place"), "bits", *(F.lit(None).cast("binary").alias(c) for c in ("keys", "ids", "names")))
    return own.unionByName(ahead).repartition("shard", "place").sortWithinPartitions("shard", "place", F.isnull("bits")).drop("shard", "place").mapInArrow(test, "id long, name int, key long")


def _windows(flagged: DataFrame, window: int, anchor: int) -> DataFrame:
    """(id, name, h, c): distinct windows, by hash and check, that were estimated repeated, for each document."""

    def rehash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = split_words(part.column("text"))
                exact, key, inside = _window_keys(words, window, anchor)
                lists = part.column("keys")
                wanted = lists.flatten().to_numpy().view(np.uint64)
                owner = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                row = words.row[: len(exact)]
                take = np.flatnonzero(inside & np.isin(_in_row(key, row), _in_row(wanted, owner)))
                _, first = np.unique(_in_row(exact[take], row[take]), return_index=True)
                take = np.sort(take[first])
                place = pa.array(row[take])
                yield pa.RecordBatch.from_arrays([part.column("id").take(place), part.column("name").take(place), pa.array(encode_signed(exact[take])), pa.array(gram_checks(words, window)[take])], names=["id", "name", "h", "c"])

    return flagged.select("id", "name", "text", "keys").mapInArrow(rehash, "id long, name int, h long, c int")


RESULT = "id long, n_words long, n_removed long, kept_sha256 string"


def _marked(part: pa.RecordBatch, window: int, lists: pa.Array | None = None, whole: np.ndarray | None = None) -> pa.RecordBatch:
    """Result rows of documents with the hashes of the windows to remove, if any; from ``whole`` rows all windows go."""
    words = split_words(part.column("text"))
    gone = np.zeros(len(words.hash), bool)
    if lists is not None and len(found := lists.flatten()):
        exact, inside = grams(words, window)
        owner = np.repeat(np.arange(part.num_rows), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
        at = np.flatnonzero(inside & np.isin(_in_row(exact, words.row[: len(exact)]), _in_row(found.to_numpy().view(np.uint64), owner)))
        step = np.zeros(len(words.hash) + 1, np.int64)
        step[at] += 1
        step[at + window] -= 1
        gone = np.cumsum(step[:-1]) > 0
    if whole is not None:
        gone |= (whole & (words.counts() >= window))[words.row]
    removed = np.bincount(words.row[gone], minlength=part.num_rows)
    shas, raw = [], words.data.tobytes()
    for i in range(part.num_rows):
        stay = np.arange(words.first[i], words.first[i + 1])
        stay = stay[~gone[stay]] if removed[i] else stay
        shas.append(hashlib.sha256(b" ".join([raw[x:y] for x, y in zip(words.start[stay].tolist(), words.end[stay].tolist())])).hexdigest())
    ids = [None if i == LAST else i for i in part.column("id").to_pylist()]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words.counts()), pa.array(removed), pa.array(shas, pa.string())], names=["id", "n_words", "n_removed", "kept_sha256"])


def _cover(ready: DataFrame, copied: IdFilter, copies: DataFrame, gone: DataFrame, window: int) -> DataFrame:
    """Result rows: copies, and documents that may have windows to remove, meet their lists; the others are done in the scan."""
    touched = IdFilter(gone, "id", "name")
    tables = copied.table, touched.table

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            other = may_hold(tables[0], batch.column("cell").to_numpy()) | may_hold(tables[1], batch.column("place").to_numpy())
            for part in slices(batch.filter(pa.array(~other)), "text"):
                yield _marked(part, window)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield _marked(part, window, part.column("gone"), part.column("later").to_numpy(zero_copy_only=False))

    some = ready.filter(touched("id", "name") & ~copied(*COPY)).select("id", "name", "text", F.lit(False).alias("later"))
    met = some.unionByName(copies).join(gone, ["id", "name"], "left").select("id", "text", "later", "gone").mapInArrow(mark, RESULT)
    rest = ready.select("id", "text", copied.cell(*COPY).alias("cell"), touched.cell("id", "name").alias("place"))
    return met.unionByName(rest.mapInArrow(done, RESULT))


def dedup_substrings(docs: DataFrame, window: int = 50, anchor: int = 25, depth: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id_col, n_words, n_removed, kept_sha256 (kept words joined by one space)."""
    text = F.col(text_col).cast("string")
    ready = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(5), text).alias("t2"))
    ready = ready.withColumn("name", F.shiftright("t1", 32).cast("int"))
    groups = ready.groupBy(*COPY).agg(F.min("id").alias("least"), F.max("id").alias("most"), F.sum(F.length("text")).alias("size"))
    shared = keep(groups.select(*COPY, "least", F.col("least") < F.col("most"), "size").toDF(*COPY, "least", "shared", "size"), "texts")
    size = shared.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
    shared = shared.filter("shared").select(*COPY, "least")
    copied = IdFilter(shared, *COPY)
    copies = ready.filter(copied(*COPY)).join(shared, COPY, "left").select("id", "name", "text", F.coalesce(F.col("id") > F.col("least"), F.lit(False)).alias("later"))
    copies = keep(copies, "copies")

    none = np.zeros(copied.bits >> 5, np.uint32)
    alone = _keys(ready.select("id", "name", "text", copied.cell(*COPY).alias("cell")), copied.table, max(16, -(-size // SHARD_BYTES)), window, anchor)
    heads = _keys(copies.filter("not later").select("id", "name", "text", F.lit(0).cast("long").alias("cell")), none, max(16, -(-size // SHARD_BYTES)), window, anchor)
    keys = keep(alone.unionByName(heads), "anchors")
    sizes = keep(keys.groupBy("shard").agg(F.sum("n").alias("n")), "sizes")
    most = sizes.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first().n
    cell_count = min(CELLS, 1 << max(10, (4 * most).bit_length()))
    repeated = _repeated(keys, _sketches(keys, depth, cell_count), sizes, depth, cell_count)
    lists = keep(repeated.groupBy("id", "name").agg(F.collect_set("key").alias("keys")), "repeated")
    discard(keys)
    flagged = ready.filter(IdFilter(lists, "id", "name")("id", "name")).join(lists, ["id", "name"])
    windows = keep(_windows(flagged, window, anchor), "windows")
    discard(lists)
    least = windows.groupBy("h", "c").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").select("h", "c", "least")
    later = join_back(windows, least, "h", "c").filter("id > least")
    gone = keep(later.groupBy("id", "name").agg(F.collect_set("h").alias("gone")), "gone")
    discard(windows)
    return _cover(ready, copied, copies, gone, window).withColumnRenamed("id", id_col)
