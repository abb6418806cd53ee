"""Importance resampling towards a target distribution, by a dictionary of distinct features.

The features of a text are its runs of 1 to ``RUN`` consecutive words. Each
position of a text begins one run of each length, and the shorter ones are
prefixes of the longest, so only the longest run of each position travels; at a
text's end it is shorter.

1. ``postings``: a task takes documents in blocks of some BLOCK_BYTES and counts
   each block's distinct runs by document. Runs are dealt into cells by their
   words. Blocks are held, compressed, up to HELD_BYTES, and a row has what such
   a group of blocks has for a cell: the strings, once a block each, and their
   documents and counts, compressed. A run that makes up more than
   a 64th of its block goes to a cell of the block's own choice, so one very common
   string is never dealt to one task.
2. ``bucket_sums``: the strings of a cell, from all blocks, become a dictionary:
   each distinct string is hashed once, its prefixes with it, and its count goes
   to its bucket. Hashes of longer strings are put together from those of their
   words. Buckets are summed over all cells.
3. ``weights``: the gains of all buckets, one array of BUCKETS numbers, come back
   to each cell's dictionary and from there to the documents' counts; sums go
   back to the groups, which give one row for each document. The shuffle of the
   postings is made once for steps 2 and 3.
4. ``draw``: Gumbel noise from a hash of the identifier makes the highest scores
   a draw without replacement; positions come from range partitions.

A string that is a prefix of others is hashed once in each cell that holds it.
Memory is bounded by BLOCK_BYTES, HELD_BYTES, CELL_BYTES and the longest text; the
number of cells follows the size of the texts. Block numbers come from the place in the
input, which a repeated task sees again.

Null and empty texts have no features and weight 0; they keep their row. Very
long texts are taken whole. Rows that repeat an identifier are documents of
their own; a null identifier counts as an empty string in the noise and sorts
behind all others. Equal scores and identifiers are ranked in any order. Empty
tables give empty results; extra columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import dense_index
from ..plans.scratch import keep, width
from .lexing import U, Words, join, mix, ranges, same_words, slices, split_words

RUN = 3
BUCKETS = 10_000
BLOCK_BYTES = 2 << 20
BLOCK_ROWS = 50_000
CELL_BYTES = 4 << 20
#: Compressed postings that a task holds, so that its rows do not get too small where cells are many.
HELD_BYTES = 48 << 20
HELD_ROWS = 500_000
#: Ranges of cells in which held postings are compressed.
SHELVES = 64
#: Postings sent on at once.
SENT_BYTES = 4 << 20
#: Pieces in which the sums of all buckets are shuffled.
PARTS = 16
#: Runs whose strings are put together at once.
TOGETHER = 1 << 16
POSTINGS = "cell int, block long, strings binary, documents binary, counts binary, sizes array<long>, ids binary, known binary, words binary"
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_ZSTD = pa.Codec("zstd", compression_level=3)
_FAST = pa.Codec("zstd", compression_level=1)


def _powers() -> np.ndarray:
    """For each bit of a length, a table that moves a CRC-32 on by so many bytes: [bit, byte of the CRC, value]."""
    step = np.array([[zlib.crc32(b"\0", v << 8 * j) ^ zlib.crc32(b"\0") for v in range(256)] for j in range(4)], np.uint32)
    out = [step]
    while len(out) < 32:
        out.append(_moved(out[-1], out[-1]))
    return np.stack(out)


def _moved(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


_POWERS = _powers()


def crc_joined(left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings, one behind the other, from those of the two and the size of the right one."""
    out, bit = left.copy(), 0
    while len(size) and int(size.max()) >> bit:
        at = np.flatnonzero((size >> bit) & 1)
        out[at] = _moved(_POWERS[bit], out[at])
        bit += 1
    return out ^ right


def _encoded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each distinct value, in order of appearance, and these values."""
    out = values.dictionary_encode()
    return out.indices.to_numpy(), out.dictionary


def _strings(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """An Arrow array of the strings that lie one behind the other in ``data``, without a copy of the bytes."""
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64, copy=False)), pa.py_buffer(data)])


def _numbered(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """A number for each distinct word, and the first place of each; words of one hash that differ are told apart."""
    number, found = _encoded(pa.array(words.hash))
    number, first = number.astype(np.int64), np.zeros(len(found), np.int64)
    first[number[::-1]] = np.arange(len(number))[::-1]  # the first place is written last
    other = np.flatnonzero(~same_words(words, np.arange(len(number)), words, first[number]))
    if len(other):
        raw, more = words.data.tobytes(), {}
        for i in other.tolist():
            word = raw[words.start[i] : words.end[i]]
            number[i] = more.setdefault(word, len(first) + len(more))
        first = np.append(first, [int(other[np.flatnonzero(number[other] == len(first) + k)[0]]) for k in range(len(more))])
    return number, first


def _compressed(x: np.ndarray, codec: pa.Codec = _ZSTD) -> tuple[bytes, int]:
    """An array's bytes, the lowest of all numbers first, and their size before compression."""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T)
    return codec.compress(raw, asbytes=True), raw.nbytes


def _array(data: bytes, size: int, kind: str = "<u4") -> np.ndarray:
    raw = np.frombuffer(_ZSTD.decompress(data, size, asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _spelt(words: Words, number: np.ndarray, first: np.ndarray, head: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strings of runs, words with a space behind each and a new line behind the last, and where each run begins."""
    length = words.end[first] - words.start[first] + 1
    data = np.append(words.data, np.uint8(32))[ranges(words.start[first], length)]
    data[np.cumsum(length) - 1] = 32
    spelt, texts, at = _strings(data, np.append(0, np.cumsum(length))), [], [np.zeros(1, np.int64)]
    for a in range(0, len(head), TOGETHER):
        taken = spelt.take(pa.array(number[ranges(head[a : a + TOGETHER], size[a : a + TOGETHER])]))
        ends = np.frombuffer(taken.buffers()[1], np.int64)[np.cumsum(size[a : a + TOGETHER])]
        text = np.frombuffer(taken.buffers()[2], np.uint8)[: ends[-1]].copy()
        text[ends - 1] = 10
        texts.append(text)
        at.append(at[-1][-1] + ends)
    return np.concatenate(texts), np.concatenate(at)


def _dealt(words: Words, cells: int, block: int) -> tuple[np.ndarray, ...]:
    """A block's runs by cell: the cells, where the runs, postings and bytes of each begin; strings, documents a run, documents and counts."""
    n = len(words.hash)
    number, first = _numbered(words)
    v = len(first) + 1
    left = words.first[1:][words.row] - np.arange(n)  # words of the text from here on
    size = np.minimum(left, RUN)
    key = number.astype(np.int64) + 1
    for k in range(1, RUN):
        later = np.zeros(n, np.int64)
        later[: n - k] = np.where(left[: n - k] > k, number[k:] + 1, 0)
        if int(key.max()) >= (1 << 62) // v:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key * v + later
    order = np.argsort(key)
    key = key[order]
    run_new = np.ones(n, bool)
    run_new[1:] = key[1:] != key[:-1]
    both = np.sort((np.cumsum(run_new) - 1) * words.rows + words.row[order])  # run and row
    place = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
    count, run, document = np.diff(np.append(place, n)), *np.divmod(both[place], words.rows)
    head = order[run_new]  # a place where each distinct run stands
    del key, order, both, later
    documents = np.bincount(run)
    mark = words.hash[head]
    for k in range(1, RUN):
        there = size[head] > k
        mark = np.where(there, join(mark, words.hash[np.minimum(head + k, n - 1)]), mark)
    cell = (mix(mark) % U(cells)).astype(np.int64)
    hot = documents > max(64, len(place) >> 6)
    cell[hot] = (cell[hot] + block) % cells
    if cells <= 1 << 16:
        cell = cell.astype(np.uint16)  # which are sorted by digits
    by_cell = np.argsort(cell, kind="stable")
    head, documents_of, cell_of = head[by_cell], documents[by_cell], cell[by_cell]
    posts = np.argsort(cell[run], kind="stable")
    document, count, post_cell = document[posts], count[posts], cell[run][posts]
    text, byte_of = _spelt(words, number, first, head, size[head])
    found, run_at = np.unique(cell_of, return_index=True)
    run_at, post_at = np.append(run_at, len(cell_of)), np.append(np.searchsorted(post_cell, found), len(post_cell))
    return found, run_at, post_at, byte_of[run_at], text, documents_of, document, count


class Group:
    """Blocks whose postings are written together."""

    def __init__(self, cells: int):
        self.cells, self.step = cells, -(-cells // SHELVES)
        self.shelves: list[list[tuple]] = [[] for _ in range(0, cells, self.step)]
        self.words: list[np.ndarray] = []
        self.rows = self.bytes = 0

    def add(self, texts: pa.Array, block: int) -> None:
        words = split_words(texts, lower=True, separator=_SEPARATOR)
        self.words.append(words.counts().astype("<i8"))
        if len(words.hash):
            found, *at, text, documents_of, document, count = _dealt(words, self.cells, block)
            document = document + self.rows
            cut = np.searchsorted(found, np.arange(0, self.cells + self.step, self.step))
            for shelf, a, b in zip(self.shelves, cut[:-1].tolist(), cut[1:].tolist()):
                if b > a:
                    run, post, byte = (slice(x[a], x[b]) for x in at)
                    parts = text[byte], documents_of[run].astype("<u4"), document[post].astype("<u4"), count[post].astype("<u4")
                    shelf.append((found[a:b].copy(), [x[a : b + 1] - x[a] for x in at], [_compressed(x, _FAST) for x in parts]))
                    self.bytes += sum(len(data) for data, _ in shelf[-1][2]) + 32 * (b - a)
        self.rows += words.rows

    def postings(self) -> Iterator[dict]:
        """The words of each text, then one row a cell; what has been given is held no longer."""
        yield {"words": np.concatenate(self.words)}
        for shelf in self.shelves:
            cells: dict[int, list[tuple]] = {}
            for found, (run_at, post_at, byte_at), parts in shelf:
                text, documents_of, document, count = (_array(*x, kind) for x, kind in zip(parts, ("u1", "<u4", "<u4", "<u4")))
                ends = run_at.tolist(), post_at.tolist(), byte_at.tolist()
                for i, c in enumerate(found.tolist()):
                    run, post, byte = (slice(x[i], x[i + 1]) for x in ends)
                    cells.setdefault(c, []).append((text[byte], documents_of[run], document[post], count[post]))
            shelf.clear()
            for c, parts in cells.items():
                text, documents_of, document, count = (np.concatenate(x) for x in zip(*parts))
                packed = _compressed(text), _compressed(np.concatenate([documents_of, document])), _compressed(count)
                yield {"cell": c, **dict(zip(("strings", "documents", "counts"), (data for data, _ in packed))), "sizes": [*(size for _, size in packed), len(documents_of)]}


def _block(texts: pa.Array, cells: int, block: int) -> Iterator[dict]:
    """A block's postings by themselves."""
    group = Group(cells)
    group.add(texts, block)
    yield from group.postings()


def cell_count(texts: DataFrame, text_col: str) -> int:
    """As many cells as the texts need."""
    size = texts.agg(F.sum(F.octet_length(F.col(text_col).cast("string"))).alias("n")).first().n or 0
    return max(width(texts.sparkSession), -(-size // CELL_BYTES))


def postings(docs: DataFrame, id_col: str | None, text_col: str, cells: int) -> DataFrame:
    """Rows of the runs of a group of blocks for a cell, and one row a group of its documents' identifiers and words; ``block`` is the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done, groups, held, size = TaskContext.get().partitionId(), 0, 0, [], 0
        group, ids = Group(cells), []

        def close() -> None:
            nonlocal done, size
            table = pa.Table.from_batches(held).combine_chunks()
            group.add(table.column("text").combine_chunks(), (task << 32) + done)
            ids.append(table.column("id").combine_chunks())
            done, size = done + 1, 0
            held.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal group, groups
            number, found = (task << 32) + groups, pa.chunked_array(ids)
            fields, sent = {f.name: [] for f in schema}, 0
            for row in group.postings():
                if "words" in row:
                    known = np.asarray(found.is_valid())
                    row = {"cell": number % cells, "ids": found.fill_null(0).to_numpy().astype("<i8").tobytes(), "known": known.astype(np.uint8).tobytes(), "words": row["words"].tobytes()}
                for name in fields:
                    fields[name].append(number if name == "block" else row.get(name))
                sent += sum(len(x) for x in row.values() if isinstance(x, bytes))
                if len(fields["cell"]) >= 1000 or sent >= SENT_BYTES:
                    yield pa.RecordBatch.from_pydict(fields, schema=schema)
                    fields, sent = {f.name: [] for f in schema}, 0
            yield pa.RecordBatch.from_pydict(fields, schema=schema)
            group, groups = Group(cells), groups + 1
            ids.clear()

        for batch in batches:
            for part in slices(batch, "text"):
                held.append(part)
                size += part.column("text").nbytes
                if size >= BLOCK_BYTES or sum(p.num_rows for p in held) >= BLOCK_ROWS:
                    close()
                    if group.bytes >= HELD_BYTES or group.rows >= HELD_ROWS:
                        yield from flush()
        if held:
            close()
        if ids:
            yield from flush()

    schema = pa.schema([("cell", pa.int32()), ("block", pa.int64()), *((n, pa.binary()) for n in ("strings", "documents", "counts")), ("sizes", pa.list_(pa.int64())), *((n, pa.binary()) for n in ("ids", "known", "words"))])
    source = docs.select((F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return source.mapInArrow(run, POSTINGS)


class Dictionary:
    """The distinct strings of a cell by length: their buckets, and of each run the number of its string of each length (-1: none)."""

    def __init__(self, rows: list[dict]):
        data = np.frombuffer(b"\n" + b"".join(_ZSTD.decompress(r["strings"], r["sizes"][0], asbytes=True) for r in rows), np.uint8).copy()
        at = np.flatnonzero((data == 32) | (data == 10))  # before each word, and at the end
        first = np.flatnonzero(data[at] == 10)
        first, size = first[:-1], np.diff(first)
        data[at] = 32
        number, spelt = _encoded(_strings(data, at))
        del data, at
        length = pc.binary_length(spelt).to_numpy()  # with the space before the word
        spaced = np.fromiter(map(zlib.crc32, spelt.to_numpy(zero_copy_only=False)), np.uint32, len(spelt))
        crc = crc_joined(np.full(len(spelt), zlib.crc32(b" "), np.uint32), spaced, length - 1)  # what the space added is taken out
        self.buckets, self.strings = [crc % BUCKETS], [number[first]]
        for k in range(1, RUN):
            there = np.flatnonzero(size > k)
            back, both = _encoded(pa.array(self.strings[-1][there].astype(np.int64) * len(spelt) + number[first[there] + k]))
            shorter, word = np.divmod(both.to_numpy(), max(1, len(spelt)))
            crc = crc_joined(crc[shorter], spaced[word], length[word])
            string = np.full(len(size), -1, np.int32)
            string[there] = back
            self.buckets.append(crc % BUCKETS)
            self.strings.append(string)

    def sums(self, count: np.ndarray) -> np.ndarray:
        """Features in each bucket, from each run's count."""
        total = np.zeros(BUCKETS)
        for bucket, string in zip(self.buckets, self.strings):
            there = string >= 0
            total += np.bincount(bucket, np.bincount(string[there], count[there], len(bucket)), BUCKETS)
        return total.astype(np.int64)

    def gains(self, gain: np.ndarray) -> np.ndarray:
        """Sum of the gains of each run's strings."""
        total = np.zeros(len(self.strings[0]), np.int64)
        for bucket, string in zip(self.buckets, self.strings):
            there = string >= 0
            total[there] += gain[bucket][string[there]]
        return total


def _unpacked(rows: list[dict]) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Of each row: documents a run, the documents, and their counts."""
    many, documents, counts = [], [], []
    for r in rows:
        both, runs = _array(r["documents"], r["sizes"][1]), r["sizes"][3]
        many.append(both[:runs].astype(np.int64))
        documents.append(both[runs:].astype(np.int64))
        counts.append(_array(r["counts"], r["sizes"][2]).astype(np.int64))
    return many, documents, counts


def bucket_sums(posted: DataFrame) -> DataFrame:
    """bucket, n: features of all documents in each bucket that has any.

    A cell's sums travel as PARTS packed arrays, which are shuffled as they are: to add them up in the task that made
    them would take a second Python worker beside each that holds a cell.
    """
    size, packed = -(-BUCKETS // PARTS), "part int, sums binary"

    def total(table: pa.Table) -> pa.Table:
        rows = table.filter(pc.is_valid(table.column("strings"))).to_pylist()
        if not rows:
            return pa.table({"part": pa.array([], pa.int32()), "sums": pa.array([], pa.binary())})
        many, _, counts = _unpacked(rows)
        sums = Dictionary(rows).sums(np.concatenate([np.add.reduceat(c, np.cumsum(m) - m) for m, c in zip(many, counts)]))
        return pa.table({"part": np.arange(PARTS, dtype=np.int32), "sums": [_compressed(sums[p * size : (p + 1) * size])[0] for p in range(PARTS)]})

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, sums in zip(batch.column("part").to_pylist(), batch.column("sums").to_pylist()):
                sums = _array(sums, 8 * (min(BUCKETS, (p + 1) * size) - p * size), "<i8")
                held[p] = held[p] + sums if p in held else sums
        for p, sums in held.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at + p * size, pa.int32()), pa.array(sums[at])], names=["bucket", "n"])

    added = posted.groupBy("cell").applyInArrow(total, packed)
    return added.repartition(PARTS, "part").mapInArrow(spread, "bucket int, n long")


def bucket_gains(source: DataFrame, target: DataFrame) -> DataFrame:
    """One row: an array of the gains of all buckets, floor(1000 * log ratio of the smoothed shares)."""
    spark = source.sparkSession
    s, t = source.withColumnRenamed("n", "s"), target.withColumnRenamed("n", "t")
    every = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left")
    every = every.select("bucket", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")))
    row = every.agg(F.sort_array(F.collect_list(F.struct("bucket", "s", "t"))).alias("all"), F.sum("s").alias("S"), F.sum("t").alias("T"))
    ratio = lambda c: (c["t"] + 1.0) * (F.col("S") + float(BUCKETS)) / ((c["s"] + 1.0) * (F.col("T") + float(BUCKETS)))
    return row.select(F.transform("all", lambda c: F.floor(F.log(ratio(c)) * 1000.0).cast("long")).alias("gains"))


def weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """Per document: id_col, n_words, n_features, weight."""
    cells = cell_count(docs, text_col)
    posted = postings(docs, id_col, text_col, cells)
    aim = bucket_sums(postings(target, None, target_text_col, cell_count(target, target_text_col)))
    gains = docs.sparkSession.range(cells).select(F.col("id").cast("int").alias("cell")).crossJoin(F.broadcast(bucket_gains(bucket_sums(posted), aim)))

    def back(table: pa.Table, gain: pa.Table) -> pa.Table:
        out = {c: [] for c in ("block", "documents", "sums", "ids", "known", "words")}

        def put(**row: object) -> None:
            for c in out:
                out[c].append(row.get(c))

        for r in table.filter(pc.is_valid(table.column("ids"))).to_pylist():
            put(block=r["block"], ids=r["ids"], known=r["known"], words=r["words"])
        rows = table.filter(pc.is_valid(table.column("strings"))).to_pylist()
        if rows:
            many, documents, counts = _unpacked(rows)
            of_run = Dictionary(rows).gains(gain.column("gains").combine_chunks().flatten().to_numpy().astype(np.int64))
            cut = np.cumsum([0, *map(len, many)])
            for r, m, d, c, a, b in zip(rows, many, documents, counts, cut[:-1], cut[1:]):
                which, place = np.unique(d, return_inverse=True)
                sums = np.bincount(place, np.repeat(of_run[a:b], m) * c, len(which))  # whole numbers far below 2**53
                put(block=r["block"], documents=_compressed(which.astype("<u4"))[0], sums=_compressed(sums.astype("<i8"))[0], words=np.int64(len(which)).tobytes())
        kinds = {"block": pa.int64()}
        return pa.table({c: pa.array(v, kinds.get(c, pa.binary())) for c, v in out.items()})

    parts = posted.groupBy("cell").cogroup(gains.groupBy("cell")).applyInArrow(back, "block long, documents binary, sums binary, ids binary, known binary, words binary")

    def whole(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = next(r for r in rows if r["ids"] is not None)
        ids, known, words = np.frombuffer(head["ids"], "<i8"), np.frombuffer(head["known"], np.uint8).astype(bool), np.frombuffer(head["words"], "<i8")
        weight = np.zeros(len(ids), np.int64)
        for r in rows:
            if r["ids"] is None:
                n = int(np.frombuffer(r["words"], "<i8")[0])
                weight[_array(r["documents"], 4 * n)] += _array(r["sums"], 8 * n, "<i8")
        features = sum(np.maximum(words - k, 0) for k in range(RUN))
        return pa.table({"id": pa.array(ids, mask=~known), "n_words": words, "n_features": features, "weight": weight})

    return parts.groupBy("block").applyInArrow(whole, "id long, n_words long, n_features long, weight long").withColumnRenamed("id", id_col)


def scored(weighted: DataFrame, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """``weighted`` and its score: the weight and Gumbel noise in thousandths, from a hash of the seed and the identifier."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000.0).cast("long")
    return weighted.withColumn("score", F.col("weight") + noise)


def draw(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id_col, n_features, weight, score, and rank (from 1) if it is drawn.

    Of the documents of ``least_words`` or more, ``percent`` in a hundred are drawn.
    """
    rows = keep(scored(weights(docs, target, id_col, text_col), seed, id_col), "scored")
    drawn = percent * rows.filter(F.col("n_words") >= least_words).count() // 100
    order = rows.filter(F.col("n_words") >= least_words).withColumns({"down": -F.col("score"), "unnamed": F.col(id_col).isNull()})
    ranked = dense_index(order, [], ["down", "unnamed", id_col], "at").withColumn("rank", F.when(F.col("at") < drawn, F.col("at") + 1))
    columns = [id_col, "n_features", "weight", "score", "rank"]
    return ranked.select(columns).unionByName(rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")).select(columns))
