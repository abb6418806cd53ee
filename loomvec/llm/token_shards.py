"""Token ids in sorted-string-table shards.

Documents are range-partitioned by identifier, text hash and row number, so
that equal rows are split too; the number of partitions follows the size of the
texts. Each partition becomes one file:

    magic | blocks | sparse index | Bloom filter | footer

A block holds entries ``shared, fresh, length (uint32 each), key suffix, ids``:
each key keeps only what differs from the key before it, and every block starts
with a whole key. The index has the last key, place, length and first token
number of each block. The footer has the places and sizes of index and filter,
counts, and the width of an id (2 bytes where the vocabulary allows it, else 4).
A key is a flag byte (0: null id) and the id as 8 big-endian bytes with the sign
bit turned, so that byte order is id order.

Files are written under a fresh name by each task attempt and become visible
only through the manifest that the finished tasks return, so lost or repeated
tasks do no harm. Nulls in the text count as empty. Null ids come first.
Repeated ids stay separate entries, ordered by a hash of their text; equal rows
are entries of equal content in any order. Very long texts are encoded one at a
time and make a block of their own size. An empty table has no file.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import fresh, keep, width
from .lexing import slices
from .tokens import cache

MAGIC = b"LVSST001"
_ENTRY = struct.Struct("<III")
_INDEX = struct.Struct("<HQIIQ")
_FOOTER = struct.Struct("<QQQQQQBB6x8s")
BLOCK = 64 << 10
BLOOM_BITS = 10
#: Text bytes for a shard; small tables have smaller ones, so that all cores work.
SHARD_BYTES, LEAST_BYTES = 256 << 20, 4 << 20
MANIFEST = "shard int, path string, entries long, tokens long, bytes long"
ROWS = "id long, start long, n_tokens long, ids_crc32 long"


def key_of(doc_id: int | None) -> bytes:
    return b"\0" + bytes(8) if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & (2**64 - 1))


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x5BD1E995) | 1
    return [(a + i * b) % bits for i in range(7)]


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class ShardWriter:
    """Appends sorted entries to a stream, keeping one block and the sparse index in memory."""

    def __init__(self, out, wide: bool):
        self.out, self.wide = out, wide
        self.at = self.out.write(MAGIC) and len(MAGIC)
        self.block, self.before, self.block_first = io.BytesIO(), b"", 0
        self.index: list[tuple[bytes, int, int, int, int]] = []
        self.keys: list[bytes] = []
        self.in_block = self.tokens = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.in_block:
            while shared < len(key) and key[shared] == self.before[shared]:
                shared += 1
        value = ids.astype("<u4" if self.wide else "<u2").tobytes()
        self.block.write(_ENTRY.pack(shared, len(key) - shared, len(value)) + key[shared:])
        self.block.write(value)
        self.before, self.in_block = key, self.in_block + 1
        self.tokens += len(ids)
        self.keys.append(key)
        if self.block.tell() >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.in_block:
            data = self.block.getvalue()
            self.out.write(data)
            self.index.append((self.before, self.at, len(data), self.in_block, self.block_first))
            self.at += len(data)
            self.block, self.in_block, self.block_first = io.BytesIO(), 0, self.tokens

    def close(self) -> int:
        self._flush()
        index = b"".join(_INDEX.pack(len(k), at, size, n, first) + k for k, at, size, n, first in self.index)
        bits = max(64, BLOOM_BITS * len(self.keys) + 7 & ~7)
        bloom = np.zeros(bits, bool)
        for key in self.keys:
            bloom[_probes(key, bits)] = True
        packed = np.packbits(bloom, bitorder="little").tobytes()
        self.out.write(index)
        self.out.write(packed)
        self.out.write(_FOOTER.pack(self.at, len(index), self.at + len(index), len(packed), len(self.keys), self.tokens, 4 if self.wide else 2, 1, MAGIC))
        return self.at + len(index) + len(packed) + _FOOTER.size


class ShardReader:
    """Reads a shard: footer, index and filter at once, blocks on demand."""

    def __init__(self, path: str):
        filesystem, name = _filesystem(path)
        self.file = filesystem.open_input_file(name)
        size = self.file.size()
        head = self.file.read_at(_FOOTER.size, size - _FOOTER.size)
        index_at, index_size, bloom_at, bloom_size, self.entries, self.tokens, self.id_bytes, _, magic = _FOOTER.unpack(head)
        if magic != MAGIC:
            raise ValueError(f"{path} is not a token shard")
        raw, self.index, at = self.file.read_at(index_size, index_at), [], 0
        while at < len(raw):
            n, place, length, count, first = _INDEX.unpack_from(raw, at)
            at += _INDEX.size
            self.index.append((raw[at : at + n], place, length, count, first))
            at += n
        self.bloom = np.unpackbits(np.frombuffer(self.file.read_at(bloom_size, bloom_at), np.uint8), bitorder="little")

    def block(self, number: int) -> Iterator[tuple[bytes, int, np.ndarray]]:
        """(key, token number, ids) of each entry of a block."""
        _, place, length, count, number_at = self.index[number]
        raw, at, key = self.file.read_at(length, place), 0, b""
        for _ in range(count):
            shared, new, size = _ENTRY.unpack_from(raw, at)
            at += _ENTRY.size
            key = key[:shared] + raw[at : at + new]
            at += new
            ids = np.frombuffer(raw, f"<u{self.id_bytes}", size // self.id_bytes, at)
            at += size
            yield key, number_at, ids
            number_at += len(ids)

    def __iter__(self) -> Iterator[tuple[bytes, int, np.ndarray]]:
        for number in range(len(self.index)):
            yield from self.block(number)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Token ids of every entry with this id: the filter, then a binary search of the index, then one block or more."""
        key = key_of(doc_id)
        if not all(self.bloom[p] for p in _probes(key, len(self.bloom))):
            return []
        low, high = 0, len(self.index)
        while low < high:
            middle = (low + high) // 2
            if self.index[middle][0] < key:
                low = middle + 1
            else:
                high = middle
        found = []
        while low < len(self.index):
            found += [ids.copy() for k, _, ids in self.block(low) if k == key]
            if self.index[low][0] > key:
                break
            low += 1
        return found


def write_shards(docs: DataFrame, tokenizer: str, path: str, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards under ``path`` and return the manifest, one row per shard in key order."""
    spark = docs.sparkSession

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        words, writer = cache(tokenizer), None
        for batch in batches:
            for part in slices(batch, "text"):
                if writer is None:
                    filesystem, folder = _filesystem(path)
                    filesystem.create_dir(folder, recursive=True)
                    name = f"shard-{number:06d}-{uuid.uuid4().hex}.sst"
                    stream = filesystem.open_output_stream(f"{folder}/{name}")
                    writer = ShardWriter(stream, words.wide)
                ids, offsets = words.encode(part.column("text"))
                for i, doc_id in enumerate(part.column("id").to_pylist()):
                    writer.add(key_of(doc_id), ids[offsets[i] : offsets[i + 1]])
        if writer is not None:
            size = writer.close()
            stream.close()
            yield pa.RecordBatch.from_pylist([{"shard": number, "path": f"{path}/{name}", "entries": len(writer.keys), "tokens": writer.tokens, "bytes": size}], schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("entries", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())]))

    ready = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    if shards is None:
        size = ready.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
        shards = max(-(-size // SHARD_BYTES), min(width(spark), -(-size // LEAST_BYTES)), 1)
    order = F.col("id").asc_nulls_first(), F.xxhash64("text"), F.col("row")
    ready = ready.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(shards, *order).sortWithinPartitions(*order).select("id", "text")
    return keep(ready.mapInArrow(build, MANIFEST), "manifest")


def read_shards(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Per entry of the files: id, start (tokens of all entries before it), n_tokens, ids_crc32 of the ids as uint32."""
    # one row per shard: as many as the job had partitions
    rows = sorted((r.shard, r.path, r.tokens) for r in manifest.select("shard", "path", "tokens").collect())
    bases, total = [], 0
    for shard, path, tokens in rows:
        bases.append((shard, path, total))
        total += tokens

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                reader = ShardReader(place)
                for number in range(len(reader.index)):
                    got = [(id_of(key), base + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for key, at, ids in reader.block(number)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got)], names=["id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame(bases, "shard int, path string, base long")
    return files.repartition(max(1, len(bases))).mapInArrow(scan, ROWS)


def token_table(docs: DataFrame, tokenizer: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all of ``docs`` as shards and describe every document from what the files hold."""
    spark = docs.sparkSession
    manifest = write_shards(docs, tokenizer, path or fresh(spark, "tokens"), id_col=id_col, text_col=text_col)
    return read_shards(spark, manifest).withColumnRenamed("id", id_col)
