"""Array kernels over whole Arrow text columns: words, hashes, n-gram hashes.

A word is a maximal run of bytes other than space and ``\\t\\n\\v\\f\\r``. Those
separators are ASCII, so splitting the UTF-8 bytes equals splitting the text.
A word's hash takes eight bytes at a time through a mixing step; a gram's hash
joins the hashes of its halves the same way, so neither is linear and texts of
regular structure meet no more often than others. Work goes by whole columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_STEP = U(0x9E3779B97F4A7C15)
_JOIN = U(0xC2B2AE3D27D4EB4F)
#: Words of more bytes are hashed one by one.
LONG = 64
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CLOSING = np.zeros(256, bool)
_CLOSING[list(b".,!?:;")] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


@dataclass
class Words:
    """The words of a column: byte spans, the row of each, the first eight bytes of each, hashes, and where each row's words begin."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    head: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.first) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def split_words(column: pa.Array, lower: bool = False, closing: bool = False, separator: np.ndarray = _SEPARATOR) -> Words:
    """Words of a column; ``closing`` makes a run of ``.,!?:;`` after a letter or digit at a word's end a word of its own.

    ``separator`` says of each byte whether it parts words.
    """
    data, offsets = text_bytes(column)
    if lower:
        data = _LOWER[data]
    inside = ~separator[data]
    before = np.zeros_like(inside)
    before[1:] = inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros_like(inside)
    after[:-1] = inside[1:]
    after[edges - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    if closing and len(start):
        last = np.maximum.accumulate(np.where(_CLOSING[data], -1, np.arange(len(data))))[end - 1]
        cut = last[(last >= start) & (last < end - 1) & _PLAIN[data[last]]] + 1
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    head, value = hash_words(data, start, end)
    return Words(data, start, end, row, head, value, first)


def join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One hash of two, in this order."""
    x = left * _JOIN
    x += right
    x ^= x >> U(29)
    x *= _STEP
    x ^= x >> U(32)
    return x


def hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first eight bytes (zeros behind a shorter word) and the hash of each word."""
    size = end - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    head = eight[start] & _MASK[np.minimum(size, 8)]
    value = mix(head + size.astype(np.uint64) * _STEP)
    rest = np.flatnonzero((size > 8) & (size <= LONG))
    at = 8
    while len(rest):
        value[rest] = join(value[rest], mix(eight[start[rest] + at] & _MASK[np.minimum(size[rest] - at, 8)]))
        at += 8
        rest = rest[size[rest] > at]
    for i in np.flatnonzero(size > LONG).tolist():
        value[i] = int.from_bytes(blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return head, value


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start[i] .. start[i] + size[i] - 1 of all i, one after another."""
    total = np.cumsum(size)
    return np.repeat(start - (total - size), size) + np.arange(total[-1] if len(total) else 0)


def same_words(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Whether word i[k] of a and word j[k] of b have the same bytes."""
    size = a.end[i] - a.start[i]
    same = (size == b.end[j] - b.start[j]) & (a.head[i] == b.head[j])
    long = np.flatnonzero(same & (size > 8))
    if len(long):
        more = size[long] - 8
        differ = a.data[ranges(a.start[i[long]] + 8, more)] != b.data[ranges(b.start[j[long]] + 8, more)]
        same[long] = np.add.reduceat(differ, np.cumsum(more) - more, dtype=np.int64) == 0
    return same


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from each position, and whether they lie in one row."""
    count = len(words.hash) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    span, part, value, done = 1, words.hash, None, 0
    while span <= n:
        if n & span:  # the binary digits of n, the smallest parts last
            value = part[n - done - span :][:count] if value is None else join(part[n - done - span :][:count], value)
            done += span
        if span * 2 <= n:
            part = join(part[:-span], part[span:])
        span *= 2
    return value if n > 1 else mix(value), words.row[n - 1 :] == words.row[:count]


def gram_checks(words: Words, n: int) -> np.ndarray:
    """32 more bits for the n words from each position, independent of the hash but for the words' order."""
    count = len(words.hash) - n + 1
    if count <= 0:
        return np.zeros(0, np.int32)
    total = np.zeros(len(words.hash) + 1, np.uint64)
    np.cumsum(mix(words.hash + _JOIN), out=total[1:])
    return (mix(total[n:] - total[:-n]) >> U(32)).astype(np.uint32).view(np.int32)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    if len(values) < width:
        return values[:0]
    span, low = 1, values
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    return low


def slices(batch: pa.RecordBatch, text: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about ``limit`` bytes, so that memory stays bounded."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
    total, begin = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > begin and total + size > limit:
            yield batch.slice(begin, i - begin)
            total, begin = 0, i
        total += size
    yield batch.slice(begin)


def encode_signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)
