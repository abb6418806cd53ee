"""Best-fit packing with swap-based local search.

Documents become pieces of at most ``capacity`` tokens; only longer documents
are cut. Pieces are dealt by a hash of their row number, which is written with
them, into groups of bounded size, whatever rows are alike. In a group, each
piece in order of arrival goes into the fullest bin that holds it; then pieces
are moved or exchanged one for one and two for one between underfull bins, the
emptiest bins giving. Every step raises the sum of squared fills, so bins drain
until they are empty. The search ends when no step is left for any bin, or when
no packing could have fewer bins; if the former, it starts anew from the pieces
largest first, and the fewer bins count. There are at most about sqrt(2 *
capacity) different lengths in a bin, so all its pairs are looked at.

Each group then hands its least filled bin on; the bins handed on are opened and
packed together in groups again, until one group is left.

Null text counts as empty (one piece, the end id). Very long texts are encoded
one at a time and become many pieces. Pieces of one length are alike to the
search; ties go to the first in order of arrival. Repeated ids and rows are
separate documents. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import keep
from .lexing import slices
from .tokens import cache

PIECES = "id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32): the token pieces of each document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = cache(tokenizer).encode
        for batch in batches:
            for part in slices(batch, "text"):
                ids, offsets = encode(part.column("text"))
                raw = memoryview(ids.astype("<u4").tobytes())
                n = np.diff(offsets)
                times = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), times)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(times) - times, times)
                start = piece * capacity
                length = np.minimum(n[doc] - start, capacity)
                begin = offsets[doc] + start
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist())]
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, PIECES)


def best_fit(lengths: list[int], capacity: int, order: list[int] | None = None) -> list[list[int]]:
    """Bins of item numbers: each item, in the given order, into the fullest bin that still holds it."""
    free: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for item in range(len(lengths)) if order is None else order:
        at = bisect_left(free, (lengths[item], -1))
        if at < len(free):
            room, target = free.pop(at)
        else:
            room, target = capacity, len(bins)
            bins.append([])
        bins[target].append(item)
        if room > lengths[item]:
            insort(free, (room - lengths[item], target))
    return bins


def least_bins(size: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: the tokens need them, or the items of more than half a bin."""
    return max(-(-int(size.sum()) // capacity), int((size * 2 > capacity).sum()))


class LocalSearch:
    """Bins under moves and exchanges; ``where`` is each item's bin and ``fill`` each bin's tokens."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.size, self.capacity = np.asarray(lengths, np.int64), capacity
        self.where = np.zeros(len(self.size), np.int64)
        for b, items in enumerate(bins):
            self.where[items] = b
        self.fill = np.bincount(self.where, self.size, len(bins)).astype(np.int64)
        self.steps, self._at = 0, -1
        self._by_size = np.argsort(self.size, kind="stable")
        self._small = np.int16 if len(bins) < 1 << 15 else np.int64  # short integers are sorted in linear time

    def _under(self) -> tuple[np.ndarray, ...]:
        """Underfull bins, and of each their different sizes with an item that has it and a second one (-1: none): bins, bin, item, second."""
        if self._at != self.steps:
            self._at = self.steps
            bins = np.flatnonzero((self.fill > 0) & (self.fill < self.capacity))
            items = self._by_size[(self.fill < self.capacity)[self.where[self._by_size]]]
            items = items[np.argsort(self.where[items].astype(self._small), kind="stable")]
            bin_, size = self.where[items], self.size[items]
            new = np.ones(len(items), bool)
            new[1:] = (bin_[1:] != bin_[:-1]) | (size[1:] != size[:-1])
            first = np.flatnonzero(new)
            many = np.diff(np.append(first, len(items))) > 1
            self._state, self._two = (bins, bin_[first], items[first], np.where(many, items[np.minimum(first + 1, len(items) - 1)], -1)), None
        return self._state

    def _pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pairs of different sizes, and of two items of one size, of each underfull bin: bin, item, item."""
        if self._two is None:
            _, bin_, item, second = self._state
            twice = np.flatnonzero(second >= 0)
            found = [(bin_[twice], item[twice], second[twice])]
            apart = 1
            while len(at := np.flatnonzero(bin_[apart:] == bin_[:-apart])):
                found.append((bin_[at], item[at], item[at + apart]))
                apart += 1
            self._two = tuple(np.concatenate(x) for x in zip(*found))
        return self._two

    def _best(self, source: int, offer: np.ndarray, back: np.ndarray, target: np.ndarray) -> tuple[int, int, int]:
        """Rise of the sum of squares, the place of the offer, and the place of what comes back, for the best exchange of all."""
        if not len(offer) or not len(back):
            return 0, 0, 0
        fill = self.fill[target]
        at = np.searchsorted(offer, back + self.capacity - fill, "right") - 1
        gain = np.where((at >= 0) & (target != source), offer[at] - back, 0)
        rise = np.where(gain > 0, gain * (fill - self.fill[source] + gain), 0)
        k = int(rise.argmax())
        return int(rise[k]), int(at[k]), k

    def step(self, source: int) -> bool:
        """The step from this bin to a fuller one that raises the sum of squares most, if there is one.

        Moves, and one or two items for one; only if there is none of these, one item for two.
        """
        bins, bin_, item, second = self._under()
        own = np.flatnonzero(bin_ == source)
        one, again = item[own], second[own]
        left, right = np.triu_indices(len(own), 1)
        a = np.concatenate([one, one[again >= 0], one[left]])
        b = np.concatenate([np.full(len(one), -1), again[again >= 0], one[right]])
        sums = self.size[a] + np.where(b >= 0, self.size[b], 0)
        order = np.argsort(sums, kind="stable")
        move = self._best(source, self.size[one], np.zeros(len(bins), np.int64), bins)
        swap = self._best(source, sums[order], self.size[item], bin_)
        if max(move[0], swap[0]) > 0:
            if move[0] >= swap[0]:
                return self._take(source, int(bins[move[2]]), (int(one[move[1]]),), ())
            k = order[swap[1]]
            return self._take(source, int(bin_[swap[2]]), (int(a[k]), int(b[k]))[: 1 + (b[k] >= 0)], (int(item[swap[2]]),))
        target, a, b = self._pairs()
        rise, at, k = self._best(source, self.size[one], self.size[a] + self.size[b], target)
        return rise > 0 and self._take(source, int(target[k]), (int(one[at]),), (int(a[k]), int(b[k])))

    def _take(self, source: int, target: int, out: tuple[int, ...], back: tuple[int, ...]) -> bool:
        self.where[list(out)], self.where[list(back)] = target, source
        gain = int(self.size[list(out)].sum() - self.size[list(back)].sum())
        self.fill[source] -= gain
        self.fill[target] += gain
        self.steps += 1
        return True

    def bins(self) -> int:
        return int((self.fill > 0).sum())

    def run(self, gather_room: bool = False) -> LocalSearch:
        """Steps until no bin has one or no packing has fewer bins; then, if asked, from the least filled bin alone, so that it has the room of all."""
        least, changed = least_bins(self.size, self.capacity), True
        while changed and self.bins() > least:
            changed = False
            for source in np.argsort(self.fill, kind="stable").tolist():
                while 0 < self.fill[source] < self.capacity and self.bins() > least and self.step(source):
                    changed = True
        if gather_room:
            last = self.least_filled()
            while 0 < self.fill[last] < self.capacity and self.step(last):
                pass
        return self

    def least_filled(self) -> int:
        return int(np.where(self.fill > 0, self.fill, self.capacity + 1).argmin())


def search(lengths: list[int], capacity: int, gather_room: bool = False) -> LocalSearch:
    """Local search from best fit in order of arrival; where that is above the least number of bins, from largest first as well."""
    found = LocalSearch(best_fit(lengths, capacity), lengths, capacity).run(gather_room)
    if found.bins() > least_bins(found.size, capacity):
        order = np.argsort(-found.size, kind="stable").tolist()
        other = LocalSearch(best_fit(lengths, capacity, order), lengths, capacity).run(gather_room)
        found = other if other.bins() < found.bins() else found
    return found


def _pack_group(capacity: int, hand_on: bool):
    def pack(group: pa.Table) -> pa.Table:
        group = group.take(pa.array(np.argsort(group.column("row").to_numpy(), kind="stable")))
        lengths = group.column("length").to_pylist()
        found = search(lengths, capacity, hand_on)
        order = np.argsort(found.where, kind="stable")
        size = found.size[order]
        before = np.cumsum(size) - size
        new = np.ones(len(order), bool)
        new[1:] = found.where[order][1:] != found.where[order][:-1]
        offset = np.empty(len(order), np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(new, before, 0))
        loose = found.where == found.least_filled() if hand_on else np.zeros(len(order), bool)
        return group.append_column("bin", pa.array(found.where)).append_column("offset", pa.array(offset)).append_column("loose", pa.array(loose))

    return pack


def pack(pieces_df: DataFrame, capacity: int = 4096, group_size: int = 8192) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; ``row`` must be a number of its own for each piece.

    A sequence id holds the pass, the group and the bin; group counts follow the
    number of pieces, so a group never holds more than about ``group_size``.
    """
    left, out, number, groups = pieces_df, None, 0, 0
    while groups != 1:
        groups = max(1, -(-left.count() // group_size))
        dealt = left.select("row", "id", "piece", "start", "length", "ids_crc32", F.pmod(F.xxhash64("row", F.lit(number)), F.lit(groups)).alias("grp"))
        packed = keep(dealt.groupBy("grp").applyInArrow(_pack_group(capacity, groups > 1), f"row long, {PIECES}, grp long, bin long, offset long, loose boolean"), "packed")
        sequence = F.lit(number << 56).bitwiseOR(F.shiftleft("grp", 24)).bitwiseOR(F.col("bin"))
        done = packed.filter(~F.col("loose")).select("id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), "offset")
        out = done if out is None else out.unionByName(done)
        left, number = packed.filter("loose"), number + 1
    return out


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, group_size: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset."""
    ready = keep(pieces(docs, tokenizer, capacity, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "pieces")
    return pack(ready, capacity, group_size).withColumnRenamed("id", id_col)
