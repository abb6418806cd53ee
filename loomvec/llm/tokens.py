"""Token ids of whole texts by a public tokenizer, with a bounded cache of words.

The tokenizer lower-cases, and its pre-tokeniser never joins text across white
space nor letters with a closing ``.,!?:;``, so the ids of a text are the ids of
those pieces one after another. Each distinct piece is encoded once per worker;
a text is then put together by array lookups. Pieces are looked up by hash and
compared byte by byte with what the cache holds; one that differs is encoded by
itself, so equal hashes never give wrong ids.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .lexing import Words, ranges, same_words, split_words

END_ID = 1


class WordCache:
    """Words and their token ids, sorted by hash; starts anew when it holds ``limit`` words or 32 bytes for each."""

    def __init__(self, path: str, limit: int = 2_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.wide = self.tokenizer.get_vocab_size() > 65536
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        none, marks = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        self.known = Words(np.zeros(0, np.uint8), none, none, none, marks, marks, none)
        self.begin, self.count, self.ids = none, none, np.zeros(0, np.uint32)

    def _encode(self, words: Words, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words, one after another, and how many each has."""
        raw = words.data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(words.start[where].tolist(), words.end[where].tolist())]
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        count = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((i for x in got for i in x), np.uint32, int(count.sum())), count

    def _learn(self, words: Words, where: np.ndarray) -> None:
        ids, count = self._encode(words, where)
        old, size = self.known, words.end[where] - words.start[where]
        end = len(old.data) + np.cumsum(size)
        order = np.argsort(np.concatenate([old.hash, words.hash[where]]), kind="stable")  # two sorted runs: a merge
        both = lambda a, b: np.concatenate([a, b])[order]
        data = np.concatenate([old.data, words.data[ranges(words.start[where], size)]])
        self.known = Words(data, both(old.start, end - size), both(old.end, end), old.row, both(old.head, words.head[where]), both(old.hash, words.hash[where]), old.first)
        self.begin, self.count = both(self.begin, len(self.ids) + np.cumsum(count) - count), both(self.count, count)
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all rows, each closed by END_ID, and the row offsets into them."""
        words = split_words(column, lower=True, closing=True)
        if len(self.known.hash) > self.limit or len(self.known.data) > 32 * self.limit:
            self._clear()
        unique, first, back = np.unique(words.hash, return_index=True, return_inverse=True)
        if len(self.known.hash):
            at = np.minimum(np.searchsorted(self.known.hash, unique), len(self.known.hash) - 1)
            new = self.known.hash[at] != unique
        else:
            new = np.ones(len(unique), bool)
        if new.any():
            self._learn(words, first[new])
        at = np.searchsorted(self.known.hash, unique)[back] if len(unique) else np.zeros(0, np.int64)
        count, begin, ids = self.count[at], self.begin[at], self.ids
        other = np.flatnonzero(~same_words(words, np.arange(len(at)), self.known, at))
        if len(other):
            more, sizes = self._encode(words, other)
            count[other], begin[other] = sizes, len(ids) + np.cumsum(sizes) - sizes
            ids = np.concatenate([ids, more])
        # the end id of each row is one more entry after the row's words
        total = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=total[1:])
        length = total[words.first[1:]] - total[words.first[:-1]] + 1
        offsets = np.zeros(words.rows + 1, np.int64)
        np.cumsum(length, out=offsets[1:])
        out = np.full(offsets[-1], END_ID, np.uint32)
        target = np.arange(total[-1]) + np.repeat(words.row, count)
        out[target] = ids[ranges(begin, count)]
        return out, offsets


_CACHES: dict[str, WordCache] = {}


def cache(path: str) -> WordCache:
    """One cache per worker process and vocabulary."""
    if path not in _CACHES:
        _CACHES[path] = WordCache(path)
    return _CACHES[path]
