"""Secret scan by grammar inference.

Base rules find credentials of three kinds. A bounded, reproducible sample of
those labelled credentials (``sample`` values a kind by least hash, as long as
they have ``characters`` characters together; values of more than LONGEST are
not learnt from) trains one probabilistic automaton a kind: a prefix tree of
character classes, of whole values, whose states are merged when their outgoing
frequencies agree within the Hoeffding bound. Every other token that could be a
credential, six characters or more of the alphabet of the first rule, is then
scored whole by each automaton. It becomes a span of kind ``format`` if for some
kind

* it is as long as the kind's rule asks,
* its mean log-likelihood per character reaches a low quantile of what labelled
  credentials score by automata that were fitted without them, and
* its log-likelihood exceeds that by the background by log(kinds / ``alarm``).

The background is a character bigram model of all tokens of all texts that no
base span touches; a token counts once in each text. It is counted twice: the
second time without the tokens that by the first count pass all three tests, so
that bare keys do not become ordinary by being many (where they make up most of
the tokens with rare symbols, some still do).
By Markov's inequality a token drawn from the background passes the last test
with a chance of at most ``alarm``. A kind without credentials has no automaton.

Spans are in code points, end exclusive, ordered by start; at a tie as the kinds
are listed, ``format`` last. Base spans always stay; a format span never overlaps
one. Null text counts as empty. Very long texts and tokens are scanned and scored
whole, one text at a time, in linear time. Repeated ids and rows are separate
documents, one result row each. Empty tables give empty results. The texts are
read three times; the table of found credentials and counts is deleted as soon as the
models are fitted.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.scratch import discard, keep
from .lexing import slices

KINDS = ("assign", "access", "hex")
_NAME = "|".join(["password", "passwd", "secret", "token", "api_?key"])
_NAME = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in _NAME)
ASSIGN = re.compile(rf"""(?:{_NAME})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".encode())
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-][A-Za-z0-9+/_.=-]{4,}[A-Za-z0-9+/_=-]")
_QUICK = re.compile(rb"[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6}")
#: Bytes of tokens whose verdict a worker remembers, and the longest such token.
MEMORY = 64 << 20
REMEMBERED = 256
#: Longest credential that an automaton learns from, and the least length of each kind.
LONGEST = 4096
SHORTEST = {"assign": 6, "access": 20, "hex": 24}
#: Symbols of tokens; 0 is a token's beginning and end.
_ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
_CODE = np.zeros(256, np.int64)
_CODE[list(_ALPHABET)] = np.arange(1, len(_ALPHABET) + 1)
_SYMBOL_COUNT = len(_ALPHABET) + 1
SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"


def base_spans(text: bytes) -> list[tuple[int, int, str, bytes]]:
    """(start, end, kind, credential) in bytes, ordered by start and then as KINDS lists them."""
    found = []
    if _QUICK.search(text):
        found += [(m.start(), m.end(), 0, m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if b"AKIA" in text:
        found += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2, m[0]) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k], v) for a, b, k, v in sorted(found, key=lambda s: (s[0], s[2]))]


_CLASSES = {**{c: ("d", 10) for c in range(48, 58)}, **{c: ("h", 6) for c in range(97, 103)}, **{c: ("l", 20) for c in range(103, 123)}, **{c: ("H", 6) for c in range(65, 71)}, **{c: ("L", 20) for c in range(71, 91)}}


_SYMBOLS = [(name, math.log(size)) for name, size in (_CLASSES.get(c, (chr(c), 1)) for c in range(256))]


def symbols(value: bytes) -> Iterator[tuple[str, float]]:
    """Character class and log of its size, for each character."""
    return (_SYMBOLS[c] for c in value)


@dataclass
class Automaton:
    """Merged prefix-tree states: arrivals, endings, and per symbol a count and a next state."""

    arrivals: list[int] = field(default_factory=lambda: [0])
    endings: list[int] = field(default_factory=lambda: [0])
    edges: list[dict[str, tuple[int, int]]] = field(default_factory=lambda: [{}])

    def score(self, value: bytes, least: float = -math.inf) -> float:
        """Mean log-likelihood per character, the ending included; unseen steps cost one in ten thousand.

        Every step lowers the sum: once the mean cannot reach ``least``, the value so far is returned.
        """
        state, total, enough = 0, 0.0, least * (len(value) + 1)
        for name, share in symbols(value):
            count, after = self.edges[state].get(name, (0, state))
            total += math.log((count + 1e-4) / (self.arrivals[state] + 1e-2)) - share
            if total < enough:
                return total / (len(value) + 1)
            state = after
        total += math.log((self.endings[state] + 1e-4) / (self.arrivals[state] + 1e-2))
        return total / (len(value) + 1)


def infer(values: list[bytes], alpha: float = 0.01) -> Automaton:
    """Merge the states of the values' prefix tree that are statistically compatible."""
    arrivals, endings, edges = [0], [0], [{}]
    for value in values:
        state = 0
        arrivals[0] += 1
        for name, _ in symbols(value):
            if name not in edges[state]:
                edges[state][name] = [0, len(edges)]
                arrivals.append(0)
                endings.append(0)
                edges.append({})
            edges[state][name][0] += 1
            state = edges[state][name][1]
            arrivals[state] += 1
        endings[state] += 1

    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(f: int, n: int, g: int, m: int) -> bool:
        return n > 0 and m > 0 and abs(f / n - g / m) > bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            n, m = arrivals[p], arrivals[q]
            if differ(endings[p], n, endings[q], m):
                return False
            for name in {*edges[p], *edges[q]}:
                x, y = edges[p].get(name), edges[q].get(name)
                if differ(x[0] if x else 0, n, y[0] if y else 0, m):
                    return False
                if x and y and x[1] != y[1]:
                    todo.append((x[1], y[1]))
        return True

    def fold(a: int, b: int) -> None:
        """Add the tree below b to a."""
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            arrivals[p] += arrivals[q]
            endings[p] += endings[q]
            for name, (count, after) in edges[q].items():
                if name in edges[p]:
                    edges[p][name][0] += count
                    todo.append((edges[p][name][1], after))
                else:
                    edges[p][name] = [count, after]

    red, blue = [0], [(0, name, after) for name, (_, after) in sorted(edges[0].items())]
    while blue:
        parent, name, state = blue.pop(0)
        if edges[parent].get(name, [0, -1])[1] != state or state in red:
            continue
        for r in red:
            if compatible(r, state):
                edges[parent][name][1] = r
                fold(r, state)
                break
        else:
            red.append(state)
        blue = [(r, n, after) for r in red for n, (_, after) in sorted(edges[r].items()) if after not in red]
    number = {r: i for i, r in enumerate(red)}
    return Automaton([arrivals[r] for r in red], [endings[r] for r in red], [{n: (c, number[t]) for n, (c, t) in edges[r].items()} for r in red])


@dataclass
class Background:
    """Log probability of each symbol after each other one, at the ends of a token included."""

    log: np.ndarray

    def score(self, value: bytes) -> float:
        code = np.concatenate([[0], _CODE[np.frombuffer(value, np.uint8)], [0]])
        return float(self.log[code[:-1], code[1:]].sum())


def background(pairs: np.ndarray) -> Background:
    """From the counts of symbol pairs, smoothed towards the single symbols as by Witten and Bell."""
    n = pairs.reshape(_SYMBOL_COUNT, _SYMBOL_COUNT).astype(float)
    single = (n.sum(axis=0) + 1) / (n.sum() + _SYMBOL_COUNT)
    kinds = np.maximum((n > 0).sum(axis=1), 1)[:, None]
    return Background(np.log((n + kinds * single) / (n.sum(axis=1)[:, None] + kinds)))


def pair_counts(tokens: list[bytes]) -> np.ndarray:
    """How often each symbol follows each other one in tokens that are parted by their ends."""
    code = _CODE[np.frombuffer(b"\0" + b"\0".join(tokens) + b"\0", np.uint8)] if tokens else np.zeros(0, np.int64)
    return np.bincount(code[:-1] * _SYMBOL_COUNT + code[1:], minlength=_SYMBOL_COUNT**2)


@dataclass
class Formats:
    """An automaton and the least accepted score for each kind; verdicts on tokens are remembered up to MEMORY bytes."""

    automata: dict[str, tuple[Automaton, float]]
    yes: set[bytes] = field(default_factory=set)
    no: set[bytes] = field(default_factory=set)
    ordinary: Background | None = None
    bound: float = 0.0
    size: int = 0

    def accepts(self, value: bytes) -> bool:
        for kind, (automaton, least) in self.automata.items():
            if len(value) >= SHORTEST.get(kind, 0):
                score = automaton.score(value, least)
                if score >= least and (self.ordinary is None or score * (len(value) + 1) - self.ordinary.score(value) >= self.bound):
                    return True
        return False

    def verdict(self, token: bytes) -> bool:
        if token in self.yes or token in self.no:
            return token in self.yes
        found = self.accepts(token)
        if len(token) <= REMEMBERED:
            if self.size > MEMORY:
                self.yes.clear(), self.no.clear()
                self.size = 0
            (self.yes if found else self.no).add(token)
            self.size += len(token) + 100  # what a set holds beside the bytes
        return found

    def spans(self, text: bytes, base: list[tuple[int, int, str, bytes]]) -> list[tuple[int, int, str, bytes]]:
        """Accepted tokens that are clear of the base spans, which are ordered by start."""
        if not self.automata:
            return []
        found = {token for token in set(CANDIDATE.findall(text)) if self.verdict(token)}
        if not found:
            return []
        out, at, reach = [], 0, 0
        for m in CANDIDATE.finditer(text):
            while at < len(base) and base[at][0] < m.end():  # the farthest end of all base spans that begin before the token ends
                reach, at = max(reach, base[at][1]), at + 1
            if reach <= m.start() and m[0] in found:
                out.append((m.start(), m.end(), "format", m[0]))
        return out


def _left_out(values: list[bytes], folds: int = 5) -> list[float]:
    """What each value scores by the automaton of the other folds."""
    out = []
    for fold in range(min(folds, len(values))):
        automaton = infer([v for i, v in enumerate(values) if i % folds != fold])
        out += map(automaton.score, values[fold::folds])
    return out


def learn(labelled: dict[str, list[bytes]], quantile: float = 0.01, ordinary: Background | None = None, alarm: float = 1e-6) -> Formats:
    out = {}
    for kind, values in sorted(labelled.items()):
        if values:
            automaton = infer(values)
            scores = sorted(_left_out(values) if len(values) > 1 else map(automaton.score, values))
            out[kind] = (automaton, scores[int(quantile * len(scores))] - 1e-9)
    return Formats(out, ordinary=ordinary, bound=math.log(max(1, len(out)) / alarm))


def _points(text: bytes, spans: list[tuple[int, int, str, bytes]]) -> list[dict]:
    """Spans with byte places turned into code points."""
    if not spans:
        return []
    data = np.frombuffer(text, np.uint8)
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    return [{"kind": k, "start": int(before[a]), "end": int(before[b]), "value": v.decode()} for a, b, k, v in spans]


def other_tokens(text: bytes, base: list[tuple[int, int, str, bytes]]) -> set[bytes]:
    """Distinct tokens of what is left of a text without its base spans."""
    if base:
        text = bytearray(text)
        for a, b, *_ in base:
            text[a:b] = b" " * (b - a)
    return set(CANDIDATE.findall(text))


def labelled_sample(docs: DataFrame, sample: int, characters: int, text_col: str) -> tuple[dict[str, list[bytes]], np.ndarray]:
    """The first distinct credentials of each kind by hash, ``sample`` and ``characters`` at most, and the pair counts of all other tokens.

    Only those credentials and counts reach the driver.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(_SYMBOL_COUNT**2, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                found, tokens = set(), []
                for text in part.column("text").cast(pa.large_binary()).to_pylist():
                    spans = base_spans(text or b"")
                    found |= {(k, v) for *_, k, v in spans}
                    tokens += other_tokens(text or b"", spans)
                pairs += pair_counts(tokens)
                yield rows([k for k, _ in found], [v.decode() for _, v in found], [1] * len(found))
        at = np.flatnonzero(pairs)
        yield rows(["pair"] * len(at), list(map(str, at.tolist())), pairs[at])

    def rows(kinds: list[str], values: list[str], n: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.array(n, pa.int64())], names=["kind", "value", "n"])

    seen = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(scan, "kind string, value string, n long")
    values = keep(seen.groupBy("kind", "value").agg(F.sum("n").alias("n")), "credentials")
    out: dict[str, list[bytes]] = {}
    for kind in KINDS:
        some = values.filter((F.col("kind") == kind) & (F.length("value") <= min(LONGEST, characters)))
        first = some.select("value", F.xxhash64("value").alias("place")).orderBy("place", "value").limit(sample)
        so_far = F.sum(F.length("value")).over(W.orderBy("place", "value"))  # over ``sample`` rows at most
        kept = first.withColumn("so_far", so_far).filter(F.col("so_far") <= characters).toArrow()
        out[kind] = [v.encode() for _, v in sorted(zip(kept.column("place").to_pylist(), kept.column("value").to_pylist()))]
    counted = values.filter("kind = 'pair'").select(F.col("value").cast("int").alias("pair"), "n").toArrow()
    discard(values)
    return out, _table(counted)


def _table(counted: pa.Table) -> np.ndarray:
    pairs = np.zeros(_SYMBOL_COUNT**2, np.int64)
    pairs[counted.column("pair").to_numpy()] = counted.column("n").to_numpy()
    return pairs


def ordinary_pairs(docs: DataFrame, likely: Formats, text_col: str) -> np.ndarray:
    """Pair counts of all tokens that neither a base span touches nor ``likely`` accepts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(_SYMBOL_COUNT**2, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").cast(pa.large_binary()).to_pylist()
                pairs += pair_counts([t for text in texts if text for t in other_tokens(text, base_spans(text)) if not likely.verdict(t)])
        at = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(pairs[at])], names=["pair", "n"])

    seen = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(scan, "pair int, n long")
    return _table(seen.groupBy("pair").agg(F.sum("n").alias("n")).toArrow())


def learnt(docs: DataFrame, sample: int, characters: int, alarm: float, text_col: str) -> Formats:
    labelled, pairs = labelled_sample(docs, sample, characters, text_col)
    formats = learn(labelled, ordinary=background(pairs), alarm=alarm)
    if not formats.automata:
        return formats
    return learn(labelled, ordinary=background(ordinary_pairs(docs, formats, text_col)), alarm=alarm)


def find_secrets(docs: DataFrame, sample: int = 2000, characters: int = 400_000, alarm: float = 1e-6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id_col and ``spans`` (kind, start, end, value), base and format spans ordered by start and kind."""
    formats = learnt(docs, sample, characters, alarm, text_col)
    order = {k: i for i, k in enumerate((*KINDS, "format"))}
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                spans = []
                for text in part.column("text").cast(pa.large_binary()).to_pylist():
                    base = base_spans(text or b"")
                    extra = formats.spans(text or b"", base)
                    spans.append(_points(text, sorted(base + extra, key=lambda s: (s[0], order[s[2]])) if extra else base))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(spans, span)], names=["id", "spans"])

    ready = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return ready.mapInArrow(scan, f"id long, spans {SPANS}").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, sample: int = 2000, characters: int = 400_000, alarm: float = 1e-6, mask: str = "[SECRET]", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with every span replaced by ``mask``; all rows and columns stay, ``length_col`` is counted anew.

    The automata are learnt from a first scan; the second scan finds and masks the spans in place, so rows need no identifier.
    """
    formats = learnt(docs, sample, characters, alarm, text_col)
    names, schema = docs.columns, docs.schema

    at, size_at = names.index(text_col), names.index(length_col) if length_col in names else None

    def masked(text: bytes) -> bytes:
        spans = base_spans(text)
        spans += formats.spans(text, spans)
        place, pieces = 0, []
        for a, b, *_ in sorted(spans):
            if b > place:
                pieces += [text[place:a], mask.encode()] if a >= place else []
                place = b
        return b"".join([*pieces, text[place:]]) if spans else text

    def mask_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.rename_columns([f"c{i}" for i in range(len(names))]), f"c{at}"):
                out = [None if text is None else masked(text) for text in part.column(at).cast(pa.large_binary()).to_pylist()]
                columns = list(part.columns)
                columns[at] = pa.array(out, pa.large_binary()).cast(pa.large_string()).cast(batch.schema.field(at).type)
                if size_at is not None:
                    columns[size_at] = pa.array([None if t is None else len(t.decode()) for t in out], pa.int64()).cast(batch.schema.field(size_at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(mask_all, schema)


def digest(spans: list[dict]) -> tuple[int, int, int, str, str]:
    base = [s for s in spans if s["kind"] != "format"]
    count = [sum(s["kind"] == k for s in base) for k in KINDS]
    written = ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in base)
    return *count, hashlib.sha256(written.encode()).hexdigest(), ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)
