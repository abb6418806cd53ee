"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased; ASCII characters other than letters and digits become
spaces, and runs of spaces one. Its features are the distinct character n-grams
of orders ``ORDERS`` of the whole text, one space at either end, in ``BUCKETS``
hashed buckets. Over the labelled sample each bucket gets the log ratio of its
smoothed shares of toxic and of clean documents. The ``features`` buckets whose
ratio is farthest from zero in standard errors stay; a text has each of them
scaled by its ratio if it occurs, and a logistic regression with a quadratic
penalty gives the weights. Scaled weights are added to one table, so a score is
one look-up for each distinct n-gram.

The model is fitted on at most ``sample`` labelled rows, those of least hash of
their identifier and text; only the counts of buckets and the sample's chosen
features reach the driver. Inputs of a score are the text alone. Null and empty
texts have the n-grams of one space, so their score is that of the bias. Very
long texts are taken whole. Labels that are null are ignored; if an identifier
has several labels their mean is rounded. In the sample, rows that repeat an
identifier and a text count once. Without rows of both classes every score is
the share of label 1 (0.5 without labels). Repeated rows are scored each; extra
columns stay, the score's name must be new; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import keep
from .lexing import U, mix, slices

ORDERS = (3, 4, 5)
BUCKETS = 1 << 18
_SPACE = np.array([chr(c).isalnum() for c in range(128)])


def _characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in normal form, each text closed by spaces of its own, and the row of each."""
    texts = [" " + (t or "").lower() + " " for t in column.to_pylist()]
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    plain = np.minimum(code, 127)
    code = np.where((code < 128) & ~_SPACE[plain], np.uint32(32), code)
    stays = np.ones(len(code), bool)
    stays[1:] = (code[1:] != 32) | (code[:-1] != 32) | (row[1:] != row[:-1])
    return code[stays], row[stays]


def buckets(column: pa.Array, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) of the texts' n-grams; features are buckets, or ``of[bucket]`` where that is 0 or more."""
    code, row = _characters(column)
    rows, names = [], []
    value = code.astype(np.uint64)
    for n in range(2, max(ORDERS) + 1):
        if len(code) < n:
            break
        value = mix(value[:-1] * U(0x9E3779B97F4A7C15) + code[n - 1 :])
        if n in ORDERS:
            inside = row[n - 1 :] == row[: len(value)]
            name = (value >> U(46)).astype(np.int64) % BUCKETS
            if of is not None:
                name = of[name]
                inside &= name >= 0
            rows.append(row[: len(value)][inside])
            names.append(name[inside])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique(np.concatenate(rows) * BUCKETS + np.concatenate(names))
    return both // BUCKETS, both % BUCKETS


@dataclass
class Linear:
    """``of`` names the feature of a bucket, or -1; ``weight`` is a feature's, its ratio included. A constant model has neither."""

    of: np.ndarray | None
    weight: np.ndarray | None
    bias: float
    constant: float | None = None

    def score(self, column: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(column), self.constant)
        row, name = buckets(column, self.of)
        margin = self.bias + np.bincount(row, self.weight[name], len(column))
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def ratios(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, smooth: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Log-count ratio of each bucket, and the ratio in standard errors, from the documents of each class that have it."""
    p, q = toxic + smooth, clean + smooth
    ratio = np.log(p / (n_toxic + 2 * smooth)) - np.log(q / (n_clean + 2 * smooth))
    return ratio, np.abs(ratio) / np.sqrt(1 / p + 1 / q)


def fit_logistic(row: np.ndarray, name: np.ndarray, ratio: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 200) -> tuple[np.ndarray, float]:
    """Weights (their ratios included) and bias of a logistic regression on scaled, binary features, by L-BFGS."""
    n, d = len(y), len(ratio)
    scale = ratio[name]

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(row, scale * w[name], n) + w[d]
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        slope = np.append(np.bincount(name, scale * (p - y)[row], d) + penalty * w[:d], (p - y).sum())
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * penalty * (w[:d] @ w[:d])), slope

    w = np.zeros(d + 1)
    now, slope = loss(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        if np.abs(slope).max() < 1e-5 * max(1.0, n):
            break
        way, used = slope.copy(), []
        for s, t, rho in reversed(past):
            used.append(rho * (s @ way))
            way -= used[-1] * t
        way *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.abs(slope).max())
        for (s, t, rho), a in zip(past, reversed(used)):
            way += (a - rho * (t @ way)) * s
        size, gain = 1.0, slope @ way
        while True:
            after, later = loss(w - size * way)
            if after <= now - 1e-4 * size * gain or size < 1e-10:
                break
            size /= 2
        s, t = -size * way, later - slope
        w, slope = w + s, later
        if s @ t > 1e-12:
            past = [*past[-9:], (s, t, 1 / (s @ t))]
        if now - after < 1e-9 * max(1.0, abs(now)):
            break
        now = after
    return w[:d] * ratio, float(w[d])


def held_out(id_col: str):
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """A kept table of at most ``sample`` labelled texts that are not held out: place, tie, y, text."""
    usable = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y")).filter("id is not null and y is not null")
    usable = usable.filter(~held_out("id")).groupBy("id").agg(F.round(F.avg("y")).alias("y"))
    # labels of least hash, by a bound on the hash that the number of labels gives: about ``sample`` rows, which may be broadcast
    share = min(1.0, 1.02 * sample / max(1, usable.count()))
    usable = usable.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    mine = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(usable), "id")
    mine = mine.select(F.xxhash64("id").alias("place"), F.xxhash64("id", "text").alias("tie"), "y", "text")
    once = keep(mine.groupBy("place", "tie").agg(F.first("y").alias("y"), F.first("text").alias("text")), "labelled")
    last = once.select("place", "tie").orderBy("place", "tie").limit(sample).agg(F.max(F.struct("place", "tie")).alias("last")).first().last
    if last is None:
        return once
    return once.filter(F.struct("place", "tie") <= F.struct(F.lit(last.place).alias("place"), F.lit(last.tie).alias("tie")))


def _counts(chosen: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Documents of each class with each bucket, and documents of each class: one row a bucket from each task, then grouped."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, BUCKETS + 1), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                y = part.column("y").to_numpy().astype(int)
                row, name = buckets(part.column("text"))
                for c in (0, 1):
                    found[c, :BUCKETS] += np.bincount(name[y[row] == c], minlength=BUCKETS)
                    found[c, BUCKETS] += (y == c).sum()
        at = np.flatnonzero(found.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[1, at]), pa.array(found[0, at])], names=["bucket", "toxic", "clean"])

    rows = chosen.select("y", "text").mapInArrow(count, "bucket long, toxic long, clean long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toArrow()
    found = np.zeros((2, BUCKETS + 1))
    at = rows.column("bucket").to_numpy()
    found[1, at], found[0, at] = rows.column("toxic").to_numpy(), rows.column("clean").to_numpy()
    return found[1, :BUCKETS], found[0, :BUCKETS], int(found[1, BUCKETS]), int(found[0, BUCKETS])


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, features: int = 4096, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Linear:
    """Ratios and weights from at most ``sample`` labelled documents that are not held out, over ``features`` buckets."""
    chosen = labelled(docs, labels, sample, id_col, text_col, label_col)
    toxic, clean, n_toxic, n_clean = _counts(chosen)
    if not n_toxic or not n_clean:
        return Linear(None, None, 0.0, n_toxic / (n_toxic + n_clean) if n_toxic + n_clean else 0.5)
    ratio, far = ratios(toxic, clean, n_toxic, n_clean)
    far[(toxic + clean) == 0] = -1
    best = np.sort(np.argsort(-far, kind="stable")[:features])
    best = best[far[best] > 0]
    of = np.full(BUCKETS, -1, np.int64)
    of[best] = np.arange(len(best))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, name = buckets(part.column("text"), of)
                cut = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("place"), part.column("tie"), part.column("y"), pa.ListArray.from_arrays(pa.array(cut), pa.array(name, pa.int32()))], names=["place", "tie", "y", "names"])

    seen = chosen.mapInArrow(rows, "place long, tie long, y double, names array<int>").orderBy("place", "tie").toArrow()
    names = seen.column("names").combine_chunks()
    row = np.repeat(np.arange(len(seen)), np.diff(names.offsets.to_numpy()))
    weight, bias = fit_logistic(row, names.flatten().to_numpy().astype(np.int64), ratio[best], seen.column("y").to_numpy())
    return Linear(of.astype(np.int32), weight, bias)


def score(docs: DataFrame, model: Linear, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` and the score."""
    at = docs.columns.index(text_col)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])
            got = [model.score(part.column(at)) for part in slices(named, f"c{at}")] or [np.zeros(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(got), pa.float64())], names=[*batch.schema.names, score_col])

    return docs.mapInArrow(apply, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, sample: int = 20_000, features: int = 4096, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id_col, held_out, score, predicted."""
    model = train(docs, labels, sample, features, id_col, text_col)
    scored = score(docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text")), model, "text")
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
