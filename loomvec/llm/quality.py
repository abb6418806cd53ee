"""Quality classifier: regularised quadratic discriminant over document statistics.

Statistics of the whole text are counted by array kernels and transformed to be
roughly normal. Each class gets a mean and a covariance that is shrunk towards
its diagonal; a text's margin is the difference of the two log densities, each
from a squared Mahalanobis distance by the inverse of the class's Cholesky
factor, which is computed once. A logistic map fitted to held-in margins turns
the margin into a score.

The model is fitted on at most ``sample`` labelled rows, those of least hash of
their identifier, and its shrinkage and damping are those of least log loss on a
fifth of these rows when fitted on the others. Inputs of a score are the text
alone. Null and empty texts have all statistics at zero and get a score like any
other; a very long text is counted whole. Labels that are null are ignored; if
an identifier has several labels their mean is rounded. Rows that repeat an
identifier each count; where the bound cuts among them, a hash of the text
decides. Without rows of both classes every score is the share of label 1 (0.5
without labels). Extra columns stay; a new column's name must be free.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexing import slices, split_words

_ONE_OF = {name: np.isin(np.arange(256), list(chars)) for name, chars in {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "stop": b".,;:", "bang": b"!?", "bar": b"|<>{}[]()\\/", "sign": b"#$%&*@^~+=_", "line": b"\n"}.items()} | {"wide": np.arange(256) >= 128}


def statistics(column: pa.Array) -> np.ndarray:
    """One row of transformed statistics for each text."""
    words = split_words(column)
    n = words.counts().astype(float)
    size = words.end - words.start
    rows = words.rows
    per = np.maximum(n, 1)

    def total(values: np.ndarray, row: np.ndarray) -> np.ndarray:
        return np.bincount(row, values, rows) if len(row) else np.zeros(rows)

    letters = total(size, words.row)
    chars = np.maximum(letters, 1)
    byte_row = np.repeat(np.arange(rows), np.diff(_byte_offsets(column)))
    share = {name: total(table[words.data].astype(float), byte_row) for name, table in _ONE_OF.items()}
    mean = letters / per
    spread = np.sqrt(np.maximum(total(size.astype(float) ** 2, words.row) / per - mean**2, 0))
    order = np.lexsort((words.hash, words.row))
    h, r = words.hash[order], words.row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    distinct = total(new.astype(float), r)
    runs = np.diff(np.append(np.flatnonzero(new), len(h)))
    most = np.zeros(rows)
    if len(h):
        np.maximum.at(most, r[new], runs)
    same = np.zeros(len(h), bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1])
    repeat = total(same.astype(float), words.row)
    short = total((size <= 3).astype(float), words.row)
    long = total((size >= 14).astype(float), words.row)
    ends = total(_ONE_OF["stop"][words.data[words.end - 1]].astype(float), words.row) if len(size) else np.zeros(rows)
    odd = total((~(_ONE_OF["lower"] | _ONE_OF["upper"] | _ONE_OF["digit"] | _ONE_OF["wide"] | _ONE_OF["stop"])[words.data[words.end - 1]]).astype(float), words.row) if len(size) else np.zeros(rows)
    root = lambda x, y: np.sqrt(np.maximum(x, 0) / y)
    return np.column_stack([
        np.log1p(n), np.log1p(mean), np.log1p(spread),
        root(share["upper"], chars), root(share["digit"], chars), root(share["stop"], per), root(share["bang"], per),
        root(share["bar"], per), root(share["sign"], per), root(share["wide"], chars), root(share["line"], per),
        np.log1p(distinct) / np.log1p(per), root(most, per), root(repeat, per), root(short, per), root(long, per), root(ends, per), root(odd, per),
    ])


def _byte_offsets(column: pa.Array) -> np.ndarray:
    from .lexing import text_bytes

    return text_bytes(column)[1]


@dataclass
class Discriminant:
    """Means, Cholesky factors of the shrunk covariances, log priors, and the logistic map of the margin.

    Statistics of a short text say little: all but its length are drawn towards ``centre`` (the mean of class 1) as if ``damp``
    words of the usual kind stood beside its own.
    """

    mean: list[np.ndarray]
    factor: list[np.ndarray]
    inverse: list[np.ndarray]
    prior: list[float]
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None
    centre: np.ndarray | None = None
    damp: float = 0.0

    def drawn(self, x: np.ndarray) -> np.ndarray:
        n = np.expm1(x[:, :1])
        return np.hstack([x[:, :1], self.centre[1:] + (x[:, 1:] - self.centre[1:]) * (n / np.maximum(n + self.damp, 1e-9))])

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        density = []
        for mean, factor, inverse, prior in zip(self.mean, self.factor, self.inverse, self.prior):
            z = inverse @ (x - mean).T
            density.append(prior - 0.5 * (z * z).sum(axis=0) - np.log(np.diag(factor)).sum())
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * _squash(self.margin(self.drawn(x))) + self.shift, -40, 40)))


def _squash(m: np.ndarray) -> np.ndarray:
    """Signed logarithm: margins of far outliers would else rule the fit."""
    return np.sign(m) * np.log1p(np.abs(m))


def fit(x: np.ndarray, y: np.ndarray, shrink: float = 0.2, ridge: float = 1e-4, damp: float = 40.0) -> Discriminant:
    if len(y) == 0 or y.min() == y.max() or min((y == 0).sum(), (y == 1).sum()) < 3:
        return Discriminant([], [], [], [], constant=float(y.mean()) if len(y) else 0.5)
    model = Discriminant([], [], [], [], centre=x[y == 1].mean(axis=0), damp=damp)
    x = model.drawn(x)
    scale = x.var(axis=0) + 1e-6
    mean, factor, prior = [], [], []
    for c in (0, 1):
        z = x[y == c]
        cov = np.cov(z.T, bias=True)
        cov = (1 - shrink) * cov + shrink * np.diag(np.diag(cov)) + np.diag(ridge * scale + 1e-6)
        mean.append(z.mean(axis=0))
        factor.append(np.linalg.cholesky(cov))
        prior.append(float(np.log(len(z) / len(y))))
    model.mean, model.factor, model.prior = mean, factor, prior
    model.inverse = [np.tril(np.linalg.inv(f)) for f in factor]
    m = _squash(model.margin(x))
    design = np.column_stack([m, np.ones_like(m)])
    home = np.array([1.0, 0.0])

    def loss(w: np.ndarray) -> float:
        z = design @ w
        return float(np.logaddexp(0, z).sum() - (y * z).sum() + 0.5 * ((w - home) ** 2).sum())

    w = home.copy()
    for _ in range(100):  # Newton steps of a logistic regression on the margin, lightly held to (1, 0); a step is halved until it helps
        p = 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))
        slope = design.T @ (p - y) + (w - home)
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.eye(2), slope)
        size, now = 1.0, loss(w)
        while loss(w - size * step) > now and size > 1e-9:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    a, b = w
    model.slope, model.shift = float(a), float(b)
    return model


#: Settings among which the training rows choose.
SHRINK, DAMP = (0.02, 0.1, 0.2, 0.4), (0.0, 10.0, 40.0, 120.0)


def choose(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> tuple[float, float]:
    """Shrinkage and damping of least log loss on the rows of ``fold`` when fitted on the other ones; ties go to the first."""
    best, found = np.inf, (SHRINK[0], DAMP[0])
    for shrink in SHRINK:
        for damp in DAMP:
            p = np.clip(fit(x[~fold], y[~fold], shrink, damp=damp).score(x[fold]), 1e-9, 1 - 1e-9)
            loss = -float(np.mean(np.where(y[fold] == 1, np.log(p), np.log(1 - p)))) if fold.any() else 0.0
            if loss < best - 1e-12:
                best, found = loss, (shrink, damp)
    return found


def held_out(id_col: str):
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = 40_000, id_col: str = "doc_id", text_col: str = "text") -> Discriminant:
    """Fit on at most ``sample`` labelled documents that are not held out."""
    usable = labels.select(F.col(id_col).cast("long").alias("id"), F.col("quality").cast("double").alias("y")).filter("id is not null and y is not null")
    usable = usable.filter(~held_out("id")).groupBy("id").agg(F.round(F.avg("y")).alias("y"))
    # labels of least hash, by a bound on the hash that the number of labels gives: about ``sample`` rows, which may be broadcast
    share = min(1.0, 1.02 * sample / max(1, usable.count()))
    usable = usable.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(usable), "id")
    chosen = chosen.withColumns({"place": F.xxhash64("id"), "tie": F.xxhash64("text")})

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = statistics(part.column("text"))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("place", "id", "tie", "y")), pa.array(list(x), pa.list_(pa.float64()))], names=["place", "id", "tie", "y", "x"])

    seen = chosen.select("place", "id", "tie", "y", "text").mapInArrow(measure, "place long, id long, tie long, y double, x array<double>")
    rows = seen.orderBy("place", "id", "tie").limit(sample).toArrow()
    if not rows.num_rows:
        return fit(np.zeros((0, 1)), np.zeros(0))
    place, ids, tie = (rows.column(c).to_numpy() for c in ("place", "id", "tie"))
    order = np.lexsort((tie, ids))
    x = np.stack(rows.column("x").to_pylist())[order].astype(float)
    y = rows.column("y").to_numpy()[order]
    return fit(x, y, **dict(zip(("shrink", "damp"), choose(x, y, place[order] % 5 == 0))))


def score(docs: DataFrame, model: Discriminant, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` and the score; ``score_col`` must be a new name."""
    at = docs.columns.index(text_col)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])
            got = [model.score(statistics(part.column(at))) for part in slices(sizes, f"c{at}")] or [np.zeros(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(got), pa.float64())], names=[*batch.schema.names, score_col])

    from pyspark.sql import types as T

    return docs.mapInArrow(apply, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, sample: int = 40_000, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id_col, held_out, score, predicted."""
    model = train(docs, labels, sample, id_col, text_col)
    scored = score(docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text")), model, "text")
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
