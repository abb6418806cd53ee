"""Near-duplicate vectors by collision-counting projections.

Vectors of one label are dealt into blocks of bounded size. For each pair of
blocks, every vector is projected on ``projections`` random lines; the values on
a line are sorted, and a window centred on each query marks the ranks that
collide with it. A pair that collides on at least ``least`` lines is verified by
its cosine in double precision. Window width and count are calibrated: on each
line, two unit vectors at the threshold differ by a normal deviate of standard
deviation ``sqrt(2 - 2 * threshold)``, so the number of collisions of a linked
pair is at least binomial, and ``least`` is its quantile at ``miss``.

A window that keeps linked pairs holds a fixed share of a line, so windows alone
leave the work of a label quadratic. A label of many vectors is therefore dealt
into cells first, ``tables`` times, by the side of the origin on which a vector
lies on each of ``bits`` further lines: two unit vectors at the threshold share
a side with chance 1 - acos(threshold) / pi, so the calibrated number of tables
puts a linked pair into one cell at least once but for ``miss``. Bits follow the
size of the label and keep the average cell at about a block; they are 0, one
cell for all, wherever cells would not save work. A pair counts in the first
table that holds it. Cells of more vectors are dealt into pairs of blocks.

Equal vectors of a label are one node with a weight; a group of copies costs one
row. A node has a number of its own, whatever ids its vectors have; the smallest
id is looked up when the components are known. Tasks return counts for each
vector and a spanning forest of links, never the pairs. Vectors that are null,
zero, or hold null or non-finite components, or whose label is null, link with
nothing; each still has its row. Vectors of different lengths never link; very
long ones only make a block larger. Repeated ids get a row each. Null ids count
as larger than others. Pairs exactly at the threshold link. An empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import keep
from .components import components, forest
from .skew import join_back

LAST = 2**63 - 1
BLOCK = 4096
TILE = 256


def calibrate(threshold: float, projections: int, miss: float, share: float = 0.82) -> tuple[float, int]:
    """Half-width of the window on a line, and the least number of collisions, for recall of at least 1 - miss a pair."""
    distance = math.sqrt(max(0.0, 2 - 2 * threshold))
    low, high = 0.0, 8.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if math.erf(middle / math.sqrt(2)) < share else (low, middle)
    below, least = 0.0, 0
    while least < projections:
        below += math.comb(projections, least) * share**least * (1 - share) ** (projections - least)
        if below > miss:
            break
        least += 1
    return high * distance, least


def cells_for(n: int, threshold: float, miss: float) -> tuple[int, int]:
    """Bits and tables for n vectors of a label: the least work among cells of at least about BLOCK vectors."""
    share = 1 - math.acos(threshold) / math.pi
    best = (1.0, 0, 1)
    for bits in range(1, max(0, int(math.log2(max(1, n / BLOCK)))) + 1):
        tables = math.ceil(math.log(miss) / math.log1p(-(share**bits)))
        best = min(best, (tables / 2**bits, bits, tables))
    return best[1:]


def _sides(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The cell of each row in each table."""
    if not bits:
        return np.zeros((len(x), 1), np.int32)
    lines = np.random.default_rng(7919 + bits).standard_normal((x.shape[1], tables * bits))
    out = np.empty((len(x), tables), np.int32)
    for at in range(0, len(x), 4096):
        side = (x[at : at + 4096] @ lines > 0).reshape(-1, tables, bits)
        out[at : at + 4096] = side @ (1 << np.arange(bits))
    return out


def linked_pairs(x: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float, projections: int, miss: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (from rows i, from rows j) of the matrix with cosine >= threshold: count collisions, then verify."""
    norm = np.sqrt((x * x).sum(axis=1))
    unit = x / norm[:, None]
    half, least = calibrate(threshold, projections, miss)
    lines = np.random.default_rng(4099).standard_normal((x.shape[1], projections))
    value = unit @ lines
    order = np.argsort(value, axis=0)
    rank = np.empty(value.shape, np.int16)
    low, span = np.empty(value.shape, np.int16), np.empty(value.shape, np.uint16)
    for p in range(projections):
        ordered = value[order[:, p], p]
        rank[order[:, p], p] = np.arange(len(x))
        begin = np.searchsorted(ordered, value[:, p] - half, "left")
        low[:, p] = begin
        span[:, p] = np.searchsorted(ordered, value[:, p] + half, "right") - begin
    rank, low, span = (np.ascontiguousarray(t.T) for t in (rank, low, span))
    a, b = [], []
    for at in range(0, len(i), TILE):
        query = i[at : at + TILE]
        count = np.zeros((len(query), len(j)), np.uint8)
        for p in range(projections):
            count += (rank[p, j][None, :] - low[p, query][:, None]).view(np.uint16) < span[p, query][:, None]
        q, r = np.nonzero(count >= least)
        q, r = query[q], j[r]
        for part in range(0, len(q), 200_000):
            s, t = q[part : part + 200_000], r[part : part + 200_000]
            cosine = np.einsum("ij,ij->i", x[s], x[t]) / (norm[s] * norm[t])
            good = (cosine >= threshold) & (s != t)
            a.append(s[good])
            b.append(t[good])
    return np.concatenate([*a, np.zeros(0, np.int64)]), np.concatenate([*b, np.zeros(0, np.int64)])


def near_vectors(vectors: DataFrame, threshold: float = 0.93, projections: int = 64, miss: float = 1e-6, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per vector: id_col, n_links, component_id, kept."""
    x = F.col(vector_col).cast("array<double>")
    ready = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.col(label_col).alias("label"), x.alias("x"))
    finite = ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("x") > 0) & finite & F.exists("x", lambda v: v != 0), F.lit(False))
    ready = ready.withColumn("usable", usable)
    nodes = keep(ready.filter("usable").groupBy("label", "x").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("weight")).withColumn("size", F.size("x")).withColumn("node", F.monotonically_increasing_id()), "vectors")

    # a label's number of distinct vectors decides its cells; one row a label and length reaches the driver
    sizes = nodes.groupBy("label", "size").agg(F.count(F.lit(1)).alias("n"))
    plans = nodes.sparkSession.createDataFrame([(n, *cells_for(n, threshold, miss)) for (n,) in sizes.select("n").distinct().collect()], "n long, bits int, tables int")
    planned = join_back(nodes, sizes.join(plans, "n").drop("n"), "size", "label")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = np.stack([batch.column(c).to_numpy() for c in ("size", "bits", "tables")], axis=1)
            for kind in np.unique(kinds, axis=0):
                rows = batch.take(pa.array(np.flatnonzero((kinds == kind).all(axis=1))))
                cells = _sides(rows.column("x").flatten().to_numpy().reshape(rows.num_rows, -1), *kind[1:].tolist())
                yield pa.RecordBatch.from_arrays([rows.column("node"), pa.array(list(cells), pa.list_(pa.int32()))], names=["node", "cells"])

    placed = keep(planned.select("node", "size", "bits", "tables", "x").mapInArrow(place, "node long, cells array<int>").join(nodes, "node"), "cells")
    each = placed.select("label", "size", "node", "weight", "x", "cells", F.posexplode("cells").alias("tab", "cell"))
    # the node's number (fixed when the table was written) and weight stand for its copies; the nodes of one cell are dealt into blocks
    cell = ["label", "size", "tab", "cell"]
    group = each.groupBy(*cell).agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select(*cell, F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int")
    dealt = join_back(each, group, "cell", "label", "size", "tab").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))

    def compare(table: pa.Table) -> pa.Table:
        n = table.num_rows
        node, weight, own_block = (table.column(c).to_numpy() for c in ("node", "weight", "own"))
        matrix = np.asarray(table.column("x").combine_chunks().flatten().to_numpy()).reshape(n, -1)
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left = np.flatnonzero(own_block == i)
        right = left if i == j else np.flatnonzero(own_block == j)
        a, b = linked_pairs(matrix, left, right, threshold, projections, miss)
        if table_number := table.column("tab")[0].as_py():
            cells = table.column("cells").combine_chunks().flatten().to_numpy().reshape(n, -1)[:, :table_number]
            first = np.concatenate([~(cells[a[k : k + 50_000]] == cells[b[k : k + 50_000]]).any(axis=1) for k in range(0, len(a), 50_000)] or [np.zeros(0, bool)])
            a, b = a[first], b[first]
        links = np.bincount(a, weight[b], n) if i == j else np.bincount(a, weight[b], n) + np.bincount(b, weight[a], n)
        order = np.argsort(node, kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        root = node[order][forest(place[a], place[b], n)][place]
        out = links > 0
        return pa.table({"node": node[out], "links": links[out].astype(np.int64), "root": root[out]})

    found = keep(dealt.select(*cell, "i", "j", "own", "node", "weight", "x", "cells").groupBy(*cell, "i", "j").applyInArrow(compare, "node long, links long, root long"), "links")
    roots = keep(components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))), "roots")
    smallest = nodes.join(roots, "node").groupBy("root").agg(F.min("least").alias("component"))
    placed = join_back(roots, smallest, "root").select("node", "component")
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    per_node = nodes.select("label", "x", "node", "least", "weight").join(counted, "node", "left").join(placed, "node", "left")
    out = ready.join(per_node, ["label", "x"], "left")
    links = F.coalesce(F.col("links"), F.lit(0)) + F.coalesce(F.col("weight") - 1, F.lit(0))
    component = F.coalesce("component", "least", "id")
    plain = lambda c: F.when(c < LAST, c)
    return out.select(plain(F.col("id")).alias(id_col), links.alias("n_links"), plain(component).alias("component_id"), (F.col("id") == component).alias("kept"))
