"""Connected components of a link table by alternating large and small stars.

Each round groups links by one end and hooks them to the smallest neighbour, so
the number of rounds grows with the logarithm of the longest path. Minima are
taken by a grouped aggregate with map-side combine and joined back, so that a
node with very many links is split by adaptive execution, never gathered whole.
The link table should be a kept one: the first round reads it more than once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import discard, keep
from .skew import join_back


def _star(links: DataFrame, smaller: bool) -> DataFrame:
    """Links (u, v) to (v, least neighbour of u); only neighbours below u count if ``smaller``."""
    both = links if smaller else links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = join_back(both, least, "u")
    if smaller:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter("u <> v")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(a, b) links to (node, root): the smallest node of its component, for every node that has a link."""
    now = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    before = kept = None
    while True:
        now = keep(_star(_star(now, False), True).distinct(), name)
        if kept is not None:
            discard(kept)
        kept = now
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (state.n, state.s) == before or not state.n:
            break
        before = (state.n, state.s)
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least row reachable by the links (a, b) among n rows, for each row: all links of one task as one edge a row."""
    root = np.arange(n)
    while len(a):
        new = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = np.minimum(new, new[root])
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    return root
