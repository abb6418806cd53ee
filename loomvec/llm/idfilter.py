"""A bounded bitmap of identifiers, to keep rows that cannot match out of a shuffle.

The bitmap never has a false negative. Its size is capped: beyond the cap more
rows pass, and the join that follows decides exactly as before.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BITS = 1 << 26


def may_hold(table: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (table[cells >> 5] >> (cells & 31).astype(np.uint32) & 1).astype(bool)


class IdFilter:
    """True for a value of ``columns`` wherever it may be among those of ``ids``; at most MOST_BITS bits reach the driver.

    ``filter(a, b)`` is a condition on columns. A kernel that reads the texts anyway takes ``cell`` as a column and tests it by
    ``may_hold(filter.table, cells)``, which saves the task a second Python worker.
    """

    def __init__(self, ids: DataFrame, *columns: str):
        self.bits = min(MOST_BITS, 1 << max(12, (16 * ids.count()).bit_length()))
        words = ids.select(self.cell(*columns).alias("cell")).groupBy(F.expr("cell >> 5").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(cell & 31 as int)))").alias("mask"))
        rows = words.toArrow()
        self.table = np.zeros(self.bits >> 5, np.uint32)
        self.table[rows.column("word").to_numpy()] = rows.column("mask").to_numpy().astype(np.uint32)

    def cell(self, *columns: str | Column) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.bits))

    def __call__(self, *columns: str | Column) -> Column:
        table = self.table

        @F.pandas_udf("boolean")
        def member(cells: pd.Series) -> pd.Series:
            return pd.Series(may_hold(table, cells.to_numpy()))

        return member(self.cell(*columns))
