"""The n first rows of an order, found by counting, without sorting them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells that a round of counting cuts an interval into.
CELLS = 512


def _threshold(rows: DataFrame, value: str, n: int) -> tuple[object, int]:
    """The n-th smallest value, and how many rows are below it. rows has n rows at least, none null.

    Each round counts the rows of the interval that holds it by cell, and goes on with the cell's
    own least and greatest value; only CELLS counts are shuffled and brought to the driver.
    """
    low, high = rows.agg(F.min(value), F.max(value)).first()
    below = 0
    while low != high:
        wide = float(high) - float(low)
        cell = F.least(F.floor((F.col(value) - F.lit(low)).cast("double") / F.lit(wide) * CELLS), F.lit(CELLS - 1).cast("long"))
        inside = rows.where((F.col(value) >= F.lit(low)) & (F.col(value) <= F.lit(high)))
        counts = inside.groupBy(cell.alias("cell")).agg(F.count("*").alias("c"), F.min(value).alias("low"), F.max(value).alias("high")).collect()
        for r in sorted(counts, key=lambda r: r["low"]):
            if below + r["c"] >= n:
                low, high = r["low"], r["high"]
                break
            below += r["c"]
    return low, below


def first_rows(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The n rows that come first by numeric columns `order`, all of them where there are fewer; the last column should be unique.

    The n-th row's first value splits rows into those before it, which are taken, and those that
    share it, of which the next column chooses; so the result is a filter of rows.
    """
    if n <= 0:
        return rows.where(F.lit(False))
    taken: Column = F.lit(False)
    tied: Column = F.lit(True)
    left = n
    if rows.count() <= n:
        return rows
    for k, c in enumerate(order):
        at, below = _threshold(rows.where(tied), c, left)
        taken = taken | (tied & (F.col(c) < F.lit(at)))
        tied = tied & (F.col(c) == F.lit(at))
        left -= below
        if left and k == len(order) - 1 and rows.where(tied).count() <= left:
            taken = taken | tied
            left = 0
    # rows that are equal in all of the order: any of them
    return rows.where(taken) if not left else rows.where(taken).unionByName(rows.where(tied).limit(left))
