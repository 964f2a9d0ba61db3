"""Ordered top-k results that stay checkable by an order-insensitive compare.

``top_k`` sorts and cuts with ``orderBy().limit()`` (planned as a
``TakeOrderedAndProject``: each task keeps its own k best, the driver merges at
most k × tasks rows), then numbers the ≤ k surviving rows with ``pos`` so row
order is part of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_k(df: DataFrame, order: list[Column], k: int | None, offset: int = 0,
          pos: bool = True) -> DataFrame:
    ordered = df.orderBy(*order)
    if offset:
        ordered = ordered.offset(offset)
    if k is not None:
        ordered = ordered.limit(k)
    if not pos:
        return ordered
    # The window below runs on at most k rows (after the limit).
    return ordered.withColumn("pos", (F.row_number().over(Window.orderBy(*order)) + F.lit(offset)).cast("long"))
