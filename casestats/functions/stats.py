"""Exact order statistics over counted values.

Day counts repeat a lot, so a frame is first counted by value (a hash aggregation with
map-side combine, whatever the size of a group), and percentiles read value and count.
Both interpolate linearly between neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def median_of(value: str, count: str) -> Column:
    return F.percentile(value, F.lit(0.5), F.col(count))


def quantile_of(value: str, q: float, count: str) -> Column:
    return F.percentile(value, F.lit(q), F.col(count))


def quartiles_of(value: str, count: str) -> Column:
    return F.percentile(value, [0.25, 0.5, 0.75], F.col(count))
