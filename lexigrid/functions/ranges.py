"""Cutting a numeric order into ranges of about equal size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quantile_cuts(df: DataFrame, column: str, parts: int) -> list:
    """At most parts - 1 increasing cuts of a numeric column; their error shrinks with the parts, down to a hundred-thousandth."""
    if parts < 2:
        return []
    return sorted(set(df.approxQuantile(column, [i / parts for i in range(1, parts)], max(0.2 / parts, 1e-5))))


def range_of(value: Column, cuts: list) -> Column:
    """How many cuts are below the value. Found in two levels, so a row costs the square root of their number, not all of them."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[at : at + step] for at in range(0, len(cuts), step)]
    below = lambda xs: F.size(F.filter(xs, lambda c: c < value))
    block = below(F.lit([b[-1] for b in blocks]))
    inner = F.coalesce(F.get(F.array(*[F.lit(b) for b in blocks]), block), F.array().cast("array<double>"))
    # the last block may be a short one
    return F.least(block * step + below(inner), F.lit(len(cuts)))
