"""Layout of multi-dimensional points: rows near each other in all dimensions share files, so that a box reads few row groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 8


def _place(column: str, bounds: list[float]) -> Column:
    """How many of the bounds are at or below the value."""
    return F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<double>"), lambda b: b <= F.col(column)))


def curve(df: DataFrame, columns: list[str], bits: int = BITS) -> Column:
    """Place on a Z-order curve: the interleaved bits of each column's quantile. One pass for the quantiles, of bounded size."""
    cuts = df.stat.approxQuantile(columns, [i / (1 << bits) for i in range(1, 1 << bits)], 0.002) if columns else []
    key = F.lit(0).cast("long")
    for k, (c, q) in enumerate(zip(columns, cuts, strict=True)):
        place = _place(c, sorted(set(q)))
        for b in range(bits):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(place, b).bitwiseAND(F.lit(1)).cast("long"), b * len(columns) + k))
    return key


def clustered(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows in ranges of the curve, sorted along it. Null coordinates come first."""
    return df.withColumn("__z", curve(df, columns)).repartitionByRange("__z", *columns).sortWithinPartitions("__z").drop("__z")
