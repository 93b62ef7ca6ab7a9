"""Global row numbers and running sums without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of the order column; each is one window group.
RANGES = 64


def _ranged(df: DataFrame, by: str, ranges: int) -> DataFrame:
    """``df`` with its range: how many of the column's quantiles lie below. Equal values share a range."""
    bounds = df.agg(F.percentile_approx(by, [k / ranges for k in range(1, ranges)], 10_000)).first()[0] or []
    cuts = F.array(*map(F.lit, sorted(set(bounds)))) if bounds else None
    return df.withColumn("_range", F.size(F.filter(cuts, lambda b: b < F.col(by))) if bounds else F.lit(0))


def _before(ranged: DataFrame, value: Column) -> DataFrame:
    """The sum of all earlier ranges: a row for each."""
    sums = ranged.groupBy("_range").agg(F.sum(value).alias("_sum"))
    window = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(sums.select("_range", F.coalesce(F.sum("_sum").over(window), F.lit(0)).alias("_before")))  # at most RANGES rows


def running_sum(df: DataFrame, by: str, value: Column, name: str, *, ranges: int = RANGES) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows up to each, in the order of the number ``by``."""
    ranged = _ranged(df, by, ranges)
    window = Window.partitionBy("_range").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.withColumn(name, F.sum(value).over(window)).join(_before(ranged, value), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")


def numbered(df: DataFrame, by: str, name: str = "seq", *, ranges: int = RANGES) -> DataFrame:
    """``df`` with row numbers from 1 in the order of the number ``by``."""
    return running_sum(df, by, F.lit(1), name, ranges=ranges)
