"""Unions, sets, pivots and row expansion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stack(frames: dict[str, DataFrame]) -> DataFrame:
    """U-1: all frames under each other with their name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn("strategy", F.lit(n)) for n, f in frames.items()])


def distinct_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """U-2."""
    return rows.select(*keys).distinct()


def set_sizes(a: DataFrame, b: DataFrame) -> DataFrame:
    """U-3: sizes of the intersection and of the difference of two id sets; null is an id like any other.

    Ids are made distinct on each side before they meet, so that repeated ones are neither moved nor sorted.
    """
    sides = a.distinct().withColumn("__b", F.lit(False)).unionByName(b.distinct().withColumn("__b", F.lit(True)))
    ids = sides.groupBy(*a.columns).agg(F.bool_or(~F.col("__b")).alias("__in_a"), F.bool_or("__b").alias("__in_b"))
    return ids.agg(F.count_if(F.col("__in_a") & F.col("__in_b")).alias("in_both"), F.count_if(~F.col("__in_b")).alias("only_left"))


def to_wide(rows: DataFrame, key: str, name: str, value: str, columns: dict[str, str]) -> DataFrame:
    """U-4: a column for each of the given names."""
    wide = rows.groupBy(key).pivot(name, list(columns)).agg(F.sum(value))
    return wide.withColumnsRenamed(columns)


def to_long(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """U-4 and S-11: a row for each of the given columns that exist."""
    return rows.unpivot(keys, [c for c in columns if c in rows.columns], "variable", "value")


def months_of(intervals: DataFrame) -> DataFrame:
    """U-5: a row for each month that an interval touches."""
    return intervals.select("*", F.explode(F.sequence(F.trunc("start_date", "MM"), F.trunc("end_date", "MM"), F.expr("interval 1 month"))).alias("month"))


def time_grid(rows: DataFrame, start: str, end: str, every: str = "5 minutes") -> DataFrame:
    """U-5: a row for each mark between two times."""
    return rows.select("*", F.explode(F.sequence(start, end, F.expr(f"interval {every}"))).alias("mark"))
