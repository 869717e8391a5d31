"""Rankings and selections; ties always go to the smaller id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finpanel.functions import month_index, over


def _size(top: float) -> Column:
    """How many names a leg has: a number over 1 as such, else a share of the cross-section, one at least."""
    return F.lit(int(top)).cast("double") if top > 1 else F.greatest(F.lit(1.0), F.round(top * F.col("n")))


def ranked(rows: DataFrame, score: str, *, by: str = "ym", key: str = "assetid") -> DataFrame:
    """Rows with a score, their rank (best first) and the size of their cross-section."""
    own = rows.filter(F.col(score).isNotNull())
    return own.withColumn("rn", F.row_number().over(over(by, by=[F.desc(score), F.asc(key)]))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(by)))


def top_bottom(rows: DataFrame, score: str, top: float, *, by: str = "ym", key: str = "assetid") -> DataFrame:
    """T-1 and T-2: the best and the worst names of each month; months with fewer than both legs are skipped."""
    r = ranked(rows, score, by=by, key=key).withColumn("k", _size(top)).filter(F.col("n") >= 2 * F.col("k"))
    long = F.col("rn") <= F.col("k")
    r = r.filter(long | (F.col("rn") > F.col("n") - F.col("k")))
    return r.withColumn("leg", F.when(long, "long").otherwise("short")).withColumn("rank", F.when(long, F.col("rn")).otherwise(F.col("n") - F.col("rn") + 1)).drop("rn", "n", "k")


def candidates(rows: DataFrame, score: str, *, by: str = "ym", key: str = "assetid") -> DataFrame:
    """T-3: every name with its rank in both directions, and the month's last date as rebalance date."""
    r = rows.filter(F.col(score).isNotNull())
    r = r.withColumn("rank_long", F.row_number().over(over(by, by=[F.desc(score), F.asc(key)]))).withColumn("rank_short", F.row_number().over(over(by, by=[F.asc(score), F.desc(key)])))
    return r.withColumn("rebal_date", F.max("date").over(Window.partitionBy(by)))


def fill_down(ranks: DataFrame, top: int, *, price: str = "exec_px", by: str = "ym", key: str = "assetid") -> DataFrame:
    """T-4: the first names of each side that have a positive price on the execution date; shorts leave out the longs."""
    good = ranks.filter(F.col(price) > 0)
    long = good.withColumn("rank", F.row_number().over(over(by, by="rank_long"))).filter(F.col("rank") <= top).withColumn("leg", F.lit("long"))
    rest = good.join(long.select(by, key), [by, key], "left_anti")
    short = rest.withColumn("rank", F.row_number().over(over(by, by="rank_short"))).filter(F.col("rank") <= top).withColumn("leg", F.lit("short"))
    return long.unionByName(short)


def ranking(rows: DataFrame, score: str, key: str, top: int) -> DataFrame:
    """T-5: the best rows with their place; ``top`` rows are all that is ordered on one task."""
    best = rows.orderBy(F.desc(score), F.asc(key)).limit(top)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc(score), F.asc(key))))


def hit_rate(rows: DataFrame, score: str, top: int, *, by: str = "ym", key: str = "assetid") -> DataFrame:
    """T-6: how often each name is among the best, of all windows."""
    r = ranked(rows, score, by=by, key=key)
    windows = r.agg(F.countDistinct(by).alias("windows"))
    return r.filter(F.col("rn") <= top).groupBy(key).agg(F.count(F.lit(1)).alias("hits")).crossJoin(F.broadcast(windows)).withColumn("rate", F.col("hits") / F.col("windows"))  # windows is one row


def largest(rows: DataFrame, value: Column, k: int, keys: list[str]) -> DataFrame:
    """T-7."""
    return rows.orderBy(value.desc(), *keys).limit(k)


def extremes(rows: DataFrame, key: str, value: str, by: str) -> DataFrame:
    """T-8: where each key has its largest and smallest value."""
    return rows.groupBy(key).agg(F.max_by(by, F.struct(value, by)).alias(f"best_{by}"), F.min_by(by, F.struct(value, by)).alias(f"worst_{by}"))


def first_rows(rows: DataFrame, key: str, by: str) -> DataFrame:
    """T-9."""
    return rows.withColumn("__rn", F.row_number().over(over(key, by=by))).filter("__rn = 1").drop("__rn")


def leg_sizes(sizes: DataFrame) -> DataFrame:
    """A-30: legs, and their mean and smallest size, for each strategy."""
    return sizes.groupBy("strategy").agg(F.count(F.lit(1)).alias("legs"), F.avg("n").alias("avg_n"), F.min("n").alias("min_n"))


def universe_statistics(daily: DataFrame) -> DataFrame:
    """A-32: first and last day, assets, and the mean number of assets in a month."""
    months = daily.groupBy(month_index(F.col("date")).alias("ym")).agg(F.countDistinct("assetid").alias("n")).agg(F.avg("n").alias("avg_month"))
    return daily.agg(F.min("date").alias("first"), F.max("date").alias("last"), F.countDistinct("assetid").alias("assets")).crossJoin(F.broadcast(months))  # one row each
