"""Calendar, as-of and reconciliation joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finpanel.functions import over
from finpanel.operators import stages

BEFORE = (Window.unboundedPreceding, Window.currentRow)


def calendar(daily: DataFrame) -> DataFrame:
    """Distinct trading days with their ordinal; as many rows as days, so one partition orders them."""
    return daily.select("date").distinct().withColumn("ordinal", F.row_number().over(Window.orderBy("date")))


def execution_dates(signals: DataFrame, days: DataFrame, lag: int = 1, *, by: str = "date") -> DataFrame:
    """J-6: for each distinct signal date the lag-th trading day strictly after it, null behind the calendar's end.

    The last ordinal at or before each signal is filled forward over days and signal dates together.
    """
    dates = signals.select(F.col(by).alias("date")).distinct().select("date", F.lit(None).cast("int").alias("ordinal"), F.lit(1).alias("asks"))
    both = days.select("date", "ordinal", F.lit(0).alias("asks")).unionByName(dates)
    w = Window.orderBy("date", "asks").rowsBetween(*BEFORE)
    placed = both.withColumn("at", F.coalesce(F.last("ordinal", ignorenulls=True).over(w), F.lit(0))).filter("asks = 1").select(F.col("date").alias(by), (F.col("at") + lag).alias("ordinal"))
    return placed.join(days.select("ordinal", F.col("date").alias("exec_date")), "ordinal", "left").select(by, "exec_date")


def price_at(rows: DataFrame, daily: DataFrame, *, by: str, name: str, key: str = "assetid", price: str = "close") -> DataFrame:
    """J-7: the asset's price on the row's date, null if there is none."""
    return rows.join(daily.select(key, F.col("date").alias(by), F.col(price).alias(name)), [key, by], "left")


def entry_exit_prices(book: DataFrame, panel: DataFrame, *, price: str = "close") -> DataFrame:
    """J-8: price of the same asset in this and in the next rebalance month of the panel."""
    months = panel.select("ym").distinct()
    months = months.withColumn("next_ym", F.lead("ym").over(Window.orderBy("ym")))  # as many rows as months
    prices = panel.select("assetid", "ym", F.col(price).alias("entry_px"))
    later = panel.select("assetid", F.col("ym").alias("next_ym"), F.col(price).alias("exit_px"))
    return book.join(months, "ym").join(prices, ["assetid", "ym"], "left").join(later, ["assetid", "next_ym"], "left")


def align_inner(a: DataFrame, b: DataFrame, on: str = "date") -> DataFrame:
    """J-9 and J-12: rows of both calendars."""
    return a.join(b, on)


def align_outer_filled(a: DataFrame, b: DataFrame, columns: list[str], on: str = "date") -> DataFrame:
    """J-10: all dates of two series, each value carried forward; dates before either begins go."""
    w = Window.orderBy(on).rowsBetween(*BEFORE)  # two single series
    both = a.join(b, on, "full_outer")
    return both.select(on, *[F.last(c, ignorenulls=True).over(w).alias(c) for c in columns]).na.drop(subset=columns)


def as_of(rows: DataFrame, series: DataFrame, value: str, *, on: str = "date", keys: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """J-11: the newest value of the series at or before each row, per key, by one union and one window.

    Without keys the union is range-partitioned; each partition carries its own values forward, and begins with the last
    value of the partitions before it, one for each.
    """
    left = rows.withColumn("__asks", F.lit(1))
    right = series.select(*keys, on, value).withColumn("__asks", F.lit(0))
    both = left.unionByName(right, allowMissingColumns=True)
    known = F.when(F.col("__asks") == 0, F.col(value))
    if keys:
        w = Window.partitionBy(*keys).orderBy(on, "__asks").rowsBetween(*BEFORE)
        return both.withColumn(f"{value}_asof", F.last(known, ignorenulls=True).over(w)).filter("__asks = 1").drop("__asks", value)
    both = both.withColumn("__h", F.xxhash64(*both.columns))
    x = stages.ordered_parts(both, F.col(on), F.col("__asks"), F.col("__h"), parts=parts)
    order = F.struct(on, "__asks", "__h")
    last = F.max_by(value, F.when(known.isNotNull(), order)).alias("__last")
    before = stages.over_parts(last, parts=x, carry={"__before": F.last("__last", ignorenulls=True).over(stages.before_part())})
    w = Window.partitionBy("__part").orderBy(on, "__asks", "__h").rowsBetween(*BEFORE)
    x = x.join(F.broadcast(before), "__part")  # a row for each partition
    found = F.coalesce(F.last(known, ignorenulls=True).over(w), F.col("__before"))
    return x.withColumn(f"{value}_asof", found).filter("__asks = 1").drop("__asks", "__h", "__part", "__before", value)


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], x: str, y: str, tolerance: float = 1e-8) -> DataFrame:
    """J-14: rows of both, the largest absolute difference, and whether it is within the tolerance."""
    return a.join(b, keys).agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.abs(F.col(x) - F.col(y))).alias("max_diff")).withColumn("ok", F.coalesce(F.col("max_diff") <= tolerance, F.lit(True)))


def entries_exits(book: DataFrame, *, period: str = "period", keys: tuple[str, ...] = ("leg", "assetid")) -> DataFrame:
    """J-15: whether a position is new in its period, and whether it is gone in the next one."""
    w = over(*keys, by=period)
    new = F.coalesce(F.lag(period).over(w) != F.col(period) - 1, F.lit(True))
    gone = F.coalesce(F.lead(period).over(w) != F.col(period) + 1, F.lit(True))
    return book.withColumn("is_new", new).withColumn("will_exit", gone)


def history(schedule: DataFrame, panel: DataFrame, months: int = 120) -> DataFrame:
    """J-16: panel rows of the months before each training month; the years they may lie in are the equality key."""
    s = schedule.select("train_ym", F.explode(F.sequence(F.floor((F.col("train_ym") - months) / 12), F.floor(F.col("train_ym") / 12))).alias("__y"))
    p = panel.withColumn("__y", F.floor(F.col("ym") / 12))
    return s.join(p, "__y").filter((F.col("ym") >= F.col("train_ym") - months) & (F.col("ym") < F.col("train_ym"))).drop("__y")
