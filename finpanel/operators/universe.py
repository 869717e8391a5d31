"""Which assets count in which month: filters, ranks, tradability, membership."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finpanel.functions import at_least, month_index, over, percent_rank_average, safe_div
from finpanel.operators.quantiles import exact_quantiles

ALL_ROWS = (Window.unboundedPreceding, Window.currentRow)


def drop_first(panel: DataFrame, column: str = "ret") -> DataFrame:
    """F-1: rows without a return go."""
    return panel.na.drop(subset=[column])


def is_stale(volume: Column, before: Column, ret: Column) -> Column:
    """F-2: no volume now and a month ago, and no return; nulls count as zero."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return (z(volume) == 0) & (z(before) == 0) & (F.abs(z(ret)) < 1e-10)


def whitelist(panel: DataFrame, *, flag: str | None = None, column: str | None = None, values: list[str] | None = None, keep: Column | None = None) -> DataFrame:
    """F-3: rows whose flag is true and whose column has one of the values, or for which ``keep`` holds."""
    if flag:
        panel = panel.filter(F.coalesce(F.col(flag), F.lit(False)))
    if keep is not None:
        panel = panel.filter(keep)
    return panel.filter(F.col(column).isin(values)) if column else panel


def cascade(panel: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """F-4: rows that pass all conditions."""
    return panel.filter(reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for _, c in stages]))


def cascade_audit(panel: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """F-4 and A-36: rows left after each stage and removed by it, in one pass over the panel."""
    conditions = [F.lit(True)]
    for _, c in stages:
        conditions.append(conditions[-1] & F.coalesce(c, F.lit(False)))
    counted = panel.agg(*[F.count_if(c).alias(f"c{i}") for i, c in enumerate(conditions)])
    names = ["input", *[n for n, _ in stages]]
    rows = counted.select(F.explode(F.array(*[F.struct(F.lit(i).alias("stage"), F.lit(n).alias("name"), F.col(f"c{i}").alias("rows"), (F.lit(0).cast("long") if i == 0 else F.col(f"c{i - 1}") - F.col(f"c{i}")).alias("removed")) for i, n in enumerate(names)])).alias("s"))
    return rows.select("s.*")


def positive_only(levels: DataFrame, *, value: str = "level") -> DataFrame:
    """F-7: values that are not positive become null."""
    return levels.withColumn(value, F.when(F.col(value) > 0, F.col(value)))


def complete_rows(levels: DataFrame, *, key: str = "asset", by: str = "date", value: str = "level") -> DataFrame:
    """F-7 by row: dates on which every asset has a value."""
    good = levels.filter(F.col(value).isNotNull())
    n = levels.agg(F.countDistinct(key).alias("n"))
    dates = good.groupBy(by).agg(F.countDistinct(key).alias("have")).crossJoin(F.broadcast(n)).filter("have = n").select(by)  # n is one row
    return good.join(dates, by, "left_semi")


def complete_columns(levels: DataFrame, *, key: str = "asset", by: str = "date", value: str = "level") -> DataFrame:
    """F-7 by column: assets that have a value on every date."""
    return complete_rows(levels, key=by, by=key, value=value)


def last_years(rows: DataFrame, months: int, by: str = "date") -> DataFrame:
    """F-10: rows of the last months before the newest date."""
    newest = rows.agg(F.max(by).alias("__newest"))
    return rows.crossJoin(F.broadcast(newest)).filter(F.col(by) >= F.add_months("__newest", -months)).drop("__newest")  # one row


def trim_extremes(rows: DataFrame, column: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """F-11: rows between two quantiles."""
    q = exact_quantiles(rows, column, [low, high]).withColumnRenamed("q", "__q")
    return rows.crossJoin(F.broadcast(q)).filter(F.col(column).between(F.col("__q")[0], F.col("__q")[1])).drop("__q")  # one row


def split_last(rows: DataFrame, k: int, *, key: str, by: str) -> DataFrame:
    """F-12: the last k rows of each series are the test part."""
    rn = F.row_number().over(over(key, by=[F.desc(by)]))
    return rows.withColumn("part", F.when(rn <= k, "test").otherwise("train"))


def rolling_ratio(panel: DataFrame, column: str, n: int, least: int, *, key: str = "assetid", by: str = "ym", name: str | None = None) -> DataFrame:
    """W-10: the value over its rolling mean, once enough rows are there. Sums of a decimal column are exact: equal rows have equal ratios."""
    w = over(key, by=by, rows=(-(n - 1), 0))
    mean = F.sum(column).over(w).cast("double") / F.count(column).over(w)
    return panel.withColumn(name or f"{column}_ratio_{n}", safe_div(F.col(column), at_least(mean, least, w, F.col(column))))


def liquidity_bottom(panel: DataFrame, share: float, *, lookback: int = 12, least: int = 6) -> DataFrame:
    """W-11: rows whose turnover ratio is at or above the month's quantile; rows without a ratio go.

    Where many assets have the ratio that is the quantile, turnover should be a decimal: sums of doubles depend on their order, and so would the side of the bar.
    """
    rated = rolling_ratio(panel, "turnover", lookback, least, name="ratio")
    bars = rated.groupBy("ym").agg(F.percentile("ratio", F.lit(share)).alias("bar"))
    return rated.join(bars, "ym").filter("ratio >= bar")


def tradability(state: DataFrame, *, min_price: float = 1.0, min_rank: float = 0.2, max_zero_share: float = 0.2, full_month: bool = True) -> DataFrame:
    """W-9, W-10 and F-9: turnover rank and ratios, and the flag, which is never null."""
    out = rolling_ratio(rolling_ratio(state, "mean_turnover", 3, 2, name="turnover_ratio_3"), "mean_turnover", 12, 6, name="turnover_ratio_12")
    out = out.withColumn("turnover_rank", percent_rank_average(F.col("median_turnover"), "ym"))
    flag = (F.col("min_price") >= min_price) & (F.col("turnover_rank") >= min_rank) & (F.col("zero_share") <= max_zero_share)
    if full_month:
        flag = flag & (F.col("traded_days") == F.col("market_days"))
    return out.withColumn("is_tradable", F.coalesce(flag, F.lit(False)))


def members(panel: DataFrame, intervals: DataFrame) -> DataFrame:
    """J-3: rows whose month overlaps an interval of their asset, once, however many overlap."""
    spans = intervals.select("assetid", month_index(F.col("start_date")).alias("__from"), month_index(F.col("end_date")).alias("__to"))
    return panel.join(spans, (panel["assetid"] == spans["assetid"]) & F.col("ym").between(F.col("__from"), F.col("__to")), "left_semi")


def members_on(intervals: DataFrame, day: str) -> DataFrame:
    """J-4: members on a day."""
    d = F.lit(day).cast("date")
    return intervals.filter((F.col("start_date") <= d) & (F.col("end_date") >= d)).select("assetid").distinct()


def resolve_keys(rows: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """J-5: rows with their mapped id, null where there is none."""
    return rows.join(mapping.dropDuplicates([key]), key, "left")


def unresolved(rows: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """J-5: the keys that have no id, and their rows."""
    return rows.join(mapping, key, "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
