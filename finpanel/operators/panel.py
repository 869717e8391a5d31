"""Daily bars to monthly panels and states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finpanel.functions import month_index, over, safe_div


def to_monthly(daily: DataFrame) -> DataFrame:
    """A-1: first open, highest high, lowest low, last close, sums and counts for each asset and calendar month."""
    return daily.groupBy("assetid", month_index(F.col("date")).alias("ym")).agg(
        F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"),
        F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"), F.coalesce(F.sum("turnover"), F.lit(0.0)).alias("turnover"), F.max("date").alias("date"), F.count(F.lit(1)).alias("n_obs"),
    )


def with_returns(panel: DataFrame, *, key: str = "assetid", by: str = "ym", price: str = "close") -> DataFrame:
    """W-1 and W-3: simple return, and volume and turnover of the row before."""
    w = over(key, by=by)
    out = panel.withColumn("ret", F.col(price) / F.nullif(F.lag(price).over(w), F.lit(0.0)) - 1)
    for c in ("volume", "turnover"):
        if c in panel.columns:
            out = out.withColumn(f"{c}_prev", F.lag(c).over(w))
    return out


def log_return(panel: DataFrame, *, key: str, by: str, price: str) -> DataFrame:
    """W-2: log return between positive prices."""
    before = F.lag(price).over(over(key, by=by))
    return panel.withColumn("log_ret", F.when((F.col(price) > 0) & (before > 0), F.ln(price) - F.ln(before)))


def horizon_return(panel: DataFrame, n: int, *, key: str, by: str, price: str) -> DataFrame:
    """W-4: return over n rows."""
    return panel.withColumn(f"ret_{n}", safe_div(F.col(price), F.lag(price, n).over(over(key, by=by))) - 1)


def carry_metadata(daily: DataFrame, columns: list[str]) -> DataFrame:
    """A-2: the last value of each column that is not null, for each asset."""
    return daily.groupBy("assetid").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date"))).alias(c) for c in columns])


def attach_metadata(panel: DataFrame, meta: DataFrame, key: str = "assetid") -> DataFrame:
    """J-1: left join of a dimension with one row for each key; Spark broadcasts it below its size limit."""
    return panel.join(meta.dropDuplicates([key]), key, "left")


def market_days(daily: DataFrame) -> DataFrame:
    """A-4: days of each month on which any asset traded."""
    return daily.groupBy(month_index(F.col("date")).alias("ym")).agg(F.countDistinct("date").alias("market_days"))


def monthly_state(daily: DataFrame) -> DataFrame:
    """A-3 to A-5: trading state of each asset and month, with derived ratios."""
    w = over("assetid", by="date")
    rows = daily.withColumn("dret", safe_div(F.col("close"), F.lag("close").over(w)) - 1).withColumn("ym", month_index(F.col("date")))
    state = rows.groupBy("assetid", "ym").agg(
        F.max_by("close", "date").alias("last_price"), F.min("close").alias("min_price"), F.median("close").alias("median_price"),
        F.count_if(F.col("close") > 0).alias("valid_days"), F.count_if(F.col("volume") > 0).alias("traded_days"), F.count_if(F.coalesce(F.col("volume"), F.lit(0.0)) == 0).alias("zero_days"),
        F.median("turnover").alias("median_turnover"), F.avg("turnover").alias("mean_turnover"), F.max("dret").alias("max_ret"), F.min("dret").alias("min_ret"),
        F.stddev_samp("dret").alias("vol"), F.stddev_samp(F.when(F.col("dret") < 0, F.col("dret"))).alias("down_vol"), F.max("high").alias("high"), F.min("low").alias("low"),
    )
    state = state.join(market_days(daily), "ym")
    spread = F.col("high") - F.col("low")
    return state.select(
        "*", safe_div(F.col("zero_days"), F.col("market_days")).alias("zero_share"), safe_div(spread, F.col("last_price")).alias("range_hl"),
        safe_div(F.col("last_price") - F.col("low"), spread).alias("close_pos"), (safe_div(F.col("last_price"), F.col("high")) - 1).alias("dist_high"), (safe_div(F.col("last_price"), F.col("low")) - 1).alias("dist_low"),
    )


def quarter_end(levels: DataFrame, *, key: str, value: str) -> DataFrame:
    """A-8: last observation of each quarter, labelled with its last day."""
    q = F.trunc("date", "quarter")
    return levels.groupBy(key, q.alias("q")).agg(F.max_by(value, "date").alias(value)).select(key, F.last_day(F.add_months("q", 2)).alias("quarter_end"), value)
