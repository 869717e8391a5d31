"""Rolling, cumulative and fill operators on ordered series."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finpanel.functions import at_least, over, safe_div
from finpanel.functions.orderstats import trailing_counts

PAST = (Window.unboundedPreceding, Window.currentRow)


def relative_volume(daily: DataFrame, n: int = 10, *, key: str = "ticker") -> DataFrame:
    """W-12: today's volume over the mean of the n rows before today."""
    w = over(key, by="date", rows=(-n, -1))
    return daily.withColumn("rel_vol", safe_div(F.col("volume"), at_least(F.avg("volume").over(w), n, w, F.col("volume"))))


def rsi(series: DataFrame, n: int = 14, *, key: str, price: str) -> DataFrame:
    """W-13: relative strength by simple means of gains and losses."""
    d = F.col(price) - F.lag(price).over(over(key, by="date"))
    w = over(key, by="date", rows=(-(n - 1), 0))
    out = series.withColumn("__g", F.greatest(d, F.lit(0.0))).withColumn("__l", F.greatest(-d, F.lit(0.0)))
    out = out.withColumn("__g", F.when(d.isNotNull(), F.col("__g"))).withColumn("__l", F.when(d.isNotNull(), F.col("__l")))
    gain, loss = (at_least(F.avg(c).over(w), n, w, F.col(c)) for c in ("__g", "__l"))
    return out.withColumn("rsi", 100 * safe_div(gain, gain + loss)).drop("__g", "__l")


def moving_averages(series: DataFrame, short: int, long: int, slope: int, *, key: str, price: str) -> DataFrame:
    """W-14: two moving averages, the slope of the short one, and whether it stood above the long one on the row before."""
    for n, name in ((short, "sma_short"), (long, "sma_long")):
        w = over(key, by="date", rows=(-(n - 1), 0))
        series = series.withColumn(name, at_least(F.avg(price).over(w), n, w, F.col(price)))
    w = over(key, by="date")
    series = series.withColumn("sma_slope", safe_div(F.col("sma_short"), F.lag("sma_short", slope).over(w)) - 1)
    return series.withColumn("is_cross", F.coalesce(F.lag("sma_short").over(w) > F.lag("sma_long").over(w), F.lit(False)))


def rolling_drawdown(series: DataFrame, n: int, *, key: str, price: str) -> DataFrame:
    """W-15: value over the highest of the last n rows."""
    w = over(key, by="date", rows=(-(n - 1), 0))
    return series.withColumn("dd_roll", safe_div(F.col(price), at_least(F.max(price).over(w), n, w, F.col(price))) - 1)


def ratio_features(series: DataFrame, a: str, b: str, n: int, *, key: str) -> DataFrame:
    """W-16: spread and ratio of two columns, and the first over its rolling mean."""
    w = over(key, by="date", rows=(-(n - 1), 0))
    return series.withColumn("spread", F.col(a) - F.col(b)).withColumn("ratio", safe_div(F.col(a), F.col(b))).withColumn("rel", safe_div(F.col(a), at_least(F.avg(a).over(w), n, w, F.col(a))))


def equity(returns: DataFrame, *, key: str, by: str = "date", ret: str = "ret") -> DataFrame:
    """W-17 and W-18: compounded equity, its sum and log forms, running peak and drawdown."""
    w = over(key, by=by, rows=PAST)
    out = returns.withColumn("equity", F.product(1 + F.col(ret)).over(w)).withColumn("cum_sum", F.sum(ret).over(w)).withColumn("cum_log", F.exp(F.sum(F.log1p(ret)).over(w)) - 1)
    out = out.withColumn("peak", F.max("equity").over(w))
    return out.withColumn("drawdown", safe_div(F.col("equity"), F.col("peak")) - 1)


def longest_drawdown(curve: DataFrame, *, key: str, by: str = "date") -> DataFrame:
    """W-19: the longest run of rows below the peak; runs are islands between rows at the peak."""
    w = over(key, by=by, rows=PAST)
    islands = curve.withColumn("__i", F.sum((F.col("drawdown") >= 0).cast("int")).over(w)).groupBy(key, "__i").agg(F.count_if(F.col("drawdown") < 0).alias("n"))
    return islands.groupBy(key).agg(F.max("n").alias("longest"))


def worst_period(curve: DataFrame, *, key: str, by: str = "date") -> DataFrame:
    """W-20: depth, end and start (the peak before) of the largest drawdown."""
    end = curve.groupBy(key).agg(F.min("drawdown").alias("max_dd"), F.min_by(by, F.struct("drawdown", by)).alias("end_date"))
    before = curve.join(end, key).filter(F.col(by) <= F.col("end_date"))
    return before.groupBy(key, "max_dd", "end_date").agg(F.max_by(by, F.struct("equity", F.datediff(F.lit("2100-01-01"), by))).alias("start_date"))


def rolling_sharpe(rows: DataFrame, n: int, *, key: str, by: str = "date", ret: str = "ret") -> DataFrame:
    """W-21: rolling mean over deviation, and share of gains, once n rows are there."""
    w = over(key, by=by, rows=(-(n - 1), 0))
    full = F.count(F.lit(1)).over(w) >= n
    return rows.withColumn("roll_sharpe", F.when(full, safe_div(F.avg(ret).over(w), F.stddev_samp(ret).over(w)))).withColumn("roll_win", F.when(full, F.avg((F.col(ret) > 0).cast("double")).over(w)))


def rolling_ols(rows: DataFrame, n: int, *, key: str, y: str, x: str, by: str = "date") -> DataFrame:
    """W-22 and W-23: slope, intercept and correlation over the last n rows."""
    w = over(key, by=by, rows=(-(n - 1), 0))
    full = F.count(F.lit(1)).over(w) >= n
    return rows.withColumn("beta", F.when(full, F.regr_slope(y, x).over(w))).withColumn("alpha", F.when(full, F.regr_intercept(y, x).over(w))).withColumn("rho", F.when(full, F.corr(y, x).over(w)))


def fill(rows: DataFrame, column: str, *, key: str, by: str = "date", limit: int | None = None) -> DataFrame:
    """W-24: last value carried forward, by at most ``limit`` rows; and linear interpolation by date between neighbours."""
    w, ahead = over(key, by=by, rows=PAST), over(key, by=by, rows=(Window.currentRow, Window.unboundedFollowing))
    n = F.row_number().over(over(key, by=by))
    rows = rows.withColumn("__n", n)
    at = F.last(F.when(F.col(column).isNotNull(), F.col("__n")), ignorenulls=True).over(w)
    last = F.last(column, ignorenulls=True).over(w)
    filled = last if limit is None else F.when(F.col("__n") - at <= limit, last)
    d0, d1 = F.last(F.when(F.col(column).isNotNull(), F.col(by)), ignorenulls=True).over(w), F.first(F.when(F.col(column).isNotNull(), F.col(by)), ignorenulls=True).over(ahead)
    nxt = F.first(column, ignorenulls=True).over(ahead)
    share = safe_div(F.datediff(by, d0), F.datediff(d1, d0))
    rows = rows.withColumn(f"{column}_filled", filled).withColumn(f"{column}_linear", F.when(F.col(column).isNotNull(), F.col(column)).otherwise(last + (nxt - last) * share))
    return rows.drop("__n")


def rolling_state(long: DataFrame, n: int, *, variable: str = "variable", by: str = "date", value: str = "value") -> DataFrame:
    """W-25: 0, 1 or 2 for values below, within and above the quartiles of the last n rows of each variable; null with over a tenth missing."""
    w = over(variable, by=by, rows=(-(n - 1), 0))
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).over(w)
    ok = (F.count(F.lit(1)).over(w) >= n) & (F.count(value).over(w) >= 0.9 * n)
    return long.withColumn("level", F.when(ok & F.col(value).isNotNull(), F.when(F.col(value) > q[1], 2).when(F.col(value) < q[0], 0).otherwise(1)))


def state_code(levels: DataFrame, order: list[str], *, variable: str = "variable", by: str = "date", base: int = 3) -> DataFrame:
    """W-25: the levels of all variables as one number, null if one is missing."""
    place = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(variable)) - 1
    g = levels.groupBy(by).agg(F.sum(F.col("level") * F.pow(F.lit(base), place)).alias("code"), F.count("level").alias("n"))
    return g.select(by, F.when(F.col("n") == len(order), F.col("code")).cast("int").alias("state"))


def regime_changes(states: DataFrame, *, key: str, by: str = "date", state: str = "state") -> DataFrame:
    """W-26: rows, changes of state and mean rows between them."""
    flagged = states.withColumn("__c", F.coalesce(F.col(state) != F.lag(state).over(over(key, by=by)), F.lit(False)).cast("int"))
    return flagged.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("__c").alias("changes")).withColumn("holding", F.col("n") / (F.col("changes") + 1))


def trailing_rank(rows: DataFrame, n: int, *, key: str, by: str = "date", value: str = "value") -> DataFrame:
    """W-27: mid-rank of the newest value among the last n of its own, itself included.

    A key's rows are numbered and cut into blocks of n. A window spans a block and the end of the one before, so a task
    takes the values of two blocks, and ranks them by merging sorted runs: no row holds its window. Nulls are no values;
    the rank of a null is 0, as no value is below it.
    """
    at = F.row_number().over(over(key, by=by)) - 1
    x = rows.select(F.struct(*rows.columns).alias("row"), F.struct(F.col(key).alias("k")).alias("key"), F.col(value).cast("double").alias("v"), at.alias("at"))
    block = F.floor(F.col("at") / n)
    # each value is once in its own block, with its row, and once in front of the next one
    x = x.withColumn("b", F.explode(F.array(F.struct(block.alias("no"), F.lit(True).alias("own")), F.struct((block + 1).alias("no"), F.lit(False).alias("own")))))
    x = x.select(F.col("b.no").alias("no"), F.col("b.own").alias("own"), "key", "v", "at", F.when(F.col("b.own"), F.col("row")).alias("row"))

    def rank(table: pa.Table) -> pa.Table:
        own = table.column("own").to_numpy(zero_copy_only=False)
        v, at = table.column("v"), table.column("at").to_numpy()
        there, v = v.is_valid().to_numpy(zero_copy_only=False), v.fill_null(0.0).to_numpy()
        old, new = np.flatnonzero(~own), np.flatnonzero(own)
        old, new = old[np.argsort(at[old])], new[np.argsort(at[new])]
        less, same, full = trailing_counts(v[old], v[new], there[old], there[new])
        with np.errstate(invalid="ignore"):
            share = np.where(full > 0, (less + 0.5 * same) / np.maximum(full, 1), np.nan)
        return pa.table({"row": table.column("row").take(pa.array(new)), "trail_rank": pa.array(share, mask=full == 0)})

    kind = rows.schema.simpleString()
    found = x.groupBy("key", "no").applyInArrow(rank, f"row {kind}, trail_rank double")
    return found.filter("row is not null").select("row.*", "trail_rank")


def lag_signal(rows: DataFrame, signal: str, *, key: str, by: str = "date") -> DataFrame:
    """W-28: a signal holds from the row after it until the next one."""
    before = F.lag(signal).over(over(key, by=by))
    return rows.withColumn("__b", before).withColumn(f"{signal}_live", F.last("__b", ignorenulls=True).over(over(key, by=by, rows=PAST))).drop("__b")


def rebase(rows: DataFrame, value: str, *, key: str, by: str = "date", to: float = 100.0) -> DataFrame:
    """W-29: the series with its first value set to 100."""
    first = F.first(value).over(over(key, by=by, rows=(Window.unboundedPreceding, Window.unboundedFollowing)))
    return rows.withColumn("rebased", to * safe_div(F.col(value), first))


def running_mean(rows: DataFrame, value: str, *, key: str, by: str) -> DataFrame:
    """W-30: mean of all rows so far."""
    return rows.withColumn("running_mean", F.avg(value).over(over(key, by=by, rows=PAST)))


def autocorrelation(rows: DataFrame, lags: int, *, key: str, by: str = "date", value: str = "ret") -> DataFrame:
    """W-31: autocorrelations around the overall mean, one row for each lag."""
    w = over(key, by=by)
    x = rows.withColumn("__d", F.col(value) - F.avg(value).over(Window.partitionBy(key)))
    x = x.withColumn("__l", F.array(*[F.lag("__d", k).over(w) for k in range(1, lags + 1)]))
    x = x.select(key, "__d", F.posexplode("__l").alias("k", "__e"))
    g = x.groupBy(key, (F.col("k") + 1).alias("lag")).agg(F.sum(F.col("__d") * F.col("__e")).alias("c"), F.sum(F.col("__d") * F.col("__d")).alias("v"))
    return g.select(key, "lag", safe_div(F.col("c"), F.col("v")).alias("acf"))


def differences(rows: DataFrame, value: str, *, key: str, by: str = "date") -> DataFrame:
    """W-32: first differences of levels and logs."""
    w = over(key, by=by)
    return rows.withColumn("diff", F.col(value) - F.lag(value).over(w)).withColumn("dlog", F.when(F.col(value) > 0, F.ln(value)) - F.lag(F.when(F.col(value) > 0, F.ln(value))).over(w))
