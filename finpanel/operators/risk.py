"""Risk and return tables, regressions, tail risk, valuation."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finpanel.functions import over, safe_div
from finpanel.operators.stages import cut

PAST = (Window.unboundedPreceding, Window.currentRow)


def risk_return(returns: DataFrame, *, rf: float = 0.0, key: str = "asset", ret: str = "ret", periods: int = 252) -> DataFrame:
    """D-1: annualised return, risk and Sharpe ratio."""
    g = returns.groupBy(key).agg((F.avg(ret) * periods).alias("ann_ret"), (F.stddev_samp(ret) * F.sqrt(F.lit(float(periods)))).alias("ann_risk"))
    return g.withColumn("sharpe", safe_div(F.col("ann_ret") - rf, F.col("ann_risk")))


#: Assets of a block and rows of a stretch of dates, on average, of the products behind covariances.
BLOCK, STRETCH = 256, 1 << 18


def covariance(returns: DataFrame, *, key: str = "asset", by: str = "date", ret: str = "ret", block: int = BLOCK, stretch: int = STRETCH) -> DataFrame:
    """D-2: sample covariance and correlation of each pair of assets on their common dates, both triangles.

    Assets are dealt to blocks and dates to stretches. For each pair of blocks and stretch a task makes two matrices, dates
    by assets, of deviations from the assets' means, and of marks of the dates that an asset has; numpy products of these
    are the six sums over common dates of all pairs at once, and the stretches' sums are added. A return goes once to each
    pair of its block and another, so what is moved is rows times blocks, and no row is made for two assets on a date.
    Null returns are no observations; of several returns of an asset on a date the mean counts.
    """
    rows = returns.filter(F.col(key).isNotNull() & F.col(by).isNotNull() & F.col(ret).isNotNull()).groupBy(F.col(key).alias("k"), F.col(by).alias("t")).agg(F.avg(ret).alias("x"))
    assets = cut(rows.groupBy("k").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n")))
    size = assets.agg(F.count(F.lit(1)), F.sum("n")).first()
    blocks, stretches = math.ceil(size[0] / block) or 1, math.ceil((size[1] or 0) / (math.ceil(size[0] / block) or 1) / stretch) or 1
    own = F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int")
    x = rows.join(assets.select("k", "m"), "k").select("k", "t", (F.col("x") - F.col("m")).alias("x"), own.alias("b"), F.pmod(F.xxhash64("t"), F.lit(stretches)).cast("int").alias("s"))
    x = x.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("k", "t", "x", "b", "s", F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"))

    def coded(c: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
        d = c.combine_chunks().dictionary_encode()
        d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
        return d.indices.to_numpy(zero_copy_only=False), d.dictionary

    def products(table: pa.Table) -> pa.Table:
        b, x = table.column("b").to_numpy(), table.column("x").to_numpy()
        t, times = coded(table.column("t"))
        p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
        sides = []
        for block in (p, q):
            at = np.flatnonzero(b == block)
            k, names = coded(table.column("k").take(pa.array(at)))
            dev, has = np.zeros((len(times), len(names))), np.zeros((len(times), len(names)))
            dev[t[at], k], has[t[at], k] = x[at], 1.0
            sides.append((names, dev, has))
        (left, a, u), (right, c, v) = sides
        n = u.T @ v
        sums = {"n": n, "x": a.T @ v, "y": u.T @ c, "xy": a.T @ c, "xx": (a * a).T @ v, "yy": u.T @ (c * c)}
        i, j = np.nonzero(n if p != q else np.triu(n))
        out = {"i": left.take(pa.array(i)), "j": right.take(pa.array(j))}
        return pa.table(out | {name: pa.array(s[i, j]) for name, s in sums.items()})

    kind = returns.schema[key].dataType.simpleString()
    found = x.groupBy("p", "q", "s").applyInArrow(products, f"i {kind}, j {kind}, n double, x double, y double, xy double, xx double, yy double")
    if stretches > 1:  # which of a pair comes first may differ between stretches
        turn = F.col("i") > F.col("j")
        pick = lambda a, b: F.when(turn, F.col(b)).otherwise(F.col(a))
        found = found.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "n", pick("x", "y").alias("x"), pick("y", "x").alias("y"), "xy", pick("xx", "yy").alias("xx"), pick("yy", "xx").alias("yy"))
        found = found.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xy", "xx", "yy")])
    about = lambda a, b, c: F.col(a) - F.col(b) * F.col(c) / F.col("n")
    xy, xx, yy = about("xy", "x", "y"), about("xx", "x", "x"), about("yy", "y", "y")
    corr = F.when((F.col("n") > 1) & (xx > 0) & (yy > 0), xy / F.sqrt(xx * yy))
    half = found.select("i", "j", safe_div(xy, F.col("n") - 1).alias("cov"), corr.alias("corr"), F.col("n").cast("long").alias("n"))
    sides = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return half.select(F.explode(sides).alias("p"), "cov", "corr", "n").select("p.i", "p.j", "cov", "corr", "n")


def score_portfolios(weights: DataFrame, table: DataFrame, cov: DataFrame, *, rf: float = 0.0) -> DataFrame:
    """D-3 and D-4: return, risk and Sharpe ratio of each candidate's weights (candidate, asset, w)."""
    mean = weights.join(table.select("asset", "ann_ret"), "asset").groupBy("candidate").agg(F.sum(F.col("w") * F.col("ann_ret")).alias("port_ret"))
    wi, wj = weights.select("candidate", F.col("asset").alias("i"), F.col("w").alias("wi")), weights.select("candidate", F.col("asset").alias("j"), F.col("w").alias("wj"))
    var = wi.join(cov.select("i", "j", "cov"), "i").join(wj, ["candidate", "j"]).groupBy("candidate").agg(F.sum(F.col("wi") * F.col("wj") * F.col("cov") * 252).alias("var"))
    out = mean.join(var, "candidate").withColumn("port_risk", F.sqrt(F.greatest("var", F.lit(0.0)))).drop("var")
    return out.withColumn("port_sharpe", safe_div(F.col("port_ret") - rf, F.col("port_risk")))


def best_portfolios(scored: DataFrame) -> DataFrame:
    """D-4: the candidates of least risk, most return and highest Sharpe ratio."""
    return scored.agg(F.min_by("candidate", F.struct("port_risk", "candidate")).alias("min_risk"), F.max_by("candidate", F.struct("port_ret", "candidate")).alias("max_ret"), F.max_by("candidate", F.struct("port_sharpe", "candidate")).alias("max_sharpe"))


def performance(curve: DataFrame, *, key: str, periods: int = 12) -> DataFrame:
    """D-5 and D-6: totals of a curve with ret, equity and drawdown: annualised return, risk, Sharpe, worst drawdown, t value, win rate and 5 % quantile."""
    g = curve.groupBy(key).agg(
        F.count("ret").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"), (F.product(1 + F.col("ret")) - 1).alias("total"), F.min("drawdown").alias("max_dd"),
        F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"), F.percentile("ret", F.lit(0.05)).alias("q05"),
    )
    return g.select(
        key, "n", (F.col("mean") * periods).alias("ann_ret"), (F.col("sd") * F.sqrt(F.lit(float(periods)))).alias("ann_vol"), safe_div(F.col("mean") * periods, F.col("sd") * F.sqrt(F.lit(float(periods)))).alias("sharpe"),
        "total", (F.pow(1 + F.col("total"), safe_div(F.lit(float(periods)), F.col("n"))) - 1).alias("geo_ret"), "max_dd", safe_div(F.col("mean") * F.sqrt(F.col("n").cast("double")), F.col("sd")).alias("t_stat"), "win_rate", "q05",
    )


def trade_summary(trades: DataFrame, *, key: str, pnl: str = "net_pnl", r: str = "r_multiple") -> DataFrame:
    """D-7: totals, wins and losses, profit factor and R multiples of a trade log."""
    p = F.col(pnl)
    return trades.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(p > 0).alias("wins"), F.count_if(p < 0).alias("losses"), F.sum(p).alias("pnl"),
        safe_div(F.sum(F.when(p > 0, p)), -F.sum(F.when(p < 0, p))).alias("profit_factor"), F.avg(r).alias("mean_r"), F.max(r).alias("max_r"), F.min(r).alias("min_r"),
    )


def capm(rows: DataFrame, *, key: str, y: str = "ret", x: str = "bench", periods: int = 252) -> DataFrame:
    """D-8: annualised alpha and beta."""
    return rows.groupBy(key).agg((F.regr_intercept(y, x) * periods).alias("alpha"), F.regr_slope(y, x).alias("beta"), F.regr_r2(y, x).alias("r2"))


def market_model(rows: DataFrame, size: int, *, key: str, y: str = "ret", x: str = "bench", by: str = "date") -> DataFrame:
    """D-9: alpha, beta, tracking error and R2 of each full window of ``size`` rows of each asset."""
    w = rows.withColumn("window_no", F.floor((F.row_number().over(over(key, by=by)) - 1) / size))
    g = w.groupBy(key, "window_no").agg(F.count(F.lit(1)).alias("n"), (F.regr_intercept(y, x) * 252).alias("alpha"), F.regr_slope(y, x).alias("beta"), F.regr_r2(y, x).alias("r2"), F.var_pop(y).alias("v"))
    return g.filter(F.col("n") == size).withColumn("te", F.sqrt(F.greatest(F.col("v") * (1 - F.col("r2")), F.lit(0.0))) * F.sqrt(F.lit(252.0))).drop("v", "n")


def tracking_bands(models: DataFrame) -> DataFrame:
    """D-9: mean, 50 % and 70 % quantile of the tracking error by window."""
    return models.groupBy("window_no").agg(F.avg("te").alias("te_mean"), F.percentile("te", F.lit(0.5)).alias("te_p50"), F.percentile("te", F.lit(0.7)).alias("te_p70"))


def ols(rows: DataFrame, y: str, xs: list[str]) -> tuple[DataFrame, dict[str, float], float]:
    """D-10: rows with fitted values and residuals, coefficients and R2 of a linear regression with intercept."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    v = VectorAssembler(inputCols=xs, outputCol="__x", handleInvalid="skip").transform(rows.na.drop(subset=[y, *xs]))
    m = LinearRegression(featuresCol="__x", labelCol=y, predictionCol="fitted", solver="normal", regParam=0.0).fit(v)
    coefficients = {"intercept": float(m.intercept), **dict(zip(xs, map(float, m.coefficients), strict=True))}
    return m.transform(v).withColumn("residual", F.col(y) - F.col("fitted")).drop("__x"), coefficients, float(m.summary.r2)


def rule_evaluation(rows: DataFrame, *, key: str, truth: Column, rule: Column) -> DataFrame:
    """D-11: accuracy, sensitivity and specificity of a rule for up days, and its two-by-two table."""
    r = rows.withColumn("__t", truth).withColumn("__r", rule).filter("__t is not null and __r is not null")
    c = lambda t, g: F.count_if((F.col("__t") == t) & (F.col("__r") == g))
    g = r.groupBy(key).agg(c(True, True).alias("tp"), c(False, True).alias("fp"), c(False, False).alias("tn"), c(True, False).alias("fn"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return g.select("*", safe_div(tp + tn, tp + fp + tn + fn).alias("accuracy"), safe_div(tp, tp + fn).alias("sensitivity"), safe_div(tn, tn + fp).alias("specificity"))


def weighted_basket(series: DataFrame, weights: dict[str, float], *, key: str, value: str, by: str = "date") -> DataFrame:
    """D-17: weighted sum of the members by date, on dates that all of them have, and the log of its hundredfold size."""
    pick = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col(key))
    g = series.filter(F.col(key).isin(list(weights))).groupBy(by).agg(F.sum(F.col(value) * pick).alias("basket"), F.countDistinct(key).alias("n")).filter(F.col("n") == len(weights))
    return g.select(by, "basket", F.when(F.col("basket") > 0, F.ln(F.col("basket") * 100)).alias("log_basket"))


def zero_coupon(rows: DataFrame, yield_: str, years: float, *, key: str, by: str = "date") -> DataFrame:
    """D-18: price of a zero bond at a yield, its exponential form, and the log change of the price."""
    rows = rows.withColumn("zero_px", 100 / F.pow(1 + F.col(yield_), F.lit(years))).withColumn("zero_exp", F.exp(-years * F.col(yield_)))
    return rows.withColumn("zero_log", F.ln("zero_px") - F.ln(F.lag("zero_px").over(over(key, by=by))))


def valuation(statements: DataFrame, *, tax: float = 0.21, rf: float = 0.045, premium: float = 0.05, beta: float = 1.1, debt_share: float = 0.3, debt_cost: float = 0.05, terminal: float = 0.02, years: int = 5, cap: float = 0.15) -> DataFrame:
    """D-19: free cash flow by year, its mean growth, WACC, discounted projection with Gordon terminal value, and equity value per share, by issuer.

    Statements have issuer, year, ebit, dep, capex, dwc, net_debt and shares; growth is kept within ``cap`` either way.
    """
    s = statements.withColumn("fcf", F.col("ebit") * (1 - tax) + F.col("dep") - F.col("capex") - F.col("dwc"))
    s = s.withColumn("growth", safe_div(F.col("fcf"), F.lag("fcf").over(over("issuer", by="year"))) - 1)
    wacc = (1 - debt_share) * (rf + beta * premium) + debt_share * debt_cost * (1 - tax)
    if wacc <= terminal:
        raise ValueError("terminal growth must be below the cost of capital")
    g = s.groupBy("issuer").agg(F.max_by("fcf", "year").alias("fcf0"), F.avg("growth").alias("g"), F.max("net_debt").alias("net_debt"), F.max("shares").alias("shares"))
    g = g.withColumn("g", F.least(F.greatest(F.coalesce("g", F.lit(0.0)), F.lit(-cap)), F.lit(cap)))
    p = g.select("*", F.explode(F.sequence(F.lit(1), F.lit(years))).alias("y")).withColumn("f", F.col("fcf0") * F.pow(1 + F.col("g"), "y"))
    v = p.groupBy("issuer", "fcf0", "g", "net_debt", "shares").agg(F.sum(F.col("f") / F.pow(F.lit(1 + wacc), "y")).alias("pv"), F.max_by("f", "y").alias("last"))
    v = v.withColumn("ev", F.col("pv") + F.col("last") * (1 + terminal) / (wacc - terminal) / (1 + wacc) ** years)
    return v.withColumn("equity_value", F.col("ev") - F.col("net_debt")).withColumn("per_share", safe_div(F.col("equity_value"), F.col("shares"))).select("issuer", "fcf0", "g", "ev", "equity_value", "per_share")


def exposure(rows: DataFrame, *, segment: str, value: str, before: str) -> DataFrame:
    """D-20: value, change and share of the book by segment, with a total row."""
    g = rows.rollup(segment).agg(F.sum(value).alias("notional"), F.sum(F.col(value) - F.col(before)).alias("delta"))
    total = rows.agg(F.sum(value).alias("book"))
    return g.crossJoin(F.broadcast(total)).withColumn("pct", 100 * safe_div(F.col("notional"), F.col("book"))).drop("book")  # total is one row


def outcome_risk(rows: DataFrame, *, key: str, value: str, level: float = 0.05, floor: float = 0.0, z: float = 1.6448536269514722) -> DataFrame:
    """D-21: historical and parametric value at risk, probability of a value below the floor, and a 90 % band."""
    g = rows.groupBy(key).agg(F.percentile(value, F.array(F.lit(level), F.lit(0.05), F.lit(0.95))).alias("q"), F.avg((F.col(value) < floor).cast("double")).alias("p_loss"), F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    return g.select(key, (-F.col("q")[0]).alias("var_hist"), (z * F.col("s") - F.col("m")).alias("var_norm"), "p_loss", F.col("q")[1].alias("band_lo"), F.col("q")[2].alias("band_hi"))


def cvar_count(rows: DataFrame, alpha: float, *, key: str, value: str) -> DataFrame:
    """D-22 a: mean of the lowest floor((1 - alpha) n) values, one at least."""
    w = over(key, by=value)
    r = rows.withColumn("__i", F.row_number().over(w)).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    return r.filter(F.col("__i") <= F.greatest(F.lit(1), F.floor(F.lit(1 - alpha) * F.col("__n")))).groupBy(key).agg(F.avg(value).alias("cvar_a"))


def cvar_quantile(rows: DataFrame, alpha: float, *, key: str, value: str) -> DataFrame:
    """D-22 b: mean of the values at or below the linear (1 - alpha) quantile."""
    q = rows.groupBy(key).agg(F.percentile(value, F.lit(1 - alpha)).alias("__q"))
    return rows.join(q, key).filter(F.col(value) <= F.col("__q")).groupBy(key).agg(F.avg(value).alias("cvar_b"))


def cvar_weighted(rows: DataFrame, alpha: float, *, key: str, value: str, weight: str) -> DataFrame:
    """D-22 c: weighted mean of the lowest values while their cumulated weight is at most 1 - alpha; else the worst value."""
    w = Window.partitionBy(key).orderBy(value, weight).rowsBetween(*PAST)
    r = rows.withColumn("__c", F.sum(weight).over(w) / F.sum(weight).over(Window.partitionBy(key)))
    tail = F.col("__c") <= 1 - alpha
    g = r.groupBy(key).agg(safe_div(F.sum(F.when(tail, F.col(value) * F.col(weight))), F.sum(F.when(tail, F.col(weight)))).alias("m"), F.min(value).alias("worst"))
    return g.select(key, F.coalesce("m", "worst").alias("cvar_c"))


def cvar_losses(rows: DataFrame, alpha: float, *, key: str, value: str) -> DataFrame:
    """D-22 d: mean loss at or above the alpha quantile of losses."""
    losses = rows.withColumn("__l", -F.col(value))
    q = losses.groupBy(key).agg(F.percentile("__l", F.lit(alpha)).alias("__q"))
    return losses.join(q, key).filter("__l >= __q").groupBy(key).agg(F.avg("__l").alias("cvar_d"))


def efficiency(returns: DataFrame, horizon: int, alpha: float = 0.95, *, key: str, by: str = "date", ret: str = "ret") -> DataFrame:
    """D-23: mean of rolling horizon sums over the size of their tail mean."""
    w = over(key, by=by, rows=(-(horizon - 1), 0))
    sums = returns.withColumn("h", F.when(F.count(F.lit(1)).over(w) >= horizon, F.sum(ret).over(w))).filter("h is not null")
    m = sums.groupBy(key).agg(F.avg("h").alias("mean_h"))
    return m.join(cvar_quantile(sums, alpha, key=key, value="h"), key).withColumn("efficiency", safe_div(F.col("mean_h"), F.abs("cvar_b")))


def cvar_contribution(scenarios: DataFrame, weights: DataFrame, alpha: float, *, by: str = "date", asset: str = "asset", ret: str = "ret") -> DataFrame:
    """D-24: each asset's part of the portfolio's tail mean, and their sum with a null asset."""
    x = scenarios.join(weights, asset).withColumn("c", F.col("w") * F.col(ret))
    port = x.groupBy(by).agg(F.sum("c").alias("port"))
    q = port.agg(F.percentile("port", F.lit(1 - alpha)).alias("q"))
    tail = port.crossJoin(F.broadcast(q)).filter("port <= q").select(by)  # q is one row
    n = tail.agg(F.count(F.lit(1)).alias("n"))
    return x.join(tail, by).rollup(asset).agg(F.sum("c").alias("c")).crossJoin(F.broadcast(n)).select(asset, (F.col("c") / F.col("n")).alias("contribution"))


def size_by_risk(cvars: DataFrame, *, budget: float, gross_cap: float, capital: float, key: str, cvar: str) -> DataFrame:
    """D-25: leverage that a risk budget allows, capped by gross exposure and, for all together, by the portfolio cap; notional."""
    s = cvars.withColumn("lev", F.least(safe_div(F.lit(budget), F.abs(cvar)), F.lit(gross_cap)))
    total = s.agg(F.sum("lev").alias("sum_lev"))
    scale = F.least(F.lit(1.0), safe_div(F.lit(gross_cap), F.col("sum_lev")))
    return s.crossJoin(F.broadcast(total)).withColumn("leverage", F.col("lev") * scale).withColumn("notional", F.col("leverage") * capital).drop("sum_lev", "lev")  # total is one row


def portfolio_series(returns: DataFrame, weights: DataFrame, *, asset: str = "asset", by: str = "date", ret: str = "ret") -> DataFrame:
    """D-30: each portfolio's return by date, over the assets it holds."""
    return returns.join(weights, asset).groupBy("portfolio", by).agg(F.sum(F.col("w") * F.col(ret)).alias("ret"))


def trend_leverage(series: DataFrame, *, key: str, rank: str, ret: str, bear: Column, by: str = "date", cost: float = 0.001) -> DataFrame:
    """D-27: leverage by rank with a bear override, live from the next row, and the equity after turnover costs."""
    lev = F.when(bear, 0.0).when(F.col(rank) < 0.25, 0.5).when(F.col(rank) < 0.75, 1.0).otherwise(1.5)
    w = over(key, by=by)
    s = series.withColumn("__t", lev).withColumn("lev", F.coalesce(F.lag("__t").over(w), F.lit(1.0)))
    s = s.withColumn("turn", F.abs(F.col("lev") - F.coalesce(F.lag("lev").over(w), F.lit(1.0))))
    return s.withColumn("equity", F.product((1 - cost * F.col("turn")) * (1 + F.col("lev") * F.col(ret))).over(over(key, by=by, rows=PAST))).drop("__t")


def crisis_drawdowns(returns: DataFrame, periods: DataFrame, *, key: str, by: str = "date", ret: str = "ret") -> DataFrame:
    """D-28: return and worst drawdown of each series within each named period, from the period's own start."""
    x = returns.join(F.broadcast(periods), (F.col(by) >= F.col("start")) & (F.col(by) <= F.col("stop")))  # a table of a few named periods
    w = Window.partitionBy(key, "period").orderBy(by).rowsBetween(*PAST)
    x = x.withColumn("e", F.product(1 + F.col(ret)).over(w))
    x = x.withColumn("d", F.col("e") / F.greatest(F.max("e").over(w), F.lit(1.0)) - 1)
    return x.groupBy(key, "period").agg((F.max_by("e", by) - 1).alias("ret"), F.least(F.min("d"), F.lit(0.0)).alias("max_dd"))


def fold_table(daily: DataFrame, *, fold: str, key: str | None = None, ret: str = "ret", lev: str = "lev") -> DataFrame:
    """D-29: return, days, rebalances and mean leverage of each fold, and of each key in it."""
    keys = [key, fold] if key else [fold]
    return daily.groupBy(*keys).agg((F.product(1 + F.col(ret)) - 1).alias("fold_ret"), F.count(F.lit(1)).alias("days"), F.count_if(F.col("turn") > 0).alias("rebalances"), F.avg(lev).alias("avg_lev"))


def crash_rate(returns: DataFrame, *, key: str, by: str, ret: str = "ret", size: int = 12, limit: float = 0.2) -> DataFrame:
    """P-10: share of full blocks of ``size`` rows whose worst drawdown exceeds the limit, averaged over all block starts."""
    n = returns.withColumn("__rn", F.row_number().over(over(key, by=by)) - 1)
    s = n.select("*", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("shift")).filter("__rn >= shift").withColumn("block", F.floor((F.col("__rn") - F.col("shift")) / size))
    w = Window.partitionBy(key, "shift", "block").orderBy(by).rowsBetween(*PAST)
    s = s.withColumn("e", F.product(1 + F.col(ret)).over(w)).withColumn("d", F.col("e") / F.greatest(F.max("e").over(w), F.lit(1.0)) - 1)
    blocks = s.groupBy(key, "shift", "block").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("dd")).filter(F.col("n") == size)
    return blocks.groupBy(key, "shift").agg(F.avg((F.col("dd") < -limit).cast("double")).alias("r")).groupBy(key).agg(F.avg("r").alias("crash_rate"))
