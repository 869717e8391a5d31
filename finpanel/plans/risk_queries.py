"""Risk, regressions, valuation and regimes over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from finpanel.operators import regimes as G
from finpanel.operators import risk as R
from finpanel.operators import windows as W
from finpanel.plans.catalog import query
from finpanel.plans.table_queries import CURVE, JOINED, small_returns, with_market

RR = "SELECT asset, avg(ret) * 252 AS ann_ret, stddev_samp(ret) * sqrt(252) AS ann_risk, (avg(ret) * 252 - 0.045) / nullif(stddev_samp(ret) * sqrt(252), 0) AS sharpe FROM returns GROUP BY asset"
COV = "SELECT a.asset AS i, b.asset AS j, covar_samp(a.ret, b.ret) AS cov, corr(a.ret, b.ret) AS corr, count(*) AS n FROM returns a JOIN returns b ON a.date = b.date GROUP BY ALL"
CAND = "SELECT c.candidate, asset, r / sum(r) OVER (PARTITION BY c.candidate) AS w FROM range(11) c(candidate), LATERAL (SELECT asset, 1 + (c.candidate * 7 + CAST(asset[1] AS INTEGER) * 13) % 11 AS r FROM (SELECT DISTINCT asset FROM returns))"
SCORED = "SELECT candidate, port_ret, sqrt(var) AS port_risk, (port_ret - 0.045) / sqrt(var) AS port_sharpe FROM (SELECT candidate, sum(w * ann_ret) AS port_ret FROM cand JOIN rr USING (asset) GROUP BY candidate) JOIN (SELECT a.candidate, sum(a.w * b.w * cov * 252) AS var FROM cand a JOIN cand b ON a.candidate = b.candidate JOIN cv ON cv.i = a.asset AND cv.j = b.asset GROUP BY a.candidate) USING (candidate)"


def candidates(t, n: int = 11):
    from pyspark.sql import Window

    names = t.returns.select("asset").distinct()
    r = t.spark.range(n).withColumnRenamed("id", "candidate").crossJoin(F.broadcast(names))  # a given number of candidates
    r = r.withColumn("r", 1 + (F.col("candidate") * 7 + F.substring("asset", 1, 1).cast("int") * 13) % 11)
    return r.select("candidate", "asset", (F.col("r") / F.sum("r").over(Window.partitionBy("candidate"))).alias("w"))


@query("d1_risk_return", "asset ann_ret~8 ann_risk~8 sharpe~8", "returns", RR)
def _(t):
    return R.risk_return(t.returns, rf=0.045)


@query("d2_covariance", "i j cov~7 corr~8 n", "returns", COV)
def _(t):
    return R.covariance(t.returns)


@query("d3_portfolio_scores", "candidate port_ret~7 port_risk~7 port_sharpe~7", "returns", SCORED, rr=RR, cv=COV, cand=CAND)
def _(t):
    return R.score_portfolios(candidates(t), R.risk_return(t.returns), R.covariance(t.returns), rf=0.045)


@query("d4_best_portfolios", "min_risk max_ret max_sharpe", "returns", "SELECT arg_min(candidate, row(port_risk, candidate)) AS min_risk, arg_max(candidate, row(port_ret, candidate)) AS max_ret, arg_max(candidate, row(port_sharpe, candidate)) AS max_sharpe FROM scored", rr=RR, cv=COV, cand=CAND, scored=SCORED)
def _(t):
    return R.best_portfolios(R.score_portfolios(candidates(t), R.risk_return(t.returns), R.covariance(t.returns), rf=0.045))


@query("d6_performance", "asset n ann_ret~7 ann_vol~7 sharpe~7 total~7 geo_ret~7 max_dd~7 t_stat~7 win_rate~8 q05~9", "returns", "SELECT asset, count(ret) AS n, avg(ret) * 252 AS ann_ret, stddev_samp(ret) * sqrt(252) AS ann_vol, avg(ret) * 252 / nullif(stddev_samp(ret) * sqrt(252), 0) AS sharpe, product(1 + ret) - 1 AS total, pow(product(1 + ret), 252 / count(ret)) - 1 AS geo_ret, min(drawdown) AS max_dd, avg(ret) * sqrt(count(ret)) / stddev_samp(ret) AS t_stat, avg(CAST(ret > 0 AS DOUBLE)) AS win_rate, quantile_cont(ret, 0.05) AS q05 FROM curve GROUP BY asset", curve=CURVE)
def _(t):
    return R.performance(W.equity(small_returns(t), key="asset"), key="asset", periods=252)


@query("d8_capm", "asset alpha~6 beta~7 r2~8", "returns market", "SELECT asset, regr_intercept(ret, bench) * 252 AS alpha, regr_slope(ret, bench) AS beta, regr_r2(ret, bench) AS r2 FROM j GROUP BY asset", j=JOINED)
def _(t):
    return R.capm(with_market(t), key="asset")


MODEL = "SELECT * FROM (SELECT asset, window_no, count(*) AS n, regr_intercept(ret, bench) * 252 AS alpha, regr_slope(ret, bench) AS beta, regr_r2(ret, bench) AS r2, sqrt(greatest(var_pop(ret) * (1 - regr_r2(ret, bench)), 0)) * sqrt(252) AS te FROM (SELECT *, (row_number() OVER (PARTITION BY asset ORDER BY date) - 1) // 504 AS window_no FROM j) GROUP BY ALL) WHERE n = 504"


@query("d9_market_model", "asset window_no# alpha~6 beta~7 r2~8 te~6", "returns market", MODEL, j=JOINED)
def _(t):
    return R.market_model(with_market(t), 504, key="asset")


@query("d9_tracking_bands", "window_no# te_mean~6 te_p50~6 te_p70~6", "returns market", "SELECT window_no, avg(te) AS te_mean, quantile_cont(te, 0.5) AS te_p50, quantile_cont(te, 0.7) AS te_p70 FROM mm GROUP BY ALL", j=JOINED, mm=MODEL)
def _(t):
    return R.tracking_bands(R.market_model(with_market(t), 504, key="asset"))


@query("d10_ols_fit", "n rmse~4 mean_fit~4", "market", "SELECT count(*) AS n, sqrt(avg(pow(level - (regr_a + regr_b * n_orders), 2))) AS rmse, avg(regr_a + regr_b * n_orders) AS mean_fit FROM market, (SELECT regr_intercept(level, n_orders) AS regr_a, regr_slope(level, n_orders) AS regr_b FROM market)")
def _(t):
    fitted, _, _ = R.ols(t.market, "level", ["n_orders"])
    return fitted.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("residual") ** 2)).alias("rmse"), F.avg("fitted").alias("mean_fit"))


@query("d11_rule_evaluation", "asset tp fp tn fn accuracy~9 sensitivity~9 specificity~9", "returns", "SELECT *, (tp + tn) / nullif(tp + fp + tn + fn, 0) AS accuracy, tp / nullif(tp + fn, 0) AS sensitivity, tn / nullif(tn + fp, 0) AS specificity FROM (SELECT asset, count(*) FILTER (t AND g) AS tp, count(*) FILTER (NOT t AND g) AS fp, count(*) FILTER (NOT t AND NOT g) AS tn, count(*) FILTER (t AND NOT g) AS fn FROM (SELECT asset, ret > 0 AS t, lag(ret) OVER (PARTITION BY asset ORDER BY date) < 0 AS g FROM returns) WHERE g IS NOT NULL GROUP BY asset)")
def _(t):
    from finpanel.functions import over

    x = t.returns.withColumn("prev", F.lag("ret").over(over("asset", by="date")))
    return R.rule_evaluation(x, key="asset", truth=F.col("ret") > 0, rule=F.col("prev") < 0)


BASKET = {"1-URGENT": 0.4, "2-HIGH": 0.35, "3-MEDIUM": 0.25}


@query("d17_weighted_basket", "date basket~4 log_basket~8", "levels", "SELECT date, sum(level * CASE asset WHEN '1-URGENT' THEN 0.4 WHEN '2-HIGH' THEN 0.35 ELSE 0.25 END) AS basket, ln(sum(level * CASE asset WHEN '1-URGENT' THEN 0.4 WHEN '2-HIGH' THEN 0.35 ELSE 0.25 END) * 100) AS log_basket FROM levels WHERE asset IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY date HAVING count(DISTINCT asset) = 3")
def _(t):
    return R.weighted_basket(t.levels, BASKET, key="asset", value="level")


@query("d18_zero_coupon", "k# date zero_px~8 zero_exp~8 zero_log~8", "market", "SELECT 1 AS k, date, px AS zero_px, exp(-10 * y) AS zero_exp, ln(px) - ln(lag(px) OVER (ORDER BY date)) AS zero_log FROM (SELECT date, n_orders / 1000 AS y, 100 / pow(1 + n_orders / 1000, 10) AS px FROM market)")
def _(t):
    return R.zero_coupon(t.market.select(F.lit(1).alias("k"), "date", (F.col("n_orders") / 1000).alias("y")), "y", 10.0, key="k")


WACC = 0.7 * (0.045 + 1.1 * 0.05) + 0.3 * 0.05 * 0.79


@query(
    "d19_issuer_valuation", "issuer fcf0~2 g~8 ev~1 equity_value~1 per_share~4", "statements",
    f"""SELECT issuer, fcf0, g, ev, ev - debt AS equity_value, (ev - debt) / 1000 AS per_share FROM (SELECT *, pv + last * 1.02 / ({WACC!r} - 0.02) / pow(1 + {WACC!r}, 5) AS ev
    FROM (SELECT issuer, fcf0, g, debt, sum(fcf0 * pow(1 + g, y) / pow(1 + {WACC!r}, y)) AS pv, max(fcf0 * pow(1 + g, 5)) AS last FROM (SELECT issuer, fcf0, least(greatest(coalesce(g, 0), -0.15), 0.15) AS g, debt, unnest([1, 2, 3, 4, 5]) AS y
    FROM (SELECT issuer, arg_max(fcf, year) AS fcf0, avg(growth) AS g, -max(s_acctbal) AS debt FROM (SELECT *, fcf / nullif(lag(fcf) OVER (PARTITION BY issuer ORDER BY year), 0) - 1 AS growth FROM (SELECT *, ebit * 0.79 + dep - capex - dwc AS fcf FROM statements)) JOIN supplier ON s_suppkey = issuer GROUP BY issuer)) GROUP BY issuer, fcf0, g, debt))""",
)
def _(t):
    s = t.raw("supplier").select(F.col("s_suppkey").alias("issuer"), (-F.col("s_acctbal")).alias("net_debt"), F.lit(1000.0).alias("shares"))
    return R.valuation(t.statements.join(s, "issuer"))


@query("d20_exposure", "exchange_name notional~2 delta~2 pct~7", "meta", "SELECT exchange_name, sum(s_acctbal) AS notional, sum(s_acctbal - s_nationkey * 100) AS delta, 100 * sum(s_acctbal) / (SELECT sum(s_acctbal) FROM supplier) AS pct FROM meta JOIN supplier ON s_suppkey = assetid GROUP BY ROLLUP (exchange_name)")
def _(t):
    s = t.raw("supplier").select(F.col("s_suppkey").alias("assetid"), "s_acctbal", (F.col("s_nationkey") * 100).alias("before"))
    return R.exposure(t.meta.join(s, "assetid"), segment="exchange_name", value="s_acctbal", before="before")


@query("d21_outcome_risk", "asset var_hist~8 var_norm~7 p_loss~9 band_lo~8 band_hi~8", "returns", "SELECT asset, -quantile_cont(ret, 0.05) AS var_hist, 1.6448536269514722 * stddev_samp(ret) - avg(ret) AS var_norm, avg(CAST(ret < 0 AS DOUBLE)) AS p_loss, quantile_cont(ret, 0.05) AS band_lo, quantile_cont(ret, 0.95) AS band_hi FROM returns GROUP BY asset")
def _(t):
    return R.outcome_risk(t.returns, key="asset", value="ret")


@query("d22a_cvar_count", "asset cvar_a~9", "returns", "SELECT asset, avg(ret) AS cvar_a FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ret) AS i, count(*) OVER (PARTITION BY asset) AS n FROM returns) WHERE i <= greatest(1, floor(CAST(0.05 AS DOUBLE) * n)) GROUP BY asset")
def _(t):
    return R.cvar_count(t.returns, 0.95, key="asset", value="ret")


@query("d22b_cvar_quantile", "asset cvar_b~9", "returns", "SELECT asset, avg(ret) AS cvar_b FROM returns JOIN (SELECT asset, quantile_cont(ret, 0.05) AS q FROM returns GROUP BY asset) USING (asset) WHERE ret <= q GROUP BY asset")
def _(t):
    return R.cvar_quantile(t.returns, 0.95, key="asset", value="ret")


PRIOR = "SELECT *, w / sum(w) OVER (PARTITION BY asset) AS p FROM (SELECT *, pow(2.0, -(row_number() OVER (PARTITION BY asset ORDER BY date DESC) - 1) / 250.0) AS w FROM returns)"


@query("d22c_cvar_weighted", "asset cvar_c~8", "returns", "SELECT asset, coalesce(sum(ret * p) FILTER (c <= 0.05) / nullif(sum(p) FILTER (c <= 0.05), 0), min(ret)) AS cvar_c FROM (SELECT *, sum(p) OVER (PARTITION BY asset ORDER BY ret, p ROWS UNBOUNDED PRECEDING) / sum(p) OVER (PARTITION BY asset) AS c FROM pr) GROUP BY asset", pr=PRIOR)
def _(t):
    return R.cvar_weighted(G.decay_prior(t.returns, 250.0, key="asset"), 0.95, key="asset", value="ret", weight="p")


@query("d22d_cvar_losses", "asset cvar_d~9", "returns", "SELECT asset, avg(-ret) AS cvar_d FROM returns JOIN (SELECT asset, quantile_cont(-ret, 0.95) AS q FROM returns GROUP BY asset) USING (asset) WHERE -ret >= q GROUP BY asset")
def _(t):
    return R.cvar_losses(t.returns, 0.95, key="asset", value="ret")


@query("d23_efficiency", "asset mean_h~8 cvar_b~8 efficiency~7", "returns", "SELECT asset, mean_h, cvar_b, mean_h / nullif(abs(cvar_b), 0) AS efficiency FROM (SELECT asset, avg(h) AS mean_h, avg(h) FILTER (h <= q) AS cvar_b FROM (SELECT asset, h, quantile_cont(h, 0.05) OVER (PARTITION BY asset) AS q FROM (SELECT asset, CASE WHEN count(*) OVER w >= 10 THEN sum(ret) OVER w END AS h FROM returns WINDOW w AS (PARTITION BY asset ORDER BY date ROWS 9 PRECEDING)) WHERE h IS NOT NULL) GROUP BY asset)")
def _(t):
    return R.efficiency(t.returns, 10, key="asset")





@query("d24_cvar_contribution", "asset contribution~7", "returns", "SELECT asset, sum(0.2 * ret) / (SELECT count(*) FROM tail) AS contribution FROM returns JOIN tail USING (date) GROUP BY ROLLUP (asset)", port="SELECT date, sum(0.2 * ret) AS port FROM returns GROUP BY date", tail="SELECT date FROM port WHERE port <= (SELECT quantile_cont(port, 0.05) FROM port)")
def _(t):
    return R.cvar_contribution(t.returns, t.returns.select("asset", F.lit(0.2).alias("w")).distinct(), 0.95)


@query("d25_risk_sizing", "asset leverage~8 notional~2", "returns", "SELECT asset, lev * least(1, 2.0 / (SELECT sum(lev) FROM s)) AS leverage, lev * least(1, 2.0 / (SELECT sum(lev) FROM s)) * 1000000 AS notional FROM s", c="SELECT asset, avg(ret) AS cvar_b FROM returns JOIN (SELECT asset, quantile_cont(ret, 0.05) AS q FROM returns GROUP BY asset) USING (asset) WHERE ret <= q GROUP BY asset", s="SELECT asset, least(0.5 / abs(cvar_b), 2.0) AS lev FROM c")
def _(t):
    return R.size_by_risk(R.cvar_quantile(t.returns, 0.95, key="asset", value="ret"), budget=0.5, gross_cap=2.0, capital=1e6, key="asset", cvar="cvar_b")


@query("d30_portfolio_series", "portfolio date ret~9", "returns", "SELECT candidate AS portfolio, date, sum(w * ret) AS ret FROM returns JOIN cand USING (asset) WHERE candidate < 3 GROUP BY ALL", cand=CAND)
def _(t):
    return R.portfolio_series(t.returns, candidates(t).filter("candidate < 3").withColumnRenamed("candidate", "portfolio"))


RANKED = "SELECT *, percent_rank() OVER (PARTITION BY asset ORDER BY ret, date) AS pr FROM (SELECT asset, date, ret / 10000 AS ret FROM returns)"
LEV = "SELECT *, abs(lev - coalesce(lag(lev) OVER w, 1.0)) AS turn FROM (SELECT *, coalesce(lag(tl) OVER w, 1.0) AS lev FROM (SELECT *, CASE WHEN month(date) = 1 THEN 0.0 WHEN pr < 0.25 THEN 0.5 WHEN pr < 0.75 THEN 1.0 ELSE 1.5 END AS tl FROM rk) WINDOW w AS (PARTITION BY asset ORDER BY date)) WINDOW w AS (PARTITION BY asset ORDER BY date)"


def levered(t):
    from finpanel.functions import over

    x = small_returns(t).withColumn("pr", F.percent_rank().over(over("asset", by=["ret", "date"])))
    return R.trend_leverage(x, key="asset", rank="pr", ret="ret", bear=F.month("date") == 1)


@query("d27_trend_leverage", "asset date lev turn equity~8", "returns", "SELECT *, product((1 - 0.001 * turn) * (1 + lev * ret)) OVER (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity FROM lv", rk=RANKED, lv=LEV)
def _(t):
    return levered(t)


@query("d28_crisis_drawdowns", "asset period ret~8 max_dd~8", "returns", "SELECT asset, period, arg_max(e, date) - 1 AS ret, least(min(e / greatest(m, 1) - 1), 0) AS max_dd FROM (SELECT *, max(e) OVER w AS m FROM (SELECT asset, period, date, product(1 + ret / 10000) OVER w AS e FROM returns JOIN (VALUES ('a', DATE '1995-01-01', DATE '1995-06-30'), ('b', DATE '1997-03-01', DATE '1997-12-31')) p(period, lo, hi) ON date BETWEEN lo AND hi WINDOW w AS (PARTITION BY asset, period ORDER BY date ROWS UNBOUNDED PRECEDING)) WINDOW w AS (PARTITION BY asset, period ORDER BY date ROWS UNBOUNDED PRECEDING)) GROUP BY ALL")
def _(t):
    p = t.spark.createDataFrame([("a", "1995-01-01", "1995-06-30"), ("b", "1997-03-01", "1997-12-31")], "period string, s string, e string").select("period", F.col("s").cast("date").alias("start"), F.col("e").cast("date").alias("stop"))
    return R.crisis_drawdowns(small_returns(t), p, key="asset")


@query("d29_fold_table", "asset fold# fold_ret~8 days rebalances avg_lev~8", "returns", "SELECT asset, year(date) AS fold, product(1 + ret) - 1 AS fold_ret, count(*) AS days, count(*) FILTER (turn > 0) AS rebalances, avg(lev) AS avg_lev FROM lv GROUP BY asset, year(date)", rk=RANKED, lv=LEV)
def _(t):
    return R.fold_table(levered(t).withColumn("fold", F.year("date")), fold="fold", key="asset")


@query("p10_crash_rate", "asset crash_rate~9", "returns", "SELECT asset, avg(r) AS crash_rate FROM (SELECT asset, shift, avg(CAST(dd < -0.2 AS DOUBLE)) AS r FROM (SELECT asset, shift, block, count(*) AS n, min(e / greatest(m, 1) - 1) AS dd FROM (SELECT *, max(e) OVER w AS m FROM (SELECT asset, shift, block, date, product(1 + ret / 100) OVER w AS e FROM (SELECT *, (rn - shift) // 12 AS block FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date) - 1 AS rn FROM returns), range(12) s(shift) WHERE rn >= shift) WINDOW w AS (PARTITION BY asset, shift, block ORDER BY date ROWS UNBOUNDED PRECEDING)) WINDOW w AS (PARTITION BY asset, shift, block ORDER BY date ROWS UNBOUNDED PRECEDING)) GROUP BY ALL HAVING count(*) = 12) GROUP BY ALL) GROUP BY asset")
def _(t):
    return R.crash_rate(t.returns.withColumn("ret", F.col("ret") / 100), key="asset", by="date")


STATES = "SELECT *, n_orders_level + 3 * mean_price_level AS state FROM (SELECT *, CAST(n_orders > a AS INTEGER) + CAST(n_orders > b AS INTEGER) AS n_orders_level, CAST(mean_price > m AS INTEGER) AS mean_price_level FROM market, (SELECT quantile_cont(n_orders, 0.25) AS a, quantile_cont(n_orders, 0.75) AS b, quantile_cont(mean_price, 0.5) AS m FROM market))"


def states(t):
    return G.quantile_state(t.market, {"n_orders": (0.25, 0.75), "mean_price": (0.5,)})


@query("r1_quantile_states", "date n_orders_level# mean_price_level# state#", "market", STATES)
def _(t):
    return states(t)


@query("r1_training_thresholds", "date state#", "market", STATES.replace("FROM market))", "FROM market WHERE date < DATE '1998-01-01'))"))
def _(t):
    return G.quantile_state(t.market, {"n_orders": (0.25, 0.75), "mean_price": (0.5,)}, train=F.col("date") < "1998-01-01")


@query("r2_state_summary", "state# n share~9 is_current", "market", "SELECT state, count(*) AS n, count(*) / (SELECT count(*) FROM st) AS share, state = (SELECT arg_max(state, date) FROM st) AS is_current FROM st GROUP BY state", st=STATES)
def _(t):
    return G.state_summary(states(t))


@query("r3_conditional_moments", "asset state# mean~8 sigma~8 n", "returns market", "SELECT o.asset, s.k AS state, coalesce(x.m, o.m) AS mean, coalesce(x.s, o.s) AS sigma, coalesce(x.n, 0) AS n FROM (SELECT asset, avg(ret) AS m, stddev_pop(ret) AS s FROM j GROUP BY asset) o, range(7) s(k) LEFT JOIN (SELECT asset, state, avg(ret) AS m, stddev_pop(ret) AS s, count(*) AS n FROM j GROUP BY ALL) x ON x.asset = o.asset AND x.state = s.k", st=STATES, j="SELECT asset, ret, state FROM returns JOIN st USING (date)")
def _(t):
    return G.conditional_moments(t.returns.join(states(t).select("date", "state"), "date"), 7, key="asset")


@query("r4_joint_label", "date label", "market", "SELECT date, CASE WHEN n_orders > 7 AND mean_price > 250000 THEN 'Bull' WHEN n_orders < 4 AND mean_price < 250000 THEN 'Bear' WHEN n_orders BETWEEN 4 AND 7 THEN 'Neutral' ELSE 'Other' END AS label FROM market")
def _(t):
    n, m = F.col("n_orders"), F.col("mean_price")
    return G.joint_label(t.market, bull=(n > 7) & (m > 250000), bear=(n < 4) & (m < 250000), neutral=n.between(4, 7))


@query("r5_decay_prior", "asset date p~12", "returns", PRIOR)
def _(t):
    return G.decay_prior(t.returns, 250.0, key="asset")


@query("r6_weighted_moments", "asset mean~7 vol~7 skew~6 kurt~5", "returns", "SELECT asset, m AS mean, sqrt(v) AS vol, m3 / pow(v, 1.5) AS skew, m4 / pow(v, 2) AS kurt FROM (SELECT asset, any_value(m) AS m, sum(p * pow(ret - m, 2)) / sum(p) AS v, sum(p * pow(ret - m, 3)) / sum(p) AS m3, sum(p * pow(ret - m, 4)) / sum(p) AS m4 FROM (SELECT pr.*, sum(p * ret) OVER (PARTITION BY asset) / sum(p) OVER (PARTITION BY asset) AS m FROM pr) GROUP BY asset)", pr=PRIOR)
def _(t):
    return G.weighted_moments(G.decay_prior(t.returns, 250.0, key="asset"), key="asset", value="ret")


@query("r6_weighted_correlation", "rho~8", "market", "SELECT (sum(n_orders * mean_price) / count(*) - avg(n_orders) * avg(mean_price)) / (stddev_pop(n_orders) * stddev_pop(mean_price)) AS rho FROM market")
def _(t):
    return G.weighted_correlation(t.market.withColumn("p", F.lit(1.0)), x="n_orders", y="mean_price")


def even(t):
    """Equal weights, and mean and population variance of the daily order count."""
    n = t.market.agg(F.count(F.lit(1)).alias("n"), F.avg("n_orders").alias("m"), F.var_pop("n_orders").alias("v")).first()
    return t.market.withColumn("p", F.lit(1 / max(n["n"], 1))), n["m"], n["v"]


@query("r7_reweighted_moments", "q_sum~6 view_mean~6 view_square~5 n", "market", "SELECT 1.0 AS q_sum, 1.05 * avg(n_orders) AS view_mean, pow(1.05 * avg(n_orders), 2) + 1.1 * var_pop(n_orders) AS view_square, count(*) AS n FROM market")
def _(t):
    """What any right answer has in common: weights that sum to one and meet both views."""
    m, mean, var = even(t)
    x = F.col("n_orders")
    q = G.reweight(m, [(x, 1.05 * mean), (x * x, (1.05 * mean) ** 2 + 1.1 * var)])
    return q.agg(F.sum("q").alias("q_sum"), F.sum(F.col("q") * x).alias("view_mean"), F.sum(F.col("q") * x * x).alias("view_square"), F.count(F.lit(1)).alias("n"))


@query("r8_relative_entropy", "asset entropy~8 effective~8", "returns", "SELECT asset, sum(p * ln(p * n)) AS entropy, exp(-sum(p * ln(p * n))) AS effective FROM (SELECT *, count(*) OVER (PARTITION BY asset) AS n FROM pr) GROUP BY asset", pr=PRIOR)
def _(t):
    from pyspark.sql import Window

    x = G.decay_prior(t.returns, 250.0, key="asset").withColumnRenamed("p", "q").withColumn("p", 1 / F.count(F.lit(1)).over(Window.partitionBy("asset")))
    return G.relative_entropy(x, key="asset")


def with_prior(t):
    return G.decay_prior(states(t), 250.0).select("date", "state", "p")


PS = "SELECT date, state, w / sum(w) OVER () AS p FROM (SELECT *, pow(2.0, -(row_number() OVER (ORDER BY date DESC) - 1) / 250.0) AS w FROM st)"
QS = "SELECT s.k AS state, ps.date, ps.state AS own, CASE WHEN m.mass IS NULL THEN p WHEN ps.state = s.k THEN p / m.mass ELSE 0 END AS q FROM range(7) s(k) CROSS JOIN ps LEFT JOIN (SELECT state, sum(p) AS mass FROM ps GROUP BY state) m ON m.state = s.k"


@query("r9_state_probabilities", "state# date q~12", "market", QS, st=STATES, ps=PS)
def _(t):
    return G.state_probabilities(with_prior(t), 7)


@query("r10_transition_matrix", "state# to_state# n prob~9", "market", 'SELECT a.k AS state, b.k AS to_state, coalesce(n, 0) AS n, coalesce(n, 0) / nullif(sum(coalesce(n, 0)) OVER (PARTITION BY a.k), 0) AS prob FROM range(6) a(k) CROSS JOIN range(6) b(k) LEFT JOIN (SELECT state, nx, count(*) AS n FROM (SELECT state, lead(state) OVER (ORDER BY date) AS nx FROM st) WHERE nx IS NOT NULL GROUP BY ALL) x ON x.state = a.k AND x.nx = b.k', st=STATES)
def _(t):
    return G.transitions(states(t), 6).withColumnRenamed("to", "to_state")


@query("r10_transition_mass", "state# to_state# mass~9", "market", "SELECT state, own AS to_state, sum(q) AS mass FROM qs GROUP BY ALL", st=STATES, ps=PS, qs=QS)
def _(t):
    return G.transition_mass(G.state_probabilities(with_prior(t), 7), 7).withColumnRenamed("to", "to_state")


@query("r11_view_ladder", "target~9 view_mean~6", "market", "SELECT f * avg(n_orders) AS target, CASE WHEN f * avg(n_orders) BETWEEN min(n_orders) AND max(n_orders) THEN f * avg(n_orders) ELSE avg(n_orders) END AS view_mean FROM market, (VALUES (CAST(1.02 AS DOUBLE)), (CAST(1.1 AS DOUBLE))) v(f) GROUP BY f")
def _(t):
    """A view beyond the smallest and largest day, which no weights meet, keeps the prior's mean; with more orders a day their numbers lie closer together."""
    m, mean, _ = even(t)
    return G.view_ladder(m, "n_orders", [1.02 * mean, 1.1 * mean], portfolio="mean_price")


@query("r12_stress_table", "asset prior_mean~7 prior_vol~7 post_mean~7 post_vol~7", "returns", "SELECT asset, avg(ret) AS prior_mean, stddev_pop(ret) AS prior_vol, sum(p * ret) AS post_mean, sqrt(sum(p * ret * ret) - pow(sum(p * ret), 2)) AS post_vol FROM pr GROUP BY asset", pr=PRIOR)
def _(t):
    x = G.decay_prior(t.returns, 250.0, key="asset").withColumnRenamed("p", "q").withColumn("p", F.lit(1.0))
    return G.stress_table(x, key="asset", value="ret")


DRAWN = "SELECT asset, draw, ret FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY asset) AS n FROM returns), range(20) d(draw) WHERE i >= ((draw * 48271 + 69621) % 2147483647) % (n - 249) AND i < ((draw * 48271 + 69621) % 2147483647) % (n - 249) + 250"
RESAMPLED = "SELECT asset, draw, mean, cvar_b, mean / nullif(abs(cvar_b), 0) AS efficiency FROM (SELECT asset, draw, avg(ret) AS mean, avg(ret) FILTER (ret <= q) AS cvar_b FROM (SELECT *, quantile_cont(ret, 0.05) OVER (PARTITION BY asset, draw) AS q FROM dr) GROUP BY ALL)"


@query("r13_resampled_statistics", "asset draw# mean~8 cvar_b~8 efficiency~6", "returns", RESAMPLED, dr=DRAWN)
def _(t):
    return G.resample(t.returns, 20, 250, key="asset")


@query("a33_resample_summary", "asset mean~6 median~6 sd~6 lo~6 hi~6 stability~5", "returns", "SELECT asset, avg(efficiency) AS mean, median(efficiency) AS median, stddev_samp(efficiency) AS sd, min(efficiency) AS lo, max(efficiency) AS hi, avg(efficiency) / nullif(stddev_pop(efficiency), 0) AS stability FROM rs GROUP BY asset", dr=DRAWN, rs=RESAMPLED)
def _(t):
    return G.resample_summary(G.resample(t.returns, 20, 250, key="asset"), key="asset")


@query("r14_block_resample", "sim# n total~7 win_rate~8 growth~7", "returns", "SELECT sim, count(*) AS n, sum(r) AS total, avg(CAST(r > 0 AS DOUBLE)) AS win_rate, product(1 + r) - 1 AS growth FROM (SELECT sim, ret / 10000 AS r FROM (SELECT sim, ((sim * 3 + b) * 48271 + 69621) % 2147483647 % (nd - 49) + k AS d FROM range(10) s(sim), range(3) bb(b), range(50) kk(k), (SELECT count(DISTINCT date) AS nd FROM returns)) x JOIN (SELECT date, row_number() OVER (ORDER BY date) - 1 AS d FROM (SELECT DISTINCT date FROM returns)) y USING (d) JOIN returns USING (date)) GROUP BY sim")
def _(t):
    return G.block_resample(small_returns(t), 10, 3, 50)


@query("r15_rolling_preselection", "asset window_no# n_state mean~8 sigma~8 efficiency~7", "returns", "SELECT asset, wn AS window_no, count(*) AS n_state, avg(ret) AS mean, stddev_pop(ret) AS sigma, avg(ret) / nullif(stddev_pop(ret), 0) AS efficiency FROM (SELECT *, median(ret) OVER p AS med, count(*) OVER p AS n, arg_max(ret, date) OVER p AS last FROM (SELECT r.*, w.wn FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date) - 1 AS i FROM returns) r, range(100) w(wn) WHERE i >= wn * 126 AND i < wn * 126 + 504) WINDOW p AS (PARTITION BY asset, wn)) WHERE n = 504 AND (ret > med) = (last > med) GROUP BY ALL")
def _(t):
    return G.rolling_preselection(t.returns, 504, 126, key="asset")
