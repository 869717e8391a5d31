"""Roll-ups, profiles, rolling windows, top lists and shapes over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from finpanel.operators import aggregates as A
from finpanel.operators import reshape as U
from finpanel.operators import topk as T
from finpanel.operators import windows as W
from finpanel.plans.catalog import query
from finpanel.plans.panel_queries import BUCKET

BARS30 = "SELECT ticker, time_bucket(INTERVAL 30 MINUTE, ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM bars GROUP BY ticker, time_bucket(INTERVAL 30 MINUTE, ts)"
DAYBARS = "SELECT ticker, CAST(ts AS DATE) AS date, arg_min(open, ts) AS open, arg_max(close, ts) AS close, sum(volume) AS volume, count(*) AS n_bars FROM bars GROUP BY ticker, CAST(ts AS DATE)"
GUESSED = "SELECT assetid, ym, CAST(1 + list_position(probs, list_max(probs)) - 1 AS INTEGER) AS pred, label FROM predictions JOIN b USING (assetid, ym)"
LABELS = BUCKET.format(c="fwd", n="label")


def guesses(t):
    from finpanel.operators.features import bucket
    from finpanel.operators.learning import naive_class

    labels = bucket(t.features, "fwd", name="label").select("assetid", "ym", "label")
    return naive_class(t.predictions).join(labels, ["assetid", "ym"]).select("assetid", "ym", "pred", "label")


@query("a6_bars_30m", "ticker ts open high low close volume", "bars", BARS30)
def _(t):
    return A.downsample(t.bars)


@query("a7_daily_open_close", "ticker date open close n_bars", "bars", DAYBARS)
def _(t):
    return A.daily_open_close(t.bars)


GRID = "SELECT g.g AS guess, t.t AS truth, coalesce(n, 0) AS n FROM range(1, 11) g(g) CROSS JOIN range(1, 11) t(t) LEFT JOIN (SELECT pred, label, count(*) AS n FROM p WHERE label IS NOT NULL GROUP BY ALL) ON pred = g.g AND label = t.t"


@query("a9_confusion_matrix", "guess# truth# n", "predictions", GRID, b=LABELS, p=GUESSED)
def _(t):
    return A.confusion(guesses(t), 10)


@query("a10_class_accuracy", "class# precision~9 recall~9 share~9 accuracy~9", "predictions", "SELECT c.c AS class, coalesce(h / nullif(g, 0), 0) AS precision, coalesce(h / nullif(r, 0), 0) AS recall, g / s AS share, a / s AS accuracy FROM range(1, 11) c(c), LATERAL (SELECT count(*) FILTER (pred = c.c AND label = c.c) AS h, count(*) FILTER (pred = c.c) AS g, count(*) FILTER (label = c.c) AS r, count(*) AS s, count(*) FILTER (pred = label) AS a FROM p WHERE label IS NOT NULL)", b=LABELS, p=GUESSED)
def _(t):
    return A.class_accuracy(guesses(t), 10)


@query("a11_confusion_shares", "guess# truth# share~9", "predictions", "SELECT guess, truth, n / nullif(sum(n) OVER (PARTITION BY guess), 0) AS share FROM grid", b=LABELS, p=GUESSED, grid=GRID)
def _(t):
    return A.confusion(guesses(t), 10)


@query("a12_bimodality", "months hh~9 hl~9 ll~9 lh~9 bm~9", "predictions", "SELECT count(*) AS months, avg(hh) AS hh, avg(hl) AS hl, avg(ll) AS ll, avg(lh) AS lh, avg((hh + ll - hl - lh) / 2) AS bm FROM (SELECT ym, count(*) AS n, avg(CAST(label = 10 AS DOUBLE)) FILTER (pred = 10) AS hh, avg(CAST(label = 1 AS DOUBLE)) FILTER (pred = 10) AS hl, avg(CAST(label = 1 AS DOUBLE)) FILTER (pred = 1) AS ll, avg(CAST(label = 10 AS DOUBLE)) FILTER (pred = 1) AS lh FROM p WHERE label IS NOT NULL GROUP BY ym HAVING count(*) >= 10 AND count(*) FILTER (pred = 10) > 0 AND count(*) FILTER (pred = 1) > 0)", b=LABELS, p=GUESSED)
def _(t):
    return A.bimodality(guesses(t).filter("label is not null"), 10)


HOLD = ["investor", "report_date", "filing", "ordinal", "asset", "value", "category"]


@query("a13_schema_profile", "name filled nulls null_pct~6 n_distinct", "holdings", " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS filled, count(*) - count({c}) AS nulls, 100.0 * (count(*) - count({c})) / count(*) AS null_pct, count(DISTINCT {c}) AS n_distinct FROM holdings" for c in HOLD))
def _(t):
    return A.schema_profile(t.holdings.select(*HOLD))


@query("a14_timing_profile", "name lo hi missing n_distinct violations", "holdings", " UNION ALL ".join(f"SELECT '{n}' AS name, min({c}) AS lo, max({c}) AS hi, count(*) FILTER ({c} IS NULL) AS missing, count(DISTINCT {c}) AS n_distinct, count(*) FILTER ({v}) AS violations FROM holdings" for n, c, v in (("report", "report_date", "report_date > filed_at"), ("filed", "filed_at", "false"), ("available", "available_at", "available_at < filed_at"))))
def _(t):
    return A.timing_profile(t.holdings, report="report_date", filed="filed_at", available="available_at")


@query("a15_identifier_coverage", "name filled pct~6 n_distinct", "", " UNION ALL ".join(f"SELECT '{c}' AS name, count(nullif(trim(CAST({c} AS VARCHAR)), '')) AS filled, 100.0 * count(nullif(trim(CAST({c} AS VARCHAR)), '')) / count(*) AS pct, count(DISTINCT nullif(trim(CAST({c} AS VARCHAR)), '')) AS n_distinct FROM pages" for c in ("page_id", "url")))
def _(t):
    return A.identifier_profile(t.raw("pages"), ["page_id", "url"])


@query("a16_duplicate_keys", "duplicate_rows# duplicate_keys", "holdings", "SELECT coalesce(sum(n), 0) AS duplicate_rows, count(*) AS duplicate_keys FROM (SELECT count(*) AS n FROM holdings GROUP BY filing, ordinal HAVING count(*) > 1)")
def _(t):
    return A.duplicate_rows(t.holdings, ["filing", "ordinal"])


@query("a17_filing_conflicts", "report_date investor filings", "holdings", "SELECT report_date, investor, count(DISTINCT filing) AS filings FROM holdings GROUP BY ALL HAVING count(DISTINCT filing) > 1")
def _(t):
    return A.filing_conflicts(t.holdings, date="report_date", investor="investor", filing="filing")


@query("a18_value_profile", "missing negative zero positive lo p01~6 median~6 p99~6 hi", "holdings", "SELECT count(*) FILTER (value IS NULL) AS missing, count(*) FILTER (value < 0) AS negative, count(*) FILTER (value = 0) AS zero, count(*) FILTER (value > 0) AS positive, min(value) AS lo, quantile_cont(value, 0.01) AS p01, median(value) AS median, quantile_cont(value, 0.99) AS p99, max(value) AS hi FROM holdings")
def _(t):
    return A.value_profile(t.holdings, "value")


@query("a19_portfolio_profile", "groups n_p25~6 n_p50~6 n_p75~6 v_p25~3 v_p50~3 v_p75~3", "holdings", "SELECT count(*) AS groups, " + ", ".join(f"quantile_cont({c}, {p / 100}) AS {c}_p{p}" for c in ("n", "v") for p in (25, 50, 75)) + " FROM (SELECT CAST(count(*) AS DOUBLE) AS n, sum(value) AS v FROM holdings GROUP BY report_date, investor)")
def _(t):
    return A.portfolio_profile(t.holdings, ["report_date", "investor"], "value")


@query("a20_category_profile", "name value n pct~6 rank#", "", "SELECT * FROM (SELECT *, 100.0 * n / (SELECT count(*) FROM documents) AS pct, row_number() OVER (PARTITION BY name ORDER BY n DESC, value) AS rank FROM (SELECT 'lang' AS name, coalesce(nullif(trim(lang), ''), '<MISSING>') AS value, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'source', coalesce(nullif(trim(source), ''), '<MISSING>'), count(*) FROM documents GROUP BY ALL)) WHERE rank <= 5")
def _(t):
    return A.category_profile(t.raw("documents"), ["lang", "source"])


@query("a21_na_report", "table_name name null_pct~6 zeros cells", "", " UNION ALL ".join(f"SELECT '{tb}' AS table_name, '{c}' AS name, 100.0 * count(*) FILTER ({c} IS NULL) / count(*) AS null_pct, {f'count(*) FILTER ({c} = 0)' if num else 'CAST(0 AS BIGINT)'} AS zeros, count(*) * {n} AS cells FROM {tb}" for tb, n, cs in (("supplier", 4, (("s_suppkey", 1), ("s_name", 0), ("s_nationkey", 1), ("s_acctbal", 1))), ("nation", 3, (("n_nationkey", 1), ("n_name", 0), ("n_regionkey", 1)))) for c, num in cs))
def _(t):
    return A.na_report(t.raw("supplier"), "supplier").unionByName(A.na_report(t.raw("nation"), "nation"))


@query("a22_extra_copies", "extra#", "holdings", "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT filing, ordinal FROM holdings)) AS extra FROM holdings")
def _(t):
    return A.extra_copies(t.holdings, ["filing", "ordinal"])


@query("a23_describe", "asset n mean~9 sd~9 lo~9 p25~9 p50~9 p75~9 hi~9", "returns", "SELECT asset, count(ret) AS n, avg(ret) AS mean, stddev_samp(ret) AS sd, min(ret) AS lo, quantile_cont(ret, 0.25) AS p25, quantile_cont(ret, 0.5) AS p50, quantile_cont(ret, 0.75) AS p75, max(ret) AS hi FROM returns GROUP BY ALL")
def _(t):
    return A.describe(t.returns, "asset", "ret")


@query("a25_seasonality", "asset month# mean_ret~9 positive~9 negative~9", "returns", "SELECT asset, month(date) AS month, avg(ret) AS mean_ret, avg(CAST(ret > 0 AS DOUBLE)) AS positive, avg(CAST(ret < 0 AS DOUBLE)) AS negative FROM returns GROUP BY ALL")
def _(t):
    return A.seasonality(t.returns, key="asset")


@query("a25_year_month_matrix", "asset year# " + " ".join(f"m{m}~6" for m in range(1, 13)), "returns", "SELECT asset, year(date) AS year, " + ", ".join(f"sum(ret) FILTER (month(date) = {m}) AS m{m}" for m in range(1, 13)) + " FROM returns GROUP BY ALL")
def _(t):
    wide = A.year_month_matrix(t.returns.withColumn("m", F.month("date")), key="asset")
    return wide.select("asset", "year", *[F.col(str(m)).alias(f"m{m}") for m in range(1, 13)])


@query("a30_selection_counts", "legs avg_n~6 min_n", "features", "SELECT count(*) AS legs, avg(n) AS avg_n, min(n) AS min_n FROM (SELECT ym, count(*) AS n FROM features WHERE mom_6 IS NOT NULL GROUP BY ym)")
def _(t):
    return T.leg_sizes(t.features.filter("mom_6 is not null").withColumn("strategy", F.lit("mom_6")).groupBy("strategy", "ym").agg(F.count(F.lit(1)).alias("n")))


@query("a32_universe", "first last assets avg_month~6", "daily", "SELECT min(date) AS first, max(date) AS last, count(DISTINCT assetid) AS assets, (SELECT avg(n) FROM (SELECT count(DISTINCT assetid) AS n FROM daily GROUP BY year(date) * 12 + month(date))) AS avg_month FROM daily")
def _(t):
    return T.universe_statistics(t.daily)


@query("a35_pair_values", "report_date investor asset value~2", "holdings", "SELECT report_date, investor, asset, sum(value) AS value FROM holdings GROUP BY ALL")
def _(t):
    return A.pair_values(t.holdings, ["report_date", "investor", "asset"], "value")


@query("a37_total_row", "exchange_name n", "meta", "SELECT exchange_name, count(*) AS n FROM meta GROUP BY ROLLUP (exchange_name)")
def _(t):
    return A.with_total(t.meta.withColumn("one", F.lit(1.0)), "exchange_name", "one")


@query("w12_relative_volume", "ticker date rel_vol~9", "bars", "SELECT ticker, date, volume / nullif(CASE WHEN count(volume) OVER w >= 10 THEN avg(volume) OVER w END, 0) AS rel_vol FROM d WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)", d=DAYBARS)
def _(t):
    return W.relative_volume(t.bars.groupBy("ticker", F.to_date("ts").alias("date")).agg(F.sum("volume").alias("volume")))


@query("w13_rsi", "asset date rsi~7", "levels", "SELECT asset, date, 100 * CASE WHEN count(g) OVER w >= 14 THEN avg(g) OVER w END / nullif(CASE WHEN count(g) OVER w >= 14 THEN avg(g) OVER w + avg(l) OVER w END, 0) AS rsi FROM (SELECT asset, date, greatest(d, 0) AS g, greatest(-d, 0) AS l FROM (SELECT *, level - lag(level) OVER (PARTITION BY asset ORDER BY date) AS d FROM levels) WHERE d IS NOT NULL UNION ALL SELECT asset, min(date), NULL, NULL FROM levels GROUP BY asset) WINDOW w AS (PARTITION BY asset ORDER BY date ROWS 13 PRECEDING)")
def _(t):
    return W.rsi(t.levels, key="asset", price="level")


@query("w14_moving_averages", "asset date sma_short~6 sma_long~6 sma_slope~8 is_cross", "levels", "SELECT asset, date, sma_short, sma_long, sma_short / nullif(lag(sma_short, 21) OVER w, 0) - 1 AS sma_slope, coalesce(lag(sma_short) OVER w > lag(sma_long) OVER w, false) AS is_cross FROM (SELECT *, CASE WHEN count(*) OVER a >= 50 THEN avg(level) OVER a END AS sma_short, CASE WHEN count(*) OVER b >= 200 THEN avg(level) OVER b END AS sma_long FROM levels WINDOW a AS (PARTITION BY asset ORDER BY date ROWS 49 PRECEDING), b AS (PARTITION BY asset ORDER BY date ROWS 199 PRECEDING)) WINDOW w AS (PARTITION BY asset ORDER BY date)")
def _(t):
    return W.moving_averages(t.levels, 50, 200, 21, key="asset", price="level")


@query("w15_rolling_drawdown", "asset date dd_roll~9", "levels", "SELECT asset, date, level / nullif(CASE WHEN count(*) OVER w >= 252 THEN max(level) OVER w END, 0) - 1 AS dd_roll FROM levels WINDOW w AS (PARTITION BY asset ORDER BY date ROWS 251 PRECEDING)")
def _(t):
    return W.rolling_drawdown(t.levels, 252, key="asset", price="level")


@query("w16_ratio_features", "assetid date spread~9 ratio~9 rel~9", "daily", "SELECT assetid, date, high - low AS spread, high / nullif(low, 0) AS ratio, high / nullif(CASE WHEN count(*) OVER w >= 20 THEN avg(high) OVER w END, 0) AS rel FROM daily WINDOW w AS (PARTITION BY assetid ORDER BY date ROWS 19 PRECEDING)")
def _(t):
    return W.ratio_features(t.daily, "high", "low", 20, key="assetid")


# returns are scaled down so that equity stays in range
CURVE = "SELECT *, equity / nullif(peak, 0) - 1 AS drawdown FROM (SELECT *, max(equity) OVER w AS peak FROM (SELECT asset, date, r / 10000 AS ret, product(1 + r / 10000) OVER w AS equity, sum(r / 10000) OVER w AS cum_sum, exp(sum(ln(1 + r / 10000)) OVER w) - 1 AS cum_log FROM (SELECT asset, date, ret AS r FROM returns) WINDOW w AS (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING)) WINDOW w AS (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING))"


def small_returns(t):
    return t.returns.select("asset", "date", (F.col("ret") / 10000).alias("ret"))


@query("w17_w18_equity_curve", "asset date equity~7 cum_sum~7 cum_log~7 peak~7 drawdown~7", "returns", CURVE)
def _(t):
    return W.equity(small_returns(t), key="asset")


@query("w19_longest_drawdown", "asset longest", "returns", "SELECT asset, max(n) AS longest FROM (SELECT asset, i, count(*) FILTER (drawdown < 0) AS n FROM (SELECT *, sum(CAST(drawdown >= 0 AS INTEGER)) OVER (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING) AS i FROM curve) GROUP BY asset, i) GROUP BY asset", curve=CURVE)
def _(t):
    return W.longest_drawdown(W.equity(small_returns(t), key="asset"), key="asset")


@query("w20_worst_period", "asset max_dd~7 start_date end_date", "returns", "SELECT c.asset, e.max_dd, arg_max(c.date, row(c.equity, DATE '2100-01-01' - c.date)) AS start_date, e.e AS end_date FROM curve c JOIN (SELECT asset, min(drawdown) AS max_dd, arg_min(date, row(drawdown, date)) AS e FROM curve GROUP BY asset) e ON c.asset = e.asset AND c.date <= e.e GROUP BY c.asset, e.max_dd, e.e", curve=CURVE)
def _(t):
    return W.worst_period(W.equity(small_returns(t), key="asset"), key="asset")


@query("w21_rolling_sharpe", "asset date roll_sharpe~8 roll_win~8", "returns", "SELECT asset, date, CASE WHEN count(*) OVER w >= 50 THEN avg(ret) OVER w / nullif(stddev_samp(ret) OVER w, 0) END AS roll_sharpe, CASE WHEN count(*) OVER w >= 50 THEN avg(CAST(ret > 0 AS DOUBLE)) OVER w END AS roll_win FROM returns WINDOW w AS (PARTITION BY asset ORDER BY date ROWS 49 PRECEDING)")
def _(t):
    return W.rolling_sharpe(t.returns, 50, key="asset")


JOINED = "SELECT r.asset, r.date, r.ret, m.ret AS bench FROM returns r JOIN (SELECT date, level / lag(level) OVER (ORDER BY date) - 1 AS ret FROM market) m ON r.date = m.date WHERE m.ret IS NOT NULL"


def with_market(t):
    from finpanel.operators.panel import with_returns

    m = with_returns(t.market.withColumn("k", F.lit(1)), key="k", by="date", price="level").select("date", F.col("ret").alias("bench")).filter("bench is not null")
    return t.returns.select("asset", "date", "ret").join(m, "date")


@query("w22_rolling_ols", "asset date beta~6 alpha~6", "returns market", "SELECT asset, date, CASE WHEN count(*) OVER w >= 50 THEN regr_slope(ret, bench) OVER w END AS beta, CASE WHEN count(*) OVER w >= 50 THEN regr_intercept(ret, bench) OVER w END AS alpha FROM j WINDOW w AS (PARTITION BY asset ORDER BY date ROWS 49 PRECEDING)", j=JOINED)
def _(t):
    return W.rolling_ols(with_market(t), 50, key="asset", y="ret", x="bench")


@query("w23_rolling_correlation", "asset date rho~6", "returns market", "SELECT asset, date, CASE WHEN count(*) OVER w >= 30 THEN corr(ret, bench) OVER w END AS rho FROM j WINDOW w AS (PARTITION BY asset ORDER BY date ROWS 29 PRECEDING)", j=JOINED)
def _(t):
    return W.rolling_ols(with_market(t), 30, key="asset", y="ret", x="bench")


GAPPY = "SELECT asset, date, CASE WHEN hash_day % 3 = 0 THEN NULL ELSE level END AS v FROM (SELECT *, day(date) AS hash_day FROM levels)"


@query("w24_fills", "asset date v_filled~2 v_linear~4", "levels", "SELECT asset, date, CASE WHEN n - last_value(CASE WHEN v IS NOT NULL THEN n END IGNORE NULLS) OVER w <= 2 THEN last_value(v IGNORE NULLS) OVER w END AS v_filled, CASE WHEN v IS NOT NULL THEN v ELSE last_value(v IGNORE NULLS) OVER w + (first_value(v IGNORE NULLS) OVER f - last_value(v IGNORE NULLS) OVER w) * (date - last_value(CASE WHEN v IS NOT NULL THEN date END IGNORE NULLS) OVER w) / nullif(first_value(CASE WHEN v IS NOT NULL THEN date END IGNORE NULLS) OVER f - last_value(CASE WHEN v IS NOT NULL THEN date END IGNORE NULLS) OVER w, 0) END AS v_linear FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date) AS n FROM g) WINDOW w AS (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY asset ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)", g=GAPPY)
def _(t):
    gappy = t.levels.select("asset", "date", F.when(F.dayofmonth("date") % 3 != 0, F.col("level")).alias("v"))
    return W.fill(gappy, "v", key="asset", limit=2)


LONG = "SELECT date, 'mean_price' AS variable, mean_price AS value FROM market UNION ALL SELECT date, 'n_orders', n_orders FROM market"
LEVEL = "SELECT *, CASE WHEN n >= 505 AND c >= 0.9 * 505 AND value IS NOT NULL THEN CASE WHEN value > q[2] THEN 2 WHEN value < q[1] THEN 0 ELSE 1 END END AS level FROM (SELECT *, count(*) OVER w AS n, count(value) OVER w AS c, quantile_cont(value, [0.25, 0.75]) OVER w AS q FROM long_ WINDOW w AS (PARTITION BY variable ORDER BY date ROWS 504 PRECEDING))"


@query("w25_rolling_state", "date state#", "market", "SELECT date, CASE WHEN count(level) = 2 THEN CAST(sum(level * CASE variable WHEN 'mean_price' THEN 1 ELSE 3 END) AS INTEGER) END AS state FROM lv GROUP BY date", long_=LONG, lv=LEVEL)
def _(t):
    return W.state_code(W.rolling_state(U.to_long(t.market, ["date"], ["mean_price", "n_orders"]), 505), ["mean_price", "n_orders"])


@query("w26_regime_changes", "asset n changes# holding~8", "returns", "SELECT asset, count(*) AS n, sum(c) AS changes, count(*) / (sum(c) + 1) AS holding FROM (SELECT asset, CAST(coalesce(sign(ret) <> lag(sign(ret)) OVER (PARTITION BY asset ORDER BY date), false) AS INTEGER) AS c FROM returns) GROUP BY asset")
def _(t):
    return W.regime_changes(t.returns.withColumn("state", F.signum("ret")), key="asset")


@query("w27_trailing_rank", "asset date trail_rank~9", "returns", "SELECT asset, date, (len([v for v in p if v < ret]) + 0.5 * len([v for v in p if v = ret])) / len(p) AS trail_rank FROM (SELECT *, list(ret) OVER (PARTITION BY asset ORDER BY date ROWS 103 PRECEDING) AS p FROM returns)")
def _(t):
    return W.trailing_rank(t.returns, 104, key="asset", value="ret")


@query("w28_lagged_signal", "asset date sig_live", "returns", "SELECT asset, date, last_value(b IGNORE NULLS) OVER w AS sig_live FROM (SELECT asset, date, lag(CASE WHEN day(date) % 7 = 0 THEN day(date) END) OVER (PARTITION BY asset ORDER BY date) AS b FROM returns) WINDOW w AS (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING)")
def _(t):
    sig = F.when(F.dayofmonth("date") % 7 == 0, F.dayofmonth("date").cast("long"))
    return W.lag_signal(t.returns.withColumn("sig", sig), "sig", key="asset")


@query("w29_rebased", "asset date rebased~7", "levels", "SELECT asset, date, 100 * level / first_value(level) OVER (PARTITION BY asset ORDER BY date) AS rebased FROM levels")
def _(t):
    return W.rebase(t.levels, "level", key="asset")


@query("w30_running_mean", "asset date running_mean~8", "returns", "SELECT asset, date, avg(ret) OVER (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING) AS running_mean FROM returns")
def _(t):
    return W.running_mean(t.returns, "ret", key="asset", by="date")


@query("w31_autocorrelation", "asset lag# acf~8", "returns", "SELECT asset, k AS lag, sum(d * e) / sum(d * d) AS acf FROM (" + " UNION ALL ".join(f"SELECT asset, {k} AS k, d, lag(d, {k}) OVER (PARTITION BY asset ORDER BY date) AS e FROM (SELECT *, ret - avg(ret) OVER (PARTITION BY asset) AS d FROM returns)" for k in range(1, 6)) + ") GROUP BY ALL")
def _(t):
    return W.autocorrelation(t.returns, 5, key="asset")


@query("w32_differences", "asset date diff~2 dlog~8", "levels", "SELECT asset, date, level - lag(level) OVER w AS diff, ln(level) - ln(lag(level) OVER w) AS dlog FROM levels WINDOW w AS (PARTITION BY asset ORDER BY date)")
def _(t):
    return W.differences(t.levels, "level", key="asset")


TOP = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ym ORDER BY mom_6 DESC, assetid) AS rn, count(*) OVER (PARTITION BY ym) AS n FROM features WHERE mom_6 IS NOT NULL)"


@query("t1_top_bottom", "ym# assetid leg rank#", "features", "SELECT ym, assetid, CASE WHEN rn <= greatest(1, round(0.1 * n)) THEN 'long' ELSE 'short' END AS leg, CASE WHEN rn <= greatest(1, round(0.1 * n)) THEN rn ELSE n - rn + 1 END AS rank FROM top WHERE n >= 2 * greatest(1, round(0.1 * n)) AND (rn <= greatest(1, round(0.1 * n)) OR rn > n - greatest(1, round(0.1 * n)))", top=TOP)
def _(t):
    return T.top_bottom(t.features, "mom_6", 0.1)


@query("t2_class_spread", "ym# assetid leg rank#", "predictions", "SELECT ym, assetid, CASE WHEN rn <= 5 THEN 'long' ELSE 'short' END AS leg, CASE WHEN rn <= 5 THEN rn ELSE n - rn + 1 END AS rank FROM (SELECT *, row_number() OVER (PARTITION BY ym ORDER BY probs[10] - probs[1] DESC, assetid) AS rn, count(*) OVER (PARTITION BY ym) AS n FROM predictions) WHERE n >= 10 AND (rn <= 5 OR rn > n - 5)")
def _(t):
    return T.top_bottom(t.predictions.withColumn("spread", F.element_at("probs", 10) - F.element_at("probs", 1)), "spread", 5)


@query("t3_candidates", "ym# assetid rank_long# rank_short# rebal_date", "features", "SELECT ym, assetid, row_number() OVER (PARTITION BY ym ORDER BY mom_6 DESC, assetid) AS rank_long, row_number() OVER (PARTITION BY ym ORDER BY mom_6, assetid DESC) AS rank_short, max(date) OVER (PARTITION BY ym) AS rebal_date FROM features WHERE mom_6 IS NOT NULL")
def _(t):
    return T.candidates(t.features, "mom_6")


@query("t5_sharpe_ranking", "asset sharpe~8 place#", "returns", "SELECT asset, sharpe, row_number() OVER (ORDER BY sharpe DESC, asset) AS place FROM (SELECT asset, (avg(ret) * 252 - 0.045) / nullif(stddev_samp(ret) * sqrt(252), 0) AS sharpe FROM returns GROUP BY asset) ORDER BY place LIMIT 3")
def _(t):
    from finpanel.operators.risk import risk_return

    return T.ranking(risk_return(t.returns, rf=0.045), "sharpe", "asset", 3)


@query("t6_hit_rate", "assetid hits windows# rate~9", "features", "SELECT assetid, count(*) AS hits, (SELECT count(DISTINCT ym) FROM top) AS windows, count(*) / (SELECT count(DISTINCT ym) FROM top) AS rate FROM top WHERE rn <= 10 GROUP BY assetid", top=TOP)
def _(t):
    return T.hit_rate(t.features, "mom_6", 10)


@query("t7_worst_divergences", "assetid ym# ret~9", "monthly", "SELECT * FROM monthly WHERE ret IS NOT NULL ORDER BY abs(ret) DESC, assetid, ym LIMIT 20")
def _(t):
    return T.largest(t.monthly.filter("ret is not null"), F.abs("ret"), 20, ["assetid", "ym"])


@query("t8_extremes", "asset best_date worst_date", "returns", "SELECT asset, arg_max(date, row(ret, date)) AS best_date, arg_min(date, row(ret, date)) AS worst_date FROM returns GROUP BY asset")
def _(t):
    return T.extremes(t.returns, "asset", "ret", "date")


@query("t9_first_row", "ticker ts open", "bars", "SELECT ticker, ts, open FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts) AS rn FROM bars) WHERE rn = 1")
def _(t):
    return T.first_rows(t.bars, "ticker", "ts")


@query("u1_stacked", "strategy n", "features", "SELECT 'a' AS strategy, count(*) FILTER (mom_3 > 0) AS n FROM features UNION ALL SELECT 'b', count(*) FILTER (mom_6 > 0) FROM features")
def _(t):
    return U.stack({"a": t.features.filter("mom_3 > 0").select("assetid"), "b": t.features.filter("mom_6 > 0").select("assetid")}).groupBy("strategy").agg(F.count(F.lit(1)).alias("n"))


@query("u2_distinct_pairs", "investor asset", "holdings", "SELECT DISTINCT investor, asset FROM holdings")
def _(t):
    return U.distinct_keys(t.holdings, ["investor", "asset"])


@query("u3_set_operations", "in_both only_left", "daily membership", "SELECT (SELECT count(*) FROM (SELECT assetid FROM daily INTERSECT SELECT assetid FROM membership WHERE year(start_date) = 1995)) AS in_both, (SELECT count(*) FROM (SELECT assetid FROM daily EXCEPT SELECT assetid FROM membership WHERE year(start_date) = 1995)) AS only_left")
def _(t):
    return U.set_sizes(t.daily.select("assetid"), t.membership.filter(F.year("start_date") == 1995).select("assetid"))


@query("u4_pivot", "date urgent~2 high~2", "levels", "SELECT date, sum(level) FILTER (asset = '1-URGENT') AS urgent, sum(level) FILTER (asset = '2-HIGH') AS high FROM levels GROUP BY date")
def _(t):
    return U.to_wide(t.levels, "date", "asset", "level", {"1-URGENT": "urgent", "2-HIGH": "high"})


@query("u4_unpivot", "date variable value~6", "market", LONG)
def _(t):
    return U.to_long(t.market, ["date"], ["mean_price", "n_orders"])


@query("u5_interval_months", "assetid month", "membership", "SELECT DISTINCT assetid, CAST(unnest(generate_series(date_trunc('month', start_date), date_trunc('month', end_date), INTERVAL 1 MONTH)) AS DATE) AS month FROM membership")
def _(t):
    return U.months_of(t.membership).select("assetid", "month").distinct()
