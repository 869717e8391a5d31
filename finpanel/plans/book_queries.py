"""Books, bridges, bars, holdings, learning and sources over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from finpanel.operators import aggregates as A
from finpanel.operators import bars as B
from finpanel.operators import books as K
from finpanel.operators import features, holdings, joins, learning, panel
from finpanel.operators import risk as R
from finpanel.operators import topk as T
from finpanel.operators import windows as W
from finpanel.operators.stages import kept
from finpanel.plans.catalog import query
from finpanel.plans.table_queries import DAYBARS, LABELS

SCORES = ["mom_3", "mom_6", "mom_12"]
BOOK = """SELECT strategy, ym, assetid, fwd, CASE WHEN rn <= k THEN 'long' ELSE 'short' END AS leg, CASE WHEN rn <= k THEN rn ELSE n - rn + 1 END AS rank, dense_rank() OVER (PARTITION BY strategy ORDER BY ym) AS period
FROM (SELECT *, greatest(1, round(0.1 * n)) AS k FROM (SELECT strategy, ym, assetid, fwd, row_number() OVER (PARTITION BY strategy, ym ORDER BY score DESC, assetid) AS rn, count(*) OVER (PARTITION BY strategy, ym) AS n FROM (""" + " UNION ALL ".join(f"SELECT '{s}' AS strategy, ym, assetid, fwd, {s} AS score FROM features WHERE {s} IS NOT NULL" for s in SCORES) + """)))
WHERE n >= 2 * k AND (rn <= k OR rn > n - k)"""
TURN = "SELECT *, coalesce(lag(period) OVER w <> period - 1, true) AS is_new, coalesce(lead(period) OVER w <> period + 1, true) AS will_exit FROM book WINDOW w AS (PARTITION BY strategy, leg, assetid ORDER BY period)"
COSTS = "SELECT *, (entries + exits) / n * 0.0005 AS commission, CASE leg WHEN 'long' THEN 1 ELSE -1 END * 0.05 * 30 / 365 AS financing FROM (SELECT strategy, ym, period, leg, count(*) AS n, count(*) FILTER (is_new) AS entries, count(*) FILTER (will_exit) AS exits, avg(fwd) AS leg_ret FROM turn GROUP BY ALL)"
MONTHS = "SELECT *, gross - commission - financing AS net FROM (SELECT strategy, ym, period, max(n) FILTER (leg = 'long') AS long_n, max(n) FILTER (leg = 'short') AS short_n, max(leg_ret) FILTER (leg = 'long') AS long_leg_ret, max(leg_ret) FILTER (leg = 'short') AS short_leg_ret, 0.5 * max(leg_ret) FILTER (leg = 'long') - 0.5 * max(leg_ret) FILTER (leg = 'short') AS gross, 0.5 * sum(commission) AS commission, 0.5 * sum(financing) AS financing FROM costs GROUP BY ALL)"
CHAIN = {"book": BOOK, "turn": TURN, "costs": COSTS, "months": MONTHS}


def book(t):
    return K.select_books(t.features, SCORES, 0.1)


def months(t):
    return K.book_months(K.period_costs(book(t)))


@query("p1_books", "strategy ym# assetid leg rank# period#", "features", "SELECT * FROM book", book=BOOK)
def _(t):
    return book(t)


@query("j15_entries_exits", "strategy ym# assetid leg is_new will_exit", "features", "SELECT * FROM turn", book=BOOK, turn=TURN)
def _(t):
    return K.with_turnover(book(t))


@query("p2_period_costs", "strategy ym# leg n entries exits commission~9 financing~9", "features", "SELECT * FROM costs", book=BOOK, turn=TURN, costs=COSTS)
def _(t):
    return K.period_costs(book(t))


@query("p3_book_months", "strategy ym# long_n short_n gross~8 commission~9 financing~9 net~8", "features", "SELECT * FROM months", **CHAIN)
def _(t):
    return months(t)


def scaled(t):
    """Net returns a hundredth of their size, so that compounded equity stays positive."""
    return months(t).filter("net is not null").withColumn("ret", F.col("net") / 100)


PERF = "SELECT strategy, count(ret) AS n, avg(ret) * 12 AS ann_ret, stddev_samp(ret) * sqrt(12) AS ann_vol, avg(ret) * 12 / nullif(stddev_samp(ret) * sqrt(12), 0) AS sharpe, product(1 + ret) - 1 AS total, min(e / m - 1) AS max_dd, avg(CAST(ret > 0 AS DOUBLE)) AS win_rate FROM (SELECT *, max(e) OVER w AS m FROM (SELECT strategy, period, net / 100 AS ret, product(1 + net / 100) OVER w AS e FROM months WHERE net IS NOT NULL WINDOW w AS (PARTITION BY strategy ORDER BY period ROWS UNBOUNDED PRECEDING)) WINDOW w AS (PARTITION BY strategy ORDER BY period ROWS UNBOUNDED PRECEDING)) GROUP BY strategy"


@query("p4_strategy_performance", "strategy n ann_ret~7 ann_vol~7 sharpe~7 total~7 max_dd~8 win_rate~9", "features", PERF, **CHAIN)
def _(t):
    """D-5 over the books of all strategies."""
    return R.performance(W.equity(scaled(t), key="strategy", by="period"), key="strategy", periods=12)


@query("a31_leg_diagnostics", "strategy long_ann~7 short_ann~7 worst~8 best~8 worst_ym#", "features", "SELECT strategy, avg(long_leg_ret) * 12 AS long_ann, avg(short_leg_ret) * 12 AS short_ann, min(net) AS worst, max(net) AS best, arg_min(ym, row(net, ym)) AS worst_ym FROM months WHERE net IS NOT NULL GROUP BY strategy", **CHAIN)
def _(t):
    return K.leg_diagnostics(months(t).filter("net is not null"))


LOG = "SELECT t.strategy, t.ym, t.leg, t.assetid, weight, e.close AS entry_px, x.close AS exit_px, commission, financing, weight * (side * fwd - commission - financing) AS net FROM (SELECT *, 0.5 / count(*) OVER (PARTITION BY strategy, ym, leg) AS weight, CASE leg WHEN 'long' THEN 1 ELSE -1 END AS side, (CAST(is_new AS INTEGER) + CAST(will_exit AS INTEGER)) * 0.0005 AS commission, CASE leg WHEN 'long' THEN 1 ELSE -1 END * 0.05 * 30 / 365 AS financing FROM turn) t JOIN (SELECT ym, lead(ym) OVER (ORDER BY ym) AS nx FROM (SELECT DISTINCT ym FROM monthly0)) c USING (ym) LEFT JOIN monthly0 e ON e.assetid = t.assetid AND e.ym = t.ym LEFT JOIN monthly0 x ON x.assetid = t.assetid AND x.ym = c.nx"


@query("p5_trade_log", "strategy ym# leg assetid weight~9 entry_px exit_px commission~9 financing~9 net~9", "features", LOG, book=BOOK, turn=TURN)
def _(t):
    return K.trade_log(book(t), panel.to_monthly(t.daily))


@query("p5_trade_log_reconcile", "n_rows ok", "features", "SELECT count(*) AS n_rows, coalesce(max(abs(a - net)) <= 1e-8, true) AS ok FROM (SELECT strategy, ym, sum(net) AS a FROM log GROUP BY ALL HAVING count(*) = count(net)) JOIN months USING (strategy, ym)", **CHAIN, log=LOG)
def _(t):
    per = K.trade_log(book(t), panel.to_monthly(t.daily)).groupBy("strategy", "ym").agg(F.sum("net").alias("a"), F.count(F.lit(1)).alias("n"), F.count("net").alias("m")).filter("n = m")
    return joins.reconcile(per.select("strategy", "ym", "a"), months(t), ["strategy", "ym"], "a", "net")


@query("p6_weighted_trade_log", "strategy ym# leg assetid weight~9 net~9", "features", "SELECT * FROM (SELECT strategy, ym, leg, assetid, weight, weight * (CASE leg WHEN 'long' THEN 1 ELSE -1 END * coalesce(fwd, 0) - (CAST(is_new AS INTEGER) + CAST(will_exit AS INTEGER)) * 0.0005 - CASE leg WHEN 'long' THEN 1 ELSE -1 END * 0.05 * 30 / 365) AS net FROM (SELECT *, (6 - rank) / 100.0 AS weight FROM turn)) WHERE weight > 0", book=BOOK, turn=TURN)
def _(t):
    return K.trade_log(book(t), panel.to_monthly(t.daily), weight=(6 - F.col("rank")) / 100.0)


CANDS = "SELECT ym, assetid, row_number() OVER (PARTITION BY ym ORDER BY mom_6 DESC, assetid) AS rank_long, row_number() OVER (PARTITION BY ym ORDER BY mom_6, assetid DESC) AS rank_short, max(date) OVER (PARTITION BY ym) AS rebal_date FROM features WHERE mom_6 IS NOT NULL"
EXECD = "SELECT s.rebal_date, c.date AS exec_date FROM (SELECT DISTINCT rebal_date FROM cands) s LEFT JOIN calendar c ON c.ordinal = (SELECT count(*) FROM calendar k WHERE k.date <= s.rebal_date) + 1"
FILLED = "SELECT ym, assetid, 'long' AS leg, r AS rank FROM lg UNION ALL SELECT ym, assetid, 'short', r FROM (SELECT ym, assetid, row_number() OVER (PARTITION BY ym ORDER BY rank_short) AS r FROM good WHERE NOT EXISTS (SELECT 1 FROM lg WHERE lg.ym = good.ym AND lg.assetid = good.assetid)) WHERE r <= 5"
FILL = {"cands": CANDS, "ex": EXECD, "good": "SELECT cands.*, d.close AS exec_px FROM cands JOIN ex USING (rebal_date) JOIN daily d ON d.assetid = cands.assetid AND d.date = ex.exec_date WHERE d.close > 0", "lg": "SELECT * FROM (SELECT ym, assetid, row_number() OVER (PARTITION BY ym ORDER BY rank_long) AS r FROM good) WHERE r <= 5", "filled": FILLED}


def filled(t):
    c = T.candidates(t.features, "mom_6").withColumnRenamed("date", "own_date")
    x = c.join(joins.execution_dates(c, t.calendar, by="rebal_date"), "rebal_date")
    return T.fill_down(joins.price_at(x, t.daily, by="exec_date", name="exec_px"), 5)


@query("t4_filldown_picks", "ym# assetid leg rank#", "features calendar", "SELECT * FROM filled", **FILL)
def _(t):
    return filled(t)


def executed(t):
    """Prices on the trading day after this and after the next month's last day."""
    m = t.monthly.groupBy("ym").agg(F.max("date").alias("d"))
    ex = m.join(joins.execution_dates(m.withColumnRenamed("d", "date"), t.calendar), m["d"] == F.col("date")).select("ym", "exec_date")
    px = t.features.select("assetid", "ym").join(ex, "ym").join(ex.select((F.col("ym") - 1).alias("ym"), F.col("exec_date").alias("next_date")), "ym", "left")
    px = joins.price_at(px, t.daily, by="exec_date", name="entry_px")
    return joins.price_at(px, t.daily, by="next_date", name="exit_px").select("assetid", "ym", "entry_px", "exit_px")


PX = {
    "mx": "SELECT ym, max(date) AS d FROM monthly GROUP BY ym", "xd": "SELECT ym, c.date AS exec_date FROM mx LEFT JOIN calendar c ON c.ordinal = (SELECT count(*) FROM calendar k WHERE k.date <= mx.d) + 1",
    "px": "SELECT f.assetid, f.ym, a.close AS entry_px, b.close AS exit_px FROM features f JOIN xd x ON x.ym = f.ym LEFT JOIN xd y ON y.ym = f.ym + 1 LEFT JOIN daily a ON a.assetid = f.assetid AND a.date = x.exec_date LEFT JOIN daily b ON b.assetid = f.assetid AND b.date = y.exec_date",
    "pos": "SELECT book.*, entry_px, exit_px, exit_px / nullif(entry_px, 0) - 1 AS daily_ret, fwd - (exit_px / nullif(entry_px, 0) - 1) AS diff FROM book LEFT JOIN px USING (assetid, ym)",
    "bm": "SELECT strategy, ym, leg, avg(fwd) AS monthly, avg(daily_ret) AS daily, avg(diff) AS diff, count(*) FILTER (entry_px IS NULL OR exit_px IS NULL) AS missing FROM pos GROUP BY ALL",
}


@query("p7_bridge_positions", "strategy ym# assetid leg fwd~8 daily_ret~8 diff~8", "features calendar", "SELECT * FROM pos", book=BOOK, **PX)
def _(t):
    return K.bridge(book(t), executed(t))


@query("p7_bridge_months", "strategy ym# leg monthly~7 daily~7 diff~7 missing", "features calendar", "SELECT * FROM bm", book=BOOK, **PX)
def _(t):
    return K.bridge_months(K.bridge(book(t), executed(t)))


@query("p7_bridge_report", "strategy leg months mean_abs_diff~6 missing#", "features calendar", "SELECT strategy, leg, count(*) AS months, avg(abs(diff)) AS mean_abs_diff, sum(missing) AS missing FROM bm GROUP BY ALL", book=BOOK, **PX)
def _(t):
    return K.bridge_report(K.bridge_months(K.bridge(book(t), executed(t))))


STALE = "SELECT d.assetid, d.date, d.ordinal, CASE WHEN d.ordinal - b.ordinal > 3 AND d.date > f.final THEN 0 ELSE b.close END AS px, d.ordinal - b.ordinal AS missing_days FROM (SELECT assetid, date, ordinal FROM (SELECT assetid, min(date) AS first FROM daily GROUP BY assetid) l JOIN calendar c ON c.date >= l.first) d ASOF JOIN (SELECT assetid, date, close, ordinal FROM daily JOIN calendar USING (date)) b ON d.assetid = b.assetid AND d.ordinal >= b.ordinal JOIN (SELECT assetid, max(date) AS final FROM daily GROUP BY assetid) f ON f.assetid = d.assetid"


@query("p9_stale_prices", "assetid date px missing_days#", "calendar", STALE)
def _(t):
    return K.stale_prices(t.daily, t.calendar)


# the recursion goes from a strategy's interval to its next one; its costs compare weights with what the interval before has left
MARKED = {
    "book": BOOK, "stale": STALE,
    "dates": "SELECT m.ym, c.date AS exec_date FROM (SELECT ym, max(date) AS d FROM monthly GROUP BY ym) m JOIN calendar k ON k.date = m.d LEFT JOIN calendar c ON c.ordinal = k.ordinal + 1",
    "held": "SELECT strategy, period, exec_date, next_date, assetid, leg, 0.005 / count(*) OVER (PARTITION BY strategy, ym, leg) AS w FROM (SELECT b.strategy, b.ym, b.period, a.exec_date, z.exec_date AS next_date, b.assetid, b.leg FROM book b JOIN dates a ON a.ym = b.ym JOIN dates z ON z.ym = b.ym + 1 WHERE b.strategy = 'mom_6' AND a.exec_date IS NOT NULL AND z.exec_date IS NOT NULL)",
    "marks": "SELECT *, product(step) OVER (PARTITION BY strategy, period, leg, assetid ORDER BY date ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT h.*, s.date, 1 + CASE leg WHEN 'long' THEN 1 ELSE -1 END * coalesce(px / nullif(px0, 0) - 1, 0) - CASE leg WHEN 'long' THEN 0.05::DOUBLE / 365 ELSE -0.02::DOUBLE / 365 END AS step FROM held h JOIN (SELECT assetid, date, px, lag(px) OVER (PARTITION BY assetid ORDER BY date) AS px0 FROM stale) s ON s.assetid = h.assetid AND s.date > h.exec_date AND s.date <= h.next_date)",
    "ends": "SELECT strategy, period, leg, assetid, arg_max(g, date) AS g, max(w) AS w FROM marks GROUP BY ALL",
    "intervals": "SELECT strategy, period, sum(w * (g - 1)) AS growth, row_number() OVER (PARTITION BY strategy ORDER BY period) AS rn FROM ends GROUP BY strategy, period",
    "moves": "SELECT strategy, period, assetid, sum(w) AS w, sum(h) AS h FROM (SELECT strategy, period, assetid, w, 0 AS h FROM held UNION ALL SELECT strategy, period + 1, assetid, 0, w * g FROM ends) GROUP BY ALL",
    "starts": """WITH RECURSIVE st AS (SELECT DISTINCT strategy, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS period, 100000::DOUBLE AS e, 0::DOUBLE AS c, 100000::DOUBLE AS after, 1::DOUBLE AS f FROM intervals UNION ALL
  SELECT strategy, rn, period, e, c, e * (1 - c + growth), 1 - c + growth FROM (SELECT st.strategy, i.rn, i.period, st.after AS e, growth, 0.001::DOUBLE * sum(abs(m.w - m.h / st.f)) AS c
    FROM st JOIN intervals i ON i.strategy = st.strategy AND i.rn = st.rn + 1 JOIN moves m ON m.strategy = i.strategy AND m.period = i.period GROUP BY ALL))
SELECT strategy, period, e, c FROM st WHERE rn > 0""",
}


@query("p8_mark_to_market", "strategy period# date n_positions equity~2", "calendar monthly features", "SELECT strategy, period, date, n_positions, e * (1 - c + s) AS equity FROM (SELECT strategy, period, date, sum(w * (g - 1)) AS s, count(*) AS n_positions FROM marks GROUP BY ALL) JOIN starts USING (strategy, period)", **MARKED)
def _(t):
    t.daily = kept(t.daily, "daily")  # calendar, months and prices read the bars
    m = t.monthly.groupBy("ym").agg(F.max("date").alias("d"))
    ex = m.join(joins.execution_dates(m.withColumnRenamed("d", "date"), t.calendar), m["d"] == F.col("date")).select("ym", "exec_date")
    b = book(t).filter("strategy = 'mom_6'").join(ex, "ym").join(ex.select((F.col("ym") - 1).alias("ym"), F.col("exec_date").alias("next_date")), "ym").filter("exec_date is not null and next_date is not null")
    from pyspark.sql import Window

    b = b.withColumn("w", 0.005 / F.count(F.lit(1)).over(Window.partitionBy("strategy", "ym", "leg")))
    return K.mark_to_market(kept(b, "book"), K.stale_prices(t.dealt(t.daily, "assetid"), t.calendar))


@query("p11_naive_class", "assetid ym# pred#", "predictions", "SELECT assetid, ym, list_position(probs, list_max(probs)) AS pred FROM predictions")
def _(t):
    return learning.naive_class(t.predictions)


MU, SIGMA = [-0.1 + 0.02 * i for i in range(10)], [0.3 + 0.01 * i for i in range(10)]


@query("p11_reclassified", "assetid ym# ret_score~9 srp_score~8", "predictions", "SELECT assetid, ym, m AS ret_score, m / nullif(sqrt(greatest(s - m * m, 0)), 0) AS srp_score FROM (SELECT assetid, ym, " + " + ".join(f"probs[{i + 1}] * {MU[i]!r}" for i in range(10)) + " AS m, " + " + ".join(f"probs[{i + 1}] * {MU[i] ** 2 + SIGMA[i] ** 2!r}" for i in range(10)) + " AS s FROM predictions)")
def _(t):
    return learning.reclassify(t.predictions, MU, SIGMA)


def tail_sql(alpha: float) -> str:
    cum = ["0.0", *[" + ".join(f"probs[{j + 1}]" for j in range(i)) for i in range(1, 10)]]
    return " + ".join(f"least(probs[{i + 1}], greatest({alpha} - ({cum[i]}), 0)) * {MU[i]!r}" for i in range(10))


@query("d22e_class_cvar", "assetid ym# cvar~8 cvr_score~7", "predictions", f"SELECT assetid, ym, c AS cvar, m / nullif(abs(c), 0) AS cvr_score FROM (SELECT assetid, ym, ({tail_sql(0.25)}) / 0.25 AS c, " + " + ".join(f"probs[{i + 1}] * {MU[i]!r}" for i in range(10)) + " AS m FROM predictions)")
def _(t):
    return learning.reclassify(t.predictions, MU, SIGMA)


def labelled(t):
    return features.bucket(t.features, "fwd", name="label")


@query("p12_class_stats", "train_ym# label# mu~8 sigma~8", "features", "SELECT train_ym, k AS label, coalesce(mu, 0) AS mu, coalesce(sg, 0.01) AS sigma FROM (SELECT DISTINCT ym AS train_ym FROM monthly WHERE ym % 12 = 0) s CROSS JOIN range(1, 11) g(k) LEFT JOIN (SELECT train_ym, label, avg(fwd) AS mu, stddev_samp(fwd) AS sg FROM (SELECT DISTINCT ym AS train_ym FROM monthly WHERE ym % 12 = 0) JOIN (SELECT features.ym, features.assetid, fwd, label FROM features JOIN lab USING (assetid, ym) WHERE label IS NOT NULL) h ON h.ym >= train_ym - 36 AND h.ym < train_ym GROUP BY ALL) x USING (train_ym) WHERE x.label = g.k OR x.label IS NULL", lab=LABELS)
def _(t):
    schedule = t.monthly.select(F.col("ym").alias("train_ym")).filter("train_ym % 12 = 0").distinct()
    return learning.class_stats(labelled(t), schedule, 10, months=36)


@query("p13_training_schedule", "ym# train_no# train_ym#", "monthly", "SELECT ym, train_no, min(ym) OVER (PARTITION BY train_no) AS train_ym FROM (SELECT ym, (row_number() OVER (ORDER BY ym) - 1) // 12 AS train_no FROM (SELECT DISTINCT ym FROM monthly) WHERE ym >= (SELECT min(ym) FROM monthly) + 24)")
def _(t):
    return learning.training_schedule(t.monthly, first=24, every=12)


@query("p14_rolling_folds", "fold# train_days test_days", "calendar", "SELECT fold, count(*) FILTER (date < mid) AS train_days, count(*) FILTER (date >= mid) AS test_days FROM (SELECT k AS fold, CAST(lo + to_months(CAST(k * 6 AS INTEGER)) AS DATE) AS start, CAST(lo + to_months(CAST(k * 6 + 24 AS INTEGER)) AS DATE) AS mid, CAST(lo + to_months(CAST(k * 6 + 30 AS INTEGER)) AS DATE) AS stop FROM range(100) r(k), (SELECT date_trunc('month', min(date)) AS lo, date_trunc('month', max(date)) AS hi FROM calendar) WHERE lo + to_months(CAST(k * 6 + 29 AS INTEGER)) <= hi) JOIN calendar ON date >= start AND date < stop GROUP BY fold")
def _(t):
    return learning.folds(t.calendar)


@query("p15_walk_forward", "assetid ym# label# probs")
def _(t):
    """Rows only: a forest of pyspark.ml for each training date."""
    return learning.walk_forward(labelled(t), ["mom_1", "mom_3", "mom_6"], first=24, every=36, months=36)


GAPS = "SELECT ticker, date, gap, CASE WHEN gap <= -15 THEN 0 WHEN gap <= -5 THEN 1 WHEN gap <= -2 THEN 2 WHEN gap <= 0 THEN 3 WHEN gap <= 2 THEN 4 WHEN gap <= 5 THEN 5 WHEN gap <= 15 THEN 6 ELSE 7 END AS bin FROM (SELECT ticker, date, 100 * (open / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1) AS gap FROM d) WHERE abs(gap) >= 0"
FIRST = "SELECT *, c1 > o AS first_up, sign(first_ret) = sign(rest_ret) AS momentum FROM (SELECT *, c1 / nullif(o, 0) - 1 AS first_ret, c / nullif(c1, 0) - 1 AS rest_ret FROM (SELECT ticker, CAST(ts AS DATE) AS date, arg_min(open, ts) AS o, arg_min(close, ts) AS c1, arg_max(close, ts) AS c, count(*) AS n FROM bars GROUP BY ticker, CAST(ts AS DATE) HAVING count(*) >= 2))"


def gaps(t):
    return B.gap_bins(A.daily_open_close(t.bars))


@query("d13_gap_bins", "ticker date gap~8 bin#", "bars", GAPS, d=DAYBARS)
def _(t):
    return gaps(t)


# Lloyd's steps, centers in a list, until they stay
CENTERS = """WITH RECURSIVE k AS (SELECT 0 AS step, [5.0, 10.0, 15.0, 25.0]::DOUBLE[] AS c, true AS moved UNION ALL
  SELECT step + 1, list(coalesce(m, old) ORDER BY i), bool_or(abs(coalesce(m, old) - old) > 1e-12 * greatest(abs(old), 1)) FROM (
    SELECT k.step, i, c[i] AS old, avg(size) FILTER (list_position(list_transform(c, lambda z: abs(size - z)), list_min(list_transform(c, lambda z: abs(size - z)))) = i) AS m
    FROM k, range(1, 5) r(i), (SELECT abs(gap) AS size FROM g WHERE gap IS NOT NULL) WHERE moved GROUP BY k.step, i, c) GROUP BY step)
SELECT c FROM k ORDER BY step DESC LIMIT 1"""


@query("d14_gap_clusters", "ticker date size~7 cluster#", "bars", "SELECT ticker, date, abs(gap) AS size, list_position(list_transform(c, lambda z: abs(abs(gap) - z)), list_min(list_transform(c, lambda z: abs(abs(gap) - z)))) - 1 AS cluster FROM g, cs WHERE gap IS NOT NULL", d=DAYBARS, g=GAPS, cs=CENTERS)
def _(t):
    return B.k_means_1d(gaps(t).withColumn("size", F.abs("gap")), "size", [5.0, 10.0, 15.0, 25.0])[0]


@query("a26_gap_bin_stats", "bin# n mean~7 median~7 sd~7 lo~7 hi~7", "bars", "SELECT bin, count(*) AS n, avg(gap) AS mean, median(gap) AS median, stddev_samp(gap) AS sd, min(gap) AS lo, max(gap) AS hi FROM g GROUP BY bin", d=DAYBARS, g=GAPS)
def _(t):
    return A.bin_stats(gaps(t), "bin", "gap")


@query("d15_first_bar_momentum", "ticker date first_ret~8 rest_ret~8 momentum", "bars", FIRST)
def _(t):
    return B.first_and_rest(t.bars)


@query("a27_momentum_by_bin", "bin# first_up n continued~8 mean_rest~7", "bars", "SELECT bin, first_up, count(*) AS n, avg(CAST(momentum AS DOUBLE)) AS continued, avg(rest_ret) AS mean_rest FROM f JOIN g USING (ticker, date) GROUP BY ALL", d=DAYBARS, g=GAPS, f=FIRST)
def _(t):
    return B.momentum_by_bin(B.first_and_rest(t.bars), gaps(t))


RELV = "SELECT ticker, date, volume / nullif(CASE WHEN count(volume) OVER w >= 10 THEN avg(volume) OVER w END, 0) AS rel_vol FROM d WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"


def relative(t):
    return W.relative_volume(t.bars.groupBy("ticker", F.to_date("ts").alias("date")).agg(F.sum("volume").alias("volume")))


@query("a28_relative_volume_by_bin", "bin# n mean~7 median~7", "bars", "SELECT bin, count(*) AS n, avg(rel_vol) AS mean, median(rel_vol) AS median FROM g JOIN rv USING (ticker, date) WHERE rel_vol IS NOT NULL GROUP BY bin", d=DAYBARS, g=GAPS, rv=RELV)
def _(t):
    return A.bin_stats(gaps(t).join(relative(t).filter("rel_vol is not null"), ["ticker", "date"]), "bin", "rel_vol")


@query("d12_directional_accuracy", "ticker n accuracy~9", "bars", "SELECT ticker, count(*) FILTER (u <> 0 AND s <> 0) AS n, count(*) FILTER (u = s AND u <> 0) / nullif(count(*) FILTER (u <> 0 AND s <> 0), 0) AS accuracy FROM (SELECT ticker, sign(first_ret) AS u, sign(c - o) AS s FROM f) GROUP BY ticker", f=FIRST)
def _(t):
    return B.directional_accuracy(B.first_and_rest(t.bars))


# Newton's steps of every ticker, until its coefficients stay
LOGIT = """WITH RECURSIVE m AS (SELECT 0 AS step, ticker, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b, false AS settled FROM (SELECT DISTINCT ticker FROM xy) UNION ALL
  SELECT step + 1, ticker, a + da, b + db, abs(da) <= 1e-8 * (1 + abs(a)) AND abs(db) <= 1e-8 * (1 + abs(b)) FROM (
    SELECT step, ticker, a, b, (s2 * g0 - s1 * g1) / (s0 * s2 - s1 * s1 + 1e-9) AS da, (s0 * g1 - s1 * g0) / (s0 * s2 - s1 * s1 + 1e-9) AS db FROM (
      SELECT step, ticker, a, b, sum(w) AS s0, sum(w * x) AS s1, sum(w * x * x) AS s2, sum(y - p) AS g0, sum((y - p) * x) AS g1 FROM (
        SELECT *, greatest(p * (1 - p), 1e-9) AS w FROM (SELECT m.*, x, y, 1 / (1 + exp(-(a + b * x))) AS p FROM m JOIN xy ON xy.ticker = m.ticker WHERE NOT settled AND step < 30)) GROUP BY ALL)))
SELECT ticker, arg_max(a, step) AS a, arg_max(b, step) AS b, arg_max(settled, step) AS settled FROM m GROUP BY ticker"""


@query("d16_continuation_model", "ticker n accuracy~6 settled", "bars", "SELECT ticker, count(*) AS n, avg(CAST((CASE WHEN a + b * x > 0 THEN 1 ELSE 0 END) = y AS DOUBLE)) AS accuracy, settled FROM xy JOIN lg USING (ticker) GROUP BY ALL", d=DAYBARS, f=FIRST, rv=RELV, xy="SELECT ticker, CAST(momentum AS DOUBLE) AS y, rel_vol AS x FROM f JOIN rv USING (ticker, date) WHERE momentum IS NOT NULL AND rel_vol IS NOT NULL", lg=LOGIT)
def _(t):
    x = B.first_and_rest(t.bars).join(relative(t), ["ticker", "date"]).withColumn("y", F.col("momentum").cast("double"))
    return B.continuation_model(x, key="ticker", x="rel_vol", y="y")


SIG = "SELECT *, (entry - stop) * dir AS risk FROM (SELECT ticker, date, CAST(sign(c1 - o1) AS INTEGER) AS dir, entry_ts, entry, CASE WHEN c1 > o1 THEN l1 ELSE h1 END AS stop FROM (SELECT ticker, date, max(open) FILTER (n = 1) AS o1, max(close) FILTER (n = 1) AS c1, max(high) FILTER (n = 1) AS h1, max(low) FILTER (n = 1) AS l1, max(open) FILTER (n = 2) AS entry, max(ts) FILTER (n = 2) AS entry_ts FROM (SELECT *, CAST(ts AS DATE) AS date, row_number() OVER (PARTITION BY ticker, CAST(ts AS DATE) ORDER BY ts) AS n FROM bars) WHERE n <= 2 GROUP BY ALL) WHERE c1 <> o1) WHERE (entry - stop) * dir > 0"
EXIT = "SELECT ticker, date, dir, entry, stop, risk, CASE WHEN sts IS NOT NULL THEN 'SL' ELSE 'TIME' END AS reason, coalesce(sts, lts) AS exit_ts, CASE WHEN sts IS NOT NULL THEN stop ELSE lclose END AS exit_px FROM (SELECT s.*, min(b.ts) FILTER (CASE WHEN dir > 0 THEN low <= stop ELSE high >= stop END) AS sts, max(b.ts) AS lts, arg_max(b.close, b.ts) AS lclose FROM sig s JOIN bars b ON b.ticker = s.ticker AND CAST(b.ts AS DATE) = s.date AND b.ts >= s.entry_ts GROUP BY ALL)"


@query("o1_breakout_signals", "ticker date dir# entry_ts entry stop risk~8", "bars", SIG)
def _(t):
    return B.signals(t.bars)


def done(t):
    return B.exits(B.signals(t.bars), t.bars)


@query("o2_breakout_exits", "ticker date reason exit_ts exit_px", "bars", EXIT, sig=SIG)
def _(t):
    return done(t).withColumnRenamed("exit", "exit_px")


@query("o3_fill_prices", "ticker date fill_in~8 fill_out~8", "bars", "SELECT ticker, date, entry + dir * 0.015 AS fill_in, exit_px - dir * 0.015 AS fill_out FROM ex", sig=SIG, ex=EXIT)
def _(t):
    return done(t).withColumn("fill_in", B.fill_price(F.col("entry"), F.col("dir"), True, spread=0.02, slip=0.005)).withColumn("fill_out", B.fill_price(F.col("exit"), F.col("dir"), False, spread=0.02, slip=0.005))


@query("o4_position_sizes", "ticker date shares#", "bars", "SELECT ticker, date, floor(least(25000 * 0.01 / risk, 25000 * 4.0 / entry)) AS shares FROM sig", sig=SIG)
def _(t):
    return B.signals(t.bars).withColumn("shares", B.position_size(F.lit(25000.0), F.col("risk"), F.col("entry")))


def grid(t):
    return t.spark.createDataFrame([(1, 0.005), (2, 0.01), (3, 0.02)], "param int, risk_share double")


# one step of the recursion is the next trade of every ticker and parameter
SIZED = """WITH RECURSIVE tr AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn FROM ex),
f AS (SELECT ticker, param, share, CAST(0 AS BIGINT) AS rn, CAST(NULL AS DATE) AS date, CAST(0 AS DOUBLE) AS shares, CAST(0 AS DOUBLE) AS pnl, CAST(25000 AS DOUBLE) AS before, CAST(25000 AS DOUBLE) AS after
  FROM (SELECT DISTINCT ticker FROM tr), (VALUES (1, 0.005::DOUBLE), (2, 0.01::DOUBLE), (3, 0.02::DOUBLE)) v(param, share) UNION ALL
  SELECT ticker, param, share, rn, date, n, n * (exit_px - entry) * dir - n * 0.0005 * 2, cap, cap + (n * (exit_px - entry) * dir - n * 0.0005 * 2) FROM (
    SELECT f.ticker, param, share, tr.rn, tr.date, exit_px, entry, dir, f.after AS cap, greatest(0, floor(least(f.after * share / risk, f.after * 4.0::DOUBLE / entry))) AS n FROM f JOIN tr ON tr.ticker = f.ticker AND tr.rn = f.rn + 1))
SELECT ticker, param, date, CAST(shares AS BIGINT) AS shares, pnl, before, after FROM f WHERE rn > 0 AND shares >= 1"""


@query("o5_sized_trade_log", "ticker param# date shares pnl~6 before~4 after~4", "bars", "SELECT * FROM sized", sig=SIG, ex=EXIT, sized=SIZED)
def _(t):
    return B.trade_log(done(t), grid(t))


@query("o6_parameter_grid", "ticker best# final~4 total_ret~8", "bars", "SELECT ticker, arg_max(param, row(final, param)) AS best, max(final) AS final, max(final) / 25000 - 1 AS total_ret FROM (SELECT ticker, param, arg_max(after, date) AS final FROM sized GROUP BY ALL) GROUP BY ticker", sig=SIG, ex=EXIT, sized=SIZED)
def _(t):
    return B.best_parameters(B.trade_log(done(t), grid(t)))


R_TRADES = "SELECT ticker, date, dir, (exit_px - entry) * dir / risk AS r, (exit_px - entry) * dir AS pnl FROM ex"


@query("d7_trade_summary", "ticker n wins losses pnl~5 profit_factor~7 mean_r~7 max_r~7 min_r~7", "bars", "SELECT ticker, count(*) AS n, count(*) FILTER (pnl > 0) AS wins, count(*) FILTER (pnl < 0) AS losses, sum(pnl) AS pnl, sum(pnl) FILTER (pnl > 0) / nullif(-sum(pnl) FILTER (pnl < 0), 0) AS profit_factor, avg(r) AS mean_r, max(r) AS max_r, min(r) AS min_r FROM tr GROUP BY ticker", sig=SIG, ex=EXIT, tr=R_TRADES)
def _(t):
    x = done(t).withColumn("net_pnl", (F.col("exit") - F.col("entry")) * F.col("dir")).withColumn("r_multiple", F.col("net_pnl") / F.col("risk"))
    return R.trade_summary(x, key="ticker")


@query("a29_monthly_trades", "ticker month n pnl~5", "bars", "SELECT ticker, CAST(date_trunc('month', date) AS DATE) AS month, count(*) AS n, sum(pnl) AS pnl FROM tr GROUP BY ALL", sig=SIG, ex=EXIT, tr=R_TRADES)
def _(t):
    x = done(t).withColumn("pnl", (F.col("exit") - F.col("entry")) * F.col("dir"))
    return x.groupBy("ticker", F.trunc("date", "MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("pnl"))


@query("o7_sub_periods", "asset window_no# pct~7", "levels", "SELECT asset, k AS window_no, 100 * (arg_max(level, date) / nullif(arg_min(level, date), 0) - 1) AS pct FROM range(20) w(k), (SELECT min(date) AS lo, max(date) AS hi FROM levels), levels WHERE date >= lo + CAST(floor(k * (date_diff('day', lo, hi) - 365) / 19) AS INTEGER) AND date < lo + CAST(floor(k * (date_diff('day', lo, hi) - 365) / 19) AS INTEGER) + 365 GROUP BY asset, k")
def _(t):
    span = t.levels.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    w = span.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("window_no")).withColumn("start", F.date_add("lo", F.floor(F.col("window_no") * (F.datediff("hi", "lo") - 365) / 19).cast("int")))
    return B.sub_periods(t.levels, w.select("window_no", "start", F.date_add("start", 365).alias("stop")), key="asset", value="level")


@query("d26_holding_times", "bucket# n r_p25~7 r_p50~7 r_p75~7 rpm~8", "bars", "SELECT 60 * (m // 60) AS bucket, count(*) AS n, quantile_cont(r, 0.25) AS r_p25, quantile_cont(r, 0.5) AS r_p50, quantile_cont(r, 0.75) AS r_p75, median(r / nullif(m, 0)) AS rpm FROM (SELECT date_diff('minute', entry_ts, ts) AS m, (close - entry) * dir / risk AS r FROM sig s JOIN bars b ON b.ticker = s.ticker AND CAST(b.ts AS DATE) = s.date AND b.ts > entry_ts) GROUP BY ALL", sig=SIG)
def _(t):
    return B.holding_buckets(B.holding_times(B.signals(t.bars), t.bars))


@query("j12_curve_alignment", "ticker date c gap~8", "bars", "SELECT f.ticker, f.date, f.c, gap FROM f LEFT JOIN g ON f.ticker = g.ticker AND f.date = g.date", d=DAYBARS, g=GAPS, f=FIRST)
def _(t):
    return B.first_and_rest(t.bars).join(gaps(t).select("ticker", "date", "gap"), ["ticker", "date"], "left")


@query("j13_first_last_bar", "ticker date o c1 c", "bars", FIRST)
def _(t):
    return B.first_and_rest(t.bars)


ONE = "SELECT h.* FROM holdings h JOIN (SELECT report_date, investor, max(filing) AS filing FROM holdings GROUP BY ALL) USING (report_date, investor, filing)"
PAIRS = "SELECT report_date, investor, asset, sum(value) AS value FROM one WHERE value > 0 GROUP BY ALL"
ROUND = "SELECT * FROM (SELECT * FROM {p} WHERE (report_date, investor) IN (SELECT (report_date, investor) FROM {p} GROUP BY report_date, investor HAVING count(DISTINCT asset) >= 3)) x WHERE (report_date, asset) IN (SELECT (report_date, asset) FROM (SELECT * FROM {p} WHERE (report_date, investor) IN (SELECT (report_date, investor) FROM {p} GROUP BY report_date, investor HAVING count(DISTINCT asset) >= 3)) GROUP BY report_date, asset HAVING count(DISTINCT investor) >= 2)"
# rounds until one removes nothing or all; of the last one's rows, one more round leaves what stays
LAST = """WITH RECURSIVE k AS (SELECT 0 AS step, * FROM r0 UNION ALL
  SELECT step + 1, report_date, investor, asset, value FROM (SELECT *, count(*) OVER () AS after FROM (SELECT *, count(*) OVER (PARTITION BY report_date, asset) AS ca FROM (
    SELECT *, count(*) OVER (PARTITION BY report_date, investor) AS ci, count(*) OVER () AS before FROM k) WHERE ci >= 3) WHERE ca >= 2) WHERE after < before)
SELECT report_date, investor, asset, value FROM k WHERE step = (SELECT max(step) FROM k)"""
ROUNDS = {"one": ONE, "r0": PAIRS, "last": LAST, "stays": ROUND.format(p="last")}


def pairs(t):
    return A.pair_values(holdings.one_filing(t.holdings).filter("value > 0"), ["report_date", "investor", "asset"], "value")


@query("p18_degree_filter", "report_date investor asset value~2", "holdings", "SELECT * FROM stays", **ROUNDS)
def _(t):
    return holdings.degree_filter(pairs(t), least_assets=3, least_investors=2)[0]


SUMMARY = "SELECT * FROM (SELECT report_date, count(*) AS pairs FROM stays GROUP BY ALL) JOIN (SELECT report_date, count(*) AS investors, median(d) AS investor_degree FROM (SELECT report_date, investor, count(DISTINCT asset) AS d FROM stays GROUP BY ALL) GROUP BY ALL) USING (report_date) JOIN (SELECT report_date, count(*) AS assets, median(d) AS asset_degree FROM (SELECT report_date, asset, count(DISTINCT investor) AS d FROM stays GROUP BY ALL) GROUP BY ALL) USING (report_date)"


@query("a34_p19_matrix_readiness", "report_date pairs investors assets investor_degree asset_degree density_pct~7", "holdings", f"SELECT *, 100.0 * pairs / (investors * assets) AS density_pct FROM ({SUMMARY})", **ROUNDS)
def _(t):
    return holdings.matrix_readiness(holdings.one_filing(t.holdings), holdings.HoldingsSpec(), least_assets=3, least_investors=2)[0]


@query("a36_stage_audit", "stage name rows removed", "holdings", "SELECT stage, name, rows, coalesce(lag(rows) OVER (ORDER BY stage) - rows, 0) AS removed FROM (SELECT 0 AS stage, 'input' AS name, count(*) AS rows FROM one UNION ALL SELECT 1, 'investor', count(*) FILTER (investor IS NOT NULL) FROM one UNION ALL SELECT 2, 'asset', count(*) FILTER (asset IS NOT NULL) FROM one UNION ALL SELECT 3, 'value', count(*) FILTER (value IS NOT NULL) FROM one UNION ALL SELECT 4, 'positive', count(*) FILTER (value > 0) FROM one UNION ALL SELECT 5, 'category', count(*) FILTER (value > 0 AND category = 'F') FROM one)", one=ONE)
def _(t):
    from finpanel.operators.universe import cascade_audit

    spec = holdings.HoldingsSpec(category="category")
    return cascade_audit(holdings.one_filing(t.holdings), holdings.readiness_stages(t.holdings, spec, categories=["F"]))


@query("p20_diversified", "report_date investor asset filing ordinal top_share~9", "holdings", "SELECT * FROM (SELECT *, max(value) OVER w / nullif(sum(value) OVER w, 0) AS top_share FROM holdings WHERE value > 0 WINDOW w AS (PARTITION BY report_date, investor)) WHERE top_share <= 0.75")
def _(t):
    return holdings.diversified(t.holdings.filter("value > 0"))


@query("p21_available", "decision_at investor asset filing available_at", "holdings", "SELECT decision_at, investor, asset, filing, available_at FROM (SELECT *, row_number() OVER (PARTITION BY decision_at, investor, asset ORDER BY available_at DESC, filing DESC, ordinal DESC, value DESC) AS rn FROM holdings JOIN (VALUES (DATE '1996-06-30'), (DATE '1998-12-31')) d(decision_at) ON available_at <= decision_at) WHERE rn = 1")
def _(t):
    d = t.spark.createDataFrame([("1996-06-30",), ("1998-12-31",)], "d string").select(F.col("d").cast("date").alias("decision_at"))
    return holdings.available_at(t.holdings, d, ["investor", "asset"])
