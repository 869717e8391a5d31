"""Panels, universe and features over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from finpanel.functions import blank_to_null, month_index, percent_rank_average, safe_div
from finpanel.operators import features, joins, panel, universe
from finpanel.plans.catalog import query

WM = "WINDOW w AS (PARTITION BY assetid ORDER BY ym)"
STATE = """SELECT s.*, market_days, zero_days / nullif(market_days, 0) AS zero_share, (high - low) / nullif(last_price, 0) AS range_hl,
  (last_price - low) / nullif(high - low, 0) AS close_pos, last_price / nullif(high, 0) - 1 AS dist_high, last_price / nullif(low, 0) - 1 AS dist_low
FROM (SELECT assetid, ym, arg_max(close, date) AS last_price, min(close) AS min_price, median(close) AS median_price, count(*) FILTER (close > 0) AS valid_days, count(*) FILTER (volume > 0) AS traded_days,
  count(*) FILTER (volume = 0) AS zero_days, median(turnover) AS median_turnover, avg(turnover) AS mean_turnover, max(dret) AS max_ret, min(dret) AS min_ret, stddev_samp(dret) AS vol,
  stddev_samp(dret) FILTER (dret < 0) AS down_vol, max(high) AS high, min(low) AS low
  FROM (SELECT *, close / nullif(lag(close) OVER (PARTITION BY assetid ORDER BY date), 0) - 1 AS dret, year(date) * 12 + month(date) AS ym FROM daily) GROUP BY ALL) s
JOIN (SELECT year(date) * 12 + month(date) AS ym, count(DISTINCT date) AS market_days FROM daily GROUP BY ALL) USING (ym)"""


@query("a1_monthly_rollup", "assetid ym# open high low close volume~2 turnover~2 date n_obs", "monthly0", "SELECT * FROM monthly0")
def _(t):
    return panel.to_monthly(t.daily)


@query("a2_carried_metadata", "assetid volume turnover~2", "daily", "SELECT assetid, arg_max(volume, date) AS volume, arg_max(turnover, date) AS turnover FROM daily GROUP BY ALL")
def _(t):
    return panel.carry_metadata(t.daily, ["volume", "turnover"])


@query("a3_monthly_state", "assetid ym# last_price min_price median_price valid_days traded_days zero_days median_turnover~6 mean_turnover~6 max_ret~8 min_ret~8 vol~8 down_vol~8 market_days", "daily", STATE)
def _(t):
    return panel.monthly_state(t.daily)


@query("a4_market_days", "ym# market_days", "daily", "SELECT year(date) * 12 + month(date) AS ym, count(DISTINCT date) AS market_days FROM daily GROUP BY ALL")
def _(t):
    return panel.market_days(t.daily)


@query("a5_state_ratios", "assetid ym# zero_share~8 range_hl~8 close_pos~8 dist_high~8 dist_low~8", "daily", STATE)
def _(t):
    return panel.monthly_state(t.daily)


@query("a8_quarter_end", "asset quarter_end level~2", "levels", "SELECT asset, CAST(q + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS quarter_end, level FROM (SELECT asset, date_trunc('quarter', date) AS q, arg_max(level, date) AS level FROM levels GROUP BY ALL)")
def _(t):
    return panel.quarter_end(t.levels, key="asset", value="level")


@query("w1_w3_monthly_returns", "assetid ym# ret~9 volume_prev turnover_prev~2", "monthly", "SELECT * FROM monthly")
def _(t):
    return t.monthly


@query("w2_log_return", "asset date log_ret~9", "levels", "SELECT asset, date, ln(level) - ln(lag(level) OVER (PARTITION BY asset ORDER BY date)) AS log_ret FROM levels")
def _(t):
    return panel.log_return(t.levels, key="asset", by="date", price="level")


@query("w4_horizon_return", "asset date ret_21~9", "levels", "SELECT asset, date, level / nullif(lag(level, 21) OVER (PARTITION BY asset ORDER BY date), 0) - 1 AS ret_21 FROM levels")
def _(t):
    return panel.horizon_return(t.levels, 21, key="asset", by="date", price="level")


@query("j1_metadata_join", "assetid ym# close symbol exchange_name is_operating_company", "monthly meta", "SELECT * FROM monthly LEFT JOIN meta USING (assetid)")
def _(t):
    return panel.attach_metadata(t.monthly, t.meta)


@query("j2_state_join", "assetid ym# ret~9 mean_turnover~6", "monthly", "SELECT monthly.*, mean_turnover FROM monthly LEFT JOIN (SELECT assetid, year(date) * 12 + month(date) AS ym, avg(turnover) AS mean_turnover FROM daily GROUP BY ALL) USING (assetid, ym)")
def _(t):
    return t.monthly.join(panel.monthly_state(t.daily).select("assetid", "ym", "mean_turnover"), ["assetid", "ym"], "left")


@query("f1_first_observation", "assetid ym# ret~9", "monthly", "SELECT * FROM monthly WHERE ret IS NOT NULL")
def _(t):
    return universe.drop_first(t.monthly)


@query("f2_stale_filter", "assetid ym# close", "monthly", "SELECT * FROM monthly WHERE NOT (coalesce(volume, 0) <= 60 AND coalesce(volume_prev, 0) <= 60 AND abs(coalesce(ret, 0)) < 0.5)")
def _(t):
    """Volumes of up to 60 count as none here: the given tables have no empty months."""
    z = lambda c: F.when(F.col(c) > 60, F.col(c)).otherwise(0.0)
    return t.monthly.filter(~universe.is_stale(z("volume"), z("volume_prev"), F.when(F.abs("ret") >= 0.5, F.col("ret")).otherwise(0.0)))


@query("f3_whitelist", "assetid symbol exchange_name", "meta", "SELECT * FROM meta WHERE is_operating_company AND exchange_name IN ('NATION_1', 'FRANCE', 'CHINA', 'JAPAN', 'GERMANY', 'CANADA', 'BRAZIL') OR is_operating_company AND exchange_name LIKE '%1%'")
def _(t):
    return universe.whitelist(t.meta, flag="is_operating_company", keep=F.col("exchange_name").isin("NATION_1", "FRANCE", "CHINA", "JAPAN", "GERMANY", "CANADA", "BRAZIL") | F.col("exchange_name").contains("1"))


def stages():
    return [("returns", F.col("ret").isNotNull()), ("price", F.col("close") > 1200), ("volume", F.col("volume") > 100), ("operating", F.col("is_operating_company"))]
CASCADE = ["true", "ret IS NOT NULL", "close > 1200", "volume > 100", "is_operating_company"]


@query("f4_cascade", "assetid ym# close", "monthly meta", f"SELECT * FROM monthly LEFT JOIN meta USING (assetid) WHERE {' AND '.join(CASCADE)}")
def _(t):
    return universe.cascade(panel.attach_metadata(t.monthly, t.meta), stages())


@query(
    "f4_cascade_audit", "stage name rows removed", "monthly meta",
    "SELECT stage, name, rows, coalesce(lag(rows) OVER (ORDER BY stage) - rows, 0) AS removed FROM (" + " UNION ALL ".join(f"SELECT {i} AS stage, '{n}' AS name, count(*) FILTER ({' AND '.join(CASCADE[: i + 1])}) AS rows FROM m" for i, n in enumerate(["input", "returns", "price", "volume", "operating"])) + ")",
    m="SELECT * FROM monthly LEFT JOIN meta USING (assetid)",
)
def _(t):
    return universe.cascade_audit(panel.attach_metadata(t.monthly, t.meta), stages())


@query("f6_completeness", "filled blank", "", "SELECT count(*) FILTER (nullif(trim(source), '') IS NOT NULL) AS filled, count(*) FILTER (nullif(trim(source), '') IS NULL) AS blank FROM documents")
def _(t):
    v = blank_to_null(F.col("source"))
    return t.raw("documents").agg(F.count(v).alias("filled"), F.count_if(v.isNull()).alias("blank"))


@query("f7_complete_rows", "asset date level~2", "levels", "SELECT * FROM levels WHERE date IN (SELECT date FROM levels WHERE level > 0 GROUP BY date HAVING count(DISTINCT asset) = (SELECT count(DISTINCT asset) FROM levels))")
def _(t):
    return universe.complete_rows(universe.positive_only(t.levels))


@query("f7_complete_columns", "assetid ym# close", "monthly0", "SELECT * FROM monthly0 WHERE assetid IN (SELECT assetid FROM monthly0 WHERE close > 0 GROUP BY assetid HAVING count(DISTINCT ym) = (SELECT count(DISTINCT ym) FROM monthly0))")
def _(t):
    return universe.complete_columns(universe.positive_only(panel.to_monthly(t.daily), value="close"), key="assetid", by="ym", value="close")


@query("f8_safe_division", "assetid ym# ratio~12", "monthly", "SELECT assetid, ym, ret / nullif(volume_prev, 0) AS ratio FROM monthly")
def _(t):
    return t.monthly.withColumn("ratio", safe_div(F.col("ret"), F.col("volume_prev")))


TRADABLE = """SELECT *, coalesce(min_price >= 900 AND turnover_rank >= 0.2 AND zero_share <= 0.2, false) AS is_tradable FROM (SELECT *,
  mean_turnover / nullif(CASE WHEN count(mean_turnover) OVER w3 >= 2 THEN avg(mean_turnover) OVER w3 END, 0) AS turnover_ratio_3,
  mean_turnover / nullif(CASE WHEN count(mean_turnover) OVER w12 >= 6 THEN avg(mean_turnover) OVER w12 END, 0) AS turnover_ratio_12,
  (rank() OVER (PARTITION BY ym ORDER BY median_turnover) + (count(*) OVER (PARTITION BY ym, median_turnover) - 1) / 2) / count(median_turnover) OVER (PARTITION BY ym) AS turnover_rank
  FROM state WINDOW w3 AS (PARTITION BY assetid ORDER BY ym ROWS 2 PRECEDING), w12 AS (PARTITION BY assetid ORDER BY ym ROWS 11 PRECEDING))"""


@query("f9_tradability", "assetid ym# turnover_ratio_3~8 turnover_ratio_12~8 turnover_rank~8 is_tradable", "daily", TRADABLE, state=STATE)
def _(t):
    return universe.tradability(panel.monthly_state(t.daily), min_price=900.0, full_month=False)


@query("f10_last_years", "assetid date close", "daily", "SELECT * FROM daily WHERE date >= (SELECT max(date) FROM daily) - INTERVAL 24 MONTH")
def _(t):
    return universe.last_years(t.daily, 24)


@query("f11_trimmed", "asset date ret~9", "returns", "SELECT * FROM returns WHERE ret BETWEEN (SELECT quantile_cont(ret, 0.025) FROM returns) AND (SELECT quantile_cont(ret, 0.975) FROM returns)")
def _(t):
    return universe.trim_extremes(t.returns, "ret")


@query("f12_train_test", "asset part n first last", "returns", "SELECT asset, part, count(*) AS n, min(date) AS first, max(date) AS last FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY asset ORDER BY date DESC) <= 60 THEN 'test' ELSE 'train' END AS part FROM returns) GROUP BY ALL")
def _(t):
    return universe.split_last(t.returns, 60, key="asset", by="date").groupBy("asset", "part").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


@query("w5_momentum", "assetid ym# mom_1~9 mom_3~9 mom_6~9 mom_12~9", "features", "SELECT * FROM features")
def _(t):
    return features.momentum(t.monthly)


@query("w6_forward_return", "assetid ym# fwd~9", "features", "SELECT * FROM features")
def _(t):
    return features.forward_return(t.monthly)


@query("w7_z_score", "assetid ym# mom_6_z~7", "features", "SELECT assetid, ym, (mom_6 - avg(mom_6) OVER w) / nullif(stddev_samp(mom_6) OVER w, 0) AS mom_6_z FROM features WINDOW w AS (PARTITION BY ym)")
def _(t):
    return features.z_score(t.features, "mom_6")


# edges between the sorted values l of a month, as many bins as values below ten
EDGES = "SELECT *, [l[CAST(floor(p) AS BIGINT) + 1] + (p - floor(p)) * (l[CAST(ceil(p) AS BIGINT) + 1] - l[CAST(floor(p) AS BIGINT) + 1]) for p in [(len(l) - 1) * i / k for i in range(0, k + 1)]] AS e FROM (SELECT ym, list({c} ORDER BY {c}) AS l, CAST(least(10, count(*)) AS BIGINT) AS k FROM features WHERE {c} IS NOT NULL GROUP BY ym)"
BUCKET = "SELECT assetid, ym, CASE WHEN {c} IS NULL THEN NULL WHEN len(list_distinct(e)) >= 2 THEN CAST(1 + len([v for v in list_distinct(e) if v > list_min(e) AND v < list_max(e) AND v < {c}]) AS INTEGER) WHEN k = 1 THEN 1 END AS {n} FROM features LEFT JOIN (" + EDGES + ") USING (ym)"


@query("w8_bucket", "assetid ym# mom_3_bucket", "features", BUCKET.format(c="mom_3", n="mom_3_bucket"))
def _(t):
    return features.bucket(t.features, "mom_3")


@query("w9_percent_rank", "assetid ym# prank~9", "monthly", "SELECT assetid, ym, CASE WHEN volume_prev IS NOT NULL THEN (rank() OVER (PARTITION BY ym ORDER BY volume_prev NULLS LAST) + (count(*) OVER (PARTITION BY ym, volume_prev) - 1) / 2) / count(volume_prev) OVER (PARTITION BY ym) END AS prank FROM monthly")
def _(t):
    return t.monthly.withColumn("prank", percent_rank_average(F.col("volume_prev"), "ym"))


@query("w10_rolling_ratio", "assetid ym# ratio~8", "monthly", "SELECT assetid, ym, turnover / nullif(CASE WHEN count(turnover) OVER w >= 6 THEN avg(turnover) OVER w END, 0) AS ratio FROM monthly WINDOW w AS (PARTITION BY assetid ORDER BY ym ROWS 11 PRECEDING)")
def _(t):
    return universe.rolling_ratio(t.monthly, "turnover", 12, 6, name="ratio")


# turnover in cents as decimals, so that ratios on the bar are equal to it whatever the order of the sums
@query("w11_liquidity_bottom", "assetid ym# ratio~8", "trades", "SELECT assetid, ym, ratio FROM r JOIN (SELECT ym, quantile_cont(ratio, 0.1) AS bar FROM r GROUP BY ym) USING (ym) WHERE ratio >= bar", cents="SELECT assetid, year(date) * 12 + month(date) AS ym, coalesce(sum(CAST(notional AS DECIMAL(18, 2))), 0) AS turnover FROM trades GROUP BY ALL", r="SELECT assetid, ym, CAST(turnover AS DOUBLE) / nullif(CASE WHEN count(turnover) OVER w >= 6 THEN CAST(sum(turnover) OVER w AS DOUBLE) / count(turnover) OVER w END, 0) AS ratio FROM cents WINDOW w AS (PARTITION BY assetid ORDER BY ym ROWS 11 PRECEDING)")
def _(t):
    cents = t.trades.groupBy("assetid", month_index(F.col("date")).alias("ym")).agg(F.coalesce(F.sum(F.col("notional").cast("decimal(18,2)")), F.lit(0)).alias("turnover"))
    return universe.liquidity_bottom(cents, 0.1)


@query("p17_feature_table", "assetid ym# mom_1~9 mom_3_z~7 mom_6_z~7 mom_12_z~7 label", "features", "SELECT f.*, label FROM (SELECT *, " + ", ".join(f"(mom_{m} - avg(mom_{m}) OVER w) / nullif(stddev_samp(mom_{m}) OVER w, 0) AS mom_{m}_z" for m in (3, 6, 12)) + " FROM features WINDOW w AS (PARTITION BY ym)) f JOIN b USING (assetid, ym)", b=BUCKET.format(c="fwd", n="label"))
def _(t):
    return features.build_features(t.monthly)


@query("j3_pit_membership", "assetid ym# close", "monthly membership", "SELECT * FROM monthly m WHERE EXISTS (SELECT 1 FROM membership i WHERE i.assetid = m.assetid AND m.ym BETWEEN year(start_date) * 12 + month(start_date) AND year(end_date) * 12 + month(end_date))")
def _(t):
    return universe.members(t.monthly, t.membership)


@query("j4_members_on", "assetid", "membership", "SELECT DISTINCT assetid FROM membership WHERE start_date <= DATE '1995-06-30' AND end_date >= DATE '1995-06-30'")
def _(t):
    return universe.members_on(t.membership, "1995-06-30")


@query("j5_resolved_keys", "symbol assetid", "meta", "SELECT s_name AS symbol, m.assetid FROM supplier LEFT JOIN (SELECT * FROM meta WHERE is_operating_company) m ON s_name = symbol")
def _(t):
    known = t.meta.filter("is_operating_company").select("symbol", "assetid")
    return universe.resolve_keys(t.raw("supplier").select(F.col("s_name").alias("symbol")), known, "symbol")


@query("j5_unresolved_audit", "symbol rows", "meta", "SELECT s_name AS symbol, count(*) AS rows FROM supplier WHERE s_name NOT IN (SELECT symbol FROM meta WHERE is_operating_company) GROUP BY ALL")
def _(t):
    return universe.unresolved(t.raw("supplier").select(F.col("s_name").alias("symbol")), t.meta.filter("is_operating_company").select("symbol"), "symbol")


EXEC = "SELECT s.date, c.date AS exec_date FROM (SELECT DISTINCT date FROM monthly0) s LEFT JOIN calendar c ON c.ordinal = (SELECT count(*) FROM calendar k WHERE k.date <= s.date) + 1"


@query("j6_execution_dates", "date exec_date", "monthly0 calendar", EXEC)
def _(t):
    return joins.execution_dates(panel.to_monthly(t.daily), t.calendar)


@query("j7_price_lookup", "assetid ym# date px", "monthly0 calendar", "SELECT m.assetid, m.ym, m.date, d.close AS px FROM monthly0 m LEFT JOIN x USING (date) LEFT JOIN daily d ON d.assetid = m.assetid AND d.date = x.exec_date", x=EXEC)
def _(t):
    m = panel.to_monthly(t.daily)
    return joins.price_at(m.join(joins.execution_dates(m, t.calendar), "date"), t.daily, by="exec_date", name="px")


@query("j8_entry_exit", "assetid ym# entry_px exit_px", "monthly0", "SELECT a.assetid, a.ym, a.close AS entry_px, b.close AS exit_px FROM monthly0 a JOIN (SELECT ym, lead(ym) OVER (ORDER BY ym) AS nx FROM (SELECT DISTINCT ym FROM monthly0)) c ON a.ym = c.ym LEFT JOIN monthly0 b ON b.assetid = a.assetid AND b.ym = c.nx")
def _(t):
    m = panel.to_monthly(t.daily)
    return joins.entry_exit_prices(m.select("assetid", "ym"), m)


@query("j9_inner_alignment", "date a b", "levels", "SELECT x.date, x.level AS a, y.level AS b FROM levels x JOIN levels y ON x.date = y.date AND x.asset = '1-URGENT' AND y.asset = '2-HIGH'")
def _(t):
    one = lambda a, n: t.levels.filter(F.col("asset") == a).select("date", F.col("level").alias(n))
    return joins.align_inner(one("1-URGENT", "a"), one("2-HIGH", "b"))


@query("j10_outer_filled", "date a~2 b~2", "levels", "SELECT * FROM (SELECT date, last_value(a IGNORE NULLS) OVER w AS a, last_value(b IGNORE NULLS) OVER w AS b FROM (SELECT date, level AS a FROM levels WHERE asset = '1-URGENT') x FULL JOIN (SELECT date, level AS b FROM levels WHERE asset = '2-HIGH') y USING (date) WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)) WHERE a IS NOT NULL AND b IS NOT NULL")
def _(t):
    one = lambda a, n: t.levels.filter(F.col("asset") == a).select("date", F.col("level").alias(n))
    return joins.align_outer_filled(one("1-URGENT", "a"), one("2-HIGH", "b"), ["a", "b"])


@query("j11_as_of", "assetid date level_asof~2", "daily market", "SELECT d.assetid, d.date, m.level AS level_asof FROM daily d ASOF LEFT JOIN market m ON d.date >= m.date")
def _(t):
    return joins.as_of(t.daily.select("assetid", "date"), t.market, "level")


@query("j14_reconcile", "n_rows ok", "daily monthly0", "SELECT count(*) AS n_rows, coalesce(max(abs(turnover - s)) <= 0.01, true) AS ok FROM monthly0 JOIN (SELECT assetid, year(date) * 12 + month(date) AS ym, sum(turnover) AS s FROM daily GROUP BY ALL) USING (assetid, ym)")
def _(t):
    m = panel.to_monthly(t.daily)
    again = t.trades.groupBy("assetid", (F.year("date") * 12 + F.month("date")).alias("ym")).agg(F.sum("notional").alias("s"))
    return joins.reconcile(m, again, ["assetid", "ym"], "turnover", "s", 0.01)


@query("j16_history_range", "train_ym# n ret_sum~6", "monthly", "SELECT train_ym, count(*) AS n, sum(ret) AS ret_sum FROM (SELECT DISTINCT ym AS train_ym FROM monthly WHERE ym % 12 = 0) JOIN monthly ON ym >= train_ym - 24 AND ym < train_ym GROUP BY ALL")
def _(t):
    schedule = t.monthly.select(F.col("ym").alias("train_ym")).filter("train_ym % 12 = 0").distinct()
    return joins.history(schedule, t.monthly, 24).groupBy("train_ym").agg(F.count(F.lit(1)).alias("n"), F.sum("ret").alias("ret_sum"))
