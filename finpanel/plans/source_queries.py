"""Sources and sinks over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from finpanel.functions import month_index, over, safe_div
from finpanel.operators import panel
from finpanel.operators.reshape import to_wide
from finpanel.operators.stages import fresh_path
from finpanel.plans.catalog import query
from finpanel.sources import files as S

NAMES = "SELECT s_suppkey || '_' || replace(s_name, '#', '.') || CASE WHEN s_suppkey % 3 = 0 THEN '-199906.ca' ELSE '' END || '.csv' AS f, s_suppkey, s_name FROM supplier"


@query("s2_file_names", "assetid symbol is_delisted delist_ym#", "", "SELECT s_suppkey AS assetid, regexp_replace(replace(s_name, '#', '.'), '\\.[a-z]+$', '') AS symbol, s_suppkey % 3 = 0 AS is_delisted, CASE WHEN s_suppkey % 3 = 0 THEN 1999 * 12 + 6 END AS delist_ym FROM names", names=NAMES)
def _(t):
    s = t.raw("supplier")
    f = F.concat(F.col("s_suppkey").cast("string"), F.lit("_"), F.translate("s_name", "#", "."), F.when(F.col("s_suppkey") % 3 == 0, F.lit("-199906.ca")).otherwise(F.lit("")), F.lit(".csv"))
    return s.withColumn("f", f).select(*[c.alias(n) for n, c in S.parse_file_name(F.col("f")).items()])


@query("s3_renamed_columns", "assetid symbol balance", "", "SELECT s_suppkey AS assetid, s_name AS symbol, s_acctbal AS balance FROM supplier")
def _(t):
    return S.rename_columns(t.raw("supplier"), {"s_suppkey": "AssetID", "s_name": "Symbol", "s_acctbal": "Balance"}, ["assetid", "symbol", "balance"])


@query("s5_pruned_scan", "l_suppkey n", "", "SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' GROUP BY l_suppkey")
def _(t):
    return S.read_stage(t.spark, f"{t.sf_dir}/lineitem.parquet", "l_suppkey", "l_shipdate").filter("l_shipdate >= timestamp '1997-01-01'").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("s6_index_intervals", "index_name assetid start_date end_date", "membership", "SELECT * FROM membership WHERE index_name = 'IDX'")
def _(t):
    return t.membership.filter("index_name = 'IDX'")


@query("s11_wide_prices", "date asset level~2", "levels", "SELECT date, CASE asset WHEN '1-URGENT' THEN 'urgent' ELSE 'high' END AS asset, level FROM (SELECT * FROM (SELECT DISTINCT date FROM levels) CROSS JOIN (VALUES ('1-URGENT'), ('2-HIGH')) v(asset)) LEFT JOIN levels USING (date, asset)")
def _(t):
    wide = to_wide(t.levels, "date", "asset", "level", {"1-URGENT": "urgent", "2-HIGH": "high"})
    return S.wide_prices(wide, ["urgent", "high", "absent"])


@query("s7_json_props", "event_type n k_sum#", "", "SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS k_sum FROM events GROUP BY event_type")
def _(t):
    e = t.raw("events").select("event_type", F.from_json("props", "k int").alias("p"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p.k").alias("k_sum"))


def _written(t, df, name: str) -> str:
    """A new folder below the one that all machines share, with a CSV copy of ``df``."""
    path = fresh_path(t.spark, name)
    S.write_csv(df, path)
    return path


PRICES = "SELECT l_suppkey AS assetid, CAST(l_shipdate AS DATE) AS date, sum(l_extendedprice) AS turnover, sum(l_quantity) AS volume FROM lineitem GROUP BY ALL"


@query("s1_csv_panel", "is_delisted rows# days# volume~2 turnover~2", "", "SELECT assetid % 3 = 0 AS is_delisted, count(*) AS rows, count(DISTINCT date) AS days, sum(volume) AS volume, sum(turnover) AS turnover FROM p GROUP BY ALL", p=PRICES)
def _(t):
    """The given trades as two folders of bar files, read back as one panel."""
    day = t.raw("lineitem").groupBy(F.col("l_suppkey").alias("assetid"), F.col("l_shipdate").cast("date").alias("date")).agg(F.sum("l_extendedprice").alias("turnover"), F.sum("l_quantity").alias("volume"))
    bars = day.select("assetid", *[F.col(c) if c in ("date", "volume", "turnover") else F.lit(None).cast("double").alias(c) for c in S.BARS.names])
    listed, gone = (_written(t, bars.filter(f"assetid % 3 {op} 0").drop("assetid"), name) for op, name in (("<>", "listed"), ("=", "delisted")))
    return S.csv_panel(t.spark, listed, gone).groupBy("is_delisted").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("date").alias("days"), F.sum("volume").alias("volume"), F.sum("turnover").alias("turnover"))


@query("s12_fx_series", "date pair currency close~6", "market", "SELECT date, 'EURUSD' AS pair, 'USD' AS currency, mean_price AS close FROM market")
def _(t):
    """The daily mean price as a currency pair's file."""
    m = t.market.select("date", *[F.col("mean_price").alias(c) for c in ("open", "high", "low", "close")])
    return S.fx_series(t.spark, _written(t, m, "fx"), "EURUSD")


@query("s8_csv_sink", "assetid date turnover volume", "", "SELECT l_suppkey AS assetid, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS turnover, l_quantity AS volume FROM lineitem")
def _(t):
    """All trades written as CSV and read back."""
    path = _written(t, t.raw("lineitem").select(F.col("l_suppkey").alias("assetid"), F.col("l_shipdate").cast("date").alias("date"), F.col("l_extendedprice").cast("double").alias("turnover"), F.col("l_quantity").cast("double").alias("volume")), "sink")
    return t.spark.read.schema("assetid long, date date, turnover double, volume double").option("header", True).csv(path)


@query("s9_manifest_audit", "status files# bytes#", "", "SELECT CASE WHEN b % 7 = 0 THEN 'unsafe' WHEN b % 5 = 0 THEN 'missing' WHEN b % 3 = 0 THEN 'size' ELSE 'ok' END AS status, count(*) AS files, sum(bytes) AS bytes FROM (SELECT page_id % 64 AS b, sum(coalesce(strlen(html), 0) + 1) AS bytes FROM pages GROUP BY ALL) GROUP BY ALL")
def _(t):
    """All pages as text files in 64 folders; a manifest with sizes from the table, and paths as listed but for those that it gets wrong on purpose; and the folder's own listing."""
    path = fresh_path(t.spark, "pages")
    p = t.raw("pages").select(F.pmod("page_id", F.lit(64)).cast("int").alias("b"), F.coalesce("html", F.lit("")).alias("html"))
    p.repartition("b").write.partitionBy("b").text(path)
    listed = S.listed_files(t.spark, path)
    bucket = F.regexp_extract("relative_path", "^b=([0-9]+)/", 1).cast("int")
    real = listed.select(bucket.alias("b"), "relative_path")
    sizes = p.groupBy("b").agg(F.sum(F.octet_length("html") + 1).alias("bytes")).join(real, "b")
    given = F.when(F.col("b") % 7 == 0, F.concat(F.lit("../"), "relative_path")).when(F.col("b") % 5 == 0, F.concat("relative_path", F.lit(".gone"))).otherwise(F.col("relative_path"))
    wrong = (F.col("b") % 3 == 0) & (F.col("b") % 5 != 0) & (F.col("b") % 7 != 0)
    entry = F.struct(F.lit("pages").alias("table"), given.alias("relative_path"), (F.col("bytes") + wrong.cast("long")).alias("bytes"))
    audit = S.manifest_audit(sizes.select(F.array(entry).alias("table_files")), listed)
    return audit.groupBy("status").agg(F.count(F.lit(1)).alias("files"), F.sum(F.col("bytes") - (F.col("status") == "size").cast("long")).alias("bytes"))


PANEL = "SELECT m.assetid, m.ym, m.open, m.close, m.n_obs, m.ret, s.traded, s.drop_ FROM monthly m JOIN (SELECT assetid, year(date) * 12 + month(date) AS ym, count(*) FILTER (volume > 0) AS traded, min(dret) AS drop_ FROM (SELECT *, close / lag(close) OVER (PARTITION BY assetid ORDER BY date) - 1 AS dret FROM daily) GROUP BY ALL) s USING (assetid, ym)"


@query("s5_bucketed_panel", "assetid ym# open~6 close~6 n_obs ret~8 traded drop_~8", "monthly daily", PANEL)
def _(t):
    """The daily bars written once in buckets; roll-up, state, returns and their join read them without an exchange."""
    path = fresh_path(t.spark, "bars")
    return bucketed_panel(S.write_bucketed(t.daily, f"bars_{path.rpartition('-')[2]}", path, key="assetid", by="date", buckets=16))


def bucketed_panel(daily):
    """Monthly bars and returns with days traded and the worst daily return."""
    day = daily.withColumn("dret", safe_div(F.col("close"), F.lag("close").over(over("assetid", by="date"))) - 1).withColumn("ym", month_index(F.col("date")))
    state = day.groupBy("assetid", "ym").agg(F.count_if(F.col("volume") > 0).alias("traded"), F.min("dret").alias("drop_"))
    return panel.with_returns(panel.to_monthly(daily)).join(state, ["assetid", "ym"])
