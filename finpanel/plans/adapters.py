"""The given tables as domain tables: DataFrames for Spark, and the same as common table expressions for DuckDB."""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finpanel.operators import features, panel

#: Rows of a large table that a task gets when it is dealt by a key.
TASK_ROWS = 1 << 20


class Tables:
    """Domain tables over one folder of Parquet tables; each is a lazy plan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def pieces(self) -> int:
        """Tasks among which lines are dealt, none (0) where Spark may choose.

        Spark sizes tasks by shuffled bytes, and keys, days and prices pack into a few bytes a row, so that a task's rows and
        memory would grow with a large table; by rows they don't.
        """
        n = math.ceil(self.raw("lineitem").count() / TASK_ROWS)
        return n if n > self.spark.sparkContext.defaultParallelism else 0

    def dealt(self, rows: DataFrame, key: str) -> DataFrame:
        return rows.repartition(self.pieces, key) if self.pieces else rows.repartition(key)

    @cached_property
    def trades(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_suppkey").alias("assetid"), F.col("l_shipdate").cast("date").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("notional"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("o"),
        )

    @cached_property
    def daily(self) -> DataFrame:
        # dealt by asset once: days, months and windows of an asset need no further exchange
        return self.dealt(self.trades, "assetid").groupBy("assetid", "date").agg(
            F.min_by("price", "o").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "o").alias("close"), F.sum("qty").alias("volume"), F.sum("notional").alias("turnover")
        )

    @cached_property
    def meta(self) -> DataFrame:
        s, n = self.raw("supplier"), self.raw("nation")
        return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_suppkey").alias("assetid"), F.col("s_name").alias("symbol"), F.col("n_name").alias("exchange_name"), (F.col("s_acctbal") > 0).alias("is_operating_company"))

    @cached_property
    def monthly(self) -> DataFrame:
        return panel.with_returns(panel.to_monthly(self.daily))

    @cached_property
    def features(self) -> DataFrame:
        return features.forward_return(features.momentum(self.monthly))

    @cached_property
    def membership(self) -> DataFrame:
        rows = self.trades.select("assetid", "date", F.year("date").alias("y")).filter((F.pmod(F.col("y") + F.col("assetid"), F.lit(2)) == 0) & F.month("date").between(3, 10))
        return rows.groupBy("assetid", "y").agg(F.min("date").alias("start_date"), F.max("date").alias("end_date")).select(F.lit("IDX").alias("index_name"), "assetid", "start_date", "end_date")

    @cached_property
    def bars(self) -> DataFrame:
        e = self.raw("events").withColumn("w", F.window("ts", "15 minutes"))
        return e.groupBy(F.col("event_type").alias("ticker"), F.col("w.start").alias("ts")).agg(
            F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "event_id").alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
        )

    @cached_property
    def holdings(self) -> DataFrame:
        li, o = self.raw("lineitem"), self.raw("orders")
        if self.pieces:
            li, o = self.dealt(li, "l_orderkey"), self.dealt(o, "o_orderkey")
        return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(
            F.col("o_custkey").alias("investor"), F.trunc(F.col("o_orderdate").cast("date"), "quarter").alias("report_date"), F.col("o_orderkey").alias("filing"), F.col("l_linenumber").alias("ordinal"),
            F.col("l_suppkey").alias("asset"), F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).alias("value"), F.col("l_linestatus").alias("category"),
            F.col("o_orderdate").cast("date").alias("filed_at"), F.col("l_shipdate").cast("date").alias("available_at"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("holding_id"),
        )

    @cached_property
    def levels(self) -> DataFrame:
        return self.raw("orders").groupBy(F.col("o_orderpriority").alias("asset"), F.col("o_orderdate").cast("date").alias("date")).agg(F.sum("o_totalprice").alias("level"))

    @cached_property
    def returns(self) -> DataFrame:
        return panel.with_returns(self.levels, key="asset", by="date", price="level").filter("ret is not null")

    @cached_property
    def market(self) -> DataFrame:
        """State variables of each day: orders and their mean price."""
        return self.raw("orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(F.count(F.lit(1)).cast("double").alias("n_orders"), F.avg("o_totalprice").alias("mean_price"), F.sum("o_totalprice").alias("level"))

    @cached_property
    def statements(self) -> DataFrame:
        return self.raw("lineitem").groupBy(F.col("l_suppkey").alias("issuer"), F.year("l_shipdate").alias("year")).agg(
            F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("ebit"), F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("dep"), F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("capex"), F.sum("l_quantity").alias("dwc")
        )

    @cached_property
    def calendar(self) -> DataFrame:
        from finpanel.operators.joins import calendar

        return calendar(self.daily)

    @cached_property
    def predictions(self) -> DataFrame:
        """Class probabilities of each asset and month, from embeddings."""
        f = self.features
        e = self.raw("embeddings").select("vec_id", F.slice("embedding", 1, 10).alias("x"))
        n = e.agg(F.count(F.lit(1)).alias("n"))
        e = e.select("vec_id", F.transform("x", lambda v: F.exp(v.cast("double"))).alias("p"))
        e = e.withColumn("s", F.aggregate("p", F.lit(0.0), lambda a, v: a + v)).select("vec_id", F.expr("transform(p, v -> v / s)").alias("probs"))
        return f.crossJoin(F.broadcast(n)).withColumn("vec_id", F.pmod(F.col("assetid") * 83 + F.col("ym"), F.col("n"))).join(e, "vec_id").select("assetid", "ym", "fwd", "probs")  # n is one row


CTES = {
    "trades": "SELECT l_suppkey AS assetid, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS price, l_quantity AS qty, l_extendedprice AS notional, row(l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS o FROM lineitem",
    "daily": "SELECT assetid, date, arg_min(price, o) AS open, max(price) AS high, min(price) AS low, arg_max(price, o) AS close, sum(qty) AS volume, sum(notional) AS turnover FROM trades GROUP BY ALL",
    "meta": "SELECT s_suppkey AS assetid, s_name AS symbol, n_name AS exchange_name, s_acctbal > 0 AS is_operating_company FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "monthly0": "SELECT assetid, year(date) * 12 + month(date) AS ym, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close, sum(volume) AS volume, sum(turnover) AS turnover, max(date) AS date, count(*) AS n_obs FROM daily GROUP BY ALL",
    "monthly": "SELECT *, close / lag(close) OVER w - 1 AS ret, lag(volume) OVER w AS volume_prev, lag(turnover) OVER w AS turnover_prev FROM monthly0 WINDOW w AS (PARTITION BY assetid ORDER BY ym)",
    "features": "SELECT *, ret AS mom_1, "
    + ", ".join(f"CASE WHEN lag(ym, {m - 1}) OVER w = ym - {m - 1} AND count(ret) OVER w{m} = {m - 1} THEN product(1 + ret) OVER w{m} - 1 END AS mom_{m}" for m in (3, 6, 12))
    + ", CASE WHEN lead(ym) OVER w = ym + 1 THEN lead(ret) OVER w END AS fwd FROM monthly WINDOW w AS (PARTITION BY assetid ORDER BY ym), "
    + ", ".join(f"w{m} AS (PARTITION BY assetid ORDER BY ym ROWS BETWEEN {m - 1} PRECEDING AND 1 PRECEDING)" for m in (3, 6, 12)),
    "membership": "SELECT 'IDX' AS index_name, assetid, min(date) AS start_date, max(date) AS end_date FROM (SELECT *, year(date) AS y FROM trades) WHERE (y + assetid) % 2 = 0 AND month(date) BETWEEN 3 AND 10 GROUP BY assetid, y",
    "bars": "SELECT event_type AS ticker, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low, arg_max(value, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY ALL",
    "holdings": "SELECT o_custkey AS investor, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS report_date, o_orderkey AS filing, l_linenumber AS ordinal, l_suppkey AS asset, CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS value, l_linestatus AS category, CAST(o_orderdate AS DATE) AS filed_at, CAST(l_shipdate AS DATE) AS available_at, l_orderkey || '-' || l_linenumber AS holding_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "levels": "SELECT o_orderpriority AS asset, CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS level FROM orders GROUP BY ALL",
    "returns": "SELECT * FROM (SELECT *, level / lag(level) OVER (PARTITION BY asset ORDER BY date) - 1 AS ret FROM levels) WHERE ret IS NOT NULL",
    "market": "SELECT CAST(o_orderdate AS DATE) AS date, CAST(count(*) AS DOUBLE) AS n_orders, avg(o_totalprice) AS mean_price, sum(o_totalprice) AS level FROM orders GROUP BY ALL",
    "statements": "SELECT l_suppkey AS issuer, year(l_shipdate) AS year, sum(l_extendedprice * (1 - l_discount)) AS ebit, sum(l_extendedprice * l_tax) AS dep, sum(l_extendedprice * l_discount) AS capex, sum(l_quantity) AS dwc FROM lineitem GROUP BY ALL",
    "calendar": "SELECT date, row_number() OVER (ORDER BY date) AS ordinal FROM (SELECT DISTINCT date FROM daily)",
    "soft": "SELECT vec_id, [x / s for x in e] AS probs FROM (SELECT vec_id, e, list_sum(e) AS s FROM (SELECT vec_id, [exp(CAST(x AS DOUBLE)) for x in embedding[1:10]] AS e FROM embeddings))",
    "predictions": "SELECT assetid, ym, fwd, probs FROM features JOIN soft ON vec_id = (assetid * 83 + ym) % (SELECT count(*) FROM embeddings)",
}
NEEDS = {
    "daily": ["trades"], "monthly0": ["daily"], "monthly": ["monthly0"], "features": ["monthly"], "membership": ["trades"], "returns": ["levels"], "calendar": ["daily"], "predictions": ["features", "soft"],
}


def ctes(*names: str, extra: dict[str, str] | None = None) -> str:
    """WITH clause of the named tables and all they need, then ``extra``."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, ()):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [f"{n} AS ({CTES[n]})" for n in order] + [f"{n} AS ({s})" for n, s in (extra or {}).items()]
    return f"WITH {', '.join(parts)} " if parts else ""
