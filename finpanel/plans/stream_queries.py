"""Streams over the given tables: what a stream has emitted when it has read all rows there are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finpanel.operators.stages import fresh_path
from finpanel.plans.book_queries import SIG
from finpanel.plans.catalog import query
from finpanel.streaming import first_touch_stream, lag_signal_stream, stream_downsampled


def _streamed(rows: DataFrame, name: str, make) -> DataFrame:
    """Writes ``rows`` to the shared folder, runs the stream that ``make`` builds of them until nothing is left, and reads what it wrote."""
    spark = rows.sparkSession
    source, sink, state = (fresh_path(spark, f"{name}-{x}") for x in ("in", "out", "state"))
    rows.write.parquet(source)
    stream = make(spark.readStream.schema(rows.schema).parquet(source))
    q = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink)


def _timed(bars: DataFrame) -> DataFrame:
    """Bars with instants, as watermarks ask for, in place of local times."""
    return bars.withColumn("ts", F.col("ts").cast("timestamp"))


@query("o1_stream_signals", "ticker date dir# entry_ts entry stop risk~8", "bars", "SELECT * FROM sig WHERE entry_ts <= (SELECT max(ts) FROM bars) - INTERVAL 1 HOUR", sig=SIG)
def _(t):
    """Signals whose entry the watermark has reached."""
    return _streamed(_timed(t.bars), "signals", lambda s: first_touch_stream(s, "1 hour")).withColumn("entry_ts", F.col("entry_ts").cast("timestamp_ntz"))


@query("w28_stream_lagged_signal", "asset date sig_live", "returns", "SELECT asset, date, last_value(b IGNORE NULLS) OVER w AS sig_live FROM (SELECT asset, date, lag(CASE WHEN day(date) % 7 = 0 THEN day(date) END) OVER (PARTITION BY asset ORDER BY date) AS b FROM returns) WHERE date < (SELECT max(date) FROM returns) WINDOW w AS (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING)")
def _(t):
    """All rows that the watermark has reached; those of the newest day wait."""
    sig = F.when(F.dayofmonth("date") % 7 == 0, F.dayofmonth("date").cast("long"))
    rows = t.returns.select("asset", F.col("date").cast("timestamp").alias("ts"), sig.alias("sig"))
    live = _streamed(rows, "lagged", lambda s: lag_signal_stream(s, "sig", key="asset", late="1 hour"))
    return live.select("asset", F.col("ts").cast("date").alias("date"), "sig_live")


@query("a6_stream_bars_30m", "ticker ts open high low close volume", "bars", "SELECT * FROM (SELECT ticker, time_bucket(INTERVAL 30 MINUTE, ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM bars GROUP BY ALL) WHERE ts + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM bars) - INTERVAL 1 HOUR")
def _(t):
    """Half-hour bars that the watermark has closed."""
    return _streamed(_timed(t.bars), "halves", stream_downsampled).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
