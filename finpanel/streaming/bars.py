"""Streams of bars: down-sampling with a watermark, opening-range signals and lagged signals with state on event time.

The two stateful operators take rows in any order. What they emit waits for the watermark, so that rows which come within
``late`` give the rows of the batch operators; later ones are dropped by Spark. Their state is bounded and leaves by
timers. State lives in RocksDB, which Spark asks for here.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegralType, LongType, StructField, StructType

from finpanel.operators.aggregates import downsample

SIGNAL = "ticker string, date date, dir int, entry_ts timestamp, entry double, stop double, risk double"
#: The two earliest bars of a day: the first one's prices, the second one's open, times in microseconds; and the timer that waits.
DAY = "us1 long, o1 double, h1 double, l1 double, c1 double, us2 long, o2 double, sent boolean, timer long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_downsampled(bars: DataFrame, every: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """A-6 on a stream: late bars are waited for as long as ``late``."""
    return downsample(bars, every, watermark=late)


def _use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _timer(us: int) -> int:
    """The first millisecond at which the watermark has reached a time."""
    return -(-us // 1000)


class _FirstBars(StatefulProcessor):
    """Of each ticker and day, the two earliest bars so far.

    A timer at the second one's time fires when the watermark has reached it: no earlier bar can come then, and the signal
    is final. A timer at the day's end clears the state, sent or not.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.day = handle.getValueState("day", DAY)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.day.get() if self.day.exists() else None
        if old is not None and old[7]:  # sent; what comes now is later in the day
            return
        new = pd.concat(list(rows)).sort_values(["us", "open"], kind="stable")
        if old is None:
            self.handle.registerTimer(int(new["end_us"].iloc[0]) // 1000)
        known = [(b.us, b.open, b.high, b.low, b.close) for b in new.head(2).itertuples()]
        if old is not None:
            known.append(tuple(old[:5]))
            if old[5] is not None:
                known.append((old[5], old[6], None, None, None))
        known.sort(key=lambda b: b[0])
        (us1, o1, h1, l1, c1), second = known[0], known[1] if len(known) > 1 else None
        timer = _timer(second[0]) if second else None
        if old is not None and old[8] is not None and old[8] != timer:
            self.handle.deleteTimer(old[8])
        if timer is not None and (old is None or old[8] != timer):
            self.handle.registerTimer(timer)
        self.day.update((us1, o1, h1, l1, c1, second[0] if second else None, second[1] if second else None, False, timer))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.day.exists():
            return
        us1, o, h, low, c, us2, entry, sent, timer = self.day.get()
        if expiredTimerInfo.getExpiryTimeInMs() != timer:
            self.day.clear()
            return
        self.day.update((us1, o, h, low, c, us2, entry, True, None))
        if sent or any(x is None or x != x for x in (o, c, entry)):
            return
        direction = (c > o) - (c < o)
        stop = low if direction > 0 else h
        if direction and stop is not None and (entry - stop) * direction > 0:
            at = pd.Timestamp(us2, unit="us", tz="UTC")
            yield pd.DataFrame({"ticker": [key[0]], "date": [key[1]], "dir": [int(direction)], "entry_ts": [at], "entry": [entry], "stop": [stop], "risk": [(entry - stop) * direction]})

    def close(self) -> None:
        pass


def first_touch_stream(bars: DataFrame, late: str = "1 hour") -> DataFrame:
    """O-1 on a stream of bars (ticker, ts, open, high, low, close): the rows of ``signals``, each as soon as the watermark, ``late`` behind the newest bar, has reached its entry."""
    _use_rocksdb(bars.sparkSession)
    day = F.to_date("ts")
    rows = bars.select("ticker", "ts", "open", "high", "low", "close").withWatermark("ts", late)
    rows = rows.select("ticker", day.alias("date"), "ts", F.unix_micros("ts").alias("us"), F.unix_micros(F.date_add(day, 1).cast("timestamp")).alias("end_us"), *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")])
    return rows.groupBy("ticker", "date").transformWithStateInPandas(_FirstBars(), SIGNAL, "append", "EventTime")


class _Lagged(StatefulProcessor):
    """Of each key, the rows that the watermark has not reached, and the newest signal before them with the time of the row before them."""

    def __init__(self, names: list[str], signal: str, idle_us: int | None, waiting: StructType):
        self.names, self.signal, self.idle_us, self.waiting = names, names.index(signal), idle_us, waiting

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.waiting)
        self.last = handle.getValueState("last", StructType([StructField("signal", self.waiting[1 + self.signal].dataType), StructField("us", LongType()), StructField("timer", LongType())]))

    def _wait(self, signal, us: int, rows: list[tuple], timer: int | None) -> None:
        """Keeps what is known, with one timer: at the next row, or at the end of the idle time."""
        wanted = _timer(min(r[0] for r in rows)) if rows else _timer(us + self.idle_us) if self.idle_us is not None else None
        if timer is not None and timer != wanted:
            self.handle.deleteTimer(timer)
        if wanted is not None and timer != wanted:
            self.handle.registerTimer(wanted)
        self.last.update((signal, us, wanted))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        signal, us, timer = self.last.get() if self.last.exists() else (None, 0, None)
        waiting = list(self.rows.get()) if self.rows.exists() else []
        for frame in rows:
            # whole numbers with gaps come as floats
            whole = [isinstance(f.dataType, IntegralType) for f in self.waiting.fields]
            for r in frame[["us", *self.names]].itertuples(index=False):
                waiting.append(tuple(None if pd.isna(v) else int(v) if w else v for v, w in zip(r, whole, strict=True)))
        self.rows.put(waiting)
        self._wait(signal, us, waiting, timer)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.last.exists():
            return
        signal, us, _ = self.last.get()
        upto = 1000 * timerValues.getCurrentWatermarkInMs()
        waiting = sorted(self.rows.get(), key=lambda r: r[0]) if self.rows.exists() else []
        ready = [tuple(r) for r in waiting if r[0] <= upto]
        rest = [tuple(r) for r in waiting if r[0] > upto]
        out = []
        for r in ready:
            if self.idle_us is not None and r[0] > us + self.idle_us:
                signal = None
            us = r[0]
            out.append((*key, *r, signal))
            if r[1 + self.signal] is not None:
                signal = r[1 + self.signal]
        if rest:
            self.rows.put(rest)
        elif ready:
            self.rows.clear()
        if not rest and self.idle_us is not None and us + self.idle_us <= upto:
            self.last.clear()
        else:
            self._wait(signal, us, rest, None)
        if out:
            yield pd.DataFrame(out, columns=["key", "us", *self.names, "live"])

    def close(self) -> None:
        pass


def lag_signal_stream(rows: DataFrame, signal: str, *, key: str, by: str = "ts", columns: tuple[str, ...] = (), late: str = "1 hour", idle: str | None = None) -> DataFrame:
    """W-28 on a stream: key, ``by``, ``columns``, the signal and the one that is live, which holds from the row after it, as ``lag_signal`` gives them.

    A row is emitted when the watermark has reached it. A key's state is its rows since the watermark and its last signal;
    with ``idle`` (an interval such as "30 days") the signal of a key without rows for so long leaves too, and its next
    row begins anew. NaN counts as null.
    """
    _use_rocksdb(rows.sparkSession)
    kind = {f.name: f.dataType for f in rows.schema.fields}
    names = list(dict.fromkeys([*columns, signal]))
    waiting = StructType([StructField("us", LongType()), *[StructField(n, kind[n]) for n in names]])
    out = StructType([StructField("key", kind[key]), *waiting.fields, StructField("live", kind[signal])])
    idle_us = None if idle is None else int(pd.Timedelta(idle).value // 1000)
    x = rows.withWatermark(by, late).select(F.col(key).alias("key"), F.col(by), F.unix_micros(by).alias("us"), *names)
    found = x.groupBy("key").transformWithStateInPandas(_Lagged(names, signal, idle_us, waiting), out, "append", "EventTime")
    return found.select(F.col("key").alias(key), F.timestamp_micros("us").alias(by), *names, F.col("live").alias(f"{signal}_live"))
