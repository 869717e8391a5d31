"""Streams that come in pieces, out of order and late, against the batch operators."""

import datetime as dt
import random

import pytest

from finpanel.operators import bars, windows
from finpanel.streaming import first_touch_stream, lag_signal_stream

BARS = "ticker string, ts timestamp, open double, high double, low double, close double, volume double"


def run(spark, tmp_path, pieces, schema, make, name):
    """Feeds the pieces one by one, so that each is a batch, and returns the rows and the last state sizes."""
    folder = tmp_path / name
    folder.mkdir()
    stream = spark.readStream.schema(schema).json(str(folder))
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-state")).start()
    try:
        for i, rows in enumerate(pieces):
            spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / f"{name}-{i}"))
            for f in (tmp_path / f"{name}-{i}").glob("part-*"):
                f.rename(folder / f"{i}.json")
            q.processAllAvailable()
        return spark.sql(f"select * from {name}").collect(), [op["numRowsTotal"] for op in q.lastProgress["stateOperators"]]
    finally:
        q.stop()


def day_bars(dice, ticker, day):
    px, out = 10 + dice.random(), []
    for k in range(dice.choice([1, 2, 5, 9])):
        o, c = px, round(px + dice.choice([-1, 0, 1]) * dice.random() / 4, 3)
        out.append((ticker, dt.datetime(2020, 1, day, 9, 30) + dt.timedelta(minutes=5 * k), o, max(o, c) + 0.1, min(o, c) - 0.1, c, 1.0))
        px = c + 0.01
    return out


def test_signals_of_bars_in_any_order(spark, tmp_path):
    """Bars of a day come mixed, over several batches, within the watermark: the batch rows, each once; then the state is empty."""
    dice = random.Random(4)
    rows, pieces = [], []
    for day in range(2, 6):
        own = [b for t in ("A", "B", "C") for b in day_bars(dice, t, day)]
        dice.shuffle(own)
        rows += own
        pieces += [own[: len(own) // 2], own[len(own) // 2 :]]
    end = ("Z", dt.datetime(2020, 2, 1, 9, 30), 1.0, 1.0, 1.0, 1.0, 1.0)  # brings the watermark behind all days
    want = sorted(map(tuple, bars.signals(spark.createDataFrame(rows, BARS)).collect()))
    got, state = run(spark, tmp_path, [*pieces, [end]], BARS, lambda s: first_touch_stream(s, "6 hours"), "signals_mixed")
    assert len(want) > 2 and sorted(map(tuple, got)) == want
    assert sum(state) <= 3  # the last bar's own day: its state and its timer


def test_signals_wait_for_earlier_bars_and_drop_late_ones(spark, tmp_path):
    at = lambda d, m: dt.datetime(2020, 1, d, 9, 30) + dt.timedelta(minutes=m)
    bar = lambda d, m, o, c: ("A", at(d, m), o, max(o, c) + 0.5, min(o, c) - 0.5, c, 1.0)
    pieces = [
        [bar(2, 10, 12.0, 13.0), bar(2, 5, 11.0, 12.0)],
        [bar(2, 0, 10.0, 11.0)],  # within the watermark: it is the first bar now
        [bar(3, 0, 20.0, 21.0), bar(3, 5, 21.0, 22.0)],
        [bar(2, 1, 50.0, 40.0)],  # too late
        [bar(5, 0, 1.0, 1.0)],
    ]
    got, _ = run(spark, tmp_path, pieces, BARS, lambda s: first_touch_stream(s, "1 hour"), "signals_late")
    assert sorted((r.date.day, r.dir, r.entry, r.stop, r.entry_ts) for r in got) == [(2, 1, 11.0, 9.5, at(2, 5)), (3, 1, 21.0, 19.5, at(3, 5))]


@pytest.mark.parametrize("late", ["2 hours", "3 days"])
def test_lagged_signals(spark, tmp_path, late):
    """Rows over many batches, mixed within the watermark, signals with gaps: as ``lag_signal`` gives them."""
    dice = random.Random(6)
    schema = "k string, ts timestamp, ret double, sig int"
    rows, pieces = [], []
    for hour in range(0, 54, 6):
        own = [(k, dt.datetime(2020, 1, 2) + dt.timedelta(hours=hour + h, seconds=dice.randrange(1, 3000)), dice.random(), dice.choice([None, None, 1, -1])) for k in "AB" for h in (0, 0.9, 1.7)]
        dice.shuffle(own)
        rows += own
        pieces.append(own)
    end = [("A", dt.datetime(2020, 3, 1), 0.0, 1), ("B", dt.datetime(2020, 3, 1), 0.0, None)]
    t = spark.createDataFrame(rows, schema)
    want = windows.lag_signal(t, "sig", key="k", by="ts").select("k", "ts", "ret", "sig", "sig_live")
    got, _ = run(spark, tmp_path, [*pieces, end], schema, lambda s: lag_signal_stream(s, "sig", key="k", columns=("ret",), late=late), f"lag_{late[0]}")
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_idle_keys_leave(spark, tmp_path):
    schema = "k string, ts timestamp, sig int"
    at = lambda d: dt.datetime(2020, 1, d)
    pieces = [[("A", at(2), 1), ("B", at(2), 1)], [("B", at(3), None)], [("B", at(20), None)], [("A", at(21), -1), ("B", at(21), None)], [("B", at(25), None)]]
    got, _ = run(spark, tmp_path, pieces, schema, lambda s: lag_signal_stream(s, "sig", key="k", late="1 hour", idle="10 days"), "lag_idle")
    live = {(r.k, r.ts.day): r.sig_live for r in got}
    assert live == {("A", 2): None, ("B", 2): None, ("B", 3): 1, ("B", 20): None, ("A", 21): None, ("B", 21): None}
