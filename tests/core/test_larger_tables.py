"""Queries on small tables that are shaped as large ones: against their SQL, and with tasks, passes and pieces of any size."""

import datetime as dt
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from finpanel.operators import aggregates, books, learning, regimes, reshape
from finpanel.plans import ORACLES, QUERIES, adapters

SF = "/root/testdata/sf0.001"


def both_sides(spark, folder, name, **tables):
    """Rows of a query and of its SQL over the given frames."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t, frame in tables.items():
        con.register("frame", frame.astype({c: "datetime64[us]" for c in frame.select_dtypes("datetime")}))
        con.execute(f"COPY frame TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    key = lambda r: tuple(map(str, r))
    got = QUERIES[name](spark, str(folder))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
    return sorted(map(tuple, got.collect()), key=key), sorted(want, key=key)


def lineitem(rows):
    """Trades (supplier, date, price of the line) as a lineitem table."""
    f = pd.DataFrame(rows, columns=["l_suppkey", "l_shipdate", "l_extendedprice"])
    f["l_shipdate"] = pd.to_datetime(f["l_shipdate"])
    return f.assign(l_orderkey=np.arange(len(f)), l_partkey=1, l_linenumber=1, l_quantity=1.0, l_discount=0.0, l_tax=0.0, l_returnflag="N", l_linestatus="O")


def test_ratios_on_the_bar(spark, tmp_path):
    """assets of the same trades in another order all stand on the month's bar and stay."""
    rng = np.random.default_rng(3)
    rows = []
    for month in range(1, 13):
        lines = [(dt.date(2020, month, 1 + d // 4), float(p) / 100) for d, p in enumerate(rng.integers(1, 9_999_999, 60))]
        rows += [(asset, *lines[i]) for asset in range(30) for i in rng.permutation(60)]
    rng.shuffle(rows)
    got, want = both_sides(spark, tmp_path, "w11_liquidity_bottom", lineitem=lineitem(rows))
    assert got == want and len(got) == 30 * 7


def test_views_beyond_every_day(spark, tmp_path):
    """with many orders a day no day has a tenth more than the mean, and that view keeps the prior's mean."""
    n = [200, 203, 198, 205, 194]
    orders = pd.DataFrame([(d, 1.0 + i) for d, k in enumerate(n) for i in range(k)], columns=["d", "o_totalprice"])
    orders = orders.assign(o_orderkey=np.arange(len(orders)), o_custkey=1, o_orderdate=pd.Timestamp("2020-01-01") + pd.to_timedelta(orders["d"], "D"), o_orderpriority="5-LOW", o_orderstatus="O").drop(columns="d")
    got, want = both_sides(spark, tmp_path, "r11_view_ladder", orders=orders)
    assert got == want and [r[1] for r in got] == [204.0, 200.0]


def test_profile_makes_its_rows_once(spark):
    """the values of a profile are made once, however many passes their quantiles take."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(len(b))
            yield b

    n = 120_000  # more than an aggregate may hold
    rows = spark.range(n, numPartitions=4).select((F.col("id") - 100).cast("double").alias("value")).mapInPandas(count, "value double")
    r = aggregates.value_profile(rows, "value").first()
    assert made.value == n
    assert (r.negative, r.zero, r.positive, r.lo, r.p01, r.median, r.p99, r.hi) == (100, 1, n - 101, -100.0, pytest.approx(0.01 * (n - 1) - 100), (n - 1) / 2 - 100, pytest.approx(0.99 * (n - 1) - 100), n - 101.0)


@pytest.mark.parametrize(("name", "table"), [("a16_duplicate_keys", "holdings"), ("a22_extra_copies", "holdings"), ("w16_ratio_features", "daily"), ("u3_set_operations", "daily")])
def test_rows_of_a_task(spark, monkeypatch, name, table):
    """F7 to F10: the rows of a task are bounded, however few bytes a row packs into."""
    monkeypatch.setattr(adapters, "TASK_ROWS", 500, raising=False)
    rows = getattr(adapters.Tables(spark, SF), table)
    assert rows.count() > 5000 and rows.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 3000
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
    got = sorted(map(tuple, got.collect()), key=lambda r: r[:2])
    assert len(got) == len(want) and all(a == pytest.approx(b) for a, b in zip(got, sorted(want, key=lambda r: r[:2]), strict=True))


def test_set_sizes_move_distinct_ids(spark):
    """repeated ids of a large side stay where they were dealt, and null is an id."""
    moved = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            moved.add(len(b))
            yield b

    many = spark.range(20_000, numPartitions=4).selectExpr("nullif(id % 5, 4) as k").mapInPandas(count, "k long")
    other = spark.createDataFrame([(0,), (1,), (1,), (None,), (9,)], "k long")
    r = reshape.set_sizes(many, other).first()
    assert (r.in_both, r.only_left) == (3, 2)
    assert moved.value == 20_000


def counted(spark, rows, schema):
    """A frame, and a counter of the rows that are made for it."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(len(b))
            yield b

    return spark.createDataFrame(rows, schema).mapInPandas(count, schema), made


def test_forests_make_their_panel_once(spark):
    """the panel is made once, whatever the number of forests."""
    rows = [(a, ym, float(a % 5), 1 + a % 2) for ym in range(24000, 24040) for a in range(8)]
    panel, made = counted(spark, rows, "assetid long, ym int, f double, label int")
    out = learning.walk_forward(panel, ["f"], first=12, every=12, trees=2, depth=2)
    assert out.count() == 28 * 8 and made.value == len(rows)


def test_marks_make_their_prices_once(spark):
    """prices are made once for days and positions; a position that lies in three months has each of its days once."""
    days = [dt.date(2020, 1, 1) + dt.timedelta(d) for d in range(120)]
    prices, made = counted(spark, [(a, d, 100.0 + a + i) for a in (1, 2) for i, d in enumerate(days)], "assetid long, date date, px double")
    book = spark.createDataFrame([("s", 1, days[25], days[70], a, leg, 0.005) for a, leg in ((1, "long"), (2, "short"))], "strategy string, period int, exec_date date, next_date date, assetid long, leg string, w double")
    got = books.mark_to_market(book, prices).collect()
    assert sorted(r.date for r in got) == days[26:71] and {r.n_positions for r in got} == {2} and made.value == 240


def growing(spark, n):
    """Days whose value is a little greater each time that they are made, as a sum's last bits may be."""
    began = time.time()

    def make(batches):
        for b in batches:
            yield pd.DataFrame({"date": pd.Timestamp("2020-01-01") + pd.to_timedelta(b["id"], "D"), "v": b["id"] + (time.time() - began) * 1e-4})

    return spark.range(n, numPartitions=1).mapInPandas(make, "date timestamp, v double")


def test_state_of_the_median_day(spark):
    """the day that is the median itself is not above it, as its value is made once."""
    for train in (None, F.col("v") >= 0):
        got = {r.state: r for r in regimes.state_summary(regimes.quantile_state(growing(spark, 101), {"v": (0.5,)}, train=train)).collect()}
        assert {s: r.n for s, r in got.items()} == {0: 51, 1: 50} and got[1].is_current and not got[0].is_current


def test_probabilities_of_the_median_day(spark):
    """the prior conditioned on the state of the median day holds that day, and each state's weights sum to one."""
    prior = regimes.decay_prior(regimes.quantile_state(growing(spark, 101), {"v": (0.5,)}), 250.0).select("date", "state", "p")
    got = regimes.state_probabilities(prior, 3).groupBy("state").agg(F.count_if(F.col("q") > 0).alias("n"), F.sum("q").alias("mass"), F.max(F.when(F.col("q") > 0, F.col("own"))).alias("own")).collect()
    assert {r.state: (r.n, r.own) for r in got} == {0: (51, 0), 1: (50, 1), 2: (101, 1)} and all(r.mass == pytest.approx(1) for r in got)
