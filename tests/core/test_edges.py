"""Edge panels by hand, and what SQL can't express against plain restatements."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from finpanel.functions import percent_rank_average, require_columns, safe_div
from finpanel.operators import aggregates, bars, books, features, holdings, joins, learning, panel, regimes, risk, universe, windows
from finpanel.sources import files

D = dt.date


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_month_gap_makes_momentum_and_forward_return_null(spark):
    ret = {24000: None, 24001: 0.1, 24002: 0.2, 24004: 0.3, 24005: 0.4, 24006: 0.5}
    p = frame(spark, [(1, m, r) for m, r in ret.items()], "assetid long, ym int, ret double")
    got = {r.ym: (r.mom_3, r.fwd) for r in features.forward_return(features.momentum(p, (1, 3))).collect()}
    assert got[24002][1] is None and got[24004][0] is None and got[24005][0] is None
    assert math.isclose(got[24006][0], 1.3 * 1.4 - 1) and math.isclose(got[24001][1], 0.2) and got[24006][1] is None


@pytest.mark.parametrize("values", [[1.0], [5.0, 5.0, 5.0], [3.0, 1.0, 2.0], [float(i % 4) for i in range(25)], [float(i) for i in range(57)], [None, 1.0, 2.0]])
def test_bucket_is_qcut(spark, values):
    p = frame(spark, [(i, 24000, v) for i, v in enumerate(values)], "assetid long, ym int, x double")
    got = [r.x_bucket for r in features.bucket(p, "x").orderBy("assetid").collect()]
    s = pd.Series(values, dtype=float)
    n = min(10, s.notna().sum())
    if s.nunique() == 1:
        want = [1 if n == 1 else None] * len(values)
    else:
        want = [None if pd.isna(v) else int(v) + 1 for v in pd.qcut(s, n, labels=False, duplicates="drop")]
    assert got == want


def test_average_rank_and_safe_division(spark):
    p = frame(spark, [(1, 3.0), (1, 3.0), (1, None), (1, 1.0), (2, 7.0)], "ym int, x double")
    got = sorted((r.ym, -1 if r.x is None else r.x, r.k) for r in p.withColumn("k", percent_rank_average(F.col("x"), "ym")).collect() if r.x is not None)
    assert got == [(1, 1.0, pytest.approx(1 / 3)), (1, 3.0, pytest.approx(2.5 / 3)), (1, 3.0, pytest.approx(2.5 / 3)), (2, 7.0, 1.0)]
    assert p.select(safe_div(F.lit(1.0), F.lit(0.0)).alias("z")).first().z is None


def test_stale_rule_counts_nulls_as_zero(spark):
    p = frame(spark, [(1, 0.0, 0.0, 0.0), (2, None, None, None), (3, 0.0, 5.0, 0.0), (4, 0.0, 0.0, 0.1)], "id int, v double, v0 double, r double")
    assert sorted(r.id for r in p.filter(~universe.is_stale(F.col("v"), F.col("v0"), F.col("r"))).collect()) == [3, 4]


def test_membership_with_exit_and_return_in_one_month(spark):
    rows = frame(spark, [(1, 24001), (1, 24002), (1, 24004), (2, 24002)], "assetid long, ym int")
    spans = frame(spark, [(1, D(1999, 12, 1), D(2000, 2, 3)), (1, D(2000, 2, 20), D(2000, 3, 1))], "assetid long, start_date date, end_date date")
    assert sorted(tuple(r) for r in universe.members(rows.withColumn("ym", F.col("ym") + 0), spans).collect()) == [(1, 24001), (1, 24002)]


def test_full_month_trading_on_a_dense_and_a_sparse_month(spark):
    days = [D(2020, 1, d) for d in range(1, 21)] + [D(2020, 2, d) for d in range(1, 11)]
    rows = [(1, d, 10.0, 10.0, 10.0, 10.0, 5.0, 50.0) for d in days] + [(2, d, 10.0, 10.0, 10.0, 10.0, 5.0, 500.0) for d in days if d.month == 1 or d.day < 4]
    daily = frame(spark, rows, "assetid long, date date, open double, high double, low double, close double, volume double, turnover double")
    got = {(r.assetid, r.ym): r.is_tradable for r in universe.tradability(panel.monthly_state(daily)).collect()}
    jan, feb = 2020 * 12 + 1, 2020 * 12 + 2
    assert got[1, jan] and got[2, jan] and got[1, feb] and not got[2, feb]


def test_execution_dates_and_fills(spark):
    days = frame(spark, [(D(2020, 1, 2), 1), (D(2020, 1, 3), 2), (D(2020, 1, 6), 3)], "date date, ordinal int")
    sig = frame(spark, [(D(2020, 1, 1),), (D(2020, 1, 3),), (D(2020, 1, 4),), (D(2020, 1, 6),)], "date date")
    got = {r.date: r.exec_date for r in joins.execution_dates(sig, days).collect()}
    assert got == {D(2020, 1, 1): D(2020, 1, 2), D(2020, 1, 3): D(2020, 1, 6), D(2020, 1, 4): D(2020, 1, 6), D(2020, 1, 6): None}
    s = frame(spark, [(1, D(2020, 1, i + 1), v) for i, v in enumerate([None, 1.0, None, None, None, 5.0])], "k int, date date, v double")
    got = [(r.v_filled, r.v_linear) for r in windows.fill(s, "v", key="k", limit=2).orderBy("date").collect()]
    assert got == [(None, None), (1.0, 1.0), (1.0, 2.0), (1.0, 3.0), (None, 4.0), (5.0, 5.0)]


def test_cvar_rules(spark):
    v = frame(spark, [(1, float(i)) for i in range(10)], "k int, v double")
    assert risk.cvar_count(v, 0.9, key="k", value="v").first().cvar_a == 0.0
    assert risk.cvar_quantile(v, 0.9, key="k", value="v").first().cvar_b == 0.0
    w = v.withColumn("p", F.lit(0.1))
    assert risk.cvar_weighted(w, 0.75, key="k", value="v", weight="p").first().cvar_c == pytest.approx(0.5)
    assert risk.cvar_weighted(w, 0.95, key="k", value="v", weight="p").first().cvar_c == 0.0


def test_reweighting_meets_views_or_keeps_the_prior(spark):
    x = frame(spark, [(float(i), 1 / 50) for i in range(50)], "x double, p double")
    q = regimes.reweight(x, [(F.col("x"), 30.0), (F.col("x") ** 2, 1000.0)])
    r = q.agg(F.sum("q").alias("s"), F.sum(F.col("q") * F.col("x")).alias("m"), F.sum(F.col("q") * F.col("x") ** 2).alias("m2")).first()
    assert (r.s, r.m, r.m2) == (pytest.approx(1), pytest.approx(30), pytest.approx(1000))
    same = regimes.reweight(x, [(F.col("x"), 99.0)])
    assert same.filter("abs(p - q) > 1e-12").count() == 0


def test_k_means_and_continuation(spark):
    rng = np.random.default_rng(1)
    v = np.abs(rng.normal(0, 10, 200))
    t = frame(spark, [(float(x),) for x in v], "x double")
    _, got = bars.k_means_1d(t, "x", [5.0, 10.0, 15.0, 25.0])
    c, steps = np.array([5.0, 10.0, 15.0, 25.0]), 0
    while True:
        own = np.abs(v[:, None] - c[None, :]).argmin(axis=1)
        new = np.array([v[own == k].mean() if (own == k).any() else c[k] for k in range(4)])
        if np.allclose(new, c, rtol=1e-13):
            break
        c, steps = new, steps + 1
    assert steps > 10
    with pytest.raises(RuntimeError, match="not settled after 3"):
        bars.k_means_1d(t, "x", [5.0, 10.0, 15.0, 25.0], rounds=3)
    assert np.allclose(got, c)
    x = rng.normal(0, 1, 400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.3 + 1.5 * x)))).astype(float)
    t = frame(spark, [(1, float(a), float(b)) for a, b in zip(x, y, strict=True)], "k int, x double, y double")
    r = bars.continuation_model(t, key="k", x="x", y="y").first()
    p = 1 / (1 + np.exp(-(r.a + r.b * x)))
    assert r.settled and abs((y - p).sum()) < 1e-6 and abs(((y - p) * x).sum()) < 1e-6
    apart = t.unionByName(frame(spark, [(2, float(i), float(i > 5)) for i in range(12)] + [(3, None, 1.0)], t.schema))
    assert {r.k: r.settled for r in bars.continuation_model(apart, key="k", x="x", y="y").collect()} == {1: True, 2: False}


def test_capital_folds_over_many_batches(spark):
    """A ticker's trades over many batches beside others: the capital of a plain loop, whatever the size of a batch."""
    rng = np.random.default_rng(12)
    rows = [(t, D(2000, 1, 1) + dt.timedelta(i), float(rng.uniform(50, 150)), float(rng.uniform(50, 150)), int(rng.choice([-1, 1])), float(rng.uniform(0.5, 9)), "TIME") for t, n in (("A", 3000), ("B", 1), ("C", 700)) for i in range(n)]
    trades = frame(spark, rows, "ticker string, date date, entry double, exit double, dir int, risk double, reason string").repartition(5)
    grid = frame(spark, [(1, 0.002), (2, 0.0005)], "param int, risk_share double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = {(r.ticker, r.param, r.date): (r.shares, r.after) for r in bars.trade_log(trades, grid, start=1e6).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for ticker in "ABC":
        for param, share in ((1, 0.002), (2, 0.0005)):
            cap = 1e6
            for k, d, entry, exit_, way, risk_, _ in rows:
                n = int(max(0, np.floor(min(cap * share / risk_, cap * 4 / entry)))) if k == ticker else 0
                if n:
                    cap += n * (exit_ - entry) * way - n * 0.0005 * 2
                    assert got.pop((ticker, param, d)) == (n, pytest.approx(cap))
    assert not got


def test_breakout_touched_on_the_entry_bar_and_capital_fold(spark):
    at = lambda h, m: dt.datetime(2020, 1, 2, h, m)
    rows = [("A", at(9, 30), 10.0, 11.0, 9.0, 10.5, 1.0), ("A", at(9, 45), 10.6, 10.7, 8.5, 9.0, 1.0), ("A", at(10, 0), 9.0, 12.0, 9.0, 12.0, 1.0), ("B", at(9, 30), 10.0, 10.0, 10.0, 10.0, 1.0), ("B", at(9, 45), 10.0, 11.0, 9.0, 11.0, 1.0), ("C", at(9, 30), 10.0, 11.0, 9.0, 10.5, 1.0)]
    t = frame(spark, rows, "ticker string, ts timestamp, open double, high double, low double, close double, volume double")
    done = bars.exits(bars.signals(t), t).collect()
    assert [(r.ticker, r.reason, r.exit) for r in done] == [("A", "SL", 9.0)]
    rng = np.random.default_rng(4)
    days = [(f"{'AB'[i % 2]}", D(2020, 1, 1) + dt.timedelta(i), 100.0, 100.0 + float(rng.normal(0, 2)), 1, float(rng.uniform(0.5, 2)), "TIME") for i in range(60)]
    trades = frame(spark, days, "ticker string, date date, entry double, exit double, dir int, risk double, reason string")
    grid = frame(spark, [(1, 0.01), (2, 0.05)], "param int, risk_share double")
    got = {(r.ticker, r.param, r.date): (r.shares, r.after) for r in bars.trade_log(trades, grid).collect()}
    for ticker in "AB":
        for param, share in ((1, 0.01), (2, 0.05)):
            cap = 25000.0
            for k, d, entry, exit_, way, risk_, _ in days:
                if k == ticker:
                    n = max(0, math.floor(min(cap * share / risk_, cap * 4 / entry)))
                    if n:
                        cap += n * (exit_ - entry) * way - n * 0.0005 * 2
                        assert got[ticker, param, d] == (n, pytest.approx(cap))


def test_mark_to_market_is_the_day_loop(spark):
    rng = np.random.default_rng(9)
    days = [D(2020, 1, 1) + dt.timedelta(i) for i in range(60)]
    px = {a: 100 * np.cumprod(1 + rng.normal(0, 0.02, 60)) for a in range(6)}
    prices = frame(spark, [(a, d, i + 1, float(px[a][i]), 0) for a in px for i, d in enumerate(days)], "assetid long, date date, ordinal int, px double, missing_days int")
    rebal = [0, 20, 40, 59]
    book = []
    for k in range(3):
        long, short = [k, k + 1], [(k + 3) % 6, (k + 4) % 6]
        book += [("s", k + 1, days[rebal[k]], days[rebal[k + 1]], a, "long", 0.25) for a in long] + [("s", k + 1, days[rebal[k]], days[rebal[k + 1]], a, "short", 0.25) for a in short]
    b = frame(spark, book, "strategy string, period int, exec_date date, next_date date, assetid long, leg string, w double")
    got = {r.date: r.equity for r in books.mark_to_market(b, prices).collect()}
    equity, held = 100_000.0, {}
    for k in range(3):
        own = [(a, leg, w) for _, p, _, _, a, leg, w in book if p == k + 1]
        new = {}
        for a, _, w in own:
            new[a] = new.get(a, 0) + w
        turn = sum(abs(new.get(a, 0) - held.get(a, 0) / equity) for a in {*new, *held})
        start, value = equity, {(a, leg): equity * w for a, leg, w in own}
        cost = 0.001 * turn * start
        for i in range(rebal[k] + 1, rebal[k + 1] + 1):
            for (a, leg), v in value.items():
                r = px[a][i] / px[a][i - 1] - 1
                value[a, leg] = v * (1 + r - 0.05 / 365 if leg == "long" else 1 - r + 0.02 / 365)
            equity = start - cost + sum(value.values()) - sum(start * w for _, _, w in own)
            assert got[days[i]] == pytest.approx(equity, rel=1e-10)
        held = {}
        for (a, _), v in value.items():
            held[a] = held.get(a, 0) + v


def test_stale_price_rule(spark):
    days = [D(2020, 1, i) for i in range(1, 13)]
    cal = frame(spark, [(d, i + 1) for i, d in enumerate(days)], "date date, ordinal int")
    daily = frame(spark, [(1, days[0], 5.0), (1, days[1], 6.0), (1, days[7], 7.0), (2, days[11], 1.0)], "assetid long, date date, close double")
    got = {(r.assetid, r.ordinal): r.px for r in books.stale_prices(daily, cal).collect()}
    assert got[1, 7] == 6.0 and got[1, 11] == 7.0 and got[1, 12] == 0.0 and got[2, 12] == 1.0 and (2, 1) not in got


HOLD = "period string, manager string, accession string, cusip string, value double, cat string"


def holdings_rows(spark, rows):
    return frame(spark, rows, HOLD)


SPEC = holdings.HoldingsSpec(investor="manager", report_date="period", filing="accession", asset="cusip", value="value", category="cat")


def test_holdings_readiness(spark):
    t = holdings_rows(spark, [("q1", "i1", "f1", "a1", 1.0, "EC"), ("q1", "i1", "f1", "a2", 2.0, "EC"), ("q1", "i2", "f2", "a1", 1.0, "EC"), ("q1", "i2", "f2", "a2", -2.0, "EC"), ("q1", "i3", "f3", "a3", 5.0, "DB"), ("q1", "  ", "f4", "a1", 2.0, "EC")])
    summary, audit, log = holdings.matrix_readiness(t, SPEC, least_assets=1, least_investors=1, categories=["EC"])
    assert summary.first().pairs == 3 and log[-1][1] == 3
    assert [(r["name"], r["rows"]) for r in audit.orderBy("stage").collect()] == [("input", 6), ("investor", 5), ("asset", 5), ("value", 5), ("positive", 4), ("category", 3)]


def test_filing_conflict_raises(spark):
    t = holdings_rows(spark, [("q1", "m", "original", "a", 1.0, "EC"), ("q1", "m", "amendment", "a", 1.0, "EC")])
    assert aggregates.filing_conflicts(t, date="period", investor="manager", filing="accession").first().filings == 2
    with pytest.raises(ValueError, match="several filings"):
        holdings.matrix_readiness(t, SPEC, least_assets=1, least_investors=1)
    with pytest.raises(ValueError, match="missing columns: cusip"):
        SPEC.check(t.drop("cusip"))


def test_degree_filter_stops_at_a_fixed_point(spark):
    t = frame(spark, [("q", i, a) for i, a in (("i1", "a1"), ("i1", "a2"), ("i2", "a1"), ("i2", "a2"), ("i3", "a3"))], "report_date string, investor string, asset string")
    left, log = holdings.degree_filter(t, least_assets=2, least_investors=2)
    assert {(r.investor, r.asset) for r in left.collect()} == {(i, a) for i in ("i1", "i2") for a in ("a1", "a2")} and [n for _, n in log] == [5, 4, 4]


def test_degree_filter_unravels_a_long_chain(spark):
    """A chain of 24 links loses its ends in each round, until nothing is left."""
    rows = [("q", f"i{n}", f"a{n + d}") for n in range(12) for d in (0, 1)]
    left, log = holdings.degree_filter(frame(spark, rows, "report_date string, investor string, asset string"), least_assets=2, least_investors=2)
    assert left.count() == 0 and len(log) > 5


def _filtered(rows, least_assets, least_investors):
    """The rounds as loops."""
    now, log = set(rows), [len(set(rows))]
    while len(log) < 2 or log[-1] != log[-2]:
        now = {p for p in now if len({a for d, i, a in now if (d, i) == p[:2]}) >= least_assets}
        now = {p for p in now if len({i for d, i, a in now if (d, a) == (p[0], p[2])}) >= least_investors}
        log.append(len(now))
    return now, log


@pytest.mark.parametrize("few", [0, 1000])
def test_degree_filter_in_tasks_and_in_rounds(spark, few):
    """Dates in a task, dates in rounds of joins, and both together give the rounds of loops; nulls and repeats don't count."""
    rng = np.random.default_rng(5)
    rows = [(f"d{d}", f"i{rng.integers(14)}", f"a{rng.integers(12)}") for d in range(3) for _ in range(25 + 15 * d)] + [("d3", f"i{n}", f"a{n + k}") for n in range(3) for k in (0, 1)]
    want, log = _filtered(rows, 3, 2)
    assert 0 < len(want) < len(set(rows))
    t = frame(spark, [*rows, rows[0], ("d0", None, "a1"), ("d0", "i1", None)], "report_date string, investor string, asset string")
    for size in (10**6, 30, 0):
        left, got = holdings.degree_filter(t, least_assets=3, least_investors=2, task_pairs=size, few=few)
        assert {tuple(r) for r in left.collect()} == want and [n for _, n in got] == log
    assert holdings.degree_filter(t.limit(0), least_assets=3, least_investors=2)[1] == [(0, 0), (1, 0)]


def test_degree_filter_unravels_500_links(spark):
    """Each round takes a link from each end: as many rounds as half the chain, in one job."""
    rows = [("q", f"i{n}", f"a{n + d}") for n in range(250) for d in (0, 1)]
    left, log = holdings.degree_filter(frame(spark, rows, "report_date string, investor string, asset string"), least_assets=2, least_investors=2)
    assert left.count() == 0 and len(log) > 100 and log[0] == (0, 500)


def test_profiles(spark):
    p = {r["name"]: r for r in aggregates.schema_profile(frame(spark, [("A", 1.0), (None, 2.0), ("B", None)], "asset string, value double")).collect()}
    assert p["asset"].nulls == 1 and p["value"].null_pct == pytest.approx(100 / 3)
    d = frame(spark, [("h1", "f1", 1), ("h1", "f1", 1), ("h2", "f2", 1)], "h string, f string, o int")
    assert aggregates.duplicate_rows(d, ["h"]).first().duplicate_rows == 2 and aggregates.duplicate_rows(d, ["f", "o"]).first().duplicate_rows == 2 and aggregates.extra_copies(d, ["h"]).first().extra == 1
    v = aggregates.value_profile(frame(spark, [(-2.0,), (0.0,), (3.0,), (None,)], "value double"), "value").first()
    assert (v.missing, v.negative, v.zero, v.positive) == (1, 1, 1, 1)
    t = frame(spark, [(D(2024, 3, 31), D(2024, 5, 15), D(2024, 5, 15)), (D(2024, 6, 30), D(2024, 5, 15), D(2024, 5, 14))], "r date, f date, a date")
    got = {r["name"]: r.violations for r in aggregates.timing_profile(t, report="r", filed="f", available="a").collect()}
    assert got["report"] == 1 and got["available"] == 1
    with pytest.raises(ValueError):
        require_columns(t, "r", "nope")


def test_manifest_audit(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.bin").write_bytes(b"1234")
    (tmp_path / "a/two.bin").write_bytes(b"12")
    entries = [("t", "a/one.bin", 4), ("t", "a/two.bin", 3), ("t", "a/gone.bin", 1), ("t", "../secret", 1), ("t", "tables/../../secret", 1), ("t", "/tmp/secret", 1), ("t", ".", 1), ("t", "", 1), ("u", "dup", 1), ("u", "dup", 1)]
    m = frame(spark, [(entries,)], "table_files array<struct<table:string,relative_path:string,bytes:long>>")
    got = files.manifest_audit(m, files.listed_files(spark, str(tmp_path)))
    assert {r.relative_path: r.status for r in got.collect()} == {"a/one.bin": "ok", "a/two.bin": "size", "a/gone.bin": "missing", "../secret": "unsafe", "tables/../../secret": "unsafe", "/tmp/secret": "unsafe", ".": "unsafe", "": "unsafe", "dup": "duplicate"}
    assert files.product_bytes(got.filter("status in ('ok', 'size', 'missing')")).first().bytes == 8
    with pytest.raises(Exception, match="bad path"):
        files.product_bytes(got).collect()


def test_file_sources(spark, tmp_path):
    for folder, name in (("listed", "12_ABC.csv"), ("gone", "7_X.Y-200105.ca.csv")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / name).write_text("date,open,high,low,close,volume,turnover,unadjusted_close,dividend\n2001-01-02,1,2,0.5,1.5,10,15,1.5,0\n")
    got = {r.assetid: r for r in files.csv_panel(spark, str(tmp_path / "listed"), str(tmp_path / "gone")).collect()}
    assert got[12].symbol == "ABC" and not got[12].is_delisted and got[7].symbol == "X.Y" and got[7].is_delisted and got[7].delist_ym == 2001 * 12 + 5
    (tmp_path / "j.json").write_text('[{"observations": [{"date": "2020-01-01", "value": "."}, {"date": "2020-01-02", "value": "1.5"}]}]')
    o = files.observations(files.json_records(spark, str(tmp_path / "j.json"), "observations array<struct<date:string,value:string>>"))
    assert [r.value for r in o.orderBy("date").collect()] == [None, 1.5]
    with pytest.raises(ValueError, match="unknown index"):
        files.membership_intervals(spark, {}, "IDX")
    (tmp_path / "m.csv").write_text("symbol,assetid,start_date,end_date,trading_days\nA,1,2000-01-03,2000-02-01,20\n")
    assert files.membership_intervals(spark, {"IDX": str(tmp_path / "m.csv")}, "IDX").first().index_name == "IDX"
    (tmp_path / "fx.csv").write_text("date,open,high,low,close\n2020-01-02,1,1,1,1\n")
    assert files.fx_series(spark, str(tmp_path / "fx.csv"), "CADUSD").first().currency == "USD"
    files.write_csv(o, str(tmp_path / "out"))
    files.write_stage(o.withColumn("y", F.year("date")), str(tmp_path / "stage"), by=["y"])
    assert files.read_stage(spark, str(tmp_path / "stage"), "date").count() == 2


def test_streams_give_what_batches_give(spark, tmp_path):
    from finpanel.streaming import first_touch_stream, stream_downsampled

    rows = [("A", dt.datetime(2020, 1, 2, 9, 30) + dt.timedelta(minutes=15 * i), 10.0 + i, 11.0 + i, 9.0 + i, 10.5 + i, 1.0) for i in range(8)] + [("A", dt.datetime(2020, 1, 5), 1.0, 1.0, 1.0, 1.0, 1.0)]
    t = frame(spark, rows, "ticker string, ts timestamp, open double, high double, low double, close double, volume double")
    t.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    q = stream_downsampled(stream).writeStream.format("memory").queryName("down").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.sql("select * from down").collect()))
    want = sorted(map(tuple, aggregates.downsample(t).filter("ts < '2020-01-05'").collect()))
    assert got == want
    q = first_touch_stream(stream.withColumn("date", F.to_date("ts"))).writeStream.format("memory").queryName("sig").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = [(r.ticker, r.date, r.dir, r.entry, r.stop) for r in spark.sql("select * from sig").collect()]
    assert got == [(r.ticker, r.date, r.dir, r.entry, r.stop) for r in bars.signals(t).collect()]


def test_walk_forward_probabilities(spark):
    rng = np.random.default_rng(2)
    rows = [(a, 24000 + m, float(x := rng.normal()), 1 + int(x > 0)) for m in range(30) for a in range(20)]
    t = frame(spark, rows, "assetid long, ym int, f double, label int")
    out = learning.walk_forward(t, ["f"], first=12, every=12, trees=3, depth=2)
    assert out.select("ym").distinct().count() == 18
    assert out.filter(F.abs(F.aggregate("probs", F.lit(0.0), lambda a, v: a + v) - 1) > 1e-9).count() == 0
    hit = out.filter(F.array_position("probs", F.array_max("probs")) == F.col("label")).count() / out.count()
    assert hit > 0.9


def test_books_balance(spark):
    """Over a closed horizon every entry has its exit, and weights of a month sum to one."""
    rng = np.random.default_rng(3)
    t = frame(spark, [(a, 24000 + m, float(rng.normal()), float(rng.normal() / 10)) for m in range(12) for a in range(30)], "assetid long, ym int, s double, fwd double")
    b = books.with_turnover(books.select_books(t, ["s"], 5))
    r = b.agg(F.count_if("is_new").alias("i"), F.count_if("will_exit").alias("o")).first()
    assert r.i == r.o
    log = books.trade_log(books.select_books(t, ["s"], 5), t.withColumn("close", F.lit(1.0)))
    assert log.groupBy("ym").agg(F.sum("weight").alias("w")).filter("abs(w - 1) > 1e-12").count() == 0
    small = frame(spark, [(a, 1, float(a), 0.0) for a in range(9)], "assetid long, ym int, s double, fwd double")
    assert books.select_books(small, ["s"], 5).count() == 0 and books.select_books(small.unionByName(frame(spark, [(9, 1, 9.0, 0.0)], small.schema)), ["s"], 5).count() == 10


def test_risk_and_label_fallbacks(spark):
    r = frame(spark, [("a", 0, 0.1), ("a", 0, 0.3)], "asset string, state int, ret double")
    got = {x.state: (x["mean"], x["n"]) for x in regimes.conditional_moments(r, 2, key="asset").collect()}
    assert got == {0: (pytest.approx(0.2), 2), 1: (pytest.approx(0.2), 0)}
    p = frame(spark, [(1, 1)], "pred int, label int")
    assert aggregates.confusion(p, 3).agg(F.sum("n")).first()[0] == 1 and aggregates.confusion(p, 3).count() == 9
    with pytest.raises(ValueError):
        risk.valuation(frame(spark, [(1, 2000, 1.0, 1.0, 1.0, 1.0, 0.0, 1.0)], "issuer int, year int, ebit double, dep double, capex double, dwc double, net_debt double, shares double"), terminal=0.5)
