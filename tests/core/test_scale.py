"""Operators that cut their work into blocks, partitions or batches, against loops, for many sizes of these."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from finpanel.operators import joins, quantiles, regimes, risk, windows


@pytest.mark.parametrize("n", [1, 2, 5, 8, 300])
def test_trailing_rank(spark, n):
    """Ties, gaps and NaN, several keys, blocks that are not full: as a list of each row's window gives it."""
    rng = np.random.default_rng(n)
    rows = []
    for k, size in (("a", 1), ("b", 7), ("c", 67), (None, 5)):
        for t in range(size):
            v = float(rng.integers(6)) if rng.random() > 0.15 else None
            rows.append((k, t, float("nan") if v == 5 else v, f"{k}{t}"))
    t = spark.createDataFrame(rows, "k string, t int, v double, more string")
    got = {r.more: r.trail_rank for r in windows.trailing_rank(t, n, key="k", by="t", value="v").select("more", "trail_rank").collect()}
    big = lambda v: math.inf if v != v else v
    for k, i, v, name in rows:
        pool = [big(w) for kk, j, w, _ in rows if kk == k and i - n < j <= i and w is not None]
        want = None if not pool else 0.0 if v is None else (sum(w < big(v) for w in pool) + 0.5 * sum(w == big(v) for w in pool)) / len(pool)
        assert got[name] == (want if want is None else pytest.approx(want)), (name, n)
    assert windows.trailing_rank(t.limit(0), n, key="k", by="t", value="v").count() == 0


@pytest.mark.parametrize(("block", "stretch"), [(256, 1 << 18), (3, 40), (1, 7)])
def test_covariance_by_blocks(spark, block, stretch):
    """Missing dates, constant assets and assets without a common date, for blocks and stretches of any size."""
    rng = np.random.default_rng(1)
    dates = pd.date_range("2020-01-01", periods=40)
    x = rng.normal(size=(40, 9)) * np.logspace(-4, 4, 9) + 1e3
    x[:, 4] = 2.0
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:20, 7] = np.nan
    x[20:, 8] = np.nan
    rows = [(f"a{j}", d.date(), float(x[i, j])) for i, d in enumerate(dates) for j in range(9) if x[i, j] == x[i, j]]
    t = spark.createDataFrame([*rows, ("a0", None, 1.0), (None, dates[0].date(), 1.0), ("a1", dates[0].date(), None)], "asset string, date date, ret double")
    got = {(r.i, r.j): r for r in risk.covariance(t, block=block, stretch=stretch).collect()}
    frame = pd.DataFrame(x)
    for i in range(9):
        for j in range(9):
            both = frame[[i, j]].dropna() if i != j else frame[[i]].dropna().iloc[:, [0, 0]]
            r = got.pop((f"a{i}", f"a{j}"), None)
            if not len(both):
                assert r is None
                continue
            c = np.cov(both.to_numpy().T)
            assert r.n == len(both) and r["cov"] == pytest.approx(c[0, 1], rel=1e-7, abs=1e-9)
            if 4 in (i, j):
                assert r["corr"] is None
            else:
                assert r["corr"] == pytest.approx(c[0, 1] / math.sqrt(c[0, 0] * c[1, 1]), rel=1e-7, abs=1e-9)
    assert not got
    assert risk.covariance(t.filter(F.lit(False))).count() == 0


def test_many_views_in_one_plan(spark):
    """Views of different reach at once: each is met with weights of the exponential form; unreachable ones are marked and keep the prior."""
    rng = np.random.default_rng(9)
    x, y, p = rng.normal(size=300), rng.normal(size=300) * 5 + 2, rng.random(300)
    p /= p.sum()
    t = spark.createDataFrame([(i, float(a), float(b), float(c), i % 3) for i, (a, b, c) in enumerate(zip(x, y, p, strict=True))], "i int, x double, y double, p double, state int")
    goals = {f"v{k}": [0.05 * k, None if k % 2 else 2.0 + k / 4] for k in range(12)} | {"far": [50.0, None], "both far": [2.0 * float(x.max()) / 2, float(y.min())], "none": [None, None]}
    q = regimes.reweight_views(t, [F.col("x"), F.col("y")], goals)
    got = q.toPandas()
    assert len(got) == 300 * len(goals)
    for name, (gx, gy) in goals.items():
        own = got[got["view"] == name].sort_values("i")
        w = own["q"].to_numpy()
        if "far" in name:
            assert not own["settled"].any() and np.array_equal(w, p)
            continue
        assert own["settled"].all() and w.sum() == pytest.approx(1)
        assert gx is None or (w * x).sum() == pytest.approx(gx, abs=1e-8)
        assert gy is None or (w * y).sum() == pytest.approx(gy, abs=1e-8)
        # the logarithm of the change is linear in the features that the view is about
        f = np.column_stack([np.ones(300), *([x] if gx is not None else []), *([y] if gy is not None else [])])
        assert np.linalg.lstsq(f, np.log(w / p), rcond=None)[1].sum() < 1e-12
    # probabilities of states as features: the table of one view for each state
    states = regimes.reweight_views(t, [(F.col("state") == s).cast("double") for s in range(3)], {str(s): [0.8 if s == r else 0.1 for r in range(3)] for s in range(3)})
    mass = {(r["view"], r["state"]): r["m"] for r in states.groupBy("view", "state").agg(F.sum("q").alias("m")).collect()}
    assert all(m == pytest.approx(0.8 if v == str(s) else 0.1) for (v, s), m in mass.items())
    assert regimes.reweight_views(t.limit(0), [F.col("x")], {"a": [1.0]}).count() == 0
    ladder = regimes.view_ladder(t, "x", [0.1, 99.0], portfolio="y").collect()
    assert sorted((r.target, r.settled) for r in ladder) == [(0.1, True), (99.0, False)]


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_scans_without_a_key(spark, parts):
    """Weights and as-of values over any number of partitions, with ties, gaps and rows before the first value."""
    rng = np.random.default_rng(parts)
    days = pd.date_range("2020-01-01", periods=40)
    rows = [(days[int(i)].date(), k) for k, i in enumerate(rng.integers(0, 40, 90))]
    t = spark.createDataFrame(rows, "date date, i int")
    p = regimes.decay_prior(t, 7.0, parts=parts).select("date", "i", "p").collect()
    assert len(p) == 90 and sum(r.p for r in p) == pytest.approx(1)
    assert sorted(r.p for r in p) == pytest.approx(sorted(2.0 ** (-a / 7) / sum(2.0 ** (-b / 7) for b in range(90)) for a in range(90)))
    ordered = sorted(p, key=lambda r: r.p)
    assert [r.date for r in ordered] == sorted(r.date for r in ordered)
    known = [(days[i].date(), None if i % 3 == 0 else float(i)) for i in range(4, 40, 5)]
    got = joins.as_of(t, spark.createDataFrame(known, "date date, level double"), "level", parts=parts).collect()
    assert sorted((r.i, r.level_asof) for r in got) == sorted((i, next((v for d, v in reversed(known) if v is not None and d <= day), None)) for day, i in rows)
    assert regimes.decay_prior(t.limit(0), 7.0, parts=parts).count() == 0


@pytest.mark.parametrize("held", [10**6, 60, 5])
def test_exact_quantiles(spark, held):
    """Groups of one value to thousands, with ties, gaps, NaN and infinities, through brackets of any size: as ``percentile`` gives them."""
    rng = np.random.default_rng(8)
    rows = [("one", 3.0), ("none", None), (None, 1.0), (None, 2.0)]
    rows += [("wide", float(v)) for v in rng.normal(size=4000) * np.exp(3 * rng.normal(size=4000))]
    rows += [("ties", float(v)) for v in rng.integers(0, 3, 3000)] + [("two", float(v)) for v in np.repeat([1.0, 2.0], 500)] + [("same", 7.0)] * 900
    rows += [("mixed", v) for v in [None, float("inf"), -float("inf")] * 30 + list(map(float, range(200)))]
    t = spark.createDataFrame(rows, "k string, v double")
    shares = [0.0, 0.025, 0.25, 0.5, 0.501, 0.75, 0.99, 1.0]
    want = {r.k: r.q for r in t.groupBy("k").agg(F.percentile("v", F.array(*[F.lit(s) for s in shares])).alias("q")).collect()}
    got = {r.k: r.q for r in quantiles.exact_quantiles(t, "v", shares, key="k", held=held).collect()}
    assert str(got) == str({k: want[k] for k in got}) and got.keys() == want.keys()
    whole = t.filter("k = 'wide' or k = 'ties'")
    assert quantiles.exact_quantiles(whole, "v", shares, held=held).first().q == whole.agg(F.percentile("v", F.array(*[F.lit(s) for s in shares]))).first()[0]
    assert [tuple(r) for r in quantiles.exact_quantiles(t.limit(0), "v", shares, held=held).collect()] == [(None,)]


def test_bucketed_bars_need_no_exchange(spark, tmp_path):
    """Roll-up, windows and their join on a bucketed table: no exchange in the plan, and the rows of the plain one."""
    from finpanel.plans.adapters import Tables
    from finpanel.plans.source_queries import bucketed_panel
    from finpanel.sources import write_bucketed

    daily = Tables(spark, "/root/testdata/sf0.001").daily
    table = write_bucketed(daily, "bars_in_buckets", str(tmp_path / "bars"), key="assetid", by="date", buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    got = bucketed_panel(table)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(got) == rows(bucketed_panel(daily))
    for name in ("autoBroadcastJoinThreshold", "requireAllClusterKeysForCoPartition"):
        spark.conf.unset(f"spark.sql.{name}")
    spark.sql("drop table bars_in_buckets")
