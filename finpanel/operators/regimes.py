"""Regimes, scenario weights and re-weighting to views."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finpanel.functions import over, safe_div
from finpanel.operators.quantiles import exact_quantiles
from finpanel.operators.stages import behind_part, cut, kept, ordered_parts, over_parts

PAST = (Window.unboundedPreceding, Window.currentRow)


def quantile_state(rows: DataFrame, columns: dict[str, tuple[float, ...]], *, train: Column | None = None) -> DataFrame:
    """R-1: each column's level by quantiles (of the training rows where given), and all levels as one number.

    The rows are written once: a mean that is made again may differ in its last bit, and the row that is the quantile itself
    would lie above it or not by chance.
    """
    rows = kept(rows, "states")
    base = rows.filter(train) if train is not None else rows
    out = rows
    for c, qs in columns.items():
        out = out.crossJoin(F.broadcast(exact_quantiles(base, c, list(qs)).withColumnRenamed("q", f"__q_{c}")))  # one row
    code, scale = F.lit(0), 1
    for c, qs in columns.items():
        level = sum((F.when(F.col(c) > F.col(f"__q_{c}")[i], 1).otherwise(0) for i in range(len(qs))), F.lit(0))
        out = out.withColumn(f"{c}_level", F.when(F.col(c).isNotNull(), level))
        code, scale = code + F.col(f"{c}_level") * scale, scale * (len(qs) + 1)
    return out.withColumn("state", code).drop(*[f"__q_{c}" for c in columns])


def state_summary(states: DataFrame, *, by: str = "date") -> DataFrame:
    """R-2: rows and share of each state, and whether it is the newest one."""
    newest = states.agg(F.max_by("state", by).alias("newest"), F.count("state").alias("total"))
    g = states.filter("state is not null").groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    return g.crossJoin(F.broadcast(newest)).select("state", "n", safe_div(F.col("n"), F.col("total")).alias("share"), F.coalesce(F.col("state") == F.col("newest"), F.lit(False)).alias("is_current"))  # one row


def conditional_moments(rows: DataFrame, k: int, *, key: str, ret: str = "ret") -> DataFrame:
    """R-3: mean and population deviation in each of k states, of all rows where a state has none."""
    overall = rows.groupBy(key).agg(F.avg(ret).alias("m0"), F.stddev_pop(ret).alias("s0"))
    seen = rows.groupBy(key, "state").agg(F.avg(ret).alias("m"), F.stddev_pop(ret).alias("s"), F.count(F.lit(1)).alias("n"))
    grid = overall.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("state"))
    return grid.join(seen, [key, "state"], "left").select(key, "state", F.coalesce("m", "m0").alias("mean"), F.coalesce("s", "s0").alias("sigma"), F.coalesce("n", F.lit(0)).alias("n"))


def joint_label(rows: DataFrame, *, bull: Column, bear: Column, neutral: Column) -> DataFrame:
    """R-4: the first label whose rule holds."""
    return rows.withColumn("label", F.when(bull, "Bull").when(bear, "Bear").when(neutral, "Neutral").otherwise("Other"))


def decay_prior(rows: DataFrame, half_life: float, *, key: str | None = None, by: str = "date", parts: int | None = None) -> DataFrame:
    """R-5: weights that halve every ``half_life`` rows back from the newest, summing to one.

    Without a key all rows are one series: they are range-partitioned, each partition ranks its own, and the counts of
    the partitions behind it, one number for each, are added. Of rows of equal time the order is by their hash.
    """
    if key:
        age = F.row_number().over(over(key, by=[F.desc(by)])) - 1
        rows = rows.withColumn("__p", F.pow(F.lit(2.0), -age / half_life))
        return rows.withColumn("p", F.col("__p") / F.sum("__p").over(Window.partitionBy(key))).drop("__p")
    x = ordered_parts(rows.withColumn("__h", F.xxhash64(*rows.columns)), F.col(by), F.col("__h"), parts=parts)
    newer = over_parts(F.count(F.lit(1)).alias("__n"), parts=x, carry={"__newer": F.coalesce(F.sum("__n").over(behind_part()), F.lit(0))})
    age = F.row_number().over(over("__part", by=[F.desc(by), F.desc("__h")])) - 1 + F.col("__newer")
    x = x.join(F.broadcast(newer), "__part").withColumn("__p", F.pow(F.lit(2.0), -age / half_life))  # a row for each partition
    # the weights of n rows are a geometric series
    total = x.agg(F.count(F.lit(1)).alias("__n")).select(((1 - F.pow(F.lit(2.0), -F.col("__n") / half_life)) / (1 - 2.0 ** (-1 / half_life))).alias("__total"))
    return x.crossJoin(F.broadcast(total)).withColumn("p", F.col("__p") / F.col("__total")).drop("__p", "__h", "__part", "__newer", "__total")  # one row


def weighted_moments(rows: DataFrame, *, key: str, value: str, p: str = "p") -> DataFrame:
    """R-6: mean, deviation, skew and kurtosis under weights."""
    w, x = F.col(p), F.col(value)
    m = rows.groupBy(key).agg(safe_div(F.sum(w * x), F.sum(w)).alias("mean"))
    d = x - F.col("mean")
    g = rows.join(m, key).groupBy(key, "mean").agg(F.sum(w).alias("s"), *[F.sum(w * d**k).alias(f"m{k}") for k in (2, 3, 4)])
    var = F.col("m2") / F.col("s")
    return g.select(key, "mean", F.sqrt(var).alias("vol"), safe_div(F.col("m3") / F.col("s"), var**1.5).alias("skew"), safe_div(F.col("m4") / F.col("s"), var**2).alias("kurt"))


def weighted_correlation(pairs: DataFrame, *, x: str, y: str, p: str = "p") -> DataFrame:
    """R-6: correlation of two columns under weights."""
    w = F.col(p)
    s = pairs.agg(F.sum(w).alias("s"), F.sum(w * F.col(x)).alias("sx"), F.sum(w * F.col(y)).alias("sy"), F.sum(w * F.col(x) ** 2).alias("xx"), F.sum(w * F.col(y) ** 2).alias("yy"), F.sum(w * F.col(x) * F.col(y)).alias("xy"))
    n = lambda a, b, c: F.col(a) / F.col("s") - F.col(b) * F.col(c) / F.col("s") ** 2
    return s.select(safe_div(n("xy", "sx", "sy"), F.sqrt(n("xx", "sx", "sx") * n("yy", "sy", "sy"))).alias("rho"))


@dataclass
class _Dual:
    """Where one view's Newton iteration stands: its point, the dual's value and gradient there, and the steps that are tried."""

    goal: np.ndarray
    active: np.ndarray
    lam: np.ndarray
    state: str = "open"
    value: float = math.inf
    step: np.ndarray | None = None
    sizes: tuple[float, ...] = (0.0,)
    rounds: int = 0

    def trials(self) -> list[np.ndarray]:
        return [self.lam if self.step is None else self.lam + s * self.step for s in self.sizes]

    def told(self, found: dict[int, tuple[float, np.ndarray, np.ndarray]], tolerance: float, rounds: int) -> None:
        """Takes the dual at the trial points: goes to the longest step that lowers it; if the whole step doesn't, all halves are tried at once."""
        for i in sorted(found):
            value, grad, hess = found[i]
            if not (math.isfinite(value) and np.isfinite(grad).all() and np.isfinite(hess).all() and value <= self.value + 1e-12):
                continue
            self.lam, self.value, grad = self.trials()[i], value, grad[self.active]
            if np.abs(grad).max(initial=0.0) < tolerance:
                self.state = "settled"
            elif self.rounds >= rounds:
                self.state = "unsettled"
            else:
                own = hess[np.ix_(self.active, self.active)]
                self.step, self.sizes, self.rounds = np.zeros(len(self.lam)), (1.0,), self.rounds + 1
                self.step[self.active] = np.linalg.solve(own + 1e-12 * np.eye(len(own)), -grad)
            return
        if self.sizes == (1.0,):
            self.sizes = tuple(0.5**n for n in range(1, 21))
        else:
            self.state = "unsettled"


def reweight_views(scenarios: DataFrame, features: list[Column], goals: dict[str, list[float | None]], *, p: str = "p", rounds: int = 60, tolerance: float = 1e-10) -> DataFrame:
    """R-7, R-9 and R-11 for many views at once: the scenarios once for each view of ``goals``, with ``view``, its weights q and ``settled``.

    A view names the mean that each feature should have, or None where it says nothing. Its q is in proportion to
    p exp(lambda f) with the least change that meets it. All views take each step of Newton's method on their duals
    together: one aggregate of the scenarios keyed by view gives the moments at every open view's point, a few numbers for
    each, and small systems are solved for them; so there are two jobs at most for each step of the slowest view, whatever
    the number of views. Views are parameters: they are broadcast. A view that no weights can meet, or that takes more than
    ``rounds`` steps, keeps p and is not settled.
    """
    k, spark = len(features), scenarios.sparkSession
    base = scenarios.agg(*[f(x).alias(f"{name}{i}") for i, x in enumerate(features) for name, f in (("m", F.avg), ("s", F.stddev_pop), ("lo", F.min), ("hi", F.max))]).first()
    mean, dev = np.array([base[f"m{i}"] or 0.0 for i in range(k)]), np.array([base[f"s{i}"] or 1.0 for i in range(k)])
    z = [(f - float(mean[i])) / float(dev[i]) for i, f in enumerate(features)]
    rows = cut(scenarios.select(F.col(p).alias("p"), *[c.alias(f"z{i}") for i, c in enumerate(z)]))
    duals = {}
    for name, targets in goals.items():
        active = [i for i, t in enumerate(targets) if t is not None]
        goal = (np.array([0.0 if t is None else float(t) for t in targets]) - mean) / dev
        # no weights give a mean beyond the values
        within = all(base[f"lo{i}"] is not None and base[f"lo{i}"] <= targets[i] <= base[f"hi{i}"] for i in active)
        duals[name] = _Dual(np.where([t is not None for t in targets], goal, 0.0), np.array(active, dtype=int), np.zeros(k), "open" if within else "unsettled")

    def points(names: list[str]) -> DataFrame:
        return spark.createDataFrame([(n, i, [float(v) for v in lam], [float(v) for v in duals[n].goal]) for n in names for i, lam in enumerate(duals[n].trials())], "view string, trial int, lam array<double>, goal array<double>")

    off = [F.col(f"z{i}") - F.col("goal")[i] for i in range(k)]
    e = F.col("p") * F.exp(sum((F.col("lam")[i] * off[i] for i in range(k)), F.lit(0.0)))
    aggs = [F.sum("e").alias("t")] + [F.sum(F.col("e") * off[i]).alias(f"g{i}") for i in range(k)] + [F.sum(F.col("e") * off[i] * off[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
    while names := [n for n, d in duals.items() if d.state == "open"]:
        found: dict[str, dict] = {n: {} for n in names}
        for r in rows.crossJoin(F.broadcast(points(names))).withColumn("e", e).groupBy("view", "trial").agg(*aggs).collect():  # views are parameters
            t = r["t"] if r["t"] is not None and 0 < r["t"] < math.inf else math.nan
            g = np.array([r[f"g{i}"] for i in range(k)], dtype=float) / t
            h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], dtype=float) / t
            found[r["view"]][r["trial"]] = math.log(t), g, h - np.outer(g, g)
        for n in names:
            duals[n].told(found[n], tolerance, rounds)
    done = spark.createDataFrame([(n, [float(v) for v in d.lam], [float(v) for v in d.goal], float(d.value), d.state == "settled") for n, d in duals.items()], "view string, __lam array<double>, __goal array<double>, __value double, settled boolean")
    x = scenarios.crossJoin(F.broadcast(done))  # views are parameters
    power = sum((F.col("__lam")[i] * (z[i] - F.col("__goal")[i]) for i in range(k)), F.lit(0.0))
    return x.withColumn("q", F.when(F.col("settled"), F.col(p) * F.exp(power - F.col("__value"))).otherwise(F.col(p))).drop("__lam", "__goal", "__value")


def reweight(scenarios: DataFrame, views: list[tuple[Column, float]], *, p: str = "p", rounds: int = 60, tolerance: float = 1e-10) -> DataFrame:
    """R-7: weights q in proportion to p exp(lambda f) with the least change that meets each view, the mean of an expression f; and ``settled``, false where q is p because no weights meet them."""
    return reweight_views(scenarios, [f for f, _ in views], {"all": [t for _, t in views]}, p=p, rounds=rounds, tolerance=tolerance).drop("view")


def relative_entropy(rows: DataFrame, *, p: str = "p", q: str = "q", key: str | None = None) -> DataFrame:
    """R-8: relative entropy and the effective share of scenarios; rows without weight add nothing."""
    term = F.when((F.col(q) > 0) & (F.col(p) > 0), F.col(q) * F.ln(F.col(q) / F.col(p))).otherwise(0.0)
    g = (rows.groupBy(key) if key else rows.groupBy()).agg(F.sum(term).alias("entropy"))
    return g.withColumn("effective", F.exp(-F.col("entropy")))


def state_probabilities(rows: DataFrame, k: int) -> DataFrame:
    """R-9: for each of k states the prior conditioned on it, row by row; the prior itself for states without rows."""
    seen = rows.groupBy("state").agg(F.sum("p").alias("mass"))
    grid = rows.select("date", F.col("state").alias("own"), "p", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("state"))
    x = grid.join(F.broadcast(seen), "state", "left")  # a row for each state
    q = F.when(F.col("mass").isNull(), F.col("p")).when(F.col("own") == F.col("state"), F.col("p") / F.col("mass")).otherwise(0.0)
    return x.select("state", "date", "own", q.alias("q"))


def transitions(states: DataFrame, k: int, *, by: str = "date") -> DataFrame:
    """R-10: share of rows of state i whose next row has state j, on a dense grid; rows without a next one don't count."""
    nxt = states.select("state", F.lead("state").over(Window.orderBy(by)).alias("to")).filter("state is not null and to is not null")  # one state series
    n = nxt.groupBy("state", "to").agg(F.count(F.lit(1)).alias("n"))
    grid = states.sparkSession.range(k).select(F.col("id").cast("int").alias("state")).crossJoin(states.sparkSession.range(k).select(F.col("id").cast("int").alias("to")))
    full = grid.join(n, ["state", "to"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("prob", safe_div(F.col("n"), F.sum("n").over(over("state"))))


def transition_mass(q: DataFrame, k: int) -> DataFrame:
    """R-10: mass that the probabilities of state i put on rows of state j."""
    return q.groupBy("state", F.col("own").alias("to")).agg(F.sum("q").alias("mass"))


def view_ladder(scenarios: DataFrame, value: str, targets: list[float], *, portfolio: str) -> DataFrame:
    """R-11: for each mean view the posterior mean of a portfolio column, the effective share of scenarios, and whether weights meet the view; all views in one plan."""
    q = reweight_views(scenarios, [F.col(value)], {repr(float(t)): [t] for t in targets})
    entropy = F.sum(F.when(F.col("q") > 0, F.col("q") * F.ln(F.col("q") / F.col("p"))).otherwise(0.0))
    out = q.groupBy("view", "settled").agg(F.sum(F.col("q") * F.col(portfolio)).alias("post_mean"), F.sum(F.col("q") * F.col(value)).alias("view_mean"), F.exp(-entropy).alias("effective"))
    return out.select("post_mean", "view_mean", "effective", F.col("view").cast("double").alias("target"), "settled")


def stress_table(rows: DataFrame, *, key: str, value: str) -> DataFrame:
    """R-12: mean and deviation under prior and views for each asset."""
    prior = weighted_moments(rows, key=key, value=value, p="p").select(key, F.col("mean").alias("prior_mean"), F.col("vol").alias("prior_vol"))
    post = weighted_moments(rows, key=key, value=value, p="q").select(key, F.col("mean").alias("post_mean"), F.col("vol").alias("post_vol"))
    return prior.join(post, key)


def _draw(i: Column, seed: int, n: Column) -> Column:
    """The i-th number below n of a seeded sequence, by modular arithmetic alone, so that SQL gives the same."""
    return F.pmod(i.cast("long") * 48271 + seed * 69621, F.lit(2147483647)) % n


def resample(rows: DataFrame, draws: int, length: int, *, key: str, by: str = "date", ret: str = "ret", seed: int = 1) -> DataFrame:
    """R-13: mean, tail mean and efficiency of each asset over random windows of consecutive rows; starts come from a seeded sequence."""
    from finpanel.operators.risk import cvar_quantile

    n = rows.withColumn("__i", F.row_number().over(over(key, by=by)) - 1).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    draw = rows.sparkSession.range(draws).select(F.col("id").cast("int").alias("draw"))
    start = _draw(F.col("draw"), seed, F.greatest(F.col("__n") - length + 1, F.lit(1)))
    # each key's draws name the rows they take, and meet them by equality
    sizes = n.select(key, "__n").distinct().crossJoin(F.broadcast(draw)).withColumn("__s", start)  # draws are a parameter
    taken = sizes.select(key, "draw", F.explode(F.sequence(F.col("__s").cast("int"), (F.col("__s") + length - 1).cast("int"))).alias("__i"))
    x = n.join(taken, [key, "__i"])
    x = x.withColumn("__k", F.concat_ws("|", key, "draw"))
    tail = cvar_quantile(x, 0.95, key="__k", value=ret)
    g = x.groupBy("__k", key, "draw").agg(F.avg(ret).alias("mean")).join(tail, "__k").drop("__k")
    return g.withColumn("efficiency", safe_div(F.col("mean"), F.abs("cvar_b")))


def resample_summary(stats: DataFrame, *, key: str) -> DataFrame:
    """A-33: mean, median, deviation, extremes and stability of efficiencies."""
    return stats.groupBy(key).agg(F.avg("efficiency").alias("mean"), F.median("efficiency").alias("median"), F.stddev_samp("efficiency").alias("sd"), F.min("efficiency").alias("lo"), F.max("efficiency").alias("hi"), safe_div(F.avg("efficiency"), F.stddev_pop("efficiency")).alias("stability"))


def block_resample(trades: DataFrame, sims: int, blocks: int, size: int, *, by: str = "date", pnl: str = "ret", seed: int = 1) -> DataFrame:
    """R-14: per simulation the count, sum, win rate and compounded growth of trades in blocks of consecutive days; days keep the place they are drawn to."""
    days = trades.select(by).distinct().withColumn("__d", F.row_number().over(Window.orderBy(by)) - 1)  # as many rows as days
    n = days.agg(F.count(F.lit(1)).alias("n"))
    draw = trades.sparkSession.range(sims).select(F.col("id").cast("int").alias("sim"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    start = _draw(F.col("sim") * blocks + F.col("block"), seed, F.greatest(F.col("n") - size + 1, F.lit(1)))
    drawn = draw.crossJoin(F.broadcast(n)).withColumn("s", start).select("sim", "block", F.explode(F.sequence(F.col("s"), F.col("s") + size - 1)).alias("__d"))  # one row
    x = drawn.join(days, "__d").join(trades, by)
    return x.groupBy("sim").agg(F.count(F.lit(1)).alias("n"), F.sum(pnl).alias("total"), F.avg((F.col(pnl) > 0).cast("double")).alias("win_rate"), (F.product(1 + F.col(pnl)) - 1).alias("growth"))


def rolling_preselection(rows: DataFrame, size: int, step: int, *, key: str, by: str = "date", ret: str = "ret") -> DataFrame:
    """R-15: conditional efficiency of each asset in rolling windows: mean over tail mean of the rows in the window's last state (above or below its median)."""
    n = rows.withColumn("__i", F.row_number().over(over(key, by=by)) - 1)
    first = F.greatest(F.lit(0), F.ceil((F.col("__i") - size + 1) / step)).cast("int")
    x = n.withColumn("window_no", F.explode(F.sequence(first, F.floor(F.col("__i") / step).cast("int"))))
    med = x.groupBy(key, "window_no").agg(F.median(ret).alias("med"), F.count(F.lit(1)).alias("n"), F.max_by(ret, by).alias("last")).filter(F.col("n") == size)
    y = x.join(med, [key, "window_no"]).filter((F.col(ret) > F.col("med")) == (F.col("last") > F.col("med")))
    g = y.groupBy(key, "window_no").agg(F.count(F.lit(1)).alias("n_state"), F.avg(ret).alias("mean"), F.stddev_pop(ret).alias("sigma"))
    return g.withColumn("efficiency", safe_div(F.col("mean"), F.col("sigma")))
