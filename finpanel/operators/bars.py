"""Intraday bars: gaps, first bars, opening-range breakouts and holding times."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finpanel.functions import over, safe_div
from finpanel.operators.stages import cut

#: Edges of the gap bins in per cent; right-closed.
GAP_EDGES = (-15.0, -5.0, -2.0, 0.0, 2.0, 5.0, 15.0)


def gap_bins(days: DataFrame, *, threshold: float = 0.0) -> DataFrame:
    """D-13: opening gap over the close before in per cent, for gaps of a size, with its bin."""
    gap = 100 * (safe_div(F.col("open"), F.lag("close").over(over("ticker", by="date"))) - 1)
    rows = days.withColumn("gap", gap).filter(F.abs("gap") >= threshold)
    bin_: Column = F.lit(len(GAP_EDGES))
    for i in reversed(range(len(GAP_EDGES))):
        bin_ = F.when(F.col("gap") <= GAP_EDGES[i], i).otherwise(bin_)
    return rows.withColumn("bin", bin_)


def k_means_1d(rows: DataFrame, column: str, centers: list[float], rounds: int = 1000) -> tuple[DataFrame, list[float]]:
    """D-14: Lloyd's steps from given centers until they stay; one aggregate of a few rows for each round.

    No center leaves its last value while it has no rows. Raises if ``rounds`` steps don't settle them.
    """

    def nearest(c: list[float]) -> Column:
        return F.array_min(F.array(*[F.struct(F.abs(F.col(column) - x).alias("d"), F.lit(i).alias("i")) for i, x in enumerate(c)]))["i"]

    rows = cut(rows.filter(F.col(column).isNotNull()))
    for _ in range(rounds):
        means = {r["k"]: r["m"] for r in rows.groupBy(nearest(centers).alias("k")).agg(F.avg(column).alias("m")).collect()}  # a row for each center
        new = [means.get(i, c) for i, c in enumerate(centers)]
        # sums of another order differ in their last bits
        if all(abs(a - b) <= 1e-12 * max(abs(a), abs(b), 1.0) for a, b in zip(new, centers, strict=True)):
            return rows.withColumn("cluster", nearest(centers)), centers
        centers = new
    raise RuntimeError(f"centers are not settled after {rounds} rounds")


def first_and_rest(bars: DataFrame) -> DataFrame:
    """D-15 and J-13: return of the first bar and of the rest of the day, and whether they agree; days with two bars at least."""
    g = bars.groupBy("ticker", F.to_date("ts").alias("date")).agg(F.min_by("open", "ts").alias("o"), F.min_by("close", "ts").alias("c1"), F.max_by("close", "ts").alias("c"), F.count(F.lit(1)).alias("n")).filter("n >= 2")
    g = g.withColumn("first_ret", safe_div(F.col("c1"), F.col("o")) - 1).withColumn("rest_ret", safe_div(F.col("c"), F.col("c1")) - 1)
    return g.withColumn("first_up", F.col("c1") > F.col("o")).withColumn("momentum", F.signum("first_ret") == F.signum("rest_ret"))


def momentum_by_bin(first: DataFrame, gaps: DataFrame) -> DataFrame:
    """A-27: days, share of continued moves and mean rest of day by gap bin and direction of the first bar."""
    x = first.join(gaps.select("ticker", "date", "bin"), ["ticker", "date"])
    return x.groupBy("bin", "first_up").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("momentum").cast("double")).alias("continued"), F.avg("rest_ret").alias("mean_rest"))


def directional_accuracy(first: DataFrame) -> DataFrame:
    """D-12: how often the first bar shows the direction of the day; days without a direction don't count."""
    up, day = F.signum("first_ret"), F.signum(F.col("c") - F.col("o"))
    return first.groupBy("ticker").agg(F.count_if((up != 0) & (day != 0)).alias("n"), safe_div(F.count_if((up == day) & (up != 0)), F.count_if((up != 0) & (day != 0))).alias("accuracy"))


def continuation_model(rows: DataFrame, *, key: str, x: str, y: str, rounds: int = 30, tolerance: float = 1e-8) -> DataFrame:
    """D-16: logistic regression of a flag on one variable for each key, by weighted sums, with its accuracy in the sample and ``settled``.

    Each round is one aggregate over all keys and one row for each, which is kept; rounds end when no key's coefficients
    move. Keys whose coefficients still move after ``rounds`` are not settled: flags that the variable separates have no
    finite ones.
    """
    data = cut(rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))
    coef = cut(data.groupBy(key).agg(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(False).alias("settled")))
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-(F.col("a") + F.col("b") * F.col("x"))))
        w = F.greatest(p * (1 - p), F.lit(1e-9))
        d = data.join(coef.filter("not settled"), key).withColumn("w", w).withColumn("e", F.col("y") - p)
        s = d.groupBy(key, "a", "b").agg(F.sum("w").alias("s0"), F.sum(F.col("w") * F.col("x")).alias("s1"), F.sum(F.col("w") * F.col("x") ** 2).alias("s2"), F.sum("e").alias("g0"), F.sum(F.col("e") * F.col("x")).alias("g1"))
        det = F.col("s0") * F.col("s2") - F.col("s1") ** 2 + 1e-9
        da, db = (F.col("s2") * F.col("g0") - F.col("s1") * F.col("g1")) / det, (F.col("s0") * F.col("g1") - F.col("s1") * F.col("g0")) / det
        still = (F.abs(da) <= tolerance * (1 + F.abs("a"))) & (F.abs(db) <= tolerance * (1 + F.abs("b")))
        coef = cut(coef.filter("settled").unionByName(s.select(key, (F.col("a") + da).alias("a"), (F.col("b") + db).alias("b"), still.alias("settled"))))
        if coef.filter("not settled").isEmpty():
            break
    guess = (F.col("a") + F.col("b") * F.col("x") > 0).cast("double")
    return data.join(coef, key).groupBy(key, "a", "b", "settled").agg(F.count(F.lit(1)).alias("n"), F.avg((guess == F.col("y")).cast("double")).alias("accuracy"))


def signals(bars: DataFrame) -> DataFrame:
    """O-1: direction of the first bar, entry at the second one's open, stop at the first one's other end; ties, gaps and days without risk are left out."""
    rows = bars.withColumn("date", F.to_date("ts")).withColumn("n", F.row_number().over(Window.partitionBy("ticker", F.to_date("ts")).orderBy("ts")))
    pick = lambda c, n: F.max(F.when(F.col("n") == n, F.col(c)))
    g = rows.filter("n <= 2").groupBy("ticker", "date").agg(pick("open", 1).alias("o1"), pick("close", 1).alias("c1"), pick("high", 1).alias("h1"), pick("low", 1).alias("l1"), pick("open", 2).alias("entry"), pick("ts", 2).alias("entry_ts"))
    g = g.withColumn("dir", F.signum(F.col("c1") - F.col("o1")).cast("int")).filter("dir <> 0")
    g = g.withColumn("stop", F.when(F.col("dir") > 0, F.col("l1")).otherwise(F.col("h1")))
    return g.withColumn("risk", (F.col("entry") - F.col("stop")) * F.col("dir")).filter("risk > 0").select("ticker", "date", "dir", "entry_ts", "entry", "stop", "risk")


def exits(sig: DataFrame, bars: DataFrame, *, hold_minutes: int | None = None) -> DataFrame:
    """O-2: the first bar from the entry on that touches the stop ends the trade there; else the first bar after the holding time, or the day's last bar, at its close. Trades that reach neither have no exit."""
    b = bars.select("ticker", F.to_date("ts").alias("date"), "ts", "high", "low", "close")
    x = sig.join(b, ["ticker", "date"]).filter("ts >= entry_ts")
    touched = F.when(F.col("dir") > 0, F.col("low") <= F.col("stop")).otherwise(F.col("high") >= F.col("stop"))
    stop_ts = F.min(F.when(touched, F.col("ts"))).alias("stop_ts")
    if hold_minutes is None:
        timed = F.max(F.struct("ts", "close")).alias("timed")
    else:
        late = F.expr("timestampdiff(MINUTE, entry_ts, ts)") >= hold_minutes
        timed = F.min(F.when(late, F.struct("ts", "close"))).alias("timed")
    g = x.groupBy(*sig.columns).agg(stop_ts, timed)
    hit = F.col("stop_ts").isNotNull() & (F.col("timed").isNull() | (F.col("stop_ts") <= F.col("timed.ts")))
    return g.select(*sig.columns, F.when(hit, "SL").when(F.col("timed").isNotNull(), "TIME").otherwise("NONE").alias("reason"), F.when(hit, F.col("stop_ts")).otherwise(F.col("timed.ts")).alias("exit_ts"), F.when(hit, F.col("stop")).otherwise(F.col("timed.close")).alias("exit"))


def fill_price(price: Column, direction: Column, entry: bool, *, spread: float = 0.0, slip: Column | float = 0.0) -> Column:
    """O-3: half the spread and the slippage against the trader."""
    side = direction if entry else -direction
    return price + side * (F.lit(spread / 2) + (slip if isinstance(slip, Column) else F.lit(slip)))


def hashed_slip(seed: int, scale: float, *keys: str) -> Column:
    """O-3: a half-normal draw that depends on seed and keys alone (the root of -2 log u times a cosine)."""
    u = lambda k: (F.pmod(F.xxhash64(F.lit(seed + k), *keys), F.lit(1 << 30)) + 0.5) / (1 << 30)
    return scale * F.abs(F.sqrt(-2 * F.ln(u(0))) * F.cos(2 * F.pi() * u(1)))


def position_size(capital: Column, risk: Column, entry: Column, *, share: float = 0.01, leverage: float = 4.0) -> Column:
    """O-4: shares that risk a share of the capital, within the leverage."""
    return F.floor(F.least(safe_div(capital * share, risk), safe_div(capital * leverage, entry)))


def trade_log(done: DataFrame, grid: DataFrame, *, start: float = 25_000.0, leverage: float = 4.0, commission: float = 0.0005) -> DataFrame:
    """O-5: trades with sizes from the capital before each of them, for each ticker and row of ``grid`` (param, risk_share).

    Capital depends on the trades before through the floor in the size, so each ticker's trades are folded in order;
    tickers and parameters are independent. The trades of a task stand sorted, and are read batch by batch: what goes from
    one batch to the next is the ticker, the parameter and the capital, so a ticker of any number of trades takes no more
    memory than a batch. Without a risk, or without a price, that bound on the size does not hold; without both nothing is bought.
    """
    trades = done.filter("reason <> 'NONE'").select("ticker", "date", *[F.col(c).cast("double").alias(c) for c in ("entry", "exit", "dir", "risk")])
    x = trades.crossJoin(F.broadcast(grid.select("param", F.col("risk_share").cast("double").alias("share"))))  # a few parameter sets
    x = x.repartition("ticker", "param").sortWithinPartitions("ticker", "param", "date", "entry", "exit", "dir", "risk")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, cap = None, start
        for f in frames:
            out, at = [], []
            for i, (ticker, param, entry, exit_, way, risk, share) in enumerate(zip(f["ticker"], f["param"], f["entry"], f["exit"], f["dir"], f["risk"], f["share"], strict=True)):
                if (ticker, param) != own:
                    own, cap = (ticker, param), start
                bounds = [b for b in (cap * share / risk if risk else math.nan, cap * leverage / entry if entry else math.nan) if b == b]
                n = max(0, math.floor(min(bounds))) if bounds else 0
                if n:
                    pnl = n * (exit_ - entry) * way - n * commission * 2
                    out.append((n, pnl, cap, cap + pnl, (exit_ - entry) * way / risk if risk else None))
                    at.append(i)
                    cap += pnl
            log = pd.DataFrame(out, columns=["shares", "pnl", "before", "after", "r"])
            yield pd.concat([f.iloc[at][["ticker", "param", "date"]].reset_index(drop=True), log], axis=1)

    kind = {f.name: f.dataType.simpleString() for f in x.schema.fields}
    return x.mapInPandas(fold, f"ticker {kind['ticker']}, param {kind['param']}, date {kind['date']}, shares bigint, pnl double, before double, after double, r double")


def best_parameters(log: DataFrame, *, start: float = 25_000.0) -> DataFrame:
    """O-6: the parameters with the highest final capital of each ticker."""
    total = log.groupBy("ticker", "param").agg(F.max_by("after", "date").alias("final"), F.count(F.lit(1)).alias("trades"))
    return total.groupBy("ticker").agg(F.max_by("param", F.struct("final", "param")).alias("best"), F.max("final").alias("final")).withColumn("total_ret", F.col("final") / start - 1)


def sub_periods(curve: DataFrame, windows: DataFrame, *, key: str, value: str, by: str = "date") -> DataFrame:
    """O-7: the change in per cent of each series over each window (window_no, start, stop), from its first to its last value in it."""
    x = curve.join(F.broadcast(windows), (F.col(by) >= F.col("start")) & (F.col(by) < F.col("stop")))  # a few dozen windows
    g = x.groupBy(key, "window_no").agg(F.min_by(value, by).alias("a"), F.max_by(value, by).alias("z"))
    return g.select(key, "window_no", (100 * (safe_div(F.col("z"), F.col("a")) - 1)).alias("pct"))


def holding_times(sig: DataFrame, bars: DataFrame) -> DataFrame:
    """D-26: the R multiple of each trade at every later bar of its day, with minutes held."""
    b = bars.select("ticker", F.to_date("ts").alias("date"), F.col("ts").alias("mark"), F.col("close").alias("px"))
    x = sig.join(b, ["ticker", "date"]).filter("mark > entry_ts")
    return x.withColumn("minutes", F.expr("timestampdiff(MINUTE, entry_ts, mark)")).withColumn("r", (F.col("px") - F.col("entry")) * F.col("dir") / F.col("risk")).withColumn("r_per_minute", safe_div(F.col("r"), F.col("minutes")))


def holding_buckets(marks: DataFrame, every: int = 60) -> DataFrame:
    """D-26: count, median and quartiles of R by bucket of minutes held."""
    q = F.percentile("r", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return marks.groupBy((F.floor(F.col("minutes") / every) * every).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), q.alias("q"), F.median("r_per_minute").alias("rpm")).select("bucket", "n", *[F.col("q")[i].alias(f"r_p{p}") for i, p in enumerate((25, 50, 75))], "rpm")
