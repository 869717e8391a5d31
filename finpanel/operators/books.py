"""Long and short books, costs, trade logs, bridges and daily mark-to-market."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finpanel.functions import month_index, over, safe_div
from finpanel.operators.joins import entries_exits
from finpanel.operators.stages import cut, kept
from finpanel.operators.topk import top_bottom

PAST = (Window.unboundedPreceding, Window.currentRow)


def select_books(rows: DataFrame, scores: list[str], top: float) -> DataFrame:
    """P-1: the long and short names of each strategy and month, all strategies in one plan over unpivoted scores."""
    long = rows.select("assetid", "ym", "fwd", F.explode(F.array(*[F.struct(F.lit(s).alias("strategy"), F.col(s).alias("score")) for s in scores])).alias("s")).select("assetid", "ym", "fwd", "s.*")
    book = top_bottom(long.withColumn("__g", F.concat_ws("|", "strategy", "ym")), "score", top, by="__g").drop("__g")
    # months in which a strategy has a book are its periods
    periods = book.select("strategy", "ym").distinct().withColumn("period", F.row_number().over(over("strategy", by="ym"))).withColumn("periods", F.count(F.lit(1)).over(Window.partitionBy("strategy")))
    return book.join(periods, ["strategy", "ym"])


def with_turnover(book: DataFrame) -> DataFrame:
    """J-15 on a book: new and leaving positions; all are new in a strategy's first period and leave in its last."""
    return entries_exits(book, keys=("strategy", "leg", "assetid"))


def period_costs(book: DataFrame, *, bps: float = 5.0, carry: float = 0.05, days: float = 30.0) -> DataFrame:
    """P-2: commission and financing of each leg and month; shorts earn the carry."""
    g = with_turnover(book).groupBy("strategy", "ym", "period", "leg").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_new").alias("entries"), F.count_if("will_exit").alias("exits"), F.avg("fwd").alias("leg_ret"))
    g = g.withColumn("commission", (F.col("entries") + F.col("exits")) / F.col("n") * (bps / 1e4))
    return g.withColumn("financing", F.when(F.col("leg") == "long", F.lit(carry * days / 365)).otherwise(F.lit(-carry * days / 365)))


def book_months(costs: DataFrame, *, long_only: bool = False) -> DataFrame:
    """P-3 and P-4: leg means, gross, costs and net of each strategy and month."""
    pick = lambda leg, c: F.max(F.when(F.col("leg") == leg, F.col(c)))
    g = costs.groupBy("strategy", "ym", "period").agg(*[pick(leg, c).alias(f"{leg}_{c}") for leg in ("long", "short") for c in ("n", "leg_ret", "commission", "financing")])
    share = 1.0 if long_only else 0.5
    short = (lambda c: F.lit(0.0)) if long_only else (lambda c: share * F.col(f"short_{c}"))
    g = g.withColumn("gross", share * F.col("long_leg_ret") - short("leg_ret")).withColumn("commission", share * F.col("long_commission") + short("commission")).withColumn("financing", share * F.col("long_financing") + short("financing"))
    return g.withColumn("net", F.col("gross") - F.col("commission") - F.col("financing")).select("strategy", "ym", "period", "long_n", "short_n", "long_leg_ret", "short_leg_ret", "gross", "commission", "financing", "net")


def leg_diagnostics(months: DataFrame) -> DataFrame:
    """A-31: annualised leg means, worst and best month."""
    return months.groupBy("strategy").agg((F.avg("long_leg_ret") * 12).alias("long_ann"), (F.avg("short_leg_ret") * 12).alias("short_ann"), F.min("net").alias("worst"), F.max("net").alias("best"), F.min_by("ym", F.struct("net", "ym")).alias("worst_ym"))


def trade_log(book: DataFrame, panel: DataFrame, *, bps: float = 5.0, carry: float = 0.05, days: float = 30.0, weight: Column | None = None) -> DataFrame:
    """P-5 and P-6: a row for each position with prices, costs and its part of the net return; ``weight`` takes the place of equal weights, names without a positive one are left out, and a missing return counts as none."""
    from finpanel.operators.joins import entry_exit_prices

    t = with_turnover(book)
    t = t.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("strategy", "ym", "leg")))
    t = t.withColumn("weight", 0.5 / F.col("n") if weight is None else weight)
    if weight is not None:
        t = t.filter("weight > 0").withColumn("fwd", F.coalesce("fwd", F.lit(0.0)))
    t = entry_exit_prices(t, panel)
    side = F.when(F.col("leg") == "long", 1.0).otherwise(-1.0)
    t = t.withColumn("commission", (F.col("is_new").cast("int") + F.col("will_exit").cast("int")) * (bps / 1e4)).withColumn("financing", side * (carry * days / 365))
    return t.withColumn("net", F.col("weight") * (side * F.col("fwd") - F.col("commission") - F.col("financing")))


def bridge(book: DataFrame, exec_prices: DataFrame) -> DataFrame:
    """P-7: each position's monthly return beside the return between its execution prices (assetid, ym, entry_px, exit_px), and their difference."""
    x = book.join(exec_prices, ["assetid", "ym"], "left")
    x = x.withColumn("daily_ret", safe_div(F.col("exit_px"), F.col("entry_px")) - 1).withColumn("diff", F.col("fwd") - F.col("daily_ret"))
    return x.withColumn("missing_px", (F.col("entry_px").isNull() | F.col("exit_px").isNull()))


def bridge_months(positions: DataFrame) -> DataFrame:
    """P-7: means by strategy, month and leg, with missing prices."""
    return positions.groupBy("strategy", "ym", "leg").agg(F.avg("fwd").alias("monthly"), F.avg("daily_ret").alias("daily"), F.avg("diff").alias("diff"), F.count_if("missing_px").alias("missing"))


def bridge_report(months: DataFrame) -> DataFrame:
    """P-7: months, correlation of both returns and mean absolute difference of each strategy and leg."""
    return months.groupBy("strategy", "leg").agg(F.count(F.lit(1)).alias("months"), F.corr("monthly", "daily").alias("rho"), F.avg(F.abs("diff")).alias("mean_abs_diff"), F.sum("missing").alias("missing"))


def stale_prices(daily: DataFrame, days: DataFrame, *, limit: int = 3) -> DataFrame:
    """P-9: a price for every calendar day from an asset's first bar on: the last valid one, but zero beyond ``limit`` missing days behind its final bar."""
    life = daily.groupBy("assetid").agg(F.min("date").alias("first"), F.max("date").alias("final"))
    n = days.select("date", "ordinal")
    bars = daily.filter("close > 0").join(n, "date").select("assetid", "date", "close", "ordinal")
    # days between neighbouring bars are filled from the earlier one; behind the final bar up to the calendar's end
    end = n.agg((F.max("ordinal") + 1).alias("end"))
    nxt = bars.withColumn("next", F.lead("ordinal").over(over("assetid", by="date"))).crossJoin(F.broadcast(end)).withColumn("next", F.coalesce("next", "end"))  # one row
    full = nxt.select("assetid", "close", F.col("ordinal").alias("bar"), F.explode(F.sequence("ordinal", F.col("next") - 1)).alias("ordinal")).join(n, "ordinal")
    full = full.join(life.select("assetid", "final"), "assetid").withColumn("missing_days", F.col("ordinal") - F.col("bar"))
    return full.withColumn("px", F.when((F.col("missing_days") > limit) & (F.col("date") > F.col("final")), 0.0).otherwise(F.col("close"))).select("assetid", "date", "ordinal", "px", "missing_days")


def mark_to_market(book: DataFrame, prices: DataFrame, *, cost: float = 0.001, carry_long: float = 0.05, carry_short: float = 0.02, capital: float = 100_000.0) -> DataFrame:
    """P-8: daily equity of each strategy's book (strategy, period, exec_date, next_date, assetid, leg, w).

    Within a holding interval every amount is proportional to equity, so E(t) = E_k (1 - c_k + sum of w (G(t) - 1)) with G
    the growth of a position since execution: one distributed window product. The turnover cost of an interval is the sum
    of abs(w - h / f), with h what a position was worth when the interval before ended and f that interval's growth. Bounds of f follow from sums
    alone; a position whose difference keeps its sign within them is part of two sums, and only the few others, whose
    own growth is as near to f as the cost, are folded in order, with a few numbers for each interval.
    """
    rate = F.when(F.col("leg") == "long", F.lit(1.0)).otherwise(F.lit(-1.0))
    # a position meets the days of the months that it lies in, not all days of its asset
    px = prices.select("assetid", "date", "px", F.lag("px").over(over("assetid", by="date")).alias("px0"), month_index(F.col("date")).alias("__m"))
    held = book.withColumn("__m", F.explode(F.sequence(month_index(F.col("exec_date")), month_index(F.col("next_date")))))
    p = held.join(px, ["assetid", "__m"]).filter((F.col("date") > F.col("exec_date")) & (F.col("date") <= F.col("next_date")))
    r = F.coalesce(safe_div(F.col("px"), F.col("px0")) - 1, F.lit(0.0))
    step = 1 + rate * r - F.when(F.col("leg") == "long", F.lit(carry_long / 365)).otherwise(F.lit(-carry_short / 365))
    own = ("strategy", "period", "leg", "assetid")
    p = p.withColumn("g", F.product(step).over(Window.partitionBy(*own).orderBy("date").rowsBetween(*PAST)))
    p = kept(p.select(*own, "date", "w", "g"), "marks")  # read by days and by positions
    day = p.groupBy("strategy", "period", "date").agg(F.sum(F.col("w") * (F.col("g") - 1)).alias("s"), F.count(F.lit(1)).alias("n_positions"))
    # weights that a period leaves behind, against the next one's
    last = cut(p.groupBy(*own).agg(F.max_by("g", "date").alias("g"), F.max("w").alias("w")))  # a row for each position, read four times
    left = last.groupBy("strategy", "period", "assetid").agg(F.sum(F.col("w") * F.col("g")).alias("held"))
    new = book.groupBy("strategy", "period", "assetid").agg(F.sum("w").alias("w"))
    sums = last.groupBy("strategy", "period").agg(F.sum(F.col("w") * (F.col("g") - 1)).alias("end"))
    both = new.join(left.withColumn("period", F.col("period") + 1), ["strategy", "period", "assetid"], "full_outer")
    both = both.withColumns({"w": F.coalesce("w", F.lit(0.0)), "h": F.coalesce("held", F.lit(0.0))}).select("strategy", "period", "w", "h")
    sums = both.groupBy("strategy", "period").agg(F.sum(F.abs("w")).alias("all_w"), F.sum(F.abs("h")).alias("all_h")).join(sums, ["strategy", "period"])
    start = "cast(array() as array<struct<period:int,{}>>)"
    # bounds of the growth before each interval; none (null) from where equity might be gone
    bounds = f"""aggregate(k, named_struct('lo', 1D, 'hi', 1D, 'out', {start.format("lo:double,hi:double")}), (a, s) -> named_struct(
        'lo', case when a.lo > 0 then 1 + s.end - {cost}D * (s.all_w + s.all_h / a.lo) end, 'hi', 1 + s.end,
        'out', concat(a.out, array(named_struct('period', s.period, 'lo', case when a.lo > 0 then a.lo end, 'hi', a.hi)))), a -> a.out)"""
    limits = sums.groupBy("strategy").agg(F.array_sort(F.collect_list(F.struct("period", "end", "all_w", "all_h"))).alias("k")).select("strategy", F.inline(F.expr(bounds)))
    at_lo, at_hi = F.col("w") - F.col("h") / F.col("lo"), F.col("w") - F.col("h") / F.col("hi")
    sign = F.when(at_lo * at_hi >= 0, F.signum(at_lo + at_hi))
    pairs = both.join(limits, ["strategy", "period"]).withColumn("sign", sign).groupBy("strategy", "period").agg(
        F.coalesce(F.sum(F.col("sign") * F.col("w")), F.lit(0.0)).alias("sw"), F.coalesce(F.sum(F.col("sign") * F.col("h")), F.lit(0.0)).alias("sh"), F.collect_list(F.when(F.col("sign").isNull(), F.struct("w", "h"))).alias("x")
    )
    steps = pairs.join(sums.select("strategy", "period", "end"), ["strategy", "period"]).groupBy("strategy").agg(F.array_sort(F.collect_list(F.struct("period", "end", "sw", "sh", "x"))).alias("k"))
    share = f"{cost}D * (s.sw - s.sh / a.f + aggregate(s.x, 0D, (t, v) -> t + abs(v.w - v.h / a.f)))"
    fold = f"""aggregate(k, named_struct('e', {capital}D, 'f', 1D, 'out', {start.format("e:double,c:double")}), (a, s) -> transform(array({share}), c -> named_struct(
        'e', a.e * (1 - c + s.end), 'f', 1 - c + s.end, 'out', concat(a.out, array(named_struct('period', s.period, 'e', a.e, 'c', c)))))[0], a -> a.out)"""
    starts = steps.select("strategy", F.inline(F.expr(fold)))
    out = day.join(starts, ["strategy", "period"]).withColumn("equity", F.col("e") * (1 - F.col("c") + F.col("s")))
    return out.select("strategy", "period", "date", "n_positions", "equity", F.col("c").alias("cost_share"))
