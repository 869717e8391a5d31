"""Roll-ups, profiles and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finpanel.functions import blank_to_null, over, safe_div
from finpanel.operators.quantiles import exact_quantiles
from finpanel.operators.stages import kept


def downsample(bars: DataFrame, every: str = "30 minutes", *, watermark: str | None = None) -> DataFrame:
    """A-6: bars of a coarser interval; intervals without bars don't appear. With a watermark it runs on a stream too."""
    if watermark:
        bars = bars.withWatermark("ts", watermark)
    return bars.groupBy("ticker", F.window("ts", every).alias("w")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")
    ).select("ticker", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def daily_open_close(bars: DataFrame) -> DataFrame:
    """A-7."""
    return bars.groupBy("ticker", F.to_date("ts").alias("date")).agg(F.min_by("open", "ts").alias("open"), F.max_by("close", "ts").alias("close"), F.count(F.lit(1)).alias("n_bars"))


def confusion(pred: DataFrame, k: int, *, guess: str = "pred", truth: str = "label") -> DataFrame:
    """A-9 and A-11: a dense grid of k by k classes with counts, zeros kept, and shares of each guess."""
    counts = pred.filter(F.col(guess).isNotNull() & F.col(truth).isNotNull()).groupBy(F.col(guess).cast("int").alias("guess"), F.col(truth).cast("int").alias("truth")).agg(F.count(F.lit(1)).alias("n"))
    classes = F.sequence(F.lit(1), F.lit(k))
    grid = pred.sparkSession.range(1).select(F.explode(classes).alias("guess")).select("guess", F.explode(classes).alias("truth"))
    full = grid.join(counts, ["guess", "truth"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("share", safe_div(F.col("n"), F.sum("n").over(over("guess"))))


def class_accuracy(pred: DataFrame, k: int, *, guess: str = "pred", truth: str = "label") -> DataFrame:
    """A-10: accuracy, and precision, recall and share of guesses of each class, zero where empty."""
    grid = confusion(pred, k, guess=guess, truth=truth)
    per = grid.select(F.col("guess").alias("class"), F.col("n"), F.lit("g").alias("side"), (F.col("guess") == F.col("truth")).alias("hit")).unionByName(grid.select(F.col("truth").alias("class"), F.col("n"), F.lit("t").alias("side"), (F.col("guess") == F.col("truth")).alias("hit")))
    sums = per.groupBy("class").agg(F.sum(F.when((F.col("side") == "g") & F.col("hit"), F.col("n")).otherwise(0)).alias("hits"), F.sum(F.when(F.col("side") == "g", F.col("n")).otherwise(0)).alias("guessed"), F.sum(F.when(F.col("side") == "t", F.col("n")).otherwise(0)).alias("true"))
    total = sums.agg(F.sum("guessed").alias("total"), F.sum("hits").alias("right"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return sums.crossJoin(F.broadcast(total)).select("class", z(safe_div(F.col("hits"), F.col("guessed"))).alias("precision"), z(safe_div(F.col("hits"), F.col("true"))).alias("recall"), z(safe_div(F.col("guessed"), F.col("total"))).alias("share"), z(safe_div(F.col("right"), F.col("total"))).alias("accuracy"))  # total is one row


def bimodality(pred: DataFrame, k: int, *, guess: str = "pred", truth: str = "label", least: int = 10) -> DataFrame:
    """A-12: shares of the tails that end up in either tail, by month and averaged over months; small months and empty tails are left out."""
    top, low = F.col(guess) == k, F.col(guess) == 1
    by_month = pred.groupBy("ym").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(top).alias("nh"), F.count_if(low).alias("nl"),
        F.avg(F.when(top, (F.col(truth) == k).cast("double"))).alias("hh"), F.avg(F.when(top, (F.col(truth) == 1).cast("double"))).alias("hl"),
        F.avg(F.when(low, (F.col(truth) == 1).cast("double"))).alias("ll"), F.avg(F.when(low, (F.col(truth) == k).cast("double"))).alias("lh"),
    ).filter(f"n >= {least} and nh > 0 and nl > 0")
    return by_month.agg(F.count(F.lit(1)).alias("months"), *[F.avg(c).alias(c) for c in ("hh", "hl", "ll", "lh")], F.avg((F.col("hh") + F.col("ll") - F.col("hl") - F.col("lh")) / 2).alias("bm"))


def _stacked(one_row: DataFrame, names: list[str], fields: list[str]) -> DataFrame:
    """One wide row as a row for each name."""
    return one_row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), *[F.col(f"{f}__{n}").alias(f) for f in fields]) for n in names])).alias("s")).select("s.*")


def schema_profile(df: DataFrame, *, approximate: bool = False) -> DataFrame:
    """A-13: values, nulls, null share and distinct values of each column, in one pass."""
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    aggs = []
    for c in df.columns:
        aggs += [F.count(c).alias(f"filled__{c}"), (F.count(F.lit(1)) - F.count(c)).alias(f"nulls__{c}"), (safe_div(F.count(F.lit(1)) - F.count(c), F.count(F.lit(1))) * 100).alias(f"null_pct__{c}"), distinct(c).alias(f"n_distinct__{c}")]
    return _stacked(df.agg(*aggs), df.columns, ["filled", "nulls", "null_pct", "n_distinct"])


def timing_profile(df: DataFrame, *, report: str, filed: str, available: str) -> DataFrame:
    """A-14: range, gaps and distinct values of each date, and rows that were available before they were filed or report a period after it."""
    dates = {"report": report, "filed": filed, "available": available}
    aggs = []
    for n, c in dates.items():
        aggs += [F.min(c).alias(f"lo__{n}"), F.max(c).alias(f"hi__{n}"), F.count_if(F.col(c).isNull()).alias(f"missing__{n}"), F.countDistinct(c).alias(f"n_distinct__{n}")]
    bad = {"report": F.col(report) > F.col(filed), "available": F.col(available) < F.col(filed), "filed": F.lit(False)}
    aggs += [F.count_if(bad[n]).alias(f"violations__{n}") for n in dates]
    return _stacked(df.agg(*aggs), list(dates), ["lo", "hi", "missing", "n_distinct", "violations"])


def identifier_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """A-15: rows with a value that isn't blank, their share and distinct values."""
    aggs = []
    for c in columns:
        v = blank_to_null(F.col(c))
        aggs += [F.count(v).alias(f"filled__{c}"), (safe_div(F.count(v), F.count(F.lit(1))) * 100).alias(f"pct__{c}"), F.countDistinct(v).alias(f"n_distinct__{c}")]
    return _stacked(df.agg(*aggs), columns, ["filled", "pct", "n_distinct"])


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """A-16: rows of keys that occur several times, all copies counted, and such keys."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_rows"), F.count(F.lit(1)).alias("duplicate_keys"))


def extra_copies(df: DataFrame, keys: list[str]) -> DataFrame:
    """A-22: copies behind the first one."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra"))


def filing_conflicts(df: DataFrame, *, date: str, investor: str, filing: str) -> DataFrame:
    """A-17: investors with several filings for a date."""
    return df.groupBy(date, investor).agg(F.countDistinct(filing).alias("filings")).filter("filings > 1")


def value_profile(df: DataFrame, column: str) -> DataFrame:
    """A-18: missing, negative, zero and positive values, and quantiles."""
    v = F.col(column).try_cast("double") if hasattr(Column, "try_cast") else F.expr(f"try_cast({column} as double)")
    df, v = kept(df.select(v.alias("v")), "profile"), F.col("v")
    one = df.agg(F.count_if(v.isNull()).alias("missing"), F.count_if(v < 0).alias("negative"), F.count_if(v == 0).alias("zero"), F.count_if(v > 0).alias("positive"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    one = one.crossJoin(exact_quantiles(df, v, [0.01, 0.5, 0.99]))  # one row each
    return one.select("missing", "negative", "zero", "positive", "lo", F.col("q")[0].alias("p01"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p99"), "hi")


def portfolio_profile(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A-19: quantiles of group sizes and group values."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("v"))
    half = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    one = g.agg(F.count(F.lit(1)).alias("groups"), F.percentile("n", half).alias("n"), F.percentile("v", half).alias("v"))
    return one.select("groups", *[F.col(c)[i].alias(f"{c}_p{p}") for c in ("n", "v") for i, p in enumerate((25, 50, 75))])


def category_profile(df: DataFrame, columns: list[str], top: int = 5) -> DataFrame:
    """A-20: the commonest values of each column, missing ones as such, with their share of all rows."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.coalesce(blank_to_null(F.col(c)), F.lit("<MISSING>")).alias("value")) for c in columns])).alias("s")).select("s.*")
    n = long.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("rank", F.row_number().over(over("name", by=[F.desc("n"), F.asc("value")]))).filter(F.col("rank") <= top)
    return n.crossJoin(F.broadcast(total)).select("name", "value", "n", (100 * F.col("n") / F.col("total")).alias("pct"), "rank")  # total is one row


def na_report(df: DataFrame, label: str) -> DataFrame:
    """A-21: nulls and zeros of each column of a table, with its number of cells."""
    kinds = dict(df.dtypes)
    aggs = []
    for c in df.columns:
        zero = F.count_if(F.col(c) == 0) if kinds[c] in ("int", "bigint", "double", "float") else F.lit(0).cast("long")
        aggs += [(safe_div(F.count_if(F.col(c).isNull()), F.count(F.lit(1))) * 100).alias(f"null_pct__{c}"), zero.alias(f"zeros__{c}"), (F.count(F.lit(1)) * len(df.columns)).alias(f"cells__{c}")]
    return _stacked(df.agg(*aggs), df.columns, ["null_pct", "zeros", "cells"]).withColumn("table_name", F.lit(label))


def describe(df: DataFrame, key: str, value: str) -> DataFrame:
    """A-23: count, mean, deviation, extremes and quartiles for each key."""
    q = exact_quantiles(df, value, [0.25, 0.5, 0.75], key=key).withColumnRenamed(key, "__k")
    g = df.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    g = g.join(q, F.col(key).eqNullSafe(F.col("__k")))
    return g.select(key, "n", "mean", "sd", "lo", *[F.col("q")[i].alias(f"p{p}") for i, p in enumerate((25, 50, 75))], "hi")


def seasonality(returns: DataFrame, *, key: str) -> DataFrame:
    """A-25: mean return and share of positive ones by calendar month."""
    return returns.groupBy(key, F.month("date").alias("month")).agg(F.avg("ret").alias("mean_ret"), F.avg((F.col("ret") > 0).cast("double")).alias("positive"), F.avg((F.col("ret") < 0).cast("double")).alias("negative"))


def year_month_matrix(returns: DataFrame, *, key: str | None = None) -> DataFrame:
    """A-25 and U-4: a row for each year, and for each key in it, and a column for each month with the summed return."""
    return returns.groupBy(*([key] if key else []), F.year("date").alias("year")).pivot("m", list(range(1, 13))).agg(F.sum("ret"))


def bin_stats(rows: DataFrame, bin_: str, value: str) -> DataFrame:
    """A-26: count, mean, median, deviation and extremes by bin."""
    return rows.groupBy(bin_).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_samp(value).alias("sd"), F.min(value).alias("lo"), F.max(value).alias("hi"))


def matrix_summary(pairs: DataFrame) -> DataFrame:
    """A-34: investors, assets, pairs, density and median degrees for each report date."""
    by_investor = pairs.groupBy("report_date", "investor").agg(F.countDistinct("asset").alias("d")).groupBy("report_date").agg(F.count(F.lit(1)).alias("investors"), F.median("d").alias("investor_degree"))
    by_asset = pairs.groupBy("report_date", "asset").agg(F.countDistinct("investor").alias("d")).groupBy("report_date").agg(F.count(F.lit(1)).alias("assets"), F.median("d").alias("asset_degree"))
    n = pairs.groupBy("report_date").agg(F.count(F.lit(1)).alias("pairs"))
    out = n.join(by_investor, "report_date").join(by_asset, "report_date")
    return out.withColumn("density_pct", 100 * F.col("pairs") / (F.col("investors") * F.col("assets")))


def pair_values(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A-35: sums of values by pair, null where no value is there."""
    return rows.groupBy(*keys).agg(F.sum(value).alias(value))


def with_total(rows: DataFrame, key: str, value: str) -> DataFrame:
    """A-37: sums by key and a total row with a null key."""
    return rows.rollup(key).agg(F.sum(value).alias(value), F.count(F.lit(1)).alias("n"))
