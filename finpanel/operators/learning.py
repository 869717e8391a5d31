"""Class probabilities: decisions, class statistics, schedules and a walk-forward classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finpanel.functions import safe_div
from finpanel.operators.joins import history
from finpanel.operators.stages import kept


def naive_class(pred: DataFrame) -> DataFrame:
    """P-11: the likeliest class, from 1; the first of equals."""
    return pred.withColumn("pred", F.array_position("probs", F.array_max("probs")).cast("int"))


def class_stats(panel: DataFrame, schedule: DataFrame, k: int, *, months: int = 120, label: str = "label", value: str = "fwd") -> DataFrame:
    """P-12: mean and deviation of each class over the months before each training month, 0 and 0.01 where a class has none."""
    seen = history(schedule, panel.filter(F.col(label).isNotNull()), months).groupBy("train_ym", label).agg(F.avg(value).alias("mu"), F.stddev_samp(value).alias("sigma"))
    grid = schedule.select("train_ym", F.explode(F.sequence(F.lit(1), F.lit(k))).alias(label))
    return grid.join(seen, ["train_ym", label], "left").withColumn("mu", F.coalesce("mu", F.lit(0.0))).withColumn("sigma", F.coalesce("sigma", F.lit(0.01)))


def reclassify(pred: DataFrame, mu: list[float], sigma: list[float], alpha: float = 0.25) -> DataFrame:
    """P-11: expected return, its ratio to total deviation, and its ratio to the mean of the worst ``alpha`` of classes, of which the last enters in part."""
    m, s = F.array(*[F.lit(float(x)) for x in mu]), F.array(*[F.lit(float(x)) for x in sigma])
    add = lambda a, v: a + v
    dot = lambda x: F.aggregate(F.zip_with("probs", x, lambda p, v: p * v), F.lit(0.0), add)
    out = pred.withColumn("ret_score", dot(m))
    second = F.aggregate(F.zip_with("probs", F.zip_with(m, s, lambda a, b: a * a + b * b), lambda p, v: p * v), F.lit(0.0), add)
    out = out.withColumn("srp_score", safe_div(F.col("ret_score"), F.sqrt(F.greatest(second - F.col("ret_score") ** 2, F.lit(0.0)))))
    # classes stand in order of their mean
    start = F.struct(F.lit(0.0).alias("cum"), F.lit(0.0).alias("tail"))
    walk = F.aggregate(F.zip_with("probs", m, lambda p, v: F.struct(p.alias("p"), v.alias("v"))), start, lambda a, x: F.struct((a["cum"] + x["p"]).alias("cum"), (a["tail"] + F.least(x["p"], F.greatest(F.lit(alpha) - a["cum"], F.lit(0.0))) * x["v"]).alias("tail")))
    return out.withColumn("cvar", walk["tail"] / alpha).withColumn("cvr_score", safe_div(F.col("ret_score"), F.abs("cvar")))


def training_schedule(panel: DataFrame, *, first: int = 120, every: int = 12) -> DataFrame:
    """P-13: the training month of each prediction month: the first one lies ``first`` months behind the start, then one every ``every`` observed months."""
    months = panel.select("ym").distinct()
    w = Window.orderBy("ym")  # as many rows as months
    months = months.withColumn("start", F.min("ym").over(w)).filter(F.col("ym") >= F.col("start") + first)
    months = months.withColumn("train_no", F.floor((F.row_number().over(w) - 1) / every))
    return months.withColumn("train_ym", F.min("ym").over(Window.partitionBy("train_no"))).select("ym", "train_no", "train_ym")


def folds(days: DataFrame, *, train: int = 24, test: int = 6, step: int = 6) -> DataFrame:
    """P-14: rolling folds over a calendar: months of training, then of testing, each fold a step later; days of each part."""
    span = days.agg(F.trunc(F.min("date"), "MM").alias("lo"), F.trunc(F.max("date"), "MM").alias("hi"))
    starts = span.select(F.posexplode(F.expr(f"sequence(lo, add_months(hi, -{train + test - 1}), interval {step} months)")).alias("fold", "start"))
    cut = starts.select("fold", "start", F.add_months("start", train).alias("mid"), F.add_months("start", train + test).alias("stop"))
    rows = days.select("date").join(F.broadcast(cut), (F.col("date") >= F.col("start")) & (F.col("date") < F.col("stop")))  # a fold for every six months
    return rows.groupBy("fold", "start", "mid", "stop").agg(F.count_if(F.col("date") < F.col("mid")).alias("train_days"), F.count_if(F.col("date") >= F.col("mid")).alias("test_days"))


def walk_forward(panel: DataFrame, features: list[str], *, label: str = "label", first: int = 24, every: int = 24, months: int = 120, trees: int = 10, depth: int = 4, seed: int = 7) -> DataFrame:
    """P-15: class probabilities of each month from a forest trained on the months before its training month.

    One forest for each training date; the loop is over dates, the data stay in Spark. The panel's columns are written once, as
    each forest reads its months many times.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    panel = kept(panel.select("assetid", "ym", label, *features), "panel")
    plan = kept(training_schedule(panel, first=first, every=every), "schedule")  # a row for each month
    whole = panel.na.drop(subset=features)
    rows = VectorAssembler(inputCols=features, outputCol="x").transform(whole)
    out = None
    for r in plan.select("train_no", "train_ym").distinct().orderBy("train_no").collect():  # a row for each retraining
        past = rows.filter((F.col("ym") >= r["train_ym"] - months) & (F.col("ym") < r["train_ym"]) & F.col(label).isNotNull())
        past = past.withColumn("y", F.col(label).cast("double") - 1)
        model = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=trees, maxDepth=depth, seed=seed).fit(past)
        now = rows.join(plan.filter(F.col("train_no") == r["train_no"]).select("ym"), "ym", "left_semi")
        scored = model.transform(now).select("assetid", "ym", label, vector_to_array("probability").alias("probs"))
        out = scored if out is None else out.unionByName(scored)
    if out is None:
        raise ValueError("the panel is shorter than the first training span")
    return out
