"""Exact quantiles of groups of any size with bounded state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finpanel.operators.stages import cut, kept

#: Values that an aggregate may hold for a group.
HELD = 100_000
#: Rows that a broadcast may hold.
FEW = 100_000
#: Rank error, as a share of a bracket's values, that the brackets of a sketch are widened by.
SLACK = 0.02
#: Shares that a sketch is asked for.
GRID = 100


def _number(value: Column) -> Column:
    v = value.try_cast("double") if hasattr(Column, "try_cast") else value.cast("double")
    return F.when(~F.isnan(v), v)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= FEW else df


def _narrowed(rows: DataFrame, asks: DataFrame, held: int) -> DataFrame:
    """Exact values of ranks: ``asks`` (k, rank) over ``rows`` (k, v) as (k, rank, value), by brackets that a sketch proposes and a count proves.

    A bracket is a range of values with the number of values below it. A mergeable sketch of what lies in it proposes a
    narrower one around the rank; counting what lies below and in the proposal either proves it or, as the rank lies on
    one side of it, leaves that side. So each pass reads the rows and keeps a sketch and a few counts for each rank; the
    bracket shrinks to a twentieth or so, until it holds no more than ``held`` values, or one value many times. A proposal
    that is the whole bracket, as between two values of very many rows, is followed by one of a single value.
    """
    bounds = rows.groupBy("k").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("m"))
    open_ = cut(asks.join(bounds, asks["k"].eqNullSafe(bounds["k"])).select(asks["k"], "rank", "lo", "hi", F.lit(0).cast("long").alias("below"), "m", F.lit(False).alias("stuck")))
    done = []
    while True:
        small = open_.filter((F.col("m") <= held) | (F.col("lo") == F.col("hi")))
        done.append(small)
        open_ = open_.filter((F.col("m") > held) & (F.col("lo") < F.col("hi")))
        if open_.isEmpty():
            break
        inside = rows.withColumnRenamed("k", "rk").join(_small(open_), F.col("rk").eqNullSafe(F.col("k")) & F.col("v").between(F.col("lo"), F.col("hi")))
        share = (F.col("rank") - F.col("below")) / F.col("m")
        sketch = inside.groupBy("k", "rank", "lo", "hi", "below", "m", "stuck").agg(F.kll_sketch_agg_double("v", F.lit(400)).alias("s"))
        # a sketch is asked for a grid of shares; the bracket takes those around the rank's
        at = F.kll_sketch_get_quantile_double("s", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]))
        low = F.when(F.col("stuck"), F.round(share * GRID)).otherwise(F.floor((share - SLACK) * GRID))
        high = F.when(F.col("stuck"), F.round(share * GRID)).otherwise(F.ceil((share + SLACK) * GRID))
        clip = lambda x: F.least(F.greatest(x.cast("int"), F.lit(0)), F.lit(GRID))
        sketch = sketch.withColumn("grid", at).withColumn("a", F.col("grid")[clip(low)]).withColumn("b", F.col("grid")[clip(high)])
        tried = cut(sketch.select("k", "rank", "lo", "hi", "below", "m", "a", "b"))
        counted = rows.withColumnRenamed("k", "rk").join(_small(tried), F.col("rk").eqNullSafe(F.col("k")) & F.col("v").between(F.col("lo"), F.col("hi")))
        # the largest value below the proposal and the smallest above it end the sides
        n = counted.groupBy("k", "rank", "lo", "hi", "below", "m", "a", "b").agg(
            F.count_if(F.col("v") < F.col("a")).alias("under"), F.count_if(F.col("v").between(F.col("a"), F.col("b"))).alias("within"),
            F.max(F.when(F.col("v") < F.col("a"), F.col("v"))).alias("left"), F.min(F.when(F.col("v") > F.col("b"), F.col("v"))).alias("right"),
        )
        before, beyond = F.col("rank") < F.col("below") + F.col("under"), F.col("rank") >= F.col("below") + F.col("under") + F.col("within")
        side = lambda a, b, c: F.when(before, a).when(beyond, b).otherwise(c)
        after = F.col("below") + F.col("under") + F.col("within")
        open_ = cut(
            n.select(
                "k", "rank", side(F.col("lo"), F.col("right"), F.col("a")).alias("lo"), side(F.col("left"), F.col("hi"), F.col("b")).alias("hi"),
                side(F.col("below"), after, F.col("below") + F.col("under")).alias("below"), side(F.col("under"), F.col("m") - F.col("under") - F.col("within"), F.col("within")).alias("m"), (F.col("within") == F.col("m")).alias("stuck"),
            )
        )
    left = done[0]
    for d in done[1:]:
        left = left.unionByName(d)
    one = left.filter("lo = hi").select("k", "rank", F.col("lo").alias("value"))
    some = cut(left.filter("lo < hi"))
    last = rows.withColumnRenamed("k", "rk").join(_small(some), F.col("rk").eqNullSafe(F.col("k")) & F.col("v").between(F.col("lo"), F.col("hi")))
    last = last.groupBy("k", "rank", "below").agg(F.sort_array(F.collect_list("v")).alias("x"))  # held values at most
    return one.unionByName(last.select("k", "rank", F.col("x")[(F.col("rank") - F.col("below")).cast("int")].alias("value")))


def exact_quantiles(df: DataFrame, value: str | Column, shares: list[float], *, key: str | None = None, held: int = HELD) -> DataFrame:
    """The key and q, the interpolated quantiles of ``value`` as an array, of each group; the same as ``percentile``, which holds all distinct values of a group in one task.

    Groups of up to ``held`` values go through that; larger ones through brackets. Null and NaN are no values; a group
    without any has null. Without a key, all rows are one group, and there is one row in any case. Keys and values are
    written once, as each pass would make ``df`` anew.
    """
    v = _number(F.col(value) if isinstance(value, str) else value)
    rows = kept(df.select((F.col(key) if key else F.lit(0)).alias("k"), v.alias("v")), "values")
    sizes = cut(rows.groupBy("k").agg(F.count("v").alias("n")))
    large = sizes.filter(F.col("n") > held)
    whole = F.percentile("v", F.array(*[F.lit(x) for x in shares]))
    if large.isEmpty():
        out = rows.groupBy("k").agg(whole.alias("q"))
    else:
        large = cut(large)
        few = rows.withColumnRenamed("k", "rk").join(_small(large.select("k")), F.col("rk").eqNullSafe(F.col("k")), "left_anti").withColumnRenamed("rk", "k")
        rows = rows.filter("v is not null")
        places = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(x) * (F.col("n") - 1)).alias("place")) for i, x in enumerate(shares)])
        asks = large.select("k", F.explode(places).alias("p")).select("k", "p.i", "p.place", F.floor("p.place").alias("low"), F.ceil("p.place").alias("high"))
        ranks = asks.select("k", F.explode(F.array("low", "high")).alias("rank")).distinct()
        found = cut(_narrowed(rows, ranks, held))
        pick = lambda c, as_: found.select(F.col("k").alias(f"{as_}k"), F.col("rank").alias(f"{as_}r"), F.col("value").alias(as_))
        x = asks
        for c, as_ in (("low", "a"), ("high", "b")):
            y = pick(c, as_)
            x = x.join(y, x["k"].eqNullSafe(y[f"{as_}k"]) & (x[c] == y[f"{as_}r"]))
        between = F.when(F.col("low") == F.col("high"), F.col("a")).otherwise((F.col("high") - F.col("place")) * F.col("a") + (F.col("place") - F.col("low")) * F.col("b"))
        many = x.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("i", between.alias("v")))).alias("q")).select("k", F.col("q.v").alias("q"))  # an entry for each share
        out = few.groupBy("k").agg(whole.alias("q")).unionByName(many)
    if key:
        return out.withColumnRenamed("k", key)
    return df.sparkSession.range(1).join(out, F.col("id") == F.col("k"), "left").select("q")
