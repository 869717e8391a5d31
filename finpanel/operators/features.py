"""Gap-aware momentum, forward returns and cross-sectional buckets."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finpanel.functions import over, safe_div


def momentum(panel: DataFrame, months: tuple[int, ...] = (1, 3, 6, 12)) -> DataFrame:
    """W-5: product of the returns of the months before, null unless the row m - 1 back is exactly m - 1 months earlier; of one month it is the return."""
    w = over("assetid", by="ym")
    for m in months:
        if m == 1:
            panel = panel.withColumn("mom_1", F.col("ret"))
            continue
        frame = over("assetid", by="ym", rows=(-(m - 1), -1))
        whole = (F.lag("ym", m - 1).over(w) == F.col("ym") - (m - 1)) & (F.count("ret").over(frame) == m - 1)
        panel = panel.withColumn(f"mom_{m}", F.when(whole, F.product(1 + F.col("ret")).over(frame) - 1))
    return panel


def forward_return(panel: DataFrame) -> DataFrame:
    """W-6: the return of the next row if that is the next month."""
    w = over("assetid", by="ym")
    return panel.withColumn("fwd", F.when(F.lead("ym").over(w) == F.col("ym") + 1, F.lead("ret").over(w)))


def z_score(panel: DataFrame, column: str, by: str = "ym") -> DataFrame:
    """W-7: mean, sample deviation and z-score over the cross-section, null where all are equal."""
    w = over(by)
    return panel.withColumn(f"{column}_z", safe_div(F.col(column) - F.avg(column).over(w), F.stddev_samp(column).over(w)))


def bucket(panel: DataFrame, column: str, *, bins: int = 10, by: str = "ym", name: str | None = None) -> DataFrame:
    """W-8: quantile bucket with right-closed edges, equal edges dropped; fewer values than bins make as many bins as values.

    Edges are one aggregate for each cross-section, joined back; no cross-section is ever collected.
    """
    shares = sorted({Fraction(i, n) for n in range(1, bins + 1) for i in range(n + 1)})
    place = {f: i for i, f in enumerate(shares)}
    q = panel.filter(F.col(column).isNotNull()).groupBy(by).agg(F.percentile(column, F.array(*[F.lit(float(f)) for f in shares])).alias("__q"), F.count(column).alias("__n"))
    pick = F.lit(None)
    for n in range(1, bins + 1):
        at = F.array(*[F.col("__q")[place[Fraction(i, n)]] for i in range(n + 1)])
        pick = F.when((F.col("__n") >= n) if n == bins else (F.col("__n") == n), at).otherwise(pick)
    edges = q.select(by, "__n", F.array_distinct(pick).alias("__e"))
    below = F.aggregate(F.slice("__e", 2, F.greatest(F.size("__e") - 2, F.lit(0))), F.lit(1), lambda a, e: a + F.when(e < F.col(column), 1).otherwise(0))
    value = F.when(F.col(column).isNull(), None).when(F.size("__e") >= 2, below).when(F.col("__n") == 1, 1)
    return panel.join(edges, by, "left").withColumn(name or f"{column}_bucket", value.cast("int")).drop("__n", "__e")


def build_features(panel: DataFrame, months: tuple[int, ...] = (1, 3, 6, 12)) -> DataFrame:
    """P-17: momenta with z-scores, the forward return and its bucket as label, in one plan."""
    out = forward_return(momentum(panel, months))
    for m in months:
        out = z_score(out, f"mom_{m}")
    return bucket(out, "fwd", name="label")
