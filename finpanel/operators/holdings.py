"""Holdings: readiness of investor-asset matrices."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finpanel.functions import blank_to_null, over, require_columns, safe_div
from finpanel.operators.aggregates import filing_conflicts, matrix_summary, pair_values
from finpanel.operators.stages import cut


@dataclass(frozen=True)
class HoldingsSpec:
    """Which columns a holdings product uses for what."""

    investor: str = "investor"
    report_date: str = "report_date"
    filing: str = "filing"
    ordinal: str = "ordinal"
    asset: str = "asset"
    value: str = "value"
    category: str | None = None

    def check(self, df: DataFrame) -> None:
        require_columns(df, *[c for c in (self.investor, self.report_date, self.filing, self.asset, self.value, self.category) if c])


#: Pairs of a report date that a task peels.
TASK_PAIRS = 1_000_000
#: Nodes that a broadcast may hold.
FEW = 100_000
PAIR = ["report_date", "investor", "asset"]


def _peel(least_assets: int, least_investors: int):
    """All rounds of the filter over the pairs of one date: rows of pairs that stay, and rows of each round with its change of their number."""

    def run(table: pa.Table) -> pa.Table:
        table = table.select(PAIR)
        codes = []
        for c in PAIR[1:]:
            x = table.column(c).combine_chunks().dictionary_encode()
            codes.append((x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x).indices.to_numpy(zero_copy_only=False))
        alive, counts = np.arange(len(table)), [0, len(table)]
        while len(counts) < 3 or counts[-1] != counts[-2]:
            for code, least in zip(codes, (least_assets, least_investors), strict=True):
                alive = alive[np.bincount(code[alive], minlength=1)[code[alive]] >= least]
            counts.append(len(alive))
        changes = np.diff(counts)
        kept = table.take(pa.array(alive)).append_column("round", pa.nulls(len(alive), pa.int32())).append_column("change", pa.nulls(len(alive), pa.int64()))
        rounds = pa.table({c: pa.nulls(len(changes), table.schema.field(c).type) for c in PAIR} | {"round": pa.array(range(len(changes)), pa.int32()), "change": pa.array(changes, pa.int64())})
        return pa.concat_tables([kept, rounds])

    return run


def _rounds(pairs: DataFrame, least: dict[str, int], few: int) -> tuple[DataFrame, list[int]]:
    """The pairs that stay, and the change of their number in each round, by subtracting from kept degrees.

    Pairs and degrees are written once: a pair is gone if one of its nodes is. A half-round looks up the pairs of the
    nodes that have just fallen below their threshold, without moving the others where these nodes are few, and takes
    them off the degrees of their other ends; only the nodes that it touched can fall next.
    """
    pairs = cut(pairs)
    degrees = {s: cut(pairs.groupBy("report_date", s).agg(F.count(F.lit(1)).alias("d"))) for s in least}
    dead = {s: degrees[s].filter("false").select("report_date", s) for s in least}
    taken = {s: degrees[s].filter("false").select("report_date", s, F.col("d").alias("m")) for s in least}
    falling = {s: degrees[s].filter(F.col("d") < least[s]).select("report_date", s) for s in least}
    changes = [pairs.count()]
    while len(changes) < 2 or changes[-1]:
        gone = 0
        for s, o in (("investor", "asset"), ("asset", "investor")):
            now = cut(falling[s])
            n = now.count()
            if not n:
                continue
            lost = pairs.join(F.broadcast(now) if n <= few else now, ["report_date", s], "left_semi")
            for x in least:  # pairs that went before don't count again
                lost = lost.join(dead[x], ["report_date", x], "left_anti")
            minus = cut(lost.groupBy("report_date", o).agg(F.count(F.lit(1)).alias("m")))
            gone += minus.agg(F.sum("m")).first()[0] or 0
            dead[s] = cut(dead[s].unionByName(now))
            taken[o] = cut(taken[o].unionByName(minus).groupBy("report_date", o).agg(F.sum("m").alias("m")))
            touched = taken[o].join(minus.select("report_date", o), ["report_date", o], "left_semi").join(degrees[o], ["report_date", o])
            fell = touched.filter(F.col("d") - F.col("m") < least[o]).select("report_date", o)
            falling[s] = now.filter("false")
            falling[o] = falling[o].unionByName(fell).distinct().join(dead[o], ["report_date", o], "left_anti")
        changes.append(-gone)
    for s in least:
        pairs = pairs.join(dead[s], ["report_date", s], "left_anti")
    return pairs, changes


def degree_filter(pairs: DataFrame, *, least_assets: int, least_investors: int, task_pairs: int = TASK_PAIRS, few: int = FEW) -> tuple[DataFrame, list[tuple[int, int]]]:
    """P-18: drops investors with too few assets and then assets with too few investors, for each report date, until nothing changes; returns the pairs and the number of distinct ones after each round.

    Dates are independent. Those of up to ``task_pairs`` distinct pairs are peeled in a task each, all rounds at once;
    larger ones go through rounds of joins whose work falls with what a round removes. Rows with a null in a key are dropped.
    """
    pairs = cut(pairs.na.drop(subset=PAIR))  # read twice
    keys = pairs.select(*PAIR).distinct()
    large = cut(keys.groupBy("report_date").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > task_pairs).select("report_date"))
    kinds = ", ".join(f"{c} {keys.schema[c].dataType.simpleString()}" for c in PAIR)
    peeled = cut(keys.join(large, "report_date", "left_anti").groupBy("report_date").applyInArrow(_peel(least_assets, least_investors), f"{kinds}, round int, change long"))
    kept = peeled.filter("round is null").select(*PAIR)
    # a row for each round; a date that settles early changes no more
    changes = {r["round"]: r["change"] for r in peeled.filter("round is not null").groupBy("round").agg(F.sum("change").alias("change")).collect()}
    if not large.isEmpty():
        rest, more = _rounds(keys.join(large, "report_date", "left_semi"), {"investor": least_assets, "asset": least_investors}, few)
        kept = kept.unionByName(rest)
        changes = {i: changes.get(i, 0) + (more[i] if i < len(more) else 0) for i in range(max(len(more), len(changes)))}
    counts = [sum(changes.get(j, 0) for j in range(i + 1)) for i in range(max(len(changes), 2))]
    return pairs.join(kept, PAIR, "left_semi"), list(enumerate(counts))


def readiness_stages(df: DataFrame, spec: HoldingsSpec, *, positive: bool = True, categories: list[str] | None = None) -> list[tuple[str, object]]:
    """P-19: the named conditions in order."""
    out: list[tuple[str, object]] = [("investor", blank_to_null(F.col(spec.investor)).isNotNull()), ("asset", blank_to_null(F.col(spec.asset)).isNotNull()), ("value", F.col(spec.value).isNotNull())]
    if positive:
        out.append(("positive", F.col(spec.value) > 0))
    if categories and spec.category:
        out.append(("category", F.col(spec.category).isin(categories)))
    return out


def matrix_readiness(df: DataFrame, spec: HoldingsSpec, *, least_assets: int, least_investors: int, positive: bool = True, categories: list[str] | None = None) -> tuple[DataFrame, DataFrame, list[tuple[int, int]]]:
    """P-19: summary by report date, audit of the stages, and the filter's log; raises on investors with several filings for a date."""
    from finpanel.operators.universe import cascade, cascade_audit

    spec.check(df)
    if not filing_conflicts(df, date=spec.report_date, investor=spec.investor, filing=spec.filing).isEmpty():
        raise ValueError("investors with several filings for one report date")
    stages = readiness_stages(df, spec, positive=positive, categories=categories)
    audit = cascade_audit(df, stages)
    rows = cascade(df, stages).select(F.col(spec.report_date).alias("report_date"), F.col(spec.investor).alias("investor"), F.col(spec.asset).alias("asset"), F.col(spec.value).alias("value"))
    pairs, log = degree_filter(pair_values(rows, ["report_date", "investor", "asset"], "value"), least_assets=least_assets, least_investors=least_investors)
    return matrix_summary(pairs), audit, log


def one_filing(df: DataFrame) -> DataFrame:
    """Rows of the largest filing id of each investor and report date."""
    last = df.groupBy("report_date", "investor").agg(F.max("filing").alias("filing"))
    return df.join(last, ["report_date", "investor", "filing"], "left_semi")


def diversified(df: DataFrame, limit: float = 0.75) -> DataFrame:
    """P-20: rows of investors whose largest position is at most a share of their book."""
    w = Window.partitionBy("report_date", "investor")
    share = safe_div(F.max("value").over(w), F.sum("value").over(w))
    return df.withColumn("top_share", share).filter(F.col("top_share") <= limit)


def available_at(df: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """P-21: for each decision date the newest row of each key that was available by then."""
    x = df.join(F.broadcast(decisions), F.col("available_at") <= F.col("decision_at"))  # a few decision dates
    rn = F.row_number().over(over("decision_at", *keys, by=[F.desc("available_at"), F.desc("filing"), F.desc("ordinal"), F.desc("value")]))
    return x.withColumn("__rn", rn).filter("__rn = 1").drop("__rn")
