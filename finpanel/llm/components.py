"""Connected components by alternating large and small stars."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finpanel.llm.storage import cut

#: Links that a task merges at once, on average.
PART = 1 << 20


def connect(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``labels`` (of each place the smallest one that it is connected to) after the links between a and b."""
    while len(a):
        x, y = labels[a], labels[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (labels[labels] != labels).any():
            labels = labels[labels]
    return labels


def star(names: np.ndarray, labels: np.ndarray, columns: tuple[str, str] = ("a", "b")) -> pa.Table:
    """A link from each node to the first one that it is connected to."""
    at = np.flatnonzero(labels != np.arange(len(labels)))
    return pa.table(dict(zip(columns, (names[at], names[labels[at]]), strict=True)))


def _stars(links: DataFrame, side: int) -> DataFrame:
    """Links (u, v) that connect the same nodes as ``links``: those of a part become one from each node to the smallest that it reaches there.

    Tasks that each see some nodes of a group link them to as many different ones. A link's part is told by the hashes of
    both its ends, ``side`` places for each, so that a node is in few parts and one that many links share in several.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(side)).cast("int")

    def merge(table: pa.Table) -> pa.Table:
        u, v = (table.column(c).to_numpy() for c in ("u", "v"))
        names, own = np.unique(np.concatenate((u, v)), return_inverse=True)
        return star(names, connect(np.arange(len(names)), own[: len(u)], own[len(u) :]), ("u", "v"))

    return links.withColumn("part", place("u") * side + place("v")).groupBy("part").applyInArrow(merge, "u long, v long")


def _mark(links: DataFrame) -> tuple:
    """The count of links and the sum of their hashes."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(links: DataFrame, a: str, b: str, *, rounds: int = 50, about: int | None = None) -> DataFrame:
    """node and root (the smallest node it reaches) of every node that has a link; self-links and repeats are harmless.

    Links that tasks found apart are merged in parts, again as long as that halves them; what one part holds is settled
    then, the rest in rounds. Each round joins links with minima that are aggregated before the shuffle; no neighbour list
    is ever built, and a node that many links share is a skewed join key, which Spark splits. It stops when a round changes nothing.
    Where it is known ``about`` how many links there may be, they are merged once before they are written.
    """
    now = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v")
    now = cut(_stars(now, math.ceil(math.sqrt(math.ceil(about / PART) or 1))).distinct() if about is not None else now)
    left = now.count()
    while (side := math.ceil(math.sqrt(math.ceil(left / PART)))) > 1:
        now = cut(_stars(now, side).distinct())
        before = _mark(now)
        if 2 * before[0] > left:
            now = _settled(now, before, rounds)
            break
        left = before[0]
    else:
        now = cut(_stars(now, 1))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _settled(now: DataFrame, before: tuple, rounds: int) -> DataFrame:
    """``now``, whose mark is ``before``, as links from each node to the smallest that it reaches."""
    for _ in range(rounds):
        # large star: neighbours above a node move to the smallest node around it
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: a node's smaller neighbours and itself move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = cut(small.filter("u <> v").distinct())
        mark = _mark(now)
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    return now
