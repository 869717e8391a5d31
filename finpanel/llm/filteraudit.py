"""Filter interaction audit by difference arrays over the Lehmer ranks of filter orders.

Each document has a mask: the filters that it fails. The mask alone decides where an order of the filters removes it: at
the first filter of the order that is in the mask. In the lexicographic list of all orders, those that begin with a given
prefix are one interval, and the ranks of its ends follow from the prefix's Lehmer digits. A mask is removed at step s by
the intervals of the prefixes of length s whose last filter alone is in the mask. So its counts are added at the
beginning of each such interval and subtracted at its end, and a prefix sum over the ranks gives what each step of each
order removes, without walking through the orders for any document.

Spark makes one small row of each document (mask, part, digest of the text) in one scan; what is gathered are counts by
part and mask, 32 for each part at most. No key is a text's group: a document is compared with its text's smallest id by
joining on digest and id together.

Defined results: a null text is an empty one; a null part is the empty string; a row with a null id never fails the
filter of identical texts, is nobody's smaller id and has no labels; rows that repeat an id count each, and do not make
one another fail, whatever their text; of several labels of one id any 1 counts; an empty table has no part and no rows;
further columns are ignored. Texts are compared by SHA-256.
"""

from __future__ import annotations

from functools import cache
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finpanel.llm.storage import cut

LETTERS = "ABCDE"
RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def rank_interval(prefix: tuple[int, ...], k: int) -> tuple[int, int]:
    """First rank, and the one after the last, of the orders of k filters that begin so."""
    low = 0
    for i, x in enumerate(prefix):
        digit = x - sum(y < x for y in prefix[:i])  # smaller filters that are still free
        low += digit * factorial(k - 1 - i)
    return low, low + factorial(k - len(prefix))


@cache
def intervals(k: int) -> np.ndarray:
    """Rows (mask, step, first rank, end) of where masks are removed; bit i of a mask is filter i, steps count from 0."""
    out = []
    for step in range(k):
        for prefix in permutations(range(k), step + 1):
            low, high = rank_interval(prefix, k)
            out += [(m, step, low, high) for m in range(1 << k) if m >> prefix[-1] & 1 and not any(m >> x & 1 for x in prefix[:-1])]
    return np.array(out, dtype=np.int64)


def removals(counts: np.ndarray) -> np.ndarray:
    """What each step of each order removes, as [step, rank, measure], of counts by mask and measure."""
    k = len(counts).bit_length() - 1
    mask, step, low, high = intervals(k).T
    steps = np.zeros((k, factorial(k) + 1, counts.shape[1]), dtype=np.int64)
    np.add.at(steps, (step, low), counts[mask])
    np.subtract.at(steps, (step, high), counts[mask])
    return steps.cumsum(axis=1)[:, :-1]


def masks(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """doc_id, part and mask of each row: A (bit 0) under 100 words, B under 80 % distinct words, C over 10 % capitals, D special characters, E a smaller id has the text."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), t.alias("t"))
    rows = rows.withColumn("w", F.regexp_extract_all("t", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    n, distinct = F.size("w").cast("long"), F.size(F.array_distinct("w")).cast("long")
    capitals, points = F.regexp_count("t", F.lit("[A-Z]")).cast("long"), F.char_length("t").cast("long")
    fails = [n < 100, 100 * distinct < 80 * n, 100 * capitals > 10 * points, F.col("t").rlike(r"[#$%&*|]")]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    rows = cut(rows.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("t", 256)).alias("digest")))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    named = rows.filter("doc_id is not null").join(first, ["digest", "doc_id"], "left")
    named = named.select("doc_id", "part", F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask") + (1 << 4)).alias("mask"))
    return named.unionByName(rows.filter("doc_id is null").select("doc_id", "part", "mask"))


def cells(found: DataFrame, labels: DataFrame) -> DataFrame:
    """n, good and toxic (documents labelled so) by part and mask."""
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("bad"))
    labelled = found.filter("doc_id is not null").join(known, "doc_id", "left").select("part", "mask", "good", "bad")
    rest = found.filter("doc_id is null").select("part", "mask", F.lit(None).cast("boolean").alias("good"), F.lit(None).cast("boolean").alias("bad"))
    return labelled.unionByName(rest).groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("bad").alias("toxic"))


def audit(counted: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row for each part, order of the filters (named by ``letters``, ascending) and step, from cells (part, mask, n, good, toxic)."""
    k = len(letters)

    def run(table: pa.Table) -> pa.Table:
        counts = np.zeros((1 << k, 3), dtype=np.int64)
        counts[table.column("mask").to_numpy()] = np.stack([table.column(c).to_numpy() for c in ("n", "good", "toxic")], axis=1)
        removed = removals(counts).transpose(1, 0, 2)  # rank, step, measure
        orders = np.array(list(permutations(range(k))), dtype=np.int64)
        holds = (np.arange(1 << k)[:, None] >> np.arange(k)) & 1
        fails, alone = (counts[:, :1] * holds).sum(axis=0), counts[1 << np.arange(k), 0]
        value = np.bincount(orders.ravel(), weights=removed[:, :, 0].ravel(), minlength=k).astype(np.int64)
        cols = {"kept": counts[:, 0].sum() - removed[:, :, 0].cumsum(axis=1), "removed": removed[:, :, 0], "redundant": fails[orders] - removed[:, :, 0], "unique_fails": alone[orders]}
        cols |= {"good_lost": removed[:, :, 1], "toxic_lost": removed[:, :, 2], "shapley": value[orders]}
        names = ["".join(letters[x] for x in o) for o in orders.tolist()]
        head = {"part": pa.array([table.column("part")[0].as_py()] * orders.size), "filter_order": pa.array(np.repeat(names, k).tolist()), "step": pa.array(np.tile(np.arange(1, k + 1), len(orders)).astype(np.int32))}
        return pa.table(head | {c: pa.array(v.ravel().astype(np.int64)) for c, v in cols.items()})

    return counted.groupBy("part").applyInArrow(run, RESULT)


def filter_audit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """The audit of the five filters of ``masks`` over ``docs``, with ``labels`` (doc_id, quality, toxic)."""
    return audit(cells(masks(docs, doc_id=doc_id, text=text, part=part), labels))
