"""Approximate nearest neighbours by cross-polytope hashing.

Each of ``tables`` tables turns a unit vector by three rounds of random signs and a fast Hadamard transform and files
it under the nearest signed axis. A query looks under the ``probes`` axes nearest to it in every table, and what it
meets there is ranked by the exact cosine of the original vectors in double precision.

Equal vectors are one entry: before anything is shuffled each batch keeps the smallest ids of equal vectors, as many as
a query can return and one more, and no others can be among its nearest. Axes with many entries or queries are cut into
blocks by a hash, and every pair of blocks is a task of its own, so nothing is left out. A pair returns the best few
of each query.

Defined results: rows with a null id, and vectors that are null, empty, zero or hold null or non-finite components,
take no part; vectors of different lengths never meet; a repeated id counts once with its best score; ties go to the
smaller id; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finpanel.llm.storage import cut

BLOCK = 8192
#: More than two cosines can be apart that are computed in two ways.
MARGIN = 1e-9
RESULT = "query_id long, rank int, vec_id long, score double"


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Hadamard transform of each row; the length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def axes(unit: np.ndarray, table: int, probes: int, seed: int) -> np.ndarray:
    """The nearest signed axes of each row in one table, nearest first."""
    size = 1 << max(0, (unit.shape[1] - 1).bit_length())
    y = np.zeros((len(unit), size))
    y[:, : unit.shape[1]] = unit
    signs = np.random.default_rng((seed, table, size)).choice((-1.0, 1.0), (3, size))
    for s in signs:
        y = hadamard(y * s)
    both = np.concatenate((y, -y), axis=1)
    if probes == 1:
        return both.argmax(axis=1)[:, None]
    return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def _vectors(batch: pa.RecordBatch, kind: str) -> tuple[np.ndarray, list[bytes]]:
    """The rows that take part and their vectors as bytes of the type they have."""
    ids, lists = batch.column(0), batch.column(1)
    whole = ids.is_valid().to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = ~np.isfinite(values) | flat.is_null().to_numpy(zero_copy_only=False)
    counts = np.concatenate(([0], np.cumsum(bad)))
    some = np.concatenate(([0], np.cumsum((values != 0) & ~bad)))
    a, b = offsets[:-1], offsets[1:]
    ok = whole & lists.is_valid().to_numpy(zero_copy_only=False) & (counts[b] == counts[a]) & (some[b] > some[a])
    rows = np.flatnonzero(ok)
    values = (values + 0.0).astype(kind)  # no negative zeros
    return rows, [values[a[i] : b[i]].tobytes() for i in rows.tolist()]


def _key(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(len(raw), -1)
    with np.errstate(over="ignore"):
        scale = np.abs(x).max(axis=1, keepdims=True)
        y = x / scale
    return y / np.sqrt((y * y).sum(axis=1, keepdims=True))


def neighbours(vectors: DataFrame, queries: Column, *, vec_id: str = "vec_id", embedding: str = "embedding", top: int = 5, tables: int = 12, probes: int = 8, seed: int = 20) -> DataFrame:
    """query_id, rank from 1, vec_id and score of the ``top`` nearest found for each row where ``queries`` is true."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"), F.coalesce(queries, F.lit(False)).alias("asks"))
    most = top + 1
    kind = "f4" if isinstance(vectors.schema[embedding].dataType.elementType, T.FloatType) else "f8"

    def distinct(batches):
        for batch in batches:
            at, raw = _vectors(batch, kind)
            ids, asks = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            found: dict[bytes, list] = {}
            for i, r in zip(at.tolist(), raw, strict=True):
                entry = found.setdefault(r, [[], False])
                entry[0].append(int(ids[i]))
                entry[1] |= bool(asks[i])
            yield pa.RecordBatch.from_arrays(
                [pa.array([_key(r) for r in found], pa.binary()), pa.array(list(found), pa.binary()), pa.array([sorted(set(e[0]))[:most] for e in found.values()], pa.list_(pa.int64())), pa.array([e[1] for e in found.values()], pa.bool_())],
                names=["key", "v", "ids", "asks"],
            )

    def asking(batches):
        for batch in batches:
            at, raw = _vectors(batch, kind)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([_key(r) for r in raw], pa.binary())], names=["query_id", "key"])

    def filed(batches):
        for batch in batches:
            raw, by_length = batch.column(1).to_pylist(), {}
            for i, r in enumerate(raw):
                by_length.setdefault(len(r), []).append(i)
            asks = batch.column(3).to_numpy(zero_copy_only=False)
            for length, own in by_length.items():
                own = np.array(own)
                unit = _unit([raw[i] for i in own], kind)
                part = batch.take(pa.array(own))
                for t in range(tables):
                    for side, at, axis in ((0, np.arange(len(own)), axes(unit, t, 1, seed)), (1, np.flatnonzero(asks[own]), axes(unit[asks[own]], t, probes, seed) if asks[own].any() else np.zeros((0, 1), np.int64))):
                        rep = np.repeat(at, axis.shape[1])
                        p = part.take(pa.array(rep))
                        n = len(rep)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, length, np.int32)), pa.array(np.full(n, t, np.int32)), pa.array(axis.ravel().astype(np.int32)), pa.array(np.full(n, side, np.int32)), p.column(0), p.column(1), p.column(2)], names=["length", "t", "axis", "side", "key", "v", "ids"])

    def rank(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        there, ask = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        out: list[tuple] = []
        if len(there) and len(ask):
            take = lambda rows, c: table.column(c).take(pa.array(rows)).to_pylist()
            c_raw, q_raw, ids = take(there, "v"), take(ask, "v"), take(there, "ids")
            c_unit, q_unit = _unit(c_raw, kind), _unit(q_raw, kind)
            keys = take(ask, "key")
            least = np.array([x[0] for x in ids])
            kth = min(len(there), most) - 1
            for i in range(0, len(ask), 1024):
                close = q_unit[i : i + 1024] @ c_unit.T
                # all that rounding may put among the nearest
                enough = -np.partition(-close, kth, axis=1)[:, kth] - MARGIN
                for q, product in enumerate(close):
                    cols, q = np.flatnonzero(product >= enough[q]), q + i
                    near: list[tuple[float, int]] = []
                    for j in range(0, len(cols), 4096):
                        own = cols[j : j + 4096]
                        exact = cosines(q_raw[q], [c_raw[c] for c in own.tolist()], kind)
                        first = np.lexsort((least[own], -exact))[:most]
                        near += [(-s, v) for s, c in zip(exact[first].tolist(), own[first].tolist(), strict=True) for v in ids[c]]
                        near = sorted(near)[:most]
                    out += [(keys[q], v, -s) for s, v in near]
        return pa.table({"key": pa.array([o[0] for o in out], pa.binary()), "vec_id": pa.array([o[1] for o in out], pa.int64()), "score": pa.array([o[2] for o in out], pa.float64())})

    grouped = rows.mapInArrow(distinct, "key binary, v binary, ids array<long>, asks boolean").groupBy("key", "v")
    entries = cut(grouped.agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most).alias("ids"), F.max("asks").alias("asks")))
    files = entries.mapInArrow(filed, "length int, t int, axis int, side int, key binary, v binary, ids array<long>")
    place = ["length", "t", "axis"]
    sizes = files.groupBy(*place).agg(*[F.greatest(F.lit(1), F.ceil(F.count(F.when(F.col("side") == s, 1)) / BLOCK)).cast("int").alias(f"blocks{s}") for s in (0, 1)])
    dealt = files.join(sizes, place).withColumn("own", F.pmod(F.xxhash64("key"), F.when(F.col("side") == 0, F.col("blocks0")).otherwise(F.col("blocks1"))).cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("blocks1")).otherwise(F.col("blocks0")) - 1)).alias("other"))
    dealt = dealt.select(*place, "side", "key", "v", "ids", F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other")).alias("block0"), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own")).alias("block1"))
    found = dealt.groupBy(*place, "block0", "block1").applyInArrow(rank, "key binary, vec_id long, score double")
    order = [F.desc("score"), F.asc("vec_id")]
    found = found.groupBy("key", "vec_id").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(*order))).filter(F.col("r") <= most)
    lists = found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))).alias("near"))
    asked = rows.filter("asks").mapInArrow(asking, "query_id long, key binary").distinct()
    if_several = asked.join(lists, "key").select("query_id", F.explode("near").alias("n")).filter("n.vec_id <> query_id")
    merged = if_several.groupBy("query_id", F.col("n.vec_id").alias("vec_id")).agg(F.max(-F.col("n.minus")).alias("score"))
    return merged.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def cosines(query: bytes, others: list[bytes], kind: str = "f8") -> np.ndarray:
    """Cosines of the original vectors in double precision, each by the same sums wherever it is computed."""
    q = np.frombuffer(query, kind).astype(np.float64)
    x = np.frombuffer(b"".join(others), kind).astype(np.float64).reshape(len(others), -1)
    with np.errstate(over="ignore", invalid="ignore"):
        s = (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))
    odd = ~np.isfinite(s)
    if odd.any():  # squares out of range
        y, p = x[odd] / np.abs(x[odd]).max(axis=1, keepdims=True), q / np.abs(q).max()
        s[odd] = (y * p).sum(axis=1) / (np.sqrt((y * y).sum(axis=1)) * np.sqrt((p * p).sum()))
    return np.clip(s, -1.0, 1.0)
