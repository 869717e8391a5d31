"""SimHash near-duplicates by tiled exact comparison.

A fingerprint has a bit where more than half of the XXH64 hashes of a text's word shingles have it. Fingerprints that
differ in at most ``radius`` bits are linked, and linked documents form a component.

Equal fingerprints become one row before anything is compared. Two fingerprints within the radius agree on some bands
of bits, so the rows are dealt by the values of bands, and only rows of one value meet. There they stand in order of
their population counts and are cut into tiles; a pair of tiles is compared by numpy exclusive-or and bit counts, and
pairs of tiles whose population counts differ beyond the radius are skipped before any row is sent. A pair of tiles
returns no more links than it has rows: a spanning forest of what it found.

Defined results: a text with fewer words than a shingle is one shingle; null and empty texts have fingerprint zero and
are linked like any other; rows with a null id get a fingerprint, and their component has the smallest id that is not
null, if there is one; repeated rows are one fingerprint; further columns are ignored (``near_duplicates``) or kept
(``keep_first``).
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finpanel.llm import kernels as K
from finpanel.llm.components import components
from finpanel.llm.storage import cut, few, split

SLICE = 1 << 19
TILE = 2048
#: A key that has more than one in so many rows is hot.
HOT = 1000
#: Rows of a group that a task handles at once, on average.
PART = 4_000


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each word shingle of a flat buffer, and the number of shingles of each document."""
    docs = len(offsets) - 1
    start, end, doc = K.word_bounds(data, offsets, ~K.SPACE)
    if not len(start):
        return np.zeros(0, dtype=K.U64), np.zeros(docs, dtype=np.int64)
    # all words again, lower-cased and with one space behind each
    length = end - start + 1
    begin = np.cumsum(length) - length
    flat = np.append(K.LOWER[data], np.uint8(32))[K.ragged(start, length)]
    flat[begin + length - 1] = 32  # what stands there may be the next document
    n_words = np.bincount(doc, minlength=docs)
    first = np.cumsum(n_words) - n_words
    shingles = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    at = K.ragged(first, shingles)
    own = np.repeat(np.arange(docs), shingles)
    last = at + np.minimum(k, n_words[own]) - 1
    return K.xxh64_ranges(flat, begin[at], begin[last] + length[last] - 1 - begin[at]), shingles


def fingerprints(data: np.ndarray, offsets: np.ndarray, k: int = 4) -> np.ndarray:
    """The SimHash of each document of a flat buffer."""
    return majority(*shingle_hashes(data, offsets, k))


def majority(hashes: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """The bits that more than half of each document's hashes have."""
    out = np.zeros(len(shingles), dtype=K.U64)
    if not len(hashes):
        return out
    some = np.flatnonzero(shingles)
    cuts = (np.cumsum(shingles) - shingles)[some]
    half = shingles[some]
    raw = hashes.view(np.uint8).reshape(-1, 8)
    bits = np.zeros(len(some), dtype=K.U64)
    for byte in range(8):
        for bit in range(8):
            ones = np.add.reduceat((raw[:, byte] >> bit) & 1, cuts, dtype=np.int64)
            bits |= (2 * ones > half).astype(K.U64) << K.U64(8 * byte + bit)
    out[some] = bits
    return out


def fingerprint_table(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 4) -> DataFrame:
    """doc_id, h (a hash of the text) and its fingerprint, the 64 bits as a signed long."""
    kind = docs.schema[doc_id].dataType.simpleString()
    words = F.col(f"`{text}`").cast("string")

    def run(batches):
        for batch in batches:
            data, offsets = K.buffers(batch.column(2))
            parts = [fingerprints(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k) for i, j in K.slices(offsets, SLICE)]
            if parts:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(parts).view(np.int64))], names=["doc_id", "h", "fp"])

    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.coalesce(words, F.lit(""))).alias("h"), words.alias("text")).mapInArrow(run, f"doc_id {kind}, h long, fp long")


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Links of a spanning forest of the links given."""
    up = list(range(n))
    left, right = [], []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        i, j = x, y
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        while up[j] != j:
            up[j] = up[up[j]]
            j = up[j]
        if i != j:
            up[max(i, j)] = min(i, j)
            left.append(x)
            right.append(y)
    return left, right


def compare_tiles(one: np.ndarray, two: np.ndarray | None, radius: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within the radius of two tiles in order of population count; of one tile with itself if two is None."""
    other = one if two is None else two
    low, high = np.bitwise_count(one).astype(np.int16), np.bitwise_count(other).astype(np.int16)
    left, right = [], []
    for i in range(0, len(one), block):
        a = one[i : i + block]
        begin = int(np.searchsorted(high, low[i] - radius))
        end = int(np.searchsorted(high, low[min(i + block, len(one)) - 1] + radius, side="right"))
        if two is None:
            begin = max(begin, i)
        if begin >= end:
            continue
        x, y = np.nonzero(np.bitwise_count(a[:, None] ^ other[None, begin:end]) <= radius)
        x, y = x + i, y + begin
        if two is None:
            x, y = x[x < y], y[x < y]
        left.append(x)
        right.append(y)
    z = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (z, z)


def _bands(radius: int, rows: int) -> list[tuple[tuple[int, int], ...]]:
    """The keys under which fingerprints within the radius meet: each is some bands of bits, as shift and width, that agree.

    Of radius + agree bands, at least ``agree`` are equal in such a pair. More rows take more bands and wider keys, so that
    the rows of a key stay within a tile or so; which links are found is the same for any number.
    """
    for agree in range(1, 5):
        n = radius + agree
        if rows <= TILE << min(64 * agree // n, 40):
            break
    edges = [round(64 * i / n) for i in range(n + 1)]
    return list(combinations([(a, b - a) for a, b in zip(edges, edges[1:], strict=False)], agree))


def deal(rows: DataFrame, keys: list[str], radius: int, size: int | None = None, name: tuple[str, ...] = ("node",)) -> DataFrame:
    """``rows`` (with a population count ``pop`` and columns that ``name`` the row) with the pairs of tiles they go to: i, j and side.

    Rows of a key stand in order of population count and are cut into tiles; each row goes once to each pair of its own
    tile and another, but pairs whose population counts lie beyond the radius are left out. Keys of no more rows than a
    tile are one tile.
    """
    size = size or TILE
    big = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > size).drop("n"))
    alone = [F.lit(0).alias(c) for c in ("i", "j", "side")]
    if big.isEmpty():
        return rows.select("*", *alone)
    big = few(big)
    by_count = Window.partitionBy(*keys).orderBy("pop")
    cells = rows.join(big, keys, "left_semi").groupBy(*keys, "pop").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(by_count))
    tile = lambda c: F.floor(c / size).cast("int")
    cells = cut(cells.select(*keys, "pop", tile(F.col("upto") - F.col("n")).alias("first"), tile(F.col("upto") - 1).alias("last")))
    tiles = cells.select(*keys, "pop", F.explode(F.sequence("first", "last")).alias("own")).groupBy(*keys, "own").agg(F.min("pop").alias("low"), F.max("pop").alias("high"))
    others = tiles.select(*keys, F.col("own").alias("o"), F.col("low").alias("o_low"), F.col("high").alias("o_high"))
    near = tiles.join(others, keys).filter((F.col("o_low") <= F.col("high") + radius) & (F.col("low") <= F.col("o_high") + radius))
    near = cut(near.select(*keys, "own", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), (F.col("own") > F.col("o")).cast("int").alias("side")))
    own = F.col("first") + F.pmod(F.xxhash64(*name), F.col("last") - F.col("first") + 1).cast("int")
    crowded = rows.join(few(cells), [*keys, "pop"]).withColumn("own", own).drop("first", "last").join(few(near), [*keys, "own"])
    names = [*rows.columns, "i", "j", "side"]
    return rows.join(big, keys, "left_anti").select(*rows.columns, *alone).unionByName(crowded.select(*names))


def links(prints: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b) that connect all rows of the distinct column fp that lie within the radius, a spanning forest for each pair of tiles."""
    rows = prints.count()
    value = lambda key: F.expr(" | ".join(f"shiftleft(shiftrightunsigned(fp, {a}) & {(1 << w) - 1}L, {sum(x[1] for x in key[:i])})" for i, (a, w) in enumerate(key)))
    bands = _bands(radius, rows)
    keyed = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("band"), value(key).alias("value")) for i, key in enumerate(bands)])).alias("b"))
    tiled = deal(keyed.select("fp", F.col("fp").alias("node"), F.expr("bit_count(fp)").alias("pop"), "b.band", "b.value"), ["band", "value"], radius).drop("node", "pop")
    parts = math.ceil(rows * len(bands) / PART) or 1
    tiled = tiled.withColumn("part", F.pmod(F.xxhash64("band", "value", "i", "j"), F.lit(parts)).cast("int"))

    def compare(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(K.U64)
        keys = [table.column(c).to_numpy() for c in ("band", "value", "i", "j", "side")]
        order = np.lexsort((np.bitwise_count(fp), keys[4], keys[3], keys[2], keys[1], keys[0]))
        fp, keys = fp[order], [k[order] for k in keys]
        new = np.ones(len(fp), dtype=bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys[:4]])
        begin = np.flatnonzero(new)
        out_a, out_b = [], []
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(fp)], strict=True):
            if b - a < 2:
                continue
            own = fp[a:b]
            if keys[2][a] == keys[3][a]:
                x, y = compare_tiles(own, None, radius)
            else:
                cut_at = int(np.searchsorted(keys[4][a:b], 1))
                x, y = compare_tiles(own[:cut_at], own[cut_at:], radius)
                y = y + cut_at
            if len(x):
                x, y = _forest(b - a, x, y)
                out_a.append(own[x])
                out_b.append(own[y])
        z = np.zeros(0, K.U64)
        return pa.table({"a": (np.concatenate(out_a) if out_a else z).view(np.int64), "b": (np.concatenate(out_b) if out_b else z).view(np.int64)})

    return tiled.groupBy("part").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, h (the text's hash), fp (the bits as a signed long), root (a fingerprint that names the component) and component_id, the smallest doc_id that links reach, of each row."""
    table = cut(fingerprint_table(docs, doc_id=doc_id, text=text, k=k))
    prints = cut(table.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    found = components(links(prints.select("fp"), radius), "a", "b")
    # the smallest id of each component, for the fingerprints that have links
    named = found.join(prints, found["node"] == prints["fp"]).select("fp", "root", "least")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("fp", "root", "component_id")
    named = cut(prints.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least").alias("component_id"), "n"))
    # a fingerprint of over a thousandth of all rows is one of a thousand at most, and they are broadcast
    many = F.col("n") * HOT > table.count()
    hot, cold = F.broadcast(named.filter(many).drop("n")), named.filter(~many).drop("n")
    rest = table.join(hot.select("fp"), "fp", "left_anti").join(cold, "fp", "left")
    return table.join(hot, "fp").unionByName(rest).select("doc_id", "h", "fp", "root", "component_id")


def keep_first(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``docs``, with all their columns, one of each component: see ``keep_one``."""
    return keep_one(docs, near_duplicates(docs, doc_id=doc_id, text=text, k=k, radius=radius), doc_id, text)


def _without(docs: DataFrame, doc_id: str, h: Column, gone: DataFrame) -> DataFrame:
    """``docs`` but the rows of an id and text hash in ``gone`` (d, g); texts of other rows are not shuffled, one in 16 apart."""
    there = few(gone)
    if there is not gone:
        return docs.join(there, (docs[doc_id] == there["d"]) & (h == there["g"]), "left_anti")
    keyed = docs.select(F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"), docs[doc_id].alias("d"), h.alias("g"), F.xxhash64(docs[doc_id], h).alias("key"))
    maybe, stay = split(keyed, "key", gone.select(F.xxhash64("d", "g")))
    kept = maybe.join(gone, ["d", "g"], "left_anti").select("row").unionByName(stay.select("row"))
    return kept.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def keep_one(docs: DataFrame, found: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row of each component of ``found`` (doc_id, h, root, component_id): that of the smallest id, and of its texts that of the smallest hash; rows with a null id stay.

    Rows are judged by id and text, so that another text under the id of a row that goes is judged by its own component.
    """
    judged = found.filter("doc_id is not null").groupBy("doc_id", "h", "root", "component_id").agg(F.count(F.lit(1)).alias("times"))
    first = judged.filter("doc_id = component_id").groupBy("root").agg(F.min("h").alias("best"))
    stays = F.coalesce((F.col("doc_id") == F.col("component_id")) & (F.col("h") == F.col("best")), F.lit(False))
    judged = cut(judged.join(first, "root", "left").select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "times", stays.alias("stays")))
    h = F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit("")))
    same = lambda other: (docs[doc_id] == other["d"]) & (h == other["g"])
    again = judged.filter("stays and times > 1").select("d", "g")
    gone = judged.filter("not stays or times > 1").select("d", "g")
    kept = _without(docs, doc_id, h, gone)
    if again.isEmpty():
        return kept
    # one of each row that is repeated, whatever its other columns
    row = F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)])
    several = docs.join(again, same(again)).groupBy(again["d"], again["g"]).agg(F.first(row).alias("r"))
    return kept.unionByName(several.select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(docs.columns)]))
