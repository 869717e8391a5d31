"""Exact join of shingle sets in the metric space of the Jaccard distance.

A text is a point: the set of its distinct word shingles, with the Jaccard distance, which obeys the triangle
inequality. Points within the radius r = 1 - similarity are linked. Equal sets are one point.

Unrelated texts are all at a distance of nearly one from one another, so pivots taken from the texts separate nothing at
first: each text lies within a window of 2r of its nearest pivot's distance for every other pivot. The first level
therefore uses projections of the space. Hashes deal all shingles to g parts, and a text's point in a part is the subset
of its shingles there, with the same distance. Two texts within the radius differ in at most (n + m) r / (2 - r)
shingles, so with more parts than that they coincide in one of them. In each part every subset that occurs is a pivot;
its region holds the texts at distance zero, and replicating a text to its region of each part loses no pair. The number
of parts follows the size: sizes are distances from the empty set, they lie in classes, and a text within a window of a
factor of 1 / similarity below a class stands in that one too.

Texts that regions connect form groups, and in a group of near copies distances do differ. There the join is by pivots
taken from the points: each point goes to the region of its nearest pivot and, by the triangle inequality, to all regions
whose pivots are at most 2r further; regions join recursively, and in the last ones pairs whose distances to any pivot
differ by more than r are left out before sets are compared. Groups of more points than a task takes are dealt into
regions by Spark in the same way; of a region that stays too large, points in order of their distance to its pivot
are cut into tiles, and pairs of tiles whose distances differ by more than r are skipped before rows are sent. Points
within r of one pivot are linked through it and are compared with points outside that ball only.

Defined results: a text of fewer words than a shingle is one shingle; a text without words, or null, has the empty set
and is linked with nothing, not even with other empty ones; equal sets are linked whatever their ids; rows with a
null id take part, and their component has the smallest id that is not null, if there is one; repeated rows are one point;
further columns are ignored; an empty table gives no rows. Shingles and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finpanel.llm import kernels as K
from finpanel.llm.components import components
from finpanel.llm.simhash import HOT, deal
from finpanel.llm.storage import cut

SLICE = 1 << 19
#: Size classes are powers of this.
CLASS = 1.5
#: Keys that a task holds, and keys of a part of the shuffle on average.
HELD, KEYS = 1 << 21, 1 << 18
#: Points and shingles of a region that a task joins, and shingles of the regions of a part on average.
POINTS, SHINGLES, PART = 2048, 1 << 21, 1 << 20
#: Pivots of a region, and the points of one that is joined pair by pair.
PIVOTS, LEAF = 8, 24
#: Rounds of dealing large groups to pivots; what is still large then is cut into tiles.
ROUNDS = 4
#: Rows of one long that a broadcast may hold.
BROADCAST_ROWS = 100_000
#: Distances as integers.
SCALE = 10_000
EPS = 1e-9


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each document of a flat buffer, in ascending order, and their numbers."""
    docs = len(offsets) - 1
    start, end, doc = K.word_bounds(data, offsets, ~K.SPACE)
    if not len(start):
        return np.zeros(0, K.U64), np.zeros(docs, np.int64)
    words = K.range_hashes(K.LOWER[data], start, end)
    n = np.bincount(doc, minlength=docs)
    at = np.flatnonzero(K.gram_inside(doc, k))
    hashes, own = [K.gram_hashes(words, k)[at]], [doc[at]]
    first = np.cumsum(n) - n
    for short in range(1, k):  # the whole text
        some = np.flatnonzero(n == short)
        if len(some):
            h = np.full(len(some), short, dtype=K.U64)
            for j in range(short):
                h = K.mix(h ^ words[first[some] + j])
            hashes.append(h)
            own.append(some)
    h, d = np.concatenate(hashes), np.concatenate(own)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], np.bincount(d[new], minlength=docs)


def _names(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set of hashes in ascending order."""
    ends, raw = np.cumsum(n).tolist(), hashes.tobytes()
    return np.array([int.from_bytes(hashlib.blake2b(raw[8 * (e - m) : 8 * e], digest_size=8).digest(), "little", signed=True) for e, m in zip(ends, n.tolist(), strict=True)], dtype=np.int64)


def most_apart(n, m, similarity: float):
    """The most shingles in which sets of these sizes differ if they have the similarity."""
    return np.floor((n + m) * (1 - similarity) / (1 + similarity) + EPS).astype(np.int64)


def part_keys(hashes: np.ndarray, n: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the regions of each set at distance zero from a pivot, and their numbers."""
    own_class = np.floor(np.log(np.maximum(n, 1)) / math.log(CLASS) + EPS).astype(np.int64)
    reach = np.floor(np.log(np.maximum(n, 1) / similarity) / math.log(CLASS) + 1e-6).astype(np.int64)
    keys, sets = [], []
    begin = np.cumsum(n) - n
    for further in range(int((reach - own_class).max(initial=0)) + 1):
        some = np.flatnonzero((n > 0) & (own_class + further <= reach))
        level = own_class[some] + further
        # two sets that meet in a class are smaller than its end, and the smaller one decides how much they differ
        size = np.ceil(CLASS ** (level + 1.0)).astype(np.int64)
        parts = most_apart(size, size, similarity) + 1
        at = K.ragged(begin[some], n[some])
        which = np.repeat(np.arange(len(some)), n[some])
        place = (K.mix(hashes[at] ^ K.U64(K.BASES[1])) % np.repeat(parts, n[some]).astype(K.U64)).astype(np.int64)
        total = np.cumsum(parts) - parts
        cell = total[which] + place
        # a subset by the sum of its mixed hashes
        sums = np.zeros(int(parts.sum()), dtype=K.U64)
        np.add.at(sums, cell, K.mix(hashes[at] + K.U64(K.BASES[0])))
        filled = np.flatnonzero(np.bincount(cell, minlength=len(sums)))
        owner = np.repeat(np.arange(len(some)), parts)[filled]
        tag = (level[owner].astype(K.U64) << K.U64(32)) + (filled - total[owner]).astype(K.U64)
        keys.append(K.mix(sums[filled] ^ K.mix(tag + K.U64(1))))
        sets.append(some[owner])
    if not keys:
        return np.zeros(0, K.U64), np.zeros(len(n), np.int64)
    k, s = np.concatenate(keys), np.concatenate(sets)
    order = np.argsort(s, kind="stable")
    return k[order], np.bincount(s, minlength=len(n))


def describe(docs: DataFrame, *, doc_id: str, text: str, k: int, similarity: float) -> DataFrame:
    """doc_id, h (the text's hash), node (the name of its set), n (its size) and the keys of its regions, as bytes."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.buffers(batch.column(2))
            for i, j in K.slices(offsets, SLICE):
                hashes, n = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                keys, many = part_keys(hashes, n, similarity)
                ends = np.concatenate(([0], np.cumsum(8 * many))).astype(np.int32)
                raw = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(keys.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(_names(hashes, n)), pa.array(n), raw], names=["doc_id", "h", "node", "n", "keys"])

    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(t).alias("h"), t.alias("text")).mapInArrow(run, f"doc_id {kind}, h long, node long, n long, keys binary")


def _meet(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with their smallest node, and links from each other node of a key to that one."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    first = nodes[new]
    least = first[np.cumsum(new) - 1]
    apart = nodes != least
    return keys[new], first, nodes[apart], least[apart]


def meetings(table: DataFrame, shingles: int) -> DataFrame:
    """Links (a, b) that connect all nodes that share a region; a key is one row of each task that has it, however many nodes do."""

    def gather(batches):
        held_k, held_n, size = [], [], 0

        def send():
            keys, least, a, b = _meet(np.concatenate(held_k), np.concatenate(held_n))
            if len(a):
                pairs = np.unique(np.stack((a, b), axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["key", "a", "b"])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(least), pa.nulls(len(keys), pa.int64())], names=["key", "a", "b"])

        for batch in batches:
            raw = batch.column(1)
            ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
            held_k.append(np.frombuffer(raw.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].copy().view(np.int64))
            held_n.append(np.repeat(batch.column(0).to_numpy(), np.diff(ends) // 8))
            size += len(held_n[-1])
            if size >= HELD:
                yield from send()
                held_k, held_n, size = [], [], 0
        if size:
            yield from send()

    def match(batches):
        table = pa.Table.from_batches(list(batches), pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())]))
        if not len(table):
            return
        plain = table.column("b").is_valid().to_numpy()
        key, a = table.column("key").to_numpy(), table.column("a").to_numpy()
        b = table.column("b").fill_null(0).to_numpy()
        _, _, x, y = _meet(key[~plain], a[~plain])
        pairs = np.unique(np.stack((np.concatenate((a[plain], x)), np.concatenate((b[plain], y))), axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    parts = max(1, math.ceil(shingles / 6 / KEYS))
    return table.select("node", "keys").mapInArrow(gather, "key long, a long, b long").repartition(parts, "key").mapInArrow(match, "a long, b long")


class Points:
    """Sets of shingles as one flat array of local shingle numbers, with union by smallest place."""

    def __init__(self, raw: list[bytes]):
        self.size = np.array([len(r) // 8 for r in raw], dtype=np.int64)
        self.begin = np.cumsum(self.size) - self.size
        shingles, self.flat = np.unique(np.frombuffer(b"".join(raw), K.U64), return_inverse=True)
        self.mark = np.zeros(len(shingles), dtype=bool)
        self.labels = np.arange(len(raw))

    def distances(self, one: int, others: np.ndarray) -> np.ndarray:
        """Jaccard distances of a point from others."""
        mine = self.flat[self.begin[one] : self.begin[one] + self.size[one]]
        self.mark[mine] = True
        out = np.empty(len(others))
        for i in range(0, len(others), 512):
            two = others[i : i + 512]
            sums = np.concatenate(([0], np.cumsum(self.mark[self.flat[K.ragged(self.begin[two], self.size[two])]])))
            stop = np.cumsum(self.size[two])
            both = sums[stop] - sums[stop - self.size[two]]
            out[i : i + 512] = 1 - both / (self.size[one] + self.size[two] - both)
        self.mark[mine] = False
        return out

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.labels[a], self.labels[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.labels, np.maximum(x, y), np.minimum(x, y))
            while (self.labels[self.labels] != self.labels).any():
                self.labels = self.labels[self.labels]

    def pairs(self, ones: np.ndarray, others: np.ndarray, known: np.ndarray, far: np.ndarray, r: float, behind: bool, slack: float = EPS) -> None:
        """Links points with others whose distances to the pivots (``known`` and ``far``, exact up to ``slack``) allow it; ``behind``: others are the same points, each pair once."""
        for i, one in enumerate(ones.tolist()):
            at = np.arange(i + 1 if behind else 0, len(others))
            at = at[self.labels[others[at]] != self.labels[one]]
            if known.shape[1]:
                at = at[(np.abs(far[at] - known[i]) <= r + slack).all(axis=1)]
            two = others[at]
            small, large = np.minimum(self.size[two], self.size[one]), np.maximum(self.size[two], self.size[one])
            two = two[small >= (1 - r) * large - EPS]
            if len(two):
                two = two[self.distances(one, two) <= r + EPS]
                self.link(np.full(len(two), one), two)

    def join(self, at: np.ndarray, r: float) -> None:
        """Links all points of a region that are within the radius, by regions of pivots in turn."""
        todo = [at]
        while todo:
            at = todo.pop()
            if len(np.unique(self.labels[at])) == 1:
                continue
            if len(at) <= LEAF:
                self.pairs(at, at, np.zeros((len(at), 0)), np.zeros((len(at), 0)), r, True)
                continue
            # pivots far from one another: each next one is the point that is furthest from those before
            far, pivots = np.zeros((len(at), 0)), [0]
            while True:
                d = self.distances(int(at[pivots[-1]]), at)
                within = at[d <= r + EPS]
                self.link(np.full(len(within), at[pivots[-1]]), within)
                far = np.column_stack((far, d))
                nearest = far.min(axis=1)
                if len(pivots) == PIVOTS or nearest.max() <= r:
                    break
                pivots.append(int(nearest.argmax()))
            inside = far <= nearest[:, None] + 2 * r + EPS
            sizes = inside.sum(axis=0)
            if sizes.sum() <= 2 * len(at) and sizes.max() <= 0.7 * len(at):
                todo += [at[inside[:, p]] for p in range(len(pivots)) if sizes[p] > 1]
            else:  # regions would hold the same points again
                self.pairs(at, at, far, far, r, True)


def _held(rows: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """node and x, the set as bytes, of each of the nodes (node, h), read from one text of each."""
    texts = nodes.select("h").distinct()
    texts = F.broadcast(texts) if texts.count() <= BROADCAST_ROWS else texts

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            data, offsets = K.buffers(batch.column(0))
            for i, j in K.slices(offsets, SLICE):
                hashes, n = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                names, ends = _names(hashes, n).tolist(), np.cumsum(n)
                new = [x for x, name in enumerate(names) if not (name in seen or seen.add(name))]
                yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in new], pa.int64()), pa.array([hashes[ends[x] - n[x] : ends[x]].tobytes() for x in new], pa.binary())], names=["node", "x"])

    found = rows.join(texts, "h", "left_semi").select("text").mapInArrow(run, "node long, x binary")
    return found.join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _large(members: DataFrame) -> DataFrame:
    """region and m of those with more points or shingles than a task takes."""
    return members.groupBy("region").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s")).filter((F.col("m") > POINTS) | ((F.col("s") > SHINGLES) & (F.col("m") > LEAF))).drop("s")


def voronoi(members: DataFrame, large: DataFrame, held: DataFrame, r: float, seed: int) -> DataFrame:
    """Members (region, node, n) of the ``large`` regions (region, m) with their distance d from each pivot (node p) of their region."""
    rank = F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(1 << 40))
    rows = members.select("region", "node", "n").join(large, "region").withColumn("rank", rank)
    # some PIVOTS points of each region by their hashes, and its first one in any case
    first = rows.groupBy("region").agg(F.min("rank").alias("least"))
    chosen = rows.join(first, "region").filter((F.col("rank") == F.col("least")) | (F.col("rank").cast("double") * F.col("m") < float(PIVOTS << 40)))
    chosen = cut(chosen.select("region", "node").join(held, "node").select("region", F.col("node").alias("p"), F.col("x").alias("px")))
    # a region is dealt to parts of about as many points as a task takes; its few pivots go to each of them
    split = large.select("region", F.ceil(F.col("m") / (POINTS // 4)).cast("int").alias("parts"))
    pivots = chosen.join(split, "region").select(F.col("region").alias("r"), "p", "px", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q"))
    points = rows.select("region", "node", "n").join(split, "region").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).join(held, "node").select("region", "part", "node", "n", "x")

    def measure(left: pa.Table, right: pa.Table) -> pa.Table:
        names, pivot = left.column("node").to_numpy(), right.column("p").to_numpy()
        both = Points(left.column("x").to_pylist() + right.column("px").to_pylist())
        d = np.concatenate([both.distances(len(names) + i, np.arange(len(names))) for i in range(len(pivot))]) if len(pivot) and len(names) else np.zeros(0)
        return pa.table({"region": pa.array(np.full(len(d), left.column("region")[0].as_py() if len(names) else 0)), "node": pa.array(np.tile(names, len(pivot))), "n": pa.array(np.tile(left.column("n").to_numpy(), len(pivot))), "p": pa.array(np.repeat(pivot, len(names))), "d": pa.array(d)})

    return points.groupBy("region", "part").cogroup(pivots.groupBy("r", "q")).applyInArrow(measure, "region long, node long, n long, p long, d double")


def join_regions(members: DataFrame, held: DataFrame, r: float) -> DataFrame:
    """Links (a, b) that connect the points (region, node, n) of each region as all pairs within the radius do."""
    links, done = [], []
    members = members.withColumn("d", F.lit(0)).withColumn("ball", F.lit(None).cast("long"))
    reach = math.ceil(r * SCALE) + 1
    for level in range(ROUNDS):
        large = cut(_large(members))
        if large.isEmpty():
            break
        done.append(members.join(large, "region", "left_anti"))
        far = cut(voronoi(members, large, held, r, level))
        links.append(far.filter((F.col("d") <= r + EPS) & (F.col("node") != F.col("p"))).select(F.col("node").alias("a"), F.col("p").alias("b")))
        nearest = far.groupBy("region", "node").agg(F.min("d").alias("least"))
        inside = far.join(nearest, ["region", "node"]).filter(F.col("d") <= F.col("least") + 2 * r + EPS)
        inside = inside.select("region", F.xxhash64("region", "p", F.lit(level)).alias("inner"), "node", "n", F.round(F.col("d") * SCALE).cast("int").alias("d"), F.when(F.col("d") <= r + EPS, F.col("p")).alias("ball"))
        # points within r of a pivot are linked already: they are needed where a point outside may be near them
        outer = inside.filter("ball is null").groupBy("inner").agg(F.min("d").alias("from"))
        inside = cut(inside.join(outer, "inner").filter(F.col("ball").isNull() | (F.col("d") >= F.col("from") - reach)).drop("from"))
        # regions that hold nearly all points of their region again are no gain: it stays whole, with one pivot
        sizes = inside.groupBy("region", "inner").agg(F.count(F.lit(1)).alias("k")).groupBy("region").agg(F.max("k").alias("most"), F.sum("k").alias("all")).join(large, "region")
        gain = cut(sizes.select("region", ((F.col("most") <= 0.7 * F.col("m")) & (F.col("all") <= 4 * F.col("m"))).alias("gain")))
        one = far.groupBy("region").agg(F.min("p").alias("p"))
        whole = far.join(one, ["region", "p"]).join(gain.filter("not gain"), "region", "left_semi")
        # the pivots' links still stand, so a point's ball is its nearest pivot where that is near enough
        ball = far.groupBy("region", "node").agg(F.min_by("p", F.struct("d", "p")).alias("ball"), F.min("d").alias("least"))
        whole = whole.join(ball, ["region", "node"]).select("region", "node", "n", F.round(F.col("d") * SCALE).cast("int").alias("d"), F.when(F.col("least") <= r + EPS, F.col("ball")).alias("ball"))
        done.append(whole)
        members = inside.join(gain.filter("gain"), "region", "left_semi").select(F.col("inner").alias("region"), "node", "n", "d", "ball")
    done.append(members)
    rows = done[0]
    for x in done[1:]:
        rows = rows.unionByName(x)
    # regions of long sets have smaller tiles
    rows = cut(rows)
    sizes = rows.groupBy("region").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"))
    long = cut(sizes.filter(F.col("s") > F.col("m") * (SHINGLES // POINTS)).select("region"))
    name = rows.withColumn("pop", F.col("d"))
    tiled = deal(name.join(long, "region", "left_anti"), ["region"], reach, POINTS).unionByName(deal(name.join(long, "region", "left_semi"), ["region"], reach, max(LEAF, POINTS // 32)))
    parts = math.ceil((sizes.agg(F.sum("s")).first()[0] or 0) / PART) or 1
    tiled = tiled.withColumn("part", F.pmod(F.xxhash64("region", "i", "j"), F.lit(parts)).cast("int")).join(held, "node").select("part", "region", "node", "d", "ball", "i", "j", "side", "x")

    def join(table: pa.Table) -> pa.Table:
        c = {name: table.column(name).to_numpy() for name in ("region", "i", "j", "side", "node", "d")}
        ball = table.column("ball")
        own, balls = ball.is_valid().to_numpy(), ball.fill_null(0).to_numpy()
        order = np.lexsort((c["node"], c["side"], c["j"], c["i"], c["region"]))
        c = {name: x[order] for name, x in c.items()}
        own, balls, raw = own[order], balls[order], table.column("x").take(pa.array(order))
        new = np.ones(len(order), dtype=bool)
        new[1:] = np.logical_or.reduce([c[x][1:] != c[x][:-1] for x in ("region", "i", "j")])
        begin = np.flatnonzero(new).tolist()
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in zip(begin, [*begin[1:], len(order)], strict=True):
            if b - a < 2:
                continue
            points = Points(raw.slice(a, b - a).to_pylist())
            at = np.arange(b - a)
            some = at[own[a:b]]
            if len(some):  # one point of each ball stands for it
                _, first, which = np.unique(balls[a:b][some], return_index=True, return_inverse=True)
                points.link(some, some[first][which])
            before = points.labels.copy()
            if c["i"][a] == c["j"][a]:
                points.join(at, r)
            else:
                far = c["d"][a:b, None] / SCALE
                left, right = at[c["side"][a:b] == 0], at[c["side"][a:b] == 1]
                points.pairs(left, right, far[left], far[right], r, False, 2 / SCALE)
            moved = np.flatnonzero(points.labels != before)
            out_a.append(c["node"][a:b][before[moved]])
            out_b.append(c["node"][a:b][points.labels[moved]])
        return pa.table({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    found = tiled.groupBy("part").applyInArrow(join, "a long, b long").distinct()
    for x in links:
        found = found.unionByName(x)
    return found


def near_sets(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 3, similarity: float = 0.9) -> DataFrame:
    """doc_id, n_shingles (the size of its set) and component_id, the smallest doc_id that links reach, of each row."""
    table = cut(describe(docs, doc_id=doc_id, text=text, k=k, similarity=similarity))
    nodes = cut(table.groupBy("node").agg(F.min("h").alias("h"), F.min("doc_id").alias("least"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies")))
    total = nodes.agg(F.sum("n")).first()[0] or 0
    groups = components(meetings(table.filter("n > 0"), total), "a", "b").select("node", F.col("root").alias("region"))
    members = cut(groups.join(nodes.select("node", "n", "h"), "node"))
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    held = cut(_held(docs.select(F.xxhash64(t).alias("h"), t.alias("text")), members, k))
    found = components(join_regions(members.drop("h"), held, 1 - similarity), "a", "b")
    linked = found.join(nodes, "node").select("node", "root", "least")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = linked.join(least, "root").select("node", "component_id")
    ids = cut(nodes.join(linked, "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id"), "copies"))
    rows = table.select("doc_id", "node", F.col("n").alias("n_shingles"))
    # a set of over a thousandth of all rows is one of a thousand at most, and they are broadcast
    many = F.col("copies") * HOT > rows.count()
    hot, cold = F.broadcast(ids.filter(many).drop("copies")), ids.filter(~many).drop("copies")
    rest = rows.join(hot.select("node"), "node", "left_anti").join(cold, "node")
    out = rows.join(hot, "node").unionByName(rest)
    # empty sets are alone
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
