"""Spelling variants by blocked Gram matrices of letter counts.

Words are counted in one pass: letters are found on the flat bytes of a batch, runs are counted by Arrow, and what a
task sends is one row for each of its distinct words.

One edit changes a word's letter counts little: an insertion or deletion moves the vector of counts by a squared
distance of one, a replacement by two. Words are therefore put into blocks by their counts over a few groups of letters.
The sums of a block's vector are the words' length, so blocks are length blocks, cut further; an edit moves a word to the
same block or to one whose vector lies within a squared distance of two, and only such blocks, of equal or adjacent
length, meet. Where they meet, a numpy product of the two matrices of letter counts gives all squared distances, pairs of
at most two are kept, and an edit is verified on their code points. More words make more groups, so that blocks stay about
a tile; a block that is larger is cut into tiles, and each pair of tiles is one product.

Defined results: a null text has no words; a null id stands as nothing before the colon of the hashed key; repeated rows
count each; an empty table gives no rows; runs may be of any length; further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finpanel.llm import kernels as K
from finpanel.llm.storage import cut

SLICE = 1 << 19
#: Bytes of text whose runs are counted at once, and distinct words that a task holds before it sends them.
CHUNK, HELD = 1 << 24, 1 << 19
#: Rows of a pair of tiles, on average of a task, and cells that an edit is verified on at once.
TILE, PART, STEP = 2048, 8192, 1 << 24
#: Runs of more bytes are hashed one by one.
LONG = 64

LETTER = np.array([65 <= i <= 90 or 97 <= i <= 122 for i in range(256)])
INSIDE = np.array([False, True])
#: Latin-1 code points that words are made of, as columns of the count matrix.
COLUMN = np.array([i - 97 if 97 <= i <= 122 else i - 0xC0 + 26 if i >= 0xC0 else 0 for i in range(256)])
COLUMNS = 26 + 64


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


CRC = _crc_table()


def crc32(before: np.ndarray, flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """zlib's crc32 of byte ranges, each carried on from a crc of what stands before."""
    state = ~before.astype(np.uint32)
    short = np.minimum(length, LONG + 1)
    order = np.argsort(-short, kind="stable")
    ordered = short[order]
    now = state[order]
    for j in range(int(min(ordered[0], LONG)) if len(ordered) else 0):
        m = int(np.searchsorted(-ordered, -j, side="left"))  # runs longer than j
        now[:m] = CRC[(now[:m] ^ flat[begin[order[:m]] + j]) & 0xFF] ^ (now[:m] >> np.uint32(8))
    state[order] = now
    out = ~state
    for i in np.flatnonzero(length > LONG).tolist():
        out[i] = zlib.crc32(flat[begin[i] : begin[i] + length[i]].tobytes(), int(before[i]))
    return out


def word_runs(data: np.ndarray, offsets: np.ndarray, keys: list[bytes], least: int, drop: int) -> pa.Array:
    """The lower-cased runs of letters of a flat buffer with at least so many code points, after the keyed deletions."""
    lead = data == 0xC3  # the first byte of U+00C0 to U+00FF, and of nothing else
    inside = LETTER[data] | lead
    inside[1:] |= lead[:-1]
    start, end, doc = K.word_bounds(inside.view(np.uint8), offsets, INSIDE)
    wide = np.concatenate(([0], np.cumsum(lead)))
    points = end - start - (wide[end] - wide[start])
    keep = points >= least
    start, end, doc, points = start[keep], end[keep], doc[keep], points[keep]
    length = end - start
    flat = K.LOWER[data[K.ragged(start, length)]]
    begin = np.cumsum(length) - length
    h = crc32(np.array([zlib.crc32(k) for k in keys], dtype=np.uint32)[doc], flat, begin, length)
    gone = np.flatnonzero(h % drop == 0)
    if len(gone):
        at = (h[gone] % points[gone]).astype(np.int64)
        mark = np.ones(len(flat), dtype=bool)
        for i, k in zip(gone.tolist(), at.tolist(), strict=True):
            own = flat[begin[i] : begin[i] + length[i]]
            first = int(np.flatnonzero(own & 0xC0 != 0x80)[k])
            size = 2 if own[first] == 0xC3 else 1
            mark[begin[i] + first : begin[i] + first + size] = False
            length[i] -= size
            points[i] -= 1
        flat = flat[mark]
    ends = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
    words = pa.StringArray.from_buffers(len(length), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat)))
    return words.filter(pa.array(points >= least)) if len(gone) else words


def _summed(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])


def word_counts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = 6, drop: int = 199) -> DataFrame:
    """word and n, its occurrences, of all texts; of each run whose keyed hash ``drop`` divides a code point is deleted first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        waiting: list[pa.Array] = []
        size = 0

        def count():
            found = pc.value_counts(pa.chunked_array(waiting, pa.string()))
            held.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
            waiting.clear()

        for batch in batches:
            data, offsets = K.buffers(batch.column(1))
            keys = [b":" if k is None else f"{k}:".encode() for k in batch.column(0).to_pylist()]
            for i, j in K.slices(offsets, SLICE):
                waiting.append(word_runs(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], keys[i:j], least, drop))
                size += int(offsets[j] - offsets[i])
                if size >= CHUNK:
                    count()
                    size = 0
            if sum(len(t) for t in held) > HELD:
                held[:] = [_summed(held)]
                if len(held[0]) > HELD // 2:
                    yield from held.pop().combine_chunks().to_batches()
        if waiting:
            count()
        if held:
            yield from _summed(held).combine_chunks().to_batches()

    rows = docs.select(F.col(f"`{doc_id}`").cast("string").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _groups(words: int) -> int:
    """Groups of letters that blocks are made by: one for each factor of six in the number of words."""
    return max(1, min(8, math.ceil(math.log(max(words, 1) / TILE, 6)) + 1)) if words > TILE else 1


def blocked(words: DataFrame, groups: int) -> DataFrame:
    """word, n, block and side: each word once in its own block (side 0), and in each block of shorter or, by order, smaller vectors that an edit leads to (side 1)."""

    def run(batches):
        for batch in batches:
            block, at, side = [], [], []
            for i, w in enumerate(batch.column(0).to_pylist()):
                v = np.bincount(np.frombuffer(w.encode("latin-1"), np.uint8) % groups, minlength=groups).tolist()
                reach = [v]
                for x in range(groups):
                    if v[x]:
                        less = [*v[:x], v[x] - 1, *v[x + 1 :]]
                        reach.append(less)
                        # a letter of group x in place of one of a group behind it, so that the vector is smaller
                        reach += [[*less[:y], less[y] + 1, *less[y + 1 :]] for y in range(x + 1, groups)]
                block += [",".join(map(str, r)) for r in reach]
                side += [0, *[1] * (len(reach) - 1)]
                at += [i] * len(reach)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(block, pa.string()), pa.array(side, pa.int32())], names=["word", "n", "block", "side"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, block string, side int")


def letter_counts(points: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The counts of letters of each row of a matrix of Latin-1 code points."""
    real = np.arange(points.shape[1]) < length[:, None]
    row = np.repeat(np.arange(len(points)), length)
    return np.bincount(row * COLUMNS + COLUMN[points[real]], minlength=len(points) * COLUMNS).reshape(-1, COLUMNS)


def one_edit(points: np.ndarray, length: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of rows differ by exactly one inserted, deleted or replaced code point."""
    out = np.zeros(len(a), dtype=bool)
    step = max(1, STEP // max(points.shape[1], 1))
    for i in range(0, len(a), step):
        x, y = a[i : i + step], b[i : i + step]
        swap = length[x] > length[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        p, q, n = points[x], points[y], length[x]
        same = p == q
        replaced = (length[y] == n) & ((~same).sum(axis=1) == 1)
        # of the longer one, what is equal up to a place and shifted by one behind it
        front = np.logical_and.accumulate(same, axis=1).sum(axis=1)
        shifted = p[:, :-1] == q[:, 1:]
        shifted |= np.arange(p.shape[1] - 1) >= n[:, None]
        back = np.logical_and.accumulate(shifted[:, ::-1], axis=1).sum(axis=1)
        back = back - (p.shape[1] - 1 - n)
        out[i : i + step] = replaced | ((length[y] == n + 1) & (np.minimum(front, n) + back >= n))
    return out


def near_pairs(words: list[str], firsts: int, tile: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of near words, the first one of the first ``firsts`` and the second behind it; of different tiles if those are given."""
    raw = [w.encode("latin-1") for w in words]
    length = np.array([len(r) for r in raw], dtype=np.int64)
    points = np.zeros((len(raw), int(length.max()) + 1), dtype=np.uint8)
    points[np.arange(points.shape[1]) < length[:, None]] = np.frombuffer(b"".join(raw), np.uint8)
    counts = letter_counts(points, length).astype(np.float32 if length.max() < 2000 else np.float64)  # squares stay exact
    norm = (counts * counts).sum(axis=1)
    left, right = [], []
    for i in range(0, firsts, 512):
        own = np.arange(i, min(i + 512, firsts))
        squared = norm[own, None] + norm[None, i:] - 2 * (counts[own] @ counts[i:].T)
        x, y = np.nonzero(squared <= 2)
        x, y = own[x], y + i
        keep = x < y
        if tile is not None:
            keep &= tile[x] != tile[y]
        x, y = x[keep], y[keep]
        edited = one_edit(points, length, x, y)
        left.append(x[edited])
        right.append(y[edited])
    return np.concatenate(left), np.concatenate(right)


FOUND = "word string, n_near long, n long, near string"


def _best(words: list[str], n: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Table:
    """For each word of the pairs, how many near ones it has here and the one of the largest n, in the order of code points."""
    own, other = np.concatenate((a, b)), np.concatenate((b, a))
    rank = np.empty(len(words), dtype=np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[other], -n[other], own))
    own, other = own[order], other[order]
    first = np.flatnonzero(np.diff(own, prepend=-1))
    many = np.diff(np.append(first, len(own)))
    return pa.table({"word": pa.array([words[i] for i in own[first]], pa.string()), "n_near": pa.array(many, pa.int64()), "n": pa.array(n[other[first]], pa.int64()), "near": pa.array([words[i] for i in other[first]], pa.string())})


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near and the near word of the largest n with that n, of each of the distinct words (word, n) that has one."""
    groups = _groups(words.count())
    rows = blocked(words, groups)
    sizes = rows.groupBy("block").agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("side") == 0).alias("own")).filter("m > 1 and own > 0")
    sizes = cut(sizes.select("block", "m", F.ceil(F.col("m") / TILE).cast("int").alias("tiles")))
    total = sizes.agg(F.sum(F.col("m") * F.col("tiles"))).first()[0] or 0
    parts = math.ceil(total / PART) or 1
    rows = rows.join(sizes.drop("m"), "block").withColumn("tile", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("i", F.least("tile", "o")).withColumn("j", F.greatest("tile", "o"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("block", "i", "j"), F.lit(parts)).cast("int")).drop("tiles", "o")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("block", "i", "j", "side")])
        block = table.column("block").combine_chunks().dictionary_encode()
        block = (block.combine_chunks() if isinstance(block, pa.ChunkedArray) else block).indices.to_numpy()
        i, j, side, tile, n = (table.column(c).to_numpy() for c in ("i", "j", "side", "tile", "n"))
        words = table.column("word").to_pylist()
        new = np.ones(len(block), dtype=bool)
        new[1:] = (block[1:] != block[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        begin = np.flatnonzero(new).tolist()
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in zip(begin, [*begin[1:], len(block)], strict=True):
            own = int((side[a:b] == 0).sum())
            if b - a > 1 and own:
                x, y = near_pairs(words[a:b], own, tile[a:b] if i[a] != j[a] else None)
                left.append(x + a)
                right.append(y + a)
        # a word that stands in several blocks is one word here
        distinct, at = np.unique(np.array(words, dtype=object), return_inverse=True)
        count = np.zeros(len(distinct), dtype=np.int64)
        count[at] = n
        return _best(distinct.tolist(), count, at[np.concatenate(left)], at[np.concatenate(right)])

    found = rows.groupBy("part").applyInArrow(compare, FOUND)
    best = F.min(F.struct((-F.col("n")).alias("minus"), "near")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.minus")).alias("near_n"))


def variants(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = 6, often: int = 5, times: int = 5, drop: int = 199) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word of at least ``least`` code points and ``often`` occurrences.

    A form is the near word of the largest n if that is ``times`` the word's or more. So n grows along forms, they make
    no circle, and the number of steps to the root is a logarithm of the largest n; each round doubles the steps taken.
    """
    words = cut(word_counts(docs, doc_id=doc_id, text=text, least=least, drop=drop).filter(F.col("n") >= often))
    near = words.join(near_words(words), "word", "left")
    better = F.col("near_n") >= times * F.col("n")
    near = cut(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(better, F.col("near")).alias("form"), F.when(better, F.col("near_n")).alias("form_n")))
    now = cut(near.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        after = cut(after)
        now = after.drop("moved")
        if after.filter("moved").isEmpty():
            break
    out = near.join(now, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
