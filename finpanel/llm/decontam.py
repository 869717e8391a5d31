"""Benchmark decontamination by winnowing.

A text is lower-cased in A-Z and cut into words of digits, letters and non-ASCII characters. Of every ``window``
consecutive words the k-gram with the smallest hash is kept, so a shared span of at least ``window`` words shares a
kept k-gram: the winnowing guarantee with ``window - k + 1`` k-grams in a row. Kept k-grams of documents are joined
with those of benchmark items, and each meeting is extended to all word windows around it, which are compared by
128-bit hashes of their word sequences. An item of fewer words than ``window``, but not none, is one window; its
k-gram is the whole item, and no document k-gram of that length is left out.

Defined results: a null or empty text has no words and is clean; items with a null id or without words match
nothing; repeated documents are judged row by row, repeated items count once; further columns are ignored
(``find_contamination``) or kept (``drop_contaminated``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finpanel.llm import kernels as K

SLICE = 1 << 20
RESULT = "doc_id {id}, n_words long, n_hit long, items array<string>, spans array<struct<first:int,words:int>>"


@dataclass
class Windows:
    """Item windows of one length in order of their first hash, with the items of each window."""

    length: int
    first: np.ndarray
    second: np.ndarray
    begin: np.ndarray
    items: np.ndarray
    prints: np.ndarray


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each word and its document."""
    data = K.LOWER[data]
    start, end, doc = K.word_bounds(data, offsets, K.ALNUM)
    return K.range_hashes(data, start, end, 0), K.range_hashes(data, start, end, 1), doc


def _winnow(words: np.ndarray, doc: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the kept k-grams."""
    grams = K.gram_hashes(words, k)
    inside = K.gram_inside(doc, window)
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, K.U64)
    best, at = grams[:n].copy(), np.arange(n)
    for j in range(1, window - k + 1):
        less = grams[j : j + n] <= best
        np.copyto(best, grams[j : j + n], where=less)
        at[less] = np.flatnonzero(less) + j
    keep = np.zeros(len(grams), dtype=bool)
    keep[at[inside]] = True
    where = np.flatnonzero(keep)
    return where, grams[where]


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values


def build_index(ids: list, texts: pa.Array, window: int, k: int) -> tuple[list[str], list[Windows]]:
    """The windows of all items, by length."""
    data, offsets = K.buffers(texts)
    one, two, doc = _words(data, offsets)
    counts = np.bincount(doc, minlength=len(offsets) - 1) if len(offsets) > 1 else np.zeros(0, np.int64)
    known = np.array([x is not None for x in ids], dtype=bool)
    out = []
    for length in sorted({int(min(c, window)) for c, ok in zip(counts, known, strict=True) if c and ok}):
        inside = K.gram_inside(doc, length)
        at = np.flatnonzero(inside)
        at = at[known[doc[at]] & ((counts[doc[at]] >= window) if length == window else (counts[doc[at]] == length))]
        first, second, item = K.gram_hashes(one, length)[at], K.gram_hashes(two, length, 1)[at], doc[at]
        order = np.lexsort((item, second, first))
        first, second, item = first[order], second[order], item[order]
        new = np.ones(len(first), dtype=bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        begin = np.append(np.flatnonzero(new), len(first))
        if length == window:
            where, prints = _winnow(one, doc, k, window)
            prints = np.unique(prints[known[doc[where]]])
        else:
            prints = np.unique(first)
        out.append(Windows(length, first[new], second[new], begin, item, prints))
    return [str(x) for x in ids], out


def _hits(index: list[Windows], one: np.ndarray, two: np.ndarray, doc: np.ndarray, window: int, k: int) -> list[tuple[np.ndarray, np.ndarray, Windows]]:
    """For each window length the word positions where an item window starts, and which one it is."""
    out = []
    for w in index:
        if w.length == window:
            where, prints = _winnow(one, doc, k, window)
            met = where[_member(prints, w.prints)]
            near = (met[:, None] - np.arange(window - k + 1)[None, :]).ravel()
            at = np.unique(near[(near >= 0) & (near + window <= len(doc))])
        else:
            at = np.flatnonzero(_member(K.gram_hashes(one, w.length), w.prints))
        at = at[doc[at] == doc[at + w.length - 1]] if len(at) else at
        if not len(at):
            continue
        cells = K.ragged(at, np.full(len(at), w.length))
        first = K.gram_hashes(one[cells], w.length)[:: w.length]
        second = K.gram_hashes(two[cells], w.length, 1)[:: w.length]
        found = np.searchsorted(w.first, first)
        found[found == len(w.first)] = 0
        # Windows with one first hash and several second ones stand side by side.
        while True:
            wrong = (w.first[found] == first) & (w.second[found] != second) & (found + 1 < len(w.first))
            if not wrong.any():
                break
            found[wrong] += 1
        ok = (w.first[found] == first) & (w.second[found] == second)
        out.append((at[ok], found[ok], w))
    return out


def _judge(data: np.ndarray, offsets: np.ndarray, names: list[str], index: list[Windows], window: int, k: int) -> tuple[np.ndarray, np.ndarray, list, list]:
    """n_words, n_hit, items and hit spans of each document of a slice."""
    one, two, doc = _words(data, offsets)
    docs = len(offsets) - 1
    n_words = np.bincount(doc, minlength=docs)
    n_hit, items, spans = np.zeros(docs, np.int64), [[] for _ in range(docs)], [[] for _ in range(docs)]
    hits = _hits(index, one, two, doc, window, k)
    if sum(len(at) for at, _, _ in hits):
        starts = np.concatenate([at for at, _, _ in hits])
        lengths = np.concatenate([np.full(len(at), w.length) for at, _, w in hits])
        hit = K.cover(starts, lengths, len(doc))
        n_hit = np.bincount(doc[hit], minlength=docs)
        base = np.cumsum(n_words) - n_words
        edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            while a < b:  # a run of hits may pass from one document into the next
                d = doc[a]
                to = min(b, base[d] + n_words[d])
                spans[d].append({"first": int(a - base[d]), "words": int(to - a)})
                a = to
        found: dict[int, set[str]] = {}
        for at, which, w in hits:
            # one entry for each document and window, however often it occurs
            pairs = np.unique(np.stack([doc[at], which], axis=1), axis=0)
            for d, i in pairs.tolist():
                found.setdefault(d, set()).update(names[x] for x in w.items[w.begin[i] : w.begin[i + 1]])
        for d, s in found.items():
            items[d] = sorted(s)
    return n_words, n_hit, items, spans


def _mapper(index, window: int, k: int, text: str, emit):
    """Judges the text column of each batch and hands batch and results to ``emit``."""

    def run(batches):
        names, windows = index.value
        for batch in batches:
            data, offsets = K.buffers(batch.column(batch.schema.get_field_index(text)))
            parts = [_judge(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], names, windows, window, k) for i, j in K.slices(offsets, SLICE)]
            if not parts:
                continue
            yield emit(batch, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), [x for p in parts for x in p[2]], [x for p in parts for x in p[3]])

    return run


def _small_index(bench: DataFrame, item_id: str, item_text: str, window: int, k: int, limit: int):
    """A broadcast index if the items' texts are at most ``limit`` bytes, else None."""
    if (bench.agg(F.sum(F.octet_length(item_text))).first()[0] or 0) > limit:
        return None
    rows = bench.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("string").alias("t")).toArrow()
    built = build_index(rows["i"].to_pylist(), rows["t"].combine_chunks(), window, k)
    return bench.sparkSession.sparkContext.broadcast(built)


def find_contamination(docs: DataFrame, bench: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, k: int = 5, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids of items with occurring windows) and spans (runs of hit words) of each row.

    Benchmarks of at most ``broadcast_bytes`` of text go to every task as an index; larger ones are joined by shuffles.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    index = _small_index(bench, item_id, item_text, window, k, broadcast_bytes)
    if index is None:
        return _joined(texts, bench.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")), window, k).drop("key")
    span = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())]))

    def emit(batch, n_words, n_hit, items, spans):
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, span)], names=["doc_id", "n_words", "n_hit", "items", "spans"])

    return texts.mapInArrow(_mapper(index, window, k, "text", emit), RESULT.format(id=kind))


def drop_contaminated(docs: DataFrame, bench: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, k: int = 5, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no item window occurs."""
    index = _small_index(bench, item_id, item_text, window, k, broadcast_bytes)
    if index is None:
        texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
        found = _joined(texts, bench.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")), window, k)
        bad = found.filter("n_hit > 0").select(F.col("key").alias("__bad")).distinct()
        return docs.join(bad, _key(docs[doc_id], docs[text]) == bad["__bad"], "left_anti")

    def emit(batch, n_words, n_hit, items, spans):
        return batch.filter(pa.array(n_hit == 0))

    return docs.mapInArrow(_mapper(index, window, k, text, emit), docs.schema)


def _grams(k: int, window: int, kept: bool):
    """Rows (key, item, first, second, at, length): the kept k-grams, or all windows with the items' short ones."""

    def run(batches, lengths=None):
        for batch in batches:
            data, offsets = K.buffers(batch.column("text"))
            for i, j in K.slices(offsets, SLICE // 4):
                one, two, doc = _words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                counts = np.bincount(doc, minlength=j - i)
                base = np.cumsum(counts) - counts
                for length in sorted({window, *(lengths or ())}):
                    if kept and length == window:
                        at, first = _winnow(one, doc, k, window)
                        second = first
                    else:
                        at = np.flatnonzero(K.gram_inside(doc, length))
                        if lengths is None:
                            at = at[(counts[doc[at]] >= window) if length == window else (counts[doc[at]] == length)]
                        first, second = K.gram_hashes(one, length)[at], K.gram_hashes(two, length, 1)[at]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("key").slice(i, j - i).take(pa.array(doc[at])), pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), pa.array((at - base[doc[at]]).astype(np.int32)), pa.array(np.full(len(at), length, np.int32))],
                        names=["key", "first", "second", "at", "length"],
                    )

    return run


def _key(doc_id: Column, text: Column) -> Column:
    """Id and text of a row; a null id differs from all others, a null text is an empty one."""
    return F.concat_ws(":", doc_id.cast("string"), F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def _joined(texts: DataFrame, items: DataFrame, window: int, k: int) -> DataFrame:
    """The same result, and the key of each row, by shuffles: kept k-grams meet first, and only documents that met an item send all their windows."""
    from finpanel.llm.storage import cut

    kind = texts.schema["doc_id"].dataType.simpleString()
    word = F.size(F.expr(r"regexp_extract_all(lower(text), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', 0)"))
    items = items.filter("item is not null").withColumn("key", F.col("item"))
    short = [r[0] for r in items.select(word.alias("n")).filter(f"n between 1 and {window - 1}").distinct().collect()]  # below window numbers
    docs = texts.withColumn("key", _key(F.col("doc_id"), F.col("text")))

    def short_items(kept):
        def rows(batches):
            for batch in batches:
                yield from _grams(k, window, kept)([batch], None)
                data, offsets = K.buffers(batch.column("text"))
                one, two, doc = _words(data, offsets)
                counts = np.bincount(doc, minlength=len(offsets) - 1)
                for n in short:
                    at = np.flatnonzero(K.gram_inside(doc, n))
                    at = at[counts[doc[at]] == n]
                    yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(doc[at])), pa.array(K.gram_hashes(one, n)[at].view(np.int64)), pa.array(K.gram_hashes(two, n, 1)[at].view(np.int64)), pa.array(np.zeros(len(at), np.int32)), pa.array(np.full(len(at), n, np.int32))], names=["key", "first", "second", "at", "length"])

        return rows

    def doc_rows(kept):
        run = _grams(k, window, kept)
        return lambda batches: run(batches, short)

    schema = "key string, first long, second long, at int, length int"
    prints = items.mapInArrow(short_items(True), schema).select("first", "length").distinct()
    met = docs.select("key", "text").mapInArrow(doc_rows(True), schema).join(prints, ["first", "length"], "left_semi").select("key").distinct()
    near = docs.join(met, "key", "left_semi").dropDuplicates(["key"])
    windows = items.mapInArrow(short_items(False), schema).select("first", "second", "length", F.col("key").alias("item")).distinct()
    at = near.select("key", "text").mapInArrow(doc_rows(False), schema)
    hit = cut(at.join(windows, ["first", "second", "length"]).select("key", "item", "at", "length"))
    lists = hit.groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"), F.sort_array(F.collect_set(F.struct("at", "length"))).alias("starts"))
    runs = F.expr("""aggregate(starts, cast(array() as array<struct<first:int,words:int>>), (a, x) ->
        case when size(a) > 0 and element_at(a, -1).first + element_at(a, -1).words >= x.at
             then concat(slice(a, 1, size(a) - 1), array(named_struct('first', element_at(a, -1).first, 'words', greatest(element_at(a, -1).words, x.at + x.length - element_at(a, -1).first))))
             else concat(a, array(named_struct('first', x.at, 'words', x.length))) end)""")
    lists = lists.select("key", "items", runs.alias("spans"))
    return (
        docs.select("doc_id", "key", word.cast("long").alias("n_words"))
        .join(lists, "key", "left")
        .select("key", "doc_id", F.coalesce("n_words", F.lit(0)).alias("n_words"), F.expr("coalesce(aggregate(spans, 0L, (a, x) -> a + x.words), 0L)").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast("array<struct<first:int,words:int>>")).alias("spans"))
        .withColumn("doc_id", F.col("doc_id").cast(kind))
    )
