"""Removal of word passages that repeat across documents, by fixed-block anchors.

A window is ``window`` consecutive words of one document. Words covered by a window whose word sequence also starts
in a document with a smaller id are removed; windows are judged on the input.

Every window holds one whole block of ``(window + 1) // 2`` words out of those that stand at multiples of that
length, so the blocks of all documents are the anchors, and each rolling run of as many words probes them. An anchor
that a later document meets is extended: all windows around it, on either side, are compared by 96 bits and more of
hash, and runs of equal windows are the maximal repeats.

Documents are dealt to chunks by a hash of their content. A chunk sends each bucket of the hash space its distinct
runs once, 4 bytes each, with the documents' ids as deltas, and gets one bit back for each; then the windows that
remain, 12 bytes each, and one bit back. So a passage that a third of all documents share costs each chunk and
bucket two entries, no pair of documents is ever built, and no passage is dropped.

Defined results: null and empty texts have no words; a row with a null id neither removes nor loses words; rows with
equal ids don't count against each other; repeated rows each get their row; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finpanel.llm import kernels as K

#: Bytes of text in a chunk and behind a bucket, on average; a document is never cut.
CHUNK = 3 << 20
BUCKET = 10 << 20
WORD = ~K.SPACE
SENT = "bucket int, chunk long, ids binary, counts binary, one binary, two binary"
BACK = "chunk long, bucket int, step int, bits binary"
RESULT = "doc_id {id}, n_words long, n_removed long, kept string"


def _pack(values: np.ndarray) -> bytes:
    """Unsigned integers in the smallest type that holds them."""
    top = int(values.max()) if len(values) else 0
    kind = "u1" if top < 1 << 8 else "u2" if top < 1 << 16 else "u4" if top < 1 << 32 else "u8"
    return kind.encode() + values.astype(kind).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, raw[:2].decode(), offset=2).astype(np.int64)


class _Entries:
    """The distinct hashes of a chunk as it sends them: by bucket, then by document.

    ``group`` numbers the distinct hashes, ``of`` has the number of each occurrence, and ``rank`` the place of each
    entry's document among the chunk's ids. The order depends on the chunk's documents alone, so that one bit for each
    entry says all when it comes back.
    """

    def __init__(self, bucket: np.ndarray, rank: np.ndarray, group: np.ndarray, of: np.ndarray, one: np.ndarray, two: np.ndarray | None):
        order = np.lexsort((group, rank, bucket))
        self.bucket, self.rank, self.group, self.of, self.one = bucket[order], rank[order], group[order], of, one[order]
        self.two = None if two is None else two[order]

    def rows(self, chunk: int, ids: np.ndarray) -> pa.RecordBatch:
        names, begin = np.unique(self.bucket, return_index=True)
        end = np.append(begin[1:], len(self.bucket))[: len(begin)]
        out: list[list] = [[], [], [], []]
        for a, b in zip(begin.tolist(), end.tolist(), strict=True):
            rank, counts = np.unique(self.rank[a:b], return_counts=True)
            own = ids[rank]
            out[0].append(own[:1].tobytes() + _pack(np.diff(own)))
            out[1].append(_pack(counts))
            out[2].append(self.one[a:b].tobytes())
            out[3].append(None if self.two is None else self.two[a:b].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array(np.full(len(names), chunk, np.int64)), *(pa.array(x, pa.binary()) for x in out)], names=["bucket", "chunk", "ids", "counts", "one", "two"])

    def read(self, answers: dict[int, bytes]) -> np.ndarray:
        """For each distinct hash whether one of its entries got a 1."""
        good = np.zeros(int(self.of.max()) + 1 if len(self.of) else 0, dtype=bool)
        names, begin = np.unique(self.bucket, return_index=True)
        end = np.append(begin[1:], len(self.bucket))[: len(begin)]
        for name, a, b in zip(names.tolist(), begin.tolist(), end.tolist(), strict=True):
            bits = np.unpackbits(np.frombuffer(answers[name], np.uint8), count=b - a).astype(bool)
            good[self.group[a:b][bits]] = True
        return good


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by the keys, where its groups begin, and the group of each occurrence."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    of = np.empty(len(order), dtype=np.int64)
    of[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), of


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> K.U64(32)) * K.U64(buckets) >> K.U64(32)).astype(np.int64)


class _Chunk:
    """The words of a chunk's documents, in order of id."""

    def __init__(self, table: pa.Table, window: int, buckets: int):
        unknown = table.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        self.rest = np.flatnonzero(unknown)
        known = np.flatnonzero(~unknown)
        ids = table.column("doc_id").take(pa.array(known)).cast(pa.int64()).to_numpy()
        self.rows = known[np.argsort(ids, kind="stable")]
        self.ids, rank = np.unique(ids[np.argsort(ids, kind="stable")], return_inverse=True)
        self.data, self.offsets = K.buffers(table.column("text").take(pa.array(self.rows)))
        self.start, self.end, self.doc = K.word_bounds(self.data, self.offsets, WORD)
        self.words = K.range_hashes(self.data, self.start, self.end)
        self.n_words = np.bincount(self.doc, minlength=len(self.rows))
        self.rank = rank[self.doc]
        self.window, self.block, self.buckets = window, (window + 1) // 2, buckets

    def anchors(self) -> tuple[np.ndarray, _Entries]:
        """Positions of all runs, and the entries: 31 bits of hash, and a flag for the smallest id that has the run as a block; else it is the largest id that has the run."""
        at = np.flatnonzero(K.gram_inside(self.doc, self.block))
        h, rank = K.gram_hashes(self.words, self.block)[at], self.rank[at]
        block = (at - (np.cumsum(self.n_words) - self.n_words)[self.doc[at]]) % self.block == 0
        order, begin, of = _groups(h)
        if not len(at):
            return at, _Entries(*(np.zeros(0, np.int64),) * 4, np.zeros(0, np.uint32), None)
        n = len(at)
        last = rank[order[np.append(begin[1:], n) - 1]]  # documents stand in order of id, and the order is stable
        first_block = np.minimum.reduceat(np.where(block[order], np.arange(n), n), begin)
        has = np.flatnonzero(first_block < n)
        low = rank[order[first_block[has]]]
        single = np.zeros(len(begin), dtype=bool)
        single[has[low == last[has]]] = True
        probes = np.flatnonzero(~single)
        group = np.concatenate((has, probes))
        rep = h[order[begin[group]]]
        flag = np.arange(len(group)) < len(has)
        value = ((rep & K.U64(0x7FFFFFFF)) << K.U64(1) | flag.astype(K.U64)).astype(np.uint32)
        return at, _Entries(_bucket(rep, self.buckets), np.concatenate((low, last[probes])), group, of, value, None)

    def candidates(self, answers: dict[int, bytes]) -> np.ndarray:
        """Where the windows around runs start that a later document shares with a block of an earlier one."""
        at, entries = self.anchors()
        met = np.zeros(len(self.doc) + self.window + 1, dtype=np.int64)
        met[at[entries.read(answers)[entries.of]] + 1] = 1
        met = np.cumsum(met)
        starts = np.flatnonzero(K.gram_inside(self.doc, self.window))
        return starts[met[starts + self.window - self.block + 1] > met[starts]]

    def windows(self, answers: dict[int, bytes]) -> tuple[np.ndarray, _Entries, np.ndarray]:
        """Candidates, their entries, and for each distinct window the smallest rank that has it."""
        at = self.candidates(answers)
        one = K.gram_hashes(self.words, self.window)[at]
        two = K.gram_hashes(self.words, self.window, 1)[at].astype(np.uint32)
        order, begin, of = _groups(one, two)
        first = order[begin]
        low = self.rank[at][first]
        return at, _Entries(_bucket(one[first], self.buckets), low, np.arange(len(first)), of, one[first], two[first]), low

    def result(self, answers: dict[int, dict[int, bytes]], table: pa.Table) -> pa.Table:
        at, entries, low = self.windows(answers[1])
        gone = entries.read(answers[2])[entries.of] | (self.rank[at] > low[entries.of]) if len(at) else np.zeros(0, dtype=bool)
        removed = K.cover(at[gone], self.window, len(self.doc))
        kept = ~removed
        docs = len(self.rows)
        n_kept = np.bincount(self.doc[kept], minlength=docs)
        # each kept word and the separator behind it, but for the last kept word of a document
        to = self.end[kept].copy()
        if len(to):
            more = np.zeros(len(to), dtype=bool)
            more[:-1] = self.doc[kept][1:] == self.doc[kept][:-1]
            self_data = np.append(self.data, np.uint8(32))
            self_data[self.end[kept][more]] = 32
            to += more
            length = to - self.start[kept]
            out = self_data[K.ragged(self.start[kept], length)]
            sizes = np.bincount(self.doc[kept], weights=length, minlength=docs).astype(np.int64)
        else:
            out, sizes = np.zeros(0, np.uint8), np.zeros(docs, np.int64)
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        texts = pa.LargeStringArray.from_buffers(docs, pa.py_buffer(offsets), pa.py_buffer(out)).cast(pa.string())
        ids = table.column("doc_id").combine_chunks()
        parts = [pa.table({"doc_id": ids.take(pa.array(self.rows)), "n_words": pa.array(self.n_words, pa.int64()), "n_removed": pa.array(self.n_words - n_kept, pa.int64()), "kept": texts})]
        if len(self.rest):
            data, offsets = K.buffers(table.column("text").take(pa.array(self.rest)))
            start, end, doc = K.word_bounds(data, offsets, WORD)
            raw = data.tobytes()
            words: list[list[str]] = [[] for _ in self.rest]
            for d, a, b in zip(doc.tolist(), start.tolist(), end.tolist(), strict=True):
                words[d].append(raw[a:b].decode())
            parts.append(pa.table({"doc_id": ids.take(pa.array(self.rest)), "n_words": pa.array([len(w) for w in words], pa.int64()), "n_removed": pa.array([0] * len(words), pa.int64()), "kept": pa.array([" ".join(w) for w in words], pa.string())}))
        return pa.concat_tables(parts)


def _answers(back: pa.Table) -> dict[int, dict[int, bytes]]:
    out: dict[int, dict[int, bytes]] = {1: {}, 2: {}}
    for bucket, step, bits in zip(*(back.column(c).to_pylist() for c in ("bucket", "step", "bits")), strict=True):
        out[step][bucket] = bits
    return out


def _sent(table: pa.Table, types: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The entries of a bucket: how many each row has, the id and the values of each."""
    ids, sizes = [], []
    for raw, counts in zip(table.column("ids").to_pylist(), table.column("counts").to_pylist(), strict=True):
        first, n = np.frombuffer(raw[:8], "i8"), _unpack(counts)
        ids.append(np.repeat(np.concatenate((first, first + np.cumsum(_unpack(raw[8:])))), n))
        sizes.append(len(ids[-1]))
    values = [np.concatenate([np.frombuffer(x, kind) for x in table.column(c).to_pylist()]) for c, kind in zip(("one", "two"), types, strict=False)]
    return np.array(sizes), np.concatenate(ids), values


def _reply(table: pa.Table, sizes: np.ndarray, bits: np.ndarray, step: int) -> pa.Table:
    end = np.cumsum(sizes)
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "step": pa.array(np.full(len(sizes), step, np.int32)), "bits": pa.array([np.packbits(bits[a:b]).tobytes() for a, b in zip(end - sizes, end, strict=True)], pa.binary())})


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the remaining words, joined by a space) of each row; ids are integers."""
    kind = docs.schema[doc_id].dataType.simpleString()
    volume = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    chunks, buckets = math.ceil(volume / CHUNK) or 1, math.ceil(volume / BUCKET) or 1
    dealt = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(chunks)).cast("long").alias("chunk"))

    def send_anchors(table: pa.Table) -> pa.Table:
        c = _Chunk(table, window, buckets)
        return pa.Table.from_batches([c.anchors()[1].rows(table.column("chunk")[0].as_py(), c.ids)])

    def meet_anchors(table: pa.Table) -> pa.Table:
        sizes, ids, (value,) = _sent(table, ("u4",))
        keys, of = np.unique(value >> 1, return_inverse=True)
        low, high = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), np.iinfo(np.int64).min)
        block = (value & 1).astype(bool)
        np.minimum.at(low, of[block], ids[block])
        np.maximum.at(high, of, ids)
        return _reply(table, sizes, (low < high)[of], 1)

    def send_windows(table: pa.Table, back: pa.Table) -> pa.Table:
        c = _Chunk(table, window, buckets)
        return pa.Table.from_batches([c.windows(_answers(back)[1])[1].rows(table.column("chunk")[0].as_py(), c.ids)])

    def meet_windows(table: pa.Table) -> pa.Table:
        sizes, ids, (one, two) = _sent(table, ("u8", "u4"))
        _, begin, of = _groups(one, two)
        low = np.full(len(begin), np.iinfo(np.int64).max)
        np.minimum.at(low, of, ids)
        return _reply(table, sizes, low[of] < ids, 2)

    def finish(table: pa.Table, back: pa.Table) -> pa.Table:
        return _Chunk(table, window, buckets).result(_answers(back), table)

    by_chunk = dealt.groupBy("chunk")
    first = by_chunk.applyInArrow(send_anchors, SENT).groupBy("bucket").applyInArrow(meet_anchors, BACK)
    second = by_chunk.cogroup(first.groupBy("chunk")).applyInArrow(send_windows, SENT).groupBy("bucket").applyInArrow(meet_windows, BACK)
    return by_chunk.cogroup(first.unionByName(second).groupBy("chunk")).applyInArrow(finish, RESULT.format(id=kind))
