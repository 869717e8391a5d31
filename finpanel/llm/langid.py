"""Language identification by prediction by partial matching over bytes, with context trees of variable order.

Every language has a tree of contexts of no byte up to ``order`` bytes. A context is in the tree if at least ``share`` of
all bytes of its language stand behind it; then all its suffixes are in the tree too, and a language has at most
1 / share contexts of each length, however large the corpus is. A byte costs the exact code length of a PPM coder with
frozen counts, from the longest context in the tree on: there a seen byte x has probability n(x) / (n + d) and the escape
d / (n + d), with n counts of d distinct bytes; after an escape the context without its first byte is asked in the same way,
leaving out the bytes that the longer one has seen (with no others left, the escape is free), and at last all bytes not yet
left out are equally likely. The language with the shortest code for the whole text wins, ties go to the smaller name, and
the score is its share of probability.

Counts cover all learning rows. Contexts of two bytes and less come from one pass; each further byte is one more pass that
counts behind the contexts already in the tree only. Spark adds the counts up and leaves out what is not in the tree,
and the driver gathers the trees alone.

Defined results: a null text or one without a letter is ``und`` with score 0, and so is everything if no language was
learned; rows without a language teach nothing; repeated rows count and are predicted each; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finpanel.llm import kernels as K
from finpanel.llm.storage import cut

SLICE = 1 << 20
START = 10  # what stands before a text: a line end
FIRST = 2  # context bytes counted in the first pass
RESULT = "doc_id {id}, held_out boolean, lang_pred string, score double"


@dataclass
class Level:
    """Contexts of one length, and the bytes behind them (``gram`` is a context and one byte more), both in order."""

    context: np.ndarray
    seen: np.ndarray  # bits of finding a byte here first, without those for its count
    leave: np.ndarray  # bits of all escapes from here down to no context
    parent: np.ndarray  # bits to add for a byte found in the next shorter context, without those for its count
    gram: np.ndarray
    count: np.ndarray  # log2 of the counts


@dataclass
class Coder:
    """The trees of all languages; ``levels[language][length of the context]``."""

    names: list[str]
    order: int
    levels: list[list[Level]]

    def bits(self, windows: np.ndarray, language: int) -> np.ndarray:
        """Code length of the last byte of each window, which holds ``order`` bytes of context before it."""
        context, root = windows >> 8, self.levels[language][0]
        rows = np.arange(len(windows))
        at, found = _find(root.gram, windows & 255)
        below = np.where(found, root.count[at], 0.0)  # of the longest context so far that has seen the byte
        cost = np.where(found, root.seen[0] - below, np.log2(max(256 - len(root.gram), 1)) + root.leave[0])
        rest = np.full(len(windows), np.log2(max(256 - len(root.gram), 1)))  # bits behind all escapes
        for k in range(1, self.order + 1):
            level = self.levels[language][k]
            suffix = context[rows] & (1 << 8 * k) - 1
            node, inside = _find(level.context, suffix)
            rows, node, suffix, found = rows[inside], node[inside], suffix[inside], found[inside]
            if not len(rows):
                break
            at, here = _find(level.gram, suffix << 8 | windows[rows] & 255)
            lost = found & ~here
            rest[rows[lost]] = level.parent[node[lost]] - below[rows[lost]]
            below[rows[here]] = level.count[at[here]]
            cost[rows] = np.where(here, level.seen[node] - below[rows], level.leave[node] + rest[rows])
            found = here
        return cost


def _find(ordered: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands in an ordered array, and whether it does."""
    if not len(ordered):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(ordered, keys), len(ordered) - 1)
    return at, ordered[at] == keys


def tree(grams: list[np.ndarray], counts: list[np.ndarray]) -> list[Level]:
    """The levels of one language from the ordered grams of each context length and their counts."""
    out: list[Level] = []
    for k, (gram, n) in enumerate(zip(grams, counts, strict=True)):
        context, first = np.unique(gram >> 8, return_index=True)
        total = np.add.reduceat(n, first) if len(gram) else np.zeros(0, np.int64)
        distinct = np.diff(np.append(first, len(gram)))
        seen = np.log2(total + distinct)
        leave = seen - np.log2(np.maximum(distinct, 1))
        parent = np.zeros(len(context))
        if k:
            up, _ = _find(out[-1].context, context & (1 << 8 * (k - 1)) - 1)
            same, _ = _find(grams[k - 1], gram & (1 << 8 * k) - 1)
            shared = np.add.reduceat(counts[k - 1][same], first) if len(gram) else np.zeros(0, np.int64)
            others = up_distinct[up] - distinct
            others_total = up_total[up] - shared + others
            free = others == 0
            escape = np.where(free, 0.0, np.log2(np.maximum(others_total, 1)) - np.log2(np.maximum(others, 1))) + down[up]
            parent = np.log2(np.maximum(others_total, 1)) - escape
            leave, down = leave + escape, escape
        else:
            down = np.zeros(len(context))
        up_total, up_distinct = total, distinct
        out.append(Level(context, seen, leave, parent, gram, np.log2(n)))
    return out


def windows(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """Each byte with the ``order`` bytes before it in its document, as one number."""
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    out = data.astype(np.int64)
    for s in range(1, order + 1):
        before = np.full(len(data), START, dtype=np.int64)
        before[s:] = np.where(place[s:] >= s, data[:-s], START) if s < len(data) else before[s:]
        out |= before << 8 * s
    return out


def _counts(known: DataFrame, order: int, inside=None) -> DataFrame:
    """lang, gram, n: how often each byte stands behind each context of ``order`` bytes.

    ``inside``, a broadcast of ordered contexts by language, leaves only contexts whose last ``order`` - 1 bytes are among them.
    """

    def count(batches):
        for batch in batches:
            names = batch.column(1).dictionary_encode()
            codes = names.indices.to_numpy(zero_copy_only=False)
            data, offsets = K.buffers(batch.column(0))
            for i, j in K.slices(offsets, SLICE):
                grams = windows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], order)
                own = np.repeat(codes[i:j], np.diff(offsets[i : j + 1]))
                for code in np.unique(own):
                    name = names.dictionary[int(code)]
                    keys, n = np.unique(grams[own == code], return_counts=True)
                    if inside is not None:
                        _, kept = _find(inside.value[name.as_py()], keys >> 8 & (1 << 8 * (order - 1)) - 1)
                        keys, n = keys[kept], n[kept]
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(name.as_py(), pa.string()), len(keys)), pa.array(keys), pa.array(n)], names=["lang", "gram", "n"])

    return known.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _gather(counted: DataFrame, least: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Grams in order and their counts for each language, of the contexts that are frequent enough."""
    context = Window.partitionBy("lang", F.shiftright("gram", 8))
    table = counted.withColumn("behind", F.sum("n").over(context)).join(least, "lang").filter("behind >= least").select("lang", "gram", "n").toArrow()
    names = table["lang"].combine_chunks().dictionary_encode() if table.num_rows else None
    out = {}
    for code, name in enumerate(names.dictionary.to_pylist() if names is not None else []):
        own = np.flatnonzero(names.indices.to_numpy() == code)
        gram, n = table["gram"].to_numpy()[own], table["n"].to_numpy()[own]
        order = np.argsort(gram)
        out[name] = gram[order], n[order]
    return out


def learn(rows: DataFrame, *, text: str = "text", lang: str = "lang", order: int = 4, share: float = 2.0**-14) -> Coder:
    """Counts all rows with a language and builds the trees.

    ``order``, 2 to 6, is the length of the longest context, ``share`` the part of a language's bytes that must stand behind a context.
    """
    if not FIRST <= order <= 6:
        raise ValueError("order must be 2 to 6")
    known = rows.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).filter("lang is not null and text is not null")
    counted = cut(_counts(known, FIRST))
    # one row for each language
    least = cut(counted.groupBy("lang").agg((F.sum("n") * share).alias("least")))
    found = [_gather(counted.withColumn("gram", F.col("gram").bitwiseAND((1 << 8 * (k + 1)) - 1)).groupBy("lang", "gram").agg(F.sum("n").alias("n")), least) for k in range(FIRST + 1)]
    empty = np.zeros(0, np.int64), np.zeros(0, np.int64)
    names = sorted(found[0])
    for k in range(FIRST + 1, order + 1):
        inside = rows.sparkSession.sparkContext.broadcast({name: np.unique(found[-1].get(name, empty)[0] >> 8) for name in names})
        found.append(_gather(_counts(known, k, inside), least))
    levels = [tree(*zip(*(level.get(name, empty) for level in found), strict=True)) for name in names]
    return Coder(names, order, levels)


def identify(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", held_out: Column | None = None, order: int = 4, share: float = 2.0**-14) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row; rows where ``held_out`` is true teach nothing.

    The default holds out the rows whose crc32 of the id as text leaves 1 when divided by 3.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    if held_out is None:
        held_out = F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
    coder = docs.sparkSession.sparkContext.broadcast(learn(docs.filter(~held_out), text=text, lang=lang, order=order, share=share))

    def run(batches):
        c = coder.value
        names = pa.array([*c.names, "und"])
        for batch in batches:
            data, offsets = K.buffers(batch.column(2))
            lettered = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            best, score = np.full(len(lettered), len(c.names)), np.zeros(len(lettered))
            for i, j in K.slices(offsets, SLICE) if c.names else ():
                own = offsets[i : j + 1] - offsets[i]
                filled = np.flatnonzero(np.diff(own) > 0)
                if not len(filled):
                    continue
                # equal windows are looked up once for each slice
                distinct, which = np.unique(windows(data[offsets[i] : offsets[j]], own, c.order), return_inverse=True)
                total = np.stack([np.add.reduceat(c.bits(distinct, k)[which], own[filled]) for k in range(len(c.names))], axis=1)
                at = total.argmin(axis=1)
                best[i + filled] = at
                score[i + filled] = 1 / np.exp2(np.maximum(total[np.arange(len(at)), at][:, None] - total, -1000)).sum(axis=1)
            best[~lettered], score[~lettered] = len(c.names), 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), names.take(pa.array(best)), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out.alias("held_out"), F.col(text).cast("string").alias("text"), F.coalesce(F.col(text).cast("string").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    return rows.mapInArrow(run, RESULT.format(id=kind))
