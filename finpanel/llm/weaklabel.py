"""A quality classifier from weak labels.

Overlapping heuristic labellers look at every whole text, and each votes for good, for bad, or not at all by its own
measure alone, so that their votes meet and conflict; each common fault is seen by two of them at least. The votes of all
documents become counts of vote patterns (at most 3 to the 10th), and expectation-maximisation over these counts
estimates how often each labeller votes how on good and on bad documents, and so how far it can be trusted. Its prior
is worth a few rows at every size, so that it is the votes that meet which decide. The posterior of a document's pattern is its soft label. Soft labels of a bounded sample of rows train a linear scorer on hashed pairs of neighbouring bytes and
on the levels of the labellers' measures, hashed alike, and the scorer judges every document.

The sample is the only part that doesn't cover all rows: about ``sample_rows`` rows, picked by a hash of id and text,
and never more than twice as many.

Defined results: a null or empty text, or one of white space only, gets score 0 and is rejected; a corpus without two
kinds of votes keeps every other text; repeated rows are judged alike; further columns are ignored (``score_quality``)
or kept (``keep_good``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finpanel.llm import kernels as K

SLICE = 1 << 19
BUCKETS = 2048
STATS = 512
ODD = np.array([chr(i) in "#$%&*^~|<>{}[]\\" for i in range(256)])
UPPER = np.array([65 <= i <= 90 for i in range(256)])
LETTER = np.array([65 <= i <= 90 or 97 <= i <= 122 or i >= 128 for i in range(256)])
ALPHA = np.array([48 <= i <= 57 for i in range(256)]) | LETTER
STOP = np.array([chr(i) in ".?!" for i in range(256)])
#: Labellers: the measure that each looks at, above which value it votes for bad, and below which one for good; between
#: the two it has no vote.
LABELLERS = (
    ("odd", 0.12, 0.08),  # words with an odd symbol
    ("shouting", 0.5, 0.2),  # capitals among ASCII letters
    ("exclaiming", 0.2, 0.05),  # words with an exclamation mark
    ("bare", 0.2, 0.1),  # words without a letter or digit
    ("repeating", 0.5, 0.35),  # runs of five words that occur before in the text
    ("digits", 0.6, 0.5),  # digits among letters and digits
    ("endless", 150.0, 100.0),  # words for each full stop
    ("long", 15.0, 13.0),  # mean characters of a word
    ("echoing", 0.3, 0.15),  # words equal to one of the two words before
    ("symbols", 0.08, 0.04),  # odd symbols among visible characters
)
VOTERS = len(LABELLERS)
#: Levels into which a measure falls, as shares of its bad value.
LEVELS = np.array([0.02, 0.1, 0.2, 0.35, 0.5, 0.7, 0.85, 1.0, 1.5])
RESULT = "doc_id {id}, votes array<int>, posterior double, score double, keep boolean"


def measures(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The labellers' measures of each document of a flat buffer, and its number of words."""
    docs = len(offsets) - 1
    start, end, doc = K.word_bounds(data, offsets, ~K.SPACE)
    n = np.bincount(doc, minlength=docs)
    out = np.zeros((len(LABELLERS), docs))
    if not len(start):
        return out, n

    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask)))
        return sums[offsets[1:]] - sums[offsets[:-1]]

    def words_with(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask)))
        return np.bincount(doc, weights=sums[end] > sums[start], minlength=docs)

    some = np.maximum(n, 1)
    upper = total(UPPER[data])
    lower = total((data >= 97) & (data <= 122))
    letters, digits = total(LETTER[data] & (data < 128)), total((data >= 48) & (data <= 57))
    stops = total(STOP[data])
    visible = total((data & 0xC0 != 0x80) & ~K.SPACE[data])
    out[0] = words_with(ODD[data]) / some
    out[1] = upper / np.maximum(upper + lower, 1)
    out[2] = words_with(data == 33) / some
    out[3] = (n - words_with(ALPHA[data])) / some
    hashes = K.range_hashes(data, start, end)
    inside = K.gram_inside(doc, 5)
    if inside.any():
        own = doc[: len(inside)][inside]
        grams = K.mix(K.gram_hashes(hashes, 5)[inside] + own.astype(K.U64) * K.U64(K.BASES[1]))
        _, first = np.unique(grams, return_index=True)
        distinct = np.bincount(own[first], minlength=docs)
        all_ = np.bincount(own, minlength=docs)
        out[4] = 1 - distinct / np.maximum(all_, 1)
        out[4][all_ == 0] = 0
    out[5] = digits / np.maximum(letters + digits, 1)
    out[6] = n / np.maximum(stops, 0.5)
    out[7] = visible / some
    echo = np.zeros(len(hashes), dtype=bool)
    for lag in (1, 2):
        echo[lag:] |= (hashes[lag:] == hashes[:-lag]) & (doc[lag:] == doc[:-lag])
    out[8] = np.bincount(doc, weights=echo, minlength=docs) / some
    out[9] = total(ODD[data]) / np.maximum(visible, 1)
    return out, n


def vote(measured: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Votes by labeller and document: 0 none, 1 good, 2 bad. Repetition and stops don't judge texts of fewer than 20 words."""
    out = np.zeros((VOTERS, measured.shape[1]), dtype=np.int8)
    for i, (name, bad, good) in enumerate(LABELLERS):
        out[i][measured[i] < good] = 1
        out[i][measured[i] > bad] = 2
        if name in ("repeating", "endless"):
            out[i][n_words < 20] = 0
    out[:, n_words == 0] = 0
    return out


def pattern(votes: np.ndarray) -> np.ndarray:
    return (votes.astype(np.int64) * (3 ** np.arange(len(votes)))[:, None]).sum(axis=0)


def unpattern(codes: np.ndarray) -> np.ndarray:
    return codes[None, :] // (3 ** np.arange(VOTERS))[:, None] % 3


@dataclass
class Labels:
    """What EM found: the share of good documents, and how often each labeller that votes says good on bad (0) and good (1) ones."""

    good: float
    says_good: np.ndarray
    rounds: int

    def posterior(self, codes: np.ndarray) -> np.ndarray:
        """The probability that a document of each pattern is good; a labeller without a vote says nothing about it."""
        votes, logs = unpattern(codes), np.log(np.stack([np.ones_like(self.says_good), self.says_good, 1 - self.says_good], axis=2))
        bad = np.log(1 - self.good) + sum(logs[i, 0, votes[i]] for i in range(len(votes)))
        good = np.log(self.good) + sum(logs[i, 1, votes[i]] for i in range(len(votes)))
        return 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))

    def accuracy(self) -> np.ndarray:
        """How often each labeller's vote is right, by the share of both kinds of documents."""
        return self.good * self.says_good[:, 1] + (1 - self.good) * (1 - self.says_good[:, 0])


def expectation_maximisation(codes: np.ndarray, counts: np.ndarray, *, sure: float = 9.0, rounds: int = 500) -> Labels:
    """Two classes, votes independent given the class, having none independent of it.

    A text starts as good with the share of good ones among its votes; the rounds then weigh each vote against the others
    by the rates they find. The prior is worth ``sure`` + 1 votes of a labeller on good texts, of which ``sure`` say good,
    and two on bad ones, one of each kind; it does not grow with the corpus.
    """
    votes = unpattern(codes)
    post = ((votes == 1).sum(axis=0) + 1) / ((votes > 0).sum(axis=0) + 2)
    weights = counts.astype(float)
    total = max(weights.sum(), 1.0)
    found = Labels(0.5, np.full((len(votes), 2), 0.5), 0)
    for i in range(rounds):
        rates = np.empty((len(votes), 2))
        for c, share, prior in ((0, weights * (1 - post), 1.0), (1, weights * post, sure)):
            for j in range(len(votes)):
                n = np.bincount(votes[j], weights=share, minlength=3)
                rates[j, c] = (n[1] + prior) / (n[1] + n[2] + prior + 1)
        found = Labels(float(np.clip((weights * post).sum() / total, 1e-6, 1 - 1e-6)), rates, i + 1)
        new = found.posterior(codes)
        if np.abs(new - post).max(initial=0) < 1e-6:
            break
        post = new
    return found


def _pair_bucket() -> np.ndarray:
    """The bucket of each pair of bytes."""
    return (K.mix(np.arange(65536, dtype=K.U64) + K.U64(1)) % K.U64(BUCKETS)).astype(np.int64)


def _pairs(data: np.ndarray) -> np.ndarray:
    return data[:-1].astype(np.int64) << 8 | data[1:]


def _levels(measured: np.ndarray) -> np.ndarray:
    """The bucket of each labeller's level, by document and labeller."""
    out = np.empty(measured.T.shape, dtype=np.int64)
    for i, (_, bad, _) in enumerate(LABELLERS):
        key = np.searchsorted(LEVELS, measured[i] / bad).astype(K.U64) + K.U64(100 * i + 7)
        out[:, i] = (K.mix(key) % K.U64(STATS)).astype(np.int64)
    return out


def features(data: np.ndarray, offsets: np.ndarray, bucket: np.ndarray, measured: np.ndarray) -> np.ndarray:
    """Shares of hashed byte pairs of each document, and behind them its hashed levels."""
    docs = len(offsets) - 1
    own = np.repeat(np.arange(docs), np.diff(offsets))
    out = np.zeros((docs, BUCKETS + STATS), dtype=np.float32)
    if len(data) > 1:
        inside = own[1:] == own[:-1]
        keys = own[1:][inside] * BUCKETS + bucket[_pairs(data)[inside]]
        pairs = np.bincount(keys, minlength=docs * BUCKETS).reshape(docs, BUCKETS)
        out[:, :BUCKETS] = pairs / np.maximum(pairs.sum(axis=1, keepdims=True), 1)
    np.add.at(out, (np.arange(docs)[:, None], BUCKETS + _levels(measured)), 1)
    return out


def packed(x: np.ndarray) -> list[bytes]:
    """Each row's columns that are not zero, as 16-bit numbers, and their values, as 32-bit floats: most of a text's columns are zero."""
    out = []
    for row in x:
        at = np.flatnonzero(row)
        out.append(at.astype("<u2").tobytes() + row[at].astype("<f4").tobytes())
    return out


def matrix(rows: pa.ChunkedArray) -> np.ndarray:
    """The packed rows as one matrix of 32-bit floats that may be written."""
    x, i = np.zeros((len(rows), BUCKETS + STATS), np.float32), 0
    for chunk in rows.chunks:
        data, offsets = K.buffers(chunk)
        for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            middle = begin + (end - begin) // 6 * 2
            x[i, np.frombuffer(data[begin:middle].tobytes(), "<u2")] = np.frombuffer(data[middle:end].tobytes(), "<f4")
            i += 1
    return x


def train(x: np.ndarray, y: np.ndarray, rounds: int = 200, decay: float = 1e-6) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Adam, on shares scaled in place by each bucket's spread; classes weigh the same."""
    scale = (1 / np.sqrt(x.mean(axis=0) + 1e-5)).astype(np.float32)
    x *= scale
    w, b = np.zeros(x.shape[1], dtype=np.float32), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    share = np.clip(y.mean(), 0.02, 0.98)
    weight = (y / share + (1 - y) / (1 - share)).astype(np.float32) / 2
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        g = (p - y) * weight / len(y)
        gw, gb = x.T @ g.astype(np.float32) + decay * w, float(g.sum())
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix1, fix2 = 1 - 0.9**t, 1 - 0.999**t
        w = w - 0.05 * (m / fix1) / (np.sqrt(v / fix2) + 1e-9)
        b -= 0.05 * (mb / fix1) / (np.sqrt(vb / fix2) + 1e-9)
    return (w * scale).astype(np.float64), float(b)


@dataclass
class Scorer:
    labels: Labels
    pair_weight: np.ndarray
    level_weight: np.ndarray
    bias: float


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sample_rows: int = 4000) -> Scorer | None:
    """Labellers, EM and scorer for a corpus; None without two kinds of documents."""
    texts = docs.select(F.col(doc_id).cast("string").alias("i"), F.col(text).cast("string").alias("t")).filter("t is not null")

    def patterns(batches):
        for batch in batches:
            data, offsets = K.buffers(batch.column(0))
            for i, j in K.slices(offsets, SLICE):
                measured, n = measures(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                codes, counts = np.unique(pattern(vote(measured, n))[n > 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], names=["code", "n"])

    found = texts.select("t").mapInArrow(patterns, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").toArrow()
    codes, counts = found["code"].to_numpy(), found["n"].to_numpy()
    if len(codes) < 2:
        return None
    labels = expectation_maximisation(codes, counts)
    bucket = _pair_bucket()

    def sampled(batches):
        for batch in batches:
            data, offsets = K.buffers(batch.column(0))
            for i, j in K.slices(offsets, SLICE):
                part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                measured, n = measures(part, own)
                keep = np.flatnonzero(n > 0)
                x = features(part, own, bucket, measured)[keep]
                yield pa.RecordBatch.from_arrays([pa.array(pattern(vote(measured, n))[keep]), pa.array(packed(x), pa.binary())], names=["code", "x"])

    share = min(1.0, sample_rows / max(int(counts.sum()), 1))
    picked = texts.filter(F.pmod(F.xxhash64("i", "t"), F.lit(1 << 30)) < int(share * (1 << 30))).select("t")
    rows = picked.mapInArrow(sampled, "code long, x binary").limit(2 * sample_rows).toArrow()
    if not rows.num_rows:
        return None
    y = labels.posterior(rows["code"].to_numpy()).astype(np.float32)

    x = matrix(rows["x"])
    del rows
    w, b = train(x, y)
    return Scorer(labels, w[:BUCKETS][bucket], w[BUCKETS:], b)


def _judge(s: Scorer | None, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Votes, posterior and score of each document."""
    measured, n = measures(data, offsets)
    votes = vote(measured, n)
    docs = len(offsets) - 1
    if s is None:
        return votes, (n > 0).astype(float), (n > 0).astype(float)
    post = s.labels.posterior(pattern(votes))
    total, pairs = np.zeros(docs), np.maximum(np.diff(offsets) - 1, 1)
    if len(data) > 1:
        sums = np.concatenate(([0, 0], np.cumsum(s.pair_weight[_pairs(data)])))  # to the pair that ends at each byte
        last, first = offsets[1:], np.minimum(offsets[:-1] + 1, offsets[1:])
        total = sums[last] - sums[first]
    score = 1 / (1 + np.exp(-np.clip(total / pairs + s.level_weight[_levels(measured)].sum(axis=1) + s.bias, -500, 500)))
    post[n == 0] = score[n == 0] = 0
    return votes, post, score


def score_quality(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sample_rows: int = 4000, threshold: float = 0.5) -> DataFrame:
    """doc_id, votes (1 good, -1 bad, 0 none, in the order of LABELLERS), posterior, score and keep of each row."""
    kind = docs.schema[doc_id].dataType.simpleString()
    scorer = docs.sparkSession.sparkContext.broadcast(fit(docs, doc_id=doc_id, text=text, sample_rows=sample_rows))

    def run(batches):
        for batch in batches:
            data, offsets = K.buffers(batch.column(1))
            for i, j in K.slices(offsets, SLICE):
                votes, post, score = _judge(scorer.value, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                signed = np.array([0, 1, -1], dtype=np.int32)[votes].T
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * VOTERS), pa.array(np.ascontiguousarray(signed).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists, pa.array(post), pa.array(score), pa.array(score >= threshold)], names=["doc_id", "votes", "posterior", "score", "keep"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, RESULT.format(id=kind))


def keep_good(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sample_rows: int = 4000, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the scorer keeps."""
    scorer = docs.sparkSession.sparkContext.broadcast(fit(docs, doc_id=doc_id, text=text, sample_rows=sample_rows))

    def run(batches):
        for batch in batches:
            data, offsets = K.buffers(batch.column(batch.schema.get_field_index(text)).cast(pa.string()))
            for i, j in K.slices(offsets, SLICE):
                score = _judge(scorer.value, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[2]
                yield batch.slice(i, j - i).filter(pa.array(score >= threshold))

    return docs.mapInArrow(run, docs.schema)
