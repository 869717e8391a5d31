"""Decontamination, repeats, SimHash, quality and language against plain restatements on small tables."""

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from finpanel.llm import blockrepeats, components, decontam, kernels, langid, simhash, weaklabel

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, n_words string, h int"
LONG = " ".join(f"w{i}" for i in range(40))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, repeats, clashing columns and shared passages."""
    rows = [
        (1, None, None, "x", 1), (2, "", "en", None, 2), (3, " \n\t ", "en", None, None), (4, "one", "en", "y", 3), (5, LONG, "en", "z", 4), (6, LONG, "en", "z", 4), (6, LONG, "en", "z", 4),
        (7, "before " + LONG.upper() + " after", None, None, 5), (8, "x y z", "de", None, 6), (None, LONG, "en", None, 7), (9, "a " * 5000, "en", None, 8), (10, "Ünïcode 日本語 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13", "de", None, 9),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words2(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_contamination(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = words2(text)
        n = min(len(w), 10)
        for i in range(len(w) - n + 1 if n and item is not None else 0):
            windows[tuple(w[i : i + n])].add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words2(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= own
        out.append((doc, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [8 << 20, 0])
def test_contamination(spark, docs, odd, limit):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    own = spark.createDataFrame([(900, "w3 w4 W5"), (901, LONG), (902, None), (903, "!!"), (None, "x y z"), (904, LONG), (904, LONG), (905, "日本語 w1")], "item_id long, text string")
    bench = bench.unionByName(own)
    items = [tuple(r) for r in bench.collect()]
    for table in (odd, docs):
        got = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontam.find_contamination(table, bench, broadcast_bytes=limit).collect()), key=str)
        assert got == brute_contamination([(r.doc_id, r.text) for r in table.collect()], items)
    kept = decontam.drop_contaminated(odd, bench, broadcast_bytes=limit)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 8, 9}


def test_contamination_spans_and_empty(spark, odd):
    bench = spark.createDataFrame([(1, "w3 w4 w5")], "item_id long, text string")
    r = {x.doc_id: x for x in decontam.find_contamination(odd, bench).collect()}
    assert [tuple(s) for s in r[7].spans] == [(4, 3)]
    assert decontam.find_contamination(odd.limit(0), bench).count() == 0
    assert decontam.find_contamination(odd, bench.limit(0)).filter("n_hit > 0").count() == 0


def brute_repeats(docs, window=13):
    seqs = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    least = {}
    for d, w in seqs:
        for i in range(len(w) - window + 1 if d is not None else 0):
            k = tuple(w[i : i + window])
            least[k] = min(d, least.get(k, d))
    out = []
    for d, w in seqs:
        gone = set()
        for i in range(len(w) - window + 1 if d is not None else 0):
            if least[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [1 << 13, 3 << 20])
def test_repeats(odd, docs, monkeypatch, chunk):
    monkeypatch.setattr(blockrepeats, "CHUNK", chunk)
    monkeypatch.setattr(blockrepeats, "BUCKET", chunk)
    for table in (odd, docs):
        got = sorted((tuple(r) for r in blockrepeats.remove_repeats(table).collect()), key=str)
        assert got == brute_repeats([(r.doc_id, r.text) for r in table.collect()])
    assert blockrepeats.remove_repeats(odd.limit(0)).count() == 0


def brute_print(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), seed=42) for i in range(max(len(w) - k + 1, 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(odd, docs):
    for table in (odd, docs):
        rows = table.select("doc_id", "text").collect()
        prints = [(r.doc_id, brute_print(r.text)) for r in rows]
        up = list(range(len(prints)))

        def find(i, up=up):
            while up[i] != i:
                i = up[i]
            return i

        for i in range(len(prints)):
            for j in range(i):
                if (prints[i][1] ^ prints[j][1]).bit_count() <= 4:
                    up[find(i)] = find(j)
        least = {}
        for i, (d, _) in enumerate(prints):
            if d is not None:
                least[find(i)] = min(d, least.get(find(i), d))
        want = sorted(((d, p, least.get(find(i))) for i, (d, p) in enumerate(prints)), key=str)
        got = sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(table).collect()), key=str)
        assert got == want
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {1, 4, 5, None}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_tiles_of_a_crowded_band(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 12)
    fps = sorted({int(b) ^ int(1 << int(i)) ^ int(1 << int(j)) for b in base for i, j in rng.integers(0, 62, (25, 2))})
    got = {tuple(r) for r in components.components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")), "a", "b").collect()}
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    linked = set()
    for i, x in enumerate(fps):
        for y in fps[:i]:
            if (x ^ y).bit_count() <= 4:
                linked |= {x, y}
                a, b = sorted((find(x), find(y)))
                up[b] = a
    assert got == {(f, find(f)) for f in linked}


def test_xxh64():
    rng = np.random.default_rng(3)
    for n in range(0, 90):
        rows = rng.integers(0, 256, (3, n), dtype=np.uint8)
        assert [int(x) for x in kernels.xxh64(rows)] == [xxhash.xxh64_intdigest(r.tobytes(), seed=42) for r in rows]


def test_word_bounds():
    texts = ["a b", "", None, " x", "y", "zz  q ", "é ü"]
    data, offsets = kernels.buffers(pa.array(texts))
    start, end, doc = kernels.word_bounds(data, offsets, ~kernels.SPACE)
    got = [(d, data[a:b].tobytes().decode()) for d, a, b in zip(doc.tolist(), start, end, strict=True)]
    assert got == [(0, "a"), (0, "b"), (3, "x"), (4, "y"), (5, "zz"), (5, "q"), (6, "é"), (6, "ü")]


def test_quality(spark, odd):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    r = weaklabel.score_quality(docs).join(labels, "doc_id").agg(F.avg((F.col("keep") == (F.col("quality") == 1)).cast("double")), F.avg(F.when(F.col("quality") == 1, F.col("keep").cast("double")))).first()
    assert r[0] >= 0.97 and r[1] >= 0.99
    got = {x.doc_id: x for x in weaklabel.score_quality(odd).collect()}
    assert not got[1].keep and not got[2].keep and not got[3].keep and got[2].score == 0
    kept = weaklabel.keep_good(odd)
    assert kept.columns == odd.columns and not {1, 2, 3} & {x.doc_id for x in kept.collect()}
    assert weaklabel.score_quality(odd.limit(0)).count() == 0


def test_expectation_maximisation_recovers_rates():
    """Measures drawn for good and bad texts, votes made by ``vote``: conflicting votes, and the rates they were drawn with."""
    rng = np.random.default_rng(1)
    good = rng.random(20000) < 0.8
    rates = np.linspace(0.3, 0.8, weaklabel.VOTERS)
    measured = np.empty((weaklabel.VOTERS, len(good)))
    for i, (_, bad_at, good_at) in enumerate(weaklabel.LABELLERS):
        u = rng.random(len(good))
        fault = u < np.where(good, 0.01, rates[i])
        measured[i] = np.where(fault, bad_at * 1.1, np.where(u > 0.95, (bad_at + good_at) / 2, good_at * 0.5))
    votes = weaklabel.vote(measured, np.full(len(good), 50))
    assert ((votes == 1).any(axis=0) & (votes == 2).any(axis=0)).sum() > 3000 and (votes == 0).any()
    codes, counts = np.unique(weaklabel.pattern(votes), return_counts=True)
    found = weaklabel.expectation_maximisation(codes, counts)
    assert abs(found.good - 0.8) < 0.02 and np.allclose(1 - found.says_good[:, 0], rates / 0.95, atol=0.05) and np.allclose(1 - found.says_good[:, 1], 0.01, atol=0.01)
    post = found.posterior(weaklabel.pattern(votes))
    assert ((post >= 0.5) == good).mean() > 0.98 and (found.accuracy() > 0.8).all()


def test_expectation_maximisation_is_the_loop_over_documents():
    """The rounds over pattern counts give what a plain loop over all documents and labellers gives."""
    from math import prod

    rng = np.random.default_rng(4)
    votes = rng.choice(3, (weaklabel.VOTERS, 150), p=(0.2, 0.65, 0.15))
    codes, counts = np.unique(weaklabel.pattern(votes), return_counts=True)
    found = weaklabel.expectation_maximisation(codes, counts, rounds=6)
    docs = votes.T.tolist()
    post = [(d.count(1) + 1) / (d.count(1) + d.count(2) + 2) for d in docs]
    for _ in range(6):
        rate = []
        for j in range(weaklabel.VOTERS):
            one = []
            for c in (0, 1):
                yes = sum(p if c else 1 - p for p, d in zip(post, docs, strict=True) if d[j] == 1)
                no = sum(p if c else 1 - p for p, d in zip(post, docs, strict=True) if d[j] == 2)
                one.append((yes + 1 + 8 * c) / (yes + no + 2 + 8 * c))
            rate.append(one)
        share = sum(post) / len(post)
        like = [[prod((1, r[c], 1 - r[c])[v] for r, v in zip(rate, d, strict=True)) for c in (0, 1)] for d in docs]
        post = [share * b / (share * b + (1 - share) * a) for a, b in like]
    assert np.allclose(found.posterior(weaklabel.pattern(votes)), post, atol=1e-9)


def _half_agreements(sf: str, spoil=None):
    """On the labels of each half by a hash of the id: agreement of EM, of "one bad vote means bad" and of the majority; EM's labels."""
    import zlib

    import pyarrow.parquet as pq

    docs = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"])
    known = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    data, offsets = kernels.buffers(docs["text"].combine_chunks())
    parts = [(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in kernels.slices(offsets, weaklabel.SLICE)]
    votes = np.concatenate([weaklabel.vote(*weaklabel.measures(*p)) for p in parts], axis=1)
    votes = spoil(votes) if spoil else votes
    codes = weaklabel.pattern(votes)
    found = weaklabel.expectation_maximisation(*np.unique(codes[(votes > 0).any(axis=0)], return_counts=True))
    ids = docs["doc_id"].to_pylist()
    says = np.array([known.get(i, -1) for i in ids])
    half = np.array([zlib.crc32(str(i).encode()) % 2 for i in ids])
    rules = found.posterior(codes) >= 0.5, ~(votes == 2).any(axis=0), (votes == 1).sum(axis=0) > (votes == 2).sum(axis=0)
    agree = [[float((rule == (says == 1))[(half == h) & (says >= 0)].mean()) for rule in rules] for h in (0, 1)]
    return agree, found


def test_rounds_and_not_the_prior_decide():
    """At the query's defaults. Thresholds of the last two labellers come from half 0 of the labels (some texts of both halves
    were read before, so half 1 is not quite unseen). Labels of EM are as good as "one bad vote means bad" and better than the majority; where labellers err they are better than
    both, and a labeller whose votes are dealt anew is trusted less."""
    sf = "/root/testdata/sf0.1"
    agree, plain = _half_agreements(sf)
    assert all(a[0] >= a[1] and a[0] > a[2] for a in agree) and agree[1][0] > 0.995
    rng = np.random.default_rng(3)
    odd = next(i for i, x in enumerate(weaklabel.LABELLERS) if x[0] == "odd")

    def shuffled(votes):
        votes[odd] = rng.permutation(votes[odd])
        return votes

    def flipped(votes):
        wrong = (rng.random(votes.shape) < 0.05) & (votes > 0)
        votes[wrong] = 3 - votes[wrong]
        return votes

    agree, found = _half_agreements(sf, shuffled)
    assert all(a[0] > a[1] and a[0] > a[2] for a in agree)
    assert found.accuracy()[odd] < plain.accuracy()[odd] - 0.05 and found.accuracy().argmin() == odd
    agree, _ = _half_agreements(sf, flipped)
    assert all(a[0] > a[1] + 0.2 and a[0] > a[2] for a in agree)


def test_the_prior_does_not_grow_with_the_corpus():
    """Rates of very many rows are those of the votes themselves; of a hundred rows the prior keeps them off 0 and 1."""
    codes = weaklabel.pattern(np.array([[1] * weaklabel.VOTERS, [2, 2] + [1] * (weaklabel.VOTERS - 2)], dtype=np.int8).T)
    few, many = (weaklabel.expectation_maximisation(codes, np.array([80, 20]) * k) for k in (1, 1000))
    assert (few.posterior(codes) >= 0.5).tolist() == (many.posterior(codes) >= 0.5).tolist() == [True, False]
    assert abs(many.good - 0.8) < 0.01 and many.says_good[0, 0] < 0.01 < few.says_good[0, 0] and few.says_good[0, 1] < 0.999 < many.says_good[0, 1]


def test_quality_of_long_and_repeated_texts(spark, docs):
    """A text of some megabytes is judged like its parts, and repeated rows alike."""
    prose = " ".join(r.text for r in docs.filter("lang = 'en' and length(text) > 400").limit(5).collect())
    shout = "BUY NOW!! CHEAP!! " * 30
    rows = [(i, f"The {i}th plain sentence stands here and says little. It is followed by another one, which ends.") for i in range(60)] + [(100 + i, shout + str(i)) for i in range(10)]
    table = spark.createDataFrame([*rows, (200, shout), (200, shout), (201, shout * 6000), (202, prose)], "doc_id long, text string")
    got = {r.doc_id: r for r in weaklabel.score_quality(table).collect()}
    assert not got[200].keep and not got[201].keep and got[5].keep and -1 in got[201].votes and 1 in got[201].votes
    assert weaklabel.score_quality(table).filter("doc_id = 200").select("score").distinct().count() == 1


def test_language(spark, docs, odd):
    r = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()
    assert r[0] >= 0.98
    got = {x.doc_id: (x.lang_pred, x.score) for x in langid.identify(odd).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[5][0] in ("en", "de")
    assert all(0 <= s <= 1 for _, s in got.values())
    none = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {x.lang_pred for x in langid.identify(none).collect()} == {"und"}
    assert langid.identify(odd.limit(0)).count() == 0


def brute_bits(texts, share, order, context, byte):
    """The code length of ``byte`` behind ``context`` by a plain PPM coder over dictionaries."""
    tree = defaultdict(lambda: defaultdict(int))
    for raw in texts:
        padded = b"\n" * order + raw
        for i in range(order, len(padded)):
            for k in range(order + 1):
                tree[padded[i - k : i]][padded[i]] += 1
    least, p, left_out = share * sum(tree[b""].values()), 1.0, set()
    for k in range(order, -1, -1):
        behind = tree.get(context[len(context) - k :], {})
        if not behind or sum(behind.values()) < least:
            continue
        left = {x: n for x, n in behind.items() if x not in left_out}
        if left:
            total = sum(left.values()) + len(left)
            if byte in left:
                return -np.log2(p * left[byte] / total)
            p *= len(left) / total
        left_out |= set(behind)
    return -np.log2(p / (256 - len(left_out)))


@pytest.mark.parametrize(("order", "share"), [(2, 0.02), (4, 0.004), (4, 0.03), (6, 0.0)])
def test_code_lengths(spark, order, share):
    """Trees learned by Spark give the code lengths of a plain coder, and those of all bytes behind a context sum to one."""
    texts = {"a": ["the cat sat on the mat", "that hat", "", "the cat sat", "ünï"], "b": ["zum zoo zum", "z", "the zoo"], "c": [""]}
    table = spark.createDataFrame([(k, t) for k, v in texts.items() for t in v] + [(None, "no"), ("a", None)], "lang string, text string")
    coder = langid.learn(table.repartition(3), order=order, share=share)
    assert coder.names == ["a", "b"]
    for at, name in enumerate(coder.names):
        raw = [t.encode() for t in texts[name]]
        for context in (b"\n" * 6, b"the ca", b"on the", b"qqqqqq", b"\xc3\xbcn\xc3\xaf", b" the z", b"m zoo "):
            tail = context[-order:].rjust(order, b"\n")
            base = int.from_bytes(tail, "big") << 8
            bits = coder.bits(np.arange(256, dtype=np.int64) | base, at)
            assert np.isclose(np.exp2(-bits).sum(), 1)
            want = [brute_bits(raw, share, order, tail, x) for x in range(256)]
            assert np.allclose(bits, want)


def test_language_is_the_shortest_code(spark):
    """Whole texts, long ones among them, against the sum of plain code lengths; the share of a context bounds the tree."""
    rows = [(i, t, k) for i, (k, t) in enumerate([("a", "the cat sat on the mat"), ("a", "that hat is flat"), ("b", "le chat est sur la natte"), ("b", "la table"), ("b", "la table")])]
    asked = [(10, "the chat", None), (11, "la natte " * 300, None), (12, "flat hats", None), (13, "12", None), (14, "zq", None), (14, "zq", None)]
    docs = spark.createDataFrame(rows + asked, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs, held_out=F.col("doc_id") >= 10, order=3, share=0.01).collect()}
    for doc, text, _ in asked:
        padded = b"\n" * 3 + text.encode()
        cost = {k: sum(brute_bits([t.encode() for _, t, x in rows if x == k], 0.01, 3, padded[i - 3 : i], padded[i]) for i in range(3, min(len(padded), 40))) for k in "ab"}
        if doc == 13:
            assert (got[doc].lang_pred, got[doc].score) == ("und", 0.0)
            continue
        assert got[doc].lang_pred == min(cost, key=lambda k: (cost[k], k))
        if len(padded) < 40:
            assert np.isclose(got[doc].score, 1 / sum(2 ** (min(cost.values()) - c) for c in cost.values()))
    long = spark.createDataFrame([("x", "abcdefghij" * 30000)], "lang string, text string")
    small = langid.learn(long, order=5, share=0.05)
    assert [len(level.context) for level in small.levels[0]] == [1, 10, 10, 10, 10, 10]


@pytest.mark.parametrize("limit", [8 << 20, 0])
def test_contamination_is_judged_by_row(spark, odd, limit):
    """Clean rows of a null or repeated id stay beside contaminated ones, whatever the size of the benchmark."""
    bench = spark.createDataFrame([(1, LONG)], "item_id long, text string")
    clean = [(None, "a clean text", "en", None, 1), (6, "another clean text", "en", None, 1), (6, None, "en", None, 1)]
    kept = decontam.drop_contaminated(odd.unionByName(spark.createDataFrame(clean, SCHEMA)), bench, broadcast_bytes=limit)
    assert kept.columns == odd.columns
    assert sorted(((r.doc_id, r.text) for r in kept.filter("doc_id is null or doc_id = 6").collect()), key=str) == sorted(((r[0], r[1]) for r in clean), key=str)


def test_training_rows():
    """The scorer trains on 4,000 rows or so; their matrix is filled from packed rows in slices and chunks, and can be scaled in place."""
    import inspect

    assert {inspect.signature(f).parameters["sample_rows"].default for f in (weaklabel.fit, weaklabel.score_quality, weaklabel.keep_good)} == {4000}
    want = np.random.default_rng(1).random((7, weaklabel.BUCKETS + weaklabel.STATS), dtype=np.float32)
    want[want < 0.8] = 0
    want[2] = 0
    raw = pa.array(weaklabel.packed(want), pa.binary())
    got = weaklabel.matrix(pa.chunked_array([raw.slice(0, 3), raw.slice(3, 4), raw.slice(7)]))
    assert np.array_equal(got, want) and got.flags.writeable
