"""The pipeline's near-duplicates against brute force over five-word shingles."""

import random
import re
import time

import corpus_pipeline
import numpy as np
import pytest
from finpanel.llm import components, jaccard, pii, simhash, storage
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))) if w else frozenset()


def brute_kept(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    near = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if a == b or both / (len(a) + len(b) - both) >= 0.8:
                up[find(i)] = find(j)
                near += a != b
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return near, sorted((r for i, r in enumerate(rows) if r[0] is None or r[0] == least[find(i)]), key=str)


def test_near_duplicates(spark):
    """Pairs of similarity 0.8 to 1 go, those below stay; null ids stay, repeated ids are judged row by row."""
    dice = random.Random(3)
    base = [[f"w{dice.randrange(5000)}" for _ in range(n)] for n in (30, 60, 120, 400)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i, words in enumerate(base * 12):
        w = list(words)
        for _ in range(1 + i // 8):
            w[dice.randrange(len(w))] = f"x{dice.randrange(10**6)}"
        rows.append((100 + i, " ".join(w)))
    shared = "a line that stands in every one of these texts and is rather long for a line " * 3
    rows += [(500 + i, shared + " ".join(f"y{dice.randrange(10**6)}" for _ in range(20 + i))) for i in range(40)]
    rows += [(None, rows[0][1]), (0, "another text under an id that was used before"), (901, "another text under an id that was used before"), (902, ""), (903, None), (904, "one"), (905, "ONE")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    near, want = brute_kept(rows)
    assert near > 50
    assert sorted((tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()), key=str) == want
    table = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.near_duplicates(spark, table, SF)
    assert kept.columns == table.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == brute_kept([(r.doc_id, r.text) for r in table.collect()])[1]
    assert corpus_pipeline.near_duplicates(spark, table.limit(0), SF).count() == 0


def test_rows_are_kept_by_id_and_text(spark):
    """Another text under the id of a copy stays, and of exact repeats one stays, in both operators."""
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = [(1, a, "x"), (5, a, "x"), (5, b, "x"), (1, a, "y"), (None, a, "x"), (None, a, "x"), (7, b, "z"), (8, None, "n"), (9, "", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root string")
    for keep in (simhash.keep_first, jaccard.keep_first):
        kept = keep(docs)
        assert kept.columns == docs.columns
        got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
        assert got == sorted([(1, a), (5, b), (None, a), (None, a), (8, None)], key=str)


def test_crowded_shingles(spark, monkeypatch):
    """The same result when every shared shingle and neighbourhood is cut into tiles."""
    monkeypatch.setattr(simhash, "TILE", 8)
    monkeypatch.setattr(jaccard, "TILE", 6)
    monkeypatch.setattr(jaccard, "SHINGLES", 400)
    dice = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        for at in dice.sample(range(60), 1 + i % 3):
            w[at] = f"x{dice.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in jaccard.keep_first(docs).collect()), key=str) == brute_kept(rows)[1]


def test_fingerprints_by_lanes():
    """The fingerprint by lanes is the majority of the hashes' bits, of sets of any size."""
    n = np.array([0, 1, 2, 5, 0, 300, 70_000])
    for m in (n[:-1], n):
        hashes = np.random.default_rng(5).integers(0, 1 << 64, m.sum(), dtype=np.uint64)
        assert (jaccard.fingerprint(hashes, m) == simhash.majority(hashes, m)).all()


@pytest.mark.parametrize("width", [8, 12])
def test_fingerprint_bits_decide_what_meets(spark, monkeypatch, width):
    """pairs at the threshold meet under bands of fingerprint bits, in short and in long texts; where no bits are compared nothing meets."""
    monkeypatch.setattr(jaccard, "WIDTH", width)
    dice = random.Random(4)
    rows = []
    for i in range(300):
        w = [f"a{i}b{x}" for x in range((8, 40, 160)[i % 3])]  # 4, 36 and 156 shingles
        more = {8: 1, 40: 9, 160: 39}[len(w)]  # and a fifth of the larger set beyond them: 0.8
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w + [f"c{dice.randrange(10**9)}" for _ in range(more)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    near, want = brute_kept(rows)
    assert near == 300 and sorted((tuple(r) for r in jaccard.keep_first(docs).collect()), key=str) == want
    monkeypatch.setattr(jaccard, "_bands", lambda rows: (width, 0, 2))
    assert jaccard.keep_first(docs).count() == 600


def shuffled(spark, df):
    """Bytes that a frame's jobs shuffle, and its rows."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    before = sc.statusStore().executorSummary("driver").totalShuffleWrite()
    rows = df().collect()
    sc.listenerBus().waitUntilEmpty(30_000)
    return sc.statusStore().executorSummary("driver").totalShuffleWrite() - before, rows


def test_split_by_keys(spark):
    """Every row with a key is among those that may have one, most others are not, and no row is lost."""
    rows = spark.range(5000).select("id", F.when(F.col("id") != 7, F.xxhash64("id")).alias("h"), F.lit("x").alias("text"))
    maybe, rest = storage.split(rows, "h", storage.cut(rows.filter("id % 10 = 3").select("h")))
    a, b = ({r.id for r in x.collect()} for x in (maybe, rest))
    assert a | b == set(range(5000)) and not a & b and a >= set(range(3, 5000, 10)) and len(a) < 1100
    maybe, rest = storage.split(rows, "h", storage.cut(rows.limit(0).select("h")))
    assert maybe.count() == 0 and rest.count() == 5000


@pytest.mark.parametrize("limit", [0, 100_000])
def test_texts_stay_where_they_are(spark, monkeypatch, tmp_path, limit):
    """Texts that are no one's near copies, and texts without terms, are not shuffled, whether the keys are broadcast or told by bits."""
    monkeypatch.setattr(storage, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(pii, "BROADCAST_BYTES", limit)
    dice = random.Random(5)
    word = lambda: "".join(dice.choices("abcdefghijklmnopqrstuvwxyz", k=9))
    rows = [(i, " ".join(word() for _ in range(4000))) for i in range(150)]
    rows += [(200 + i, f"{rows[i][1]} more") for i in range(5)]
    rows += [(300 + i, f"write to {word()} at {word()}@example.org about {word()}") for i in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    size = sum(len(t) for _, t in rows)
    moved, kept = shuffled(spark, lambda: jaccard.keep_first(docs))
    assert sorted(r.doc_id for r in kept) == [*range(150), *range(300, 305)] and moved < size / 2
    moved, clean = shuffled(spark, lambda: pii.sanitise(docs))
    assert len(clean) == len(rows) and moved < size / 4
    was = dict(rows)
    assert all(r.text == was[r.doc_id] if r.doc_id < 300 else r.text.startswith("[term] ") or "[email]" in r.text for r in clean)


def test_nodes_of_one_fingerprint(spark, monkeypatch):
    """Sets that share all bits of their fingerprints are compared though no other fingerprint is near."""
    monkeypatch.setattr(jaccard, "fingerprint", lambda hashes, n: np.zeros(len(n), dtype=np.uint64))
    a = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(a)), (2, " ".join([*a, "x"])), (3, " ".join(f"z{i}" for i in range(60)))]
    kept = jaccard.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


@pytest.mark.parametrize("part", [1 << 20, 300])
def test_links_of_many_tasks(spark, monkeypatch, part):
    """pipeline: a group whose nodes many tasks link to different ones comes into the rounds with few links a node, in its components."""
    monkeypatch.setattr(components, "PART", part, raising=False)
    dice = random.Random(6)
    links = [(1000 * g + 100 + i, 1000 * g + c) for g in range(3) for i in range(200) for c in dice.sample(range(60), 40)]
    links += [(5, 5), (9001, 9000), (9000, 9001), (9002, 9003), (9001, 9003), (-7, 9100)]
    came, mark = [], components._mark
    monkeypatch.setattr(components, "_mark", lambda now: came.append(mark(now)) or came[-1])
    got = components.components(spark.createDataFrame(links, "a long, b long").repartition(7), "a", "b").collect()
    want = {n: 1000 * (n // 1000) for link in links for n in link if 0 <= n < 9000} | dict.fromkeys(range(9000, 9004), 9000) | {-7: -7, 9100: -7}
    assert len(got) == len(want) and {r.node: r.root for r in got} == want
    assert all(n < 12 * len(want) for n, _ in came) and bool(came) == (part < len(links))  # of up to 40 links a node


def test_chance_does_not_join_texts(spark):
    """fingerprints that are near in 128 bits by chance alone, as of many texts some always are, are no candidates; those near in all bits are."""
    dice = random.Random(10)
    word = lambda: dice.randrange(-(1 << 63), 1 << 63)
    same = [word() for _ in range(4)]
    some = lambda: sum(1 << i for i in dice.sample(range(63), 10))
    rows = [(1, 100, same[0] ^ some(), same[1] ^ some(), word(), word()) for _ in range(10)]
    rows += [(2, 100, *same), (2, 101, same[0] ^ 7, *same[1:])]
    rows += [(3, 5, *same), (3, 5, same[0] ^ 7, *same[1:])]  # different sets of five are at four sixths at most
    met = spark.createDataFrame(rows, "band long, n int, f1 long, f2 long, f3 long, f4 long")
    assert len(jaccard.candidates(met, len(rows), 0.8, 40).collect()) == 1


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_written_tables_leave_no_shuffle(spark):
    """what was shuffled for a table goes once the table is written, though its frame is still held, and Spark's setting stays as it was."""
    before, was = shuffle_files(spark), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    frame = spark.range(20_000, numPartitions=4).groupBy((F.col("id") % 7000).alias("k")).agg(F.sum("id").alias("s"))
    done = storage.cut(frame)
    for _ in range(100):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= before and done.count() == frame.count() == 7000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == was


def test_bands_in_rounds(spark, monkeypatch):
    """the same texts stay however few bands come at a time, and a round's rows are about as large as the texts."""
    rounds = jaccard._rounds(10**6, 2 * 10**9, 92)
    assert [i for r in rounds for i in r] == list(range(92)) and all(10**6 * len(r) * jaccard.ROW <= 2 * 10**9 for r in rounds)
    assert [list(r) for r in jaccard._rounds(10, 100, 3)] == [[0, 1, 2]]
    monkeypatch.setattr(jaccard, "ROUND", 700)
    dice = random.Random(2)
    rows = []
    for i in range(40):
        w = [f"a{i % 25}b{x}" for x in range(12)]
        rows.append((i, " ".join(w + [f"c{dice.randrange(2)}"] * (i % 3))))
    rows.append((50, " ".join(["z"] * 9)))
    assert len(jaccard._rounds(len(rows), 0, jaccard._bands(len(rows))[1])) == 5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in jaccard.keep_first(docs).collect()), key=str) == brute_kept(rows)[1]
