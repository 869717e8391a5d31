"""Spelling variants, the filter audit and the set join against brute force, and their edges."""

import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from finpanel.llm import filteraudit, metricjoin, spelling

ODD = [(None, "lost letters in a document without an id"), (900, None), (901, ""), (902, "   \t\n"), (903, "ÀÉÿ×÷ ßtraße ÑANDÚ naïveté"), (904, "x" * 3000 + " " + "y" * 70), (904, "x" * 3000 + " " + "y" * 70), (905, "A_b-c4d'efghij")]


# spelling


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def brute_counts(rows, least=6, drop=199):
    seen = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % drop == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                seen[run] += 1
    return seen


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows, drop=199):
    n = {w: c for w, c in brute_counts(rows, drop=drop).items() if c >= 5}
    form, out = {}, {}
    for w in n:
        close = [v for v in n if near(w, v)]
        best = min(close, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
        out[w] = len(close)
    rows = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, n[w], out[w], n[form[w]] if form[w] else None))
    return rows


def spelled(dice, many):
    base = ["spelling", "variant", "grouping", "naïveté", "straßen", "aaaaaa", "aaaaaab", "lettersx"]
    texts = []
    for i in range(many):
        words = []
        for _ in range(60):
            w = dice.choices(base, [40, 30, 20, 9, 8, 30, 6, 2])[0]
            for _ in range(dice.choice([0, 0, 0, 1, 1, 2])):
                at = dice.randrange(len(w))
                w = dice.choice([w[:at] + w[at + 1 :], w[:at] + dice.choice("abé") + w[at:], w[:at] + dice.choice("xyÿ") + w[at + 1 :]])
            words.append(w.upper() if dice.random() < 0.1 else w)
        texts.append((i, dice.choice([" ", "-", "\n", "1"]).join(words)))
    return texts


@pytest.mark.parametrize("tile", [2048, 16, 3])
def test_spelling_variants(spark, monkeypatch, tile):
    """Blocks of one and of many groups of letters, whole and in tiles: forms, roots and counts as loops give them."""
    monkeypatch.setattr(spelling, "TILE", tile)
    monkeypatch.setattr(spelling, "PART", 4 * tile)
    rows = spelled(random.Random(2), 250) + ODD
    want = brute_variants(rows, drop=7)
    assert len(want) > 100 and any(r[1] and r[1] != r[2] for r in want)
    got = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), drop=7)
    assert {tuple(r) for r in got.collect()} == want


def test_spelling_edges(spark):
    docs = spark.createDataFrame([(*r, 1, "a", 2) for r in ODD * 6], "doc_id long, text string, n int, word string, block int")
    got = spelling.variants(docs)
    assert {tuple(r) for r in got.collect()} == brute_variants(ODD * 6) and got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert spelling.variants(docs.limit(0)).count() == 0


def test_spelling_kernels():
    dice = random.Random(5)
    texts = [("" if i % 9 == 0 else "".join(dice.choice("abcXYZ éÿ×-\n1À") for _ in range(dice.randrange(80)))) for i in range(200)]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    for least, drop in ((1, 2), (3, 5), (6, 199)):
        got = Counter(spelling.word_runs(data, offsets, [f"{i}:".encode() for i in range(200)], least, drop).to_pylist())
        assert got == brute_counts(list(enumerate(texts)), least, drop)
    words = sorted({"".join(dice.choice("abé") for _ in range(dice.choice([5, 6]))) for _ in range(120)})
    words = [w for w in words if len(w) == 5] + [w for w in words if len(w) == 6]
    a, b = spelling.near_pairs(words, len(words))
    assert {frozenset((words[i], words[j])) for i, j in zip(a, b, strict=True)} == {frozenset((v, w)) for v in words for w in words if v != w and near(v, w)} and len(a) == len(set(zip(a, b, strict=True)))


# filters


def brute_audit(rows, labels, letters="ABCDE"):
    good, bad = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, x in labels if x == 1} - {None}
    parts = {}
    for d, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        same = [e for e, u, _ in rows if e is not None and (u or "") == t]
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > min(same)}
        parts.setdefault(lang or "", []).append((d, {f for f in letters if fails[f]}))
    out = set()
    for part, docs in parts.items():
        total = Counter()
        found = []
        for order in map("".join, permutations(letters)):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                total[f] += len(gone)
                fail = sum(f in x[1] for x in docs)
                found.append([part, order, step, len(left), len(gone), fail - len(gone), sum(x[1] == {f} for x in docs), sum(x[0] in good for x in gone), sum(x[0] in bad for x in gone), f])
        out |= {(*r[:-1], total[r[-1]]) for r in found}
    return out


def test_filter_audit(spark):
    dice = random.Random(7)
    kinds = ["word ", "WORD ", "w{} ", "a#b ", "x{}| "]
    rows = []
    for i in range(60):
        base = "".join(dice.choice(kinds).format(k) for k in range(dice.choice([3, 99, 100, 101, 140])))
        rows.append((i, base, dice.choice(["en", "de", "", None])))
        if i % 4 == 0:
            rows.append((dice.choice([i + 100, max(i - 30, 0)]), base, dice.choice(["en", "fr"])))
    rows += [(d, t, "en") for d, t in ODD] + [(None, "", "en"), (901, "", None), (3, "", "de")]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 60, 3)] + [(0, 1, 0), (None, 1, 1), (901, 1, None), (902, None, 1), (5000, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, lang string, n int, mask string, digest int")
    known = spark.createDataFrame([(*r, "z") for r in labels], "doc_id long, quality int, toxic int, text string")
    got = filteraudit.filter_audit(docs, known)
    assert {tuple(r) for r in got.collect()} == brute_audit(rows, labels) and got.count() == 600 * 4
    assert filteraudit.filter_audit(docs.limit(0), known).count() == 0
    assert filteraudit.filter_audit(docs, known.limit(0)).filter("good_lost + toxic_lost > 0").count() == 0


def test_intervals_cover_what_orders_remove():
    """For every mask and number of filters, the intervals of a step are the ranks at which the step removes it."""
    for k in range(1, 6):
        table = filteraudit.intervals(k)
        for m in range(1 << k):
            own = {(s, r) for mm, s, lo, hi in table.tolist() if mm == m for r in range(lo, hi)}
            assert own == {(next(s for s, f in enumerate(o) if m >> f & 1), r) for r, o in enumerate(permutations(range(k))) if m}


# sets


def shingles(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))) if w else frozenset()


def brute_join(rows, k=3, percent=90):
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    links = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[find(i)] = find(j)
                links += a != b
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return links, sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def copies(dice, sizes, per, edits):
    rows = []
    for n in sizes:
        base = [f"w{dice.randrange(400)}" for _ in range(n)]
        for _ in range(per):
            w = list(base)
            for _ in range(dice.randrange(edits + 1)):
                at = dice.randrange(len(w))
                dice.choice([lambda w=w, at=at: w.__setitem__(at, f"x{dice.randrange(10**6)}"), lambda w=w: w.append(f"y{dice.randrange(10**6)}"), lambda w=w, at=at: w.__delitem__(at)])() if len(w) > 1 else None
            rows.append((len(rows), " ".join(w)))
    dice.shuffle(rows)
    return rows


def test_jaccard_join(spark):
    """Near copies of texts of 3 to 700 words, at and around the threshold; edges."""
    dice = random.Random(11)
    rows = copies(dice, (3, 9, 12, 13, 21, 22, 23, 40, 85, 160, 700), 12, 4)
    shared = "a passage that stands in each of these texts and is long " * 2
    rows += [(600 + i, shared + " ".join(f"z{dice.randrange(10**6)}" for _ in range(i))) for i in range(25)]
    rows += [*ODD, (906, "One two"), (907, "one TWO"), (908, "one two one two"), (909, "one")]
    links, want = brute_join(rows)
    assert links > 100
    docs = spark.createDataFrame([(*r, 1, 2, "a", "b") for r in rows], "doc_id long, text string, n int, node int, h string, part string")
    got = metricjoin.near_sets(docs)
    assert sorted(map(tuple, got.collect()), key=str) == want and got.columns == ["doc_id", "n_shingles", "component_id"]
    assert metricjoin.near_sets(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("points", "rounds"), [(24, 4), (6, 4), (9, 0)])
def test_jaccard_join_of_large_groups(spark, monkeypatch, points, rounds):
    """Groups beyond what a task takes: regions of pivots in rounds of Spark, and pairs of tiles of what stays large."""
    monkeypatch.setattr(metricjoin, "POINTS", points)
    monkeypatch.setattr(metricjoin, "LEAF", 4)
    monkeypatch.setattr(metricjoin, "ROUNDS", rounds)
    dice = random.Random(13)
    rows = copies(dice, (60,), 70, 1) + [(1000 + d, t) for d, t in copies(dice, (90,), 70, 3)] + [(2000 + d, t) for d, t in copies(dice, (75, 80), 30, 6)]
    # a chain: each text is near the next one only
    words = [f"c{i}" for i in range(160)]
    rows += [(3000 + i, " ".join(words[2 * i : 2 * i + 60])) for i in range(50)]
    links, want = brute_join(rows)
    assert len({c for d, _, c in want if 3000 <= d < 4000}) == 1 and links > 1000
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, metricjoin.near_sets(docs).collect()), key=str) == want


@pytest.mark.parametrize(("leaf", "pivots"), [(2, 2), (5, 3), (24, 8)])
def test_regions_join_recursively(monkeypatch, leaf, pivots):
    """Points in clusters that overlap, joined by regions of any size: the components of all pairs."""
    monkeypatch.setattr(metricjoin, "LEAF", leaf)
    monkeypatch.setattr(metricjoin, "PIVOTS", pivots)
    rng = np.random.default_rng(leaf)
    for r in (0.1, 0.3):
        raw = []
        for _ in range(12):
            base = rng.integers(0, 1 << 40, 50)
            for _ in range(int(rng.integers(1, 30))):
                x = base.copy()
                x[rng.choice(50, int(rng.integers(0, 12)), replace=False)] = rng.integers(0, 1 << 40)
                raw.append(np.unique(x).astype(np.uint64))
        points = metricjoin.Points([x.tobytes() for x in raw])
        points.join(np.arange(len(raw)), r)
        up = list(range(len(raw)))
        sets = [set(x.tolist()) for x in raw]
        for i, a in enumerate(sets):
            for j in range(i):
                if 1 - len(a & sets[j]) / len(a | sets[j]) <= r + 1e-9:
                    x, y = up[i], up[j]
                    up = [min(x, y) if u in (x, y) else u for u in up]
        assert points.labels.tolist() == up


def test_sets_within_the_radius_share_a_key():
    """Sets at and near the threshold, for all sizes to 400 and some larger: a pair within it always meets in a region."""
    rng = np.random.default_rng(3)
    for n in [*range(1, 400, 3), 1000, 4321]:
        base = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        n = len(base)
        for lose in {0, n // 19, n // 10}:
            most = int((n - lose) / 0.9 - n + 1e-9) if lose * 10 <= n else -1
            if most < 0:
                continue
            other = np.unique(np.concatenate((base[rng.permutation(n)[lose:]], rng.integers(0, 1 << 63, most).astype(np.uint64))))
            assert len(np.intersect1d(base, other)) >= 0.9 * len(np.union1d(base, other)) - 1e-9
            keys, many = metricjoin.part_keys(np.concatenate((base, other)), np.array([n, len(other)]), 0.9)
            assert set(keys[: many[0]].tolist()) & set(keys[many[0] :].tolist()), (n, lose, most)
