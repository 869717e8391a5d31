"""Properties of the kernels on generated input; no Spark."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from finpanel.llm import kernels, piececodec, queries, simhash


@pytest.fixture(scope="module")
def coder():
    return piececodec.Encoder(piececodec.load(queries.model_path()))


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.model_path())


TEXT = st.lists(st.text(alphabet=st.sampled_from(list("abt he.\n\t▁é日😀0#-")), max_size=60) | st.text(max_size=30).filter(lambda s: s.isprintable()), min_size=1, max_size=6)


@given(TEXT)
@settings(max_examples=150, deadline=None)
def test_codec(coder, library, texts):
    data, offsets = kernels.buffers(pa.array(texts))
    ids, bounds, start, end = coder.texts(data, offsets)
    flat, out = piececodec.decode(coder.v, ids, bounds)
    for i, t in enumerate(texts):
        own = ids[bounds[i] : bounds[i + 1]].tolist()
        assert own == [1, *library.encode(t), 2]
        assert flat[out[i] : out[i + 1]].tobytes().decode() == library.decode(own)
        n = len(t.encode())
        assert all(0 <= a <= b <= n for a, b in zip(start[bounds[i] : bounds[i + 1]], end[bounds[i] : bounds[i + 1]], strict=True))


@given(st.lists(st.integers(0, 31999), max_size=40))
@settings(max_examples=100, deadline=None)
def test_decoding_any_ids(coder, library, ids):
    flat, out = piececodec.decode(coder.v, np.array(ids, dtype=np.int32), np.array([0, len(ids)]))
    assert flat[out[0] : out[1]].tobytes().decode() == library.decode(ids)


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 8)), max_size=12))
def test_cover_and_ragged(ranges):
    starts, lengths = np.array([a for a, _ in ranges], dtype=np.int64), np.array([n for _, n in ranges], dtype=np.int64)
    want = {i for a, n in ranges for i in range(a, a + n)}
    assert set(np.flatnonzero(kernels.cover(starts, lengths, 40)).tolist()) == want
    assert kernels.ragged(starts, lengths).tolist() == [i for a, n in ranges for i in range(a, a + n)]


@given(st.lists(st.integers(0, 255), min_size=2, max_size=40, unique=True), st.integers(0, 4), st.integers(1, 7))
def test_tiles_find_every_pair(values, radius, block):
    v = np.array(sorted(values, key=lambda x: x.bit_count()), dtype=np.uint64)
    x, y = simhash.compare_tiles(v, None, radius, block)
    assert sorted(zip(x.tolist(), y.tolist(), strict=True)) == [(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if (int(v[i]) ^ int(v[j])).bit_count() <= radius]
    cut = len(v) // 2
    x, y = simhash.compare_tiles(v[:cut], v[cut:], radius, block)
    assert sorted(zip(x.tolist(), y.tolist(), strict=True)) == [(i, j) for i in range(cut) for j in range(len(v) - cut) if (int(v[i]) ^ int(v[cut + j])).bit_count() <= radius]


@given(st.lists(st.text(alphabet="ab c\n", max_size=20), min_size=1, max_size=8))
def test_equal_ranges_have_equal_hashes(texts):
    data, offsets = kernels.buffers(pa.array(texts))
    start, end, _ = kernels.word_bounds(data, offsets, ~kernels.SPACE)
    hashes = kernels.range_hashes(data, start, end)
    words = [data[a:b].tobytes() for a, b in zip(start, end, strict=True)]
    for i in range(len(words)):
        for j in range(i):
            assert (hashes[i] == hashes[j]) == (words[i] == words[j])


def thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


def test_words_that_break_polynomial_hashes(coder, library):
    """The Thue-Morse word and its complement, which every polynomial modulo 2**64 takes for equal, as letters and as words."""
    one = thue_morse(1024)
    two = one.translate(str.maketrans("ab", "ba"))
    data, offsets = kernels.buffers(pa.array([one, two]))
    for which in (0, 1):
        h = kernels.range_hashes(data, offsets[:-1], offsets[1:], which)
        assert h[0] != h[1]
        words = np.array([[11, 13]["ab".index(c)] for c in one + two], dtype=np.uint64)
        grams = kernels.gram_hashes(words, 1024, which)
        assert grams[0] != grams[1024]
    ids, bounds, _, _ = coder.texts(data, offsets)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [[1, *library.encode(t), 2] for t in (one, two)]
