"""SentencePiece BPE encoding and decoding that keeps source offsets.

A text is normalised by the model's compiled character map: at every place the longest prefix that the map's
double-array trie knows is replaced, and each normalised byte remembers the source bytes it came from. White space
becomes the model's space mark, with one mark in front of the text. The normalised text is cut between bytes that no
piece of the vocabulary has side by side, because no merge can cross there; what lies between two cuts is merged like
any BPE: the best-scoring pair first, the leftmost of equals. All distinct parts of a slice are merged at once, one
numpy step for the next merge of each, and their pieces are kept for the next slice, up to ``CACHE`` parts, by a hash
and the bytes themselves. Symbols
that are no pieces fall back to their bytes. Every piece carries the source byte range it covers.

Models whose map is the identity take a path over flat buffers; all others, and texts that hold the space mark
itself, go text by text through the trie.

Defined results: null and empty texts have only the begin and end ids and decode to an empty text; repeated rows are
encoded alike; further columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finpanel.llm import kernels as K

MARK = "▁"
SLICE = 1 << 19
CACHE = 400_000
#: Parts of more characters are merged one by one with a heap.
LONG = 48
NONE = np.int64(1) << np.int64(40)
RESULT = "doc_id {id}, ids array<int>, starts array<int>, ends array<int>, decoded string"


@dataclass
class Vocabulary:
    """Tables of a BPE model; symbols are piece ids, or numbers above them for characters that are no pieces."""

    size: int
    score_rank: np.ndarray
    pair_keys: np.ndarray
    pair_values: np.ndarray
    symbols: int
    char_symbol: np.ndarray
    joined: np.ndarray
    byte_ids: np.ndarray
    unknown: int
    begin: int
    end: int
    byte_fallback: bool
    dummy_prefix: bool
    trim: bool
    charsmap: bytes
    out_bytes: np.ndarray
    out_offsets: np.ndarray
    raw_length: np.ndarray
    control: np.ndarray
    is_byte: np.ndarray
    names: dict[str, int] = field(default_factory=dict)


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return (K.mix(keys.astype(K.U64)) >> K.U64(64 - bits)).astype(np.int64)


def load(path: str) -> Vocabulary:
    """Compiles the model file."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    if model.trainer_spec.model_type != 2:
        raise ValueError("only BPE models are supported")
    pieces = model.pieces
    size = len(pieces)
    names = {p.piece: i for i, p in enumerate(pieces) if p.type in (1, 4, 5)}
    chars = {c for p in names for c in p}
    extra = {c: size + i for i, c in enumerate(sorted(c for c in chars if c not in names))}
    symbol = lambda s: names.get(s, extra.get(s) if len(s) == 1 else None)
    symbols = size + len(extra) + 1
    keys, values = [], []
    joined = np.zeros((256, 256), dtype=bool)
    for p, i in names.items():
        raw = p.replace(MARK, " ").encode()
        for a, b in zip(raw, raw[1:], strict=False):
            joined[a, b] = True
        for cut in range(1, len(p)):
            left, right = symbol(p[:cut]), symbol(p[cut:])
            if left is not None and right is not None:
                keys.append(left * symbols + right)
                values.append(i)
    bits = max(10, int(np.ceil(np.log2(len(keys) + 1))) + 3)
    pair_keys, pair_values = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int32)
    mask = (1 << bits) - 1
    for key, value, at in zip(keys, values, _slot(np.array(keys, dtype=np.int64), bits).tolist(), strict=True):
        while pair_keys[at] != -1:
            at = (at + 1) & mask
        pair_keys[at], pair_values[at] = key, value
    _, rank = np.unique(-np.array([p.score for p in pieces]), return_inverse=True)
    char_symbol = np.full(0x110000, symbols - 1, dtype=np.int32)
    for c in chars:
        char_symbol[ord(c)] = symbol(c)
    char_symbol[32] = symbol(MARK) if symbol(MARK) is not None else symbols - 1
    byte_ids = np.full(256, -1, dtype=np.int32)
    out, raw_length = [], np.zeros(size, dtype=np.int32)
    for i, p in enumerate(pieces):
        if p.type == 6:
            byte_ids[int(p.piece[3:5], 16)] = i
            out.append(bytes([int(p.piece[3:5], 16)]))
        elif p.type == 3:
            out.append(b"")
        elif p.type == 2:
            out.append(model.trainer_spec.unk_surface.encode())
        else:
            out.append(p.piece.replace(MARK, " ").encode())
        raw_length[i] = len(p.piece.replace(MARK, " ").encode()) if p.type not in (3, 6) else int(p.type == 6)
    kinds = np.array([p.type for p in pieces])
    return Vocabulary(
        size, rank.astype(np.int64), pair_keys, pair_values, symbols, char_symbol, joined, byte_ids,
        model.trainer_spec.unk_id, model.trainer_spec.bos_id, model.trainer_spec.eos_id, model.trainer_spec.byte_fallback,
        model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.remove_extra_whitespaces, bytes(model.normalizer_spec.precompiled_charsmap),
        np.frombuffer(b"".join(out), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int64), raw_length, kinds == 3, kinds == 6, names,
    )


class CharacterMap:
    """A compiled character map: a double-array trie of prefixes, and the texts that replace them."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.texts = blob[4 + size :]
        self.known: dict[bytes, tuple[int, bytes] | None] = {}

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of raw[at:], and its replacement."""
        if not self.units:
            return None
        offset = lambda unit: (unit >> 10) << ((unit & 0x200) >> 6)
        node, found = offset(self.units[0]), None
        for i in range(at, len(raw)):
            node ^= raw[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != raw[i]:
                break
            node ^= offset(unit)
            if unit & 0x100:
                found = (i + 1 - at, self.units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]


def normalise(text: str, v: Vocabulary, chars: CharacterMap) -> tuple[bytes, list[int], list[int]]:
    """The normalised bytes with a space for the mark, and start and end of the source bytes of each of them."""
    raw = text.encode("utf-8", "replace")
    out, start, end = bytearray(), [], []
    at = 0
    pieces: list[tuple[bytes, int, int]] = []
    while at < len(raw):
        found = chars.longest(raw, at)
        if found is None:
            n = 1
            while at + n < len(raw) and raw[at + n] & 0xC0 == 0x80:
                n += 1
            pieces.append((raw[at : at + n], at, at + n))
        else:
            n = found[0]
            pieces.append((found[1], at, at + n))
        at += n
    mark = MARK.encode()
    pieces = [(b.replace(mark, b" "), i, j) for b, i, j in pieces]
    if v.trim:
        while pieces and not pieces[0][0].strip(b" "):
            pieces.pop(0)
    if not pieces:
        return b"", [], []
    if v.dummy_prefix:
        out += b" "
        start.append(pieces[0][1])
        end.append(pieces[0][1])
    for b, i, j in pieces:
        for byte in b:
            if v.trim and byte == 32 and out[-1:] == b" ":
                continue
            out.append(byte)
            start.append(i)
            end.append(j)
    if v.trim:
        while out[-1:] == b" ":
            out.pop()
            start.pop()
            end.pop()
    return bytes(out), start, end


def _lookup(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The merged piece of each pair, or -1."""
    key = left.astype(np.int64) * v.symbols + right
    bits = len(v.pair_keys).bit_length() - 1
    at = _slot(key, bits)
    have = v.pair_keys[at]
    out = np.where(have == key, v.pair_values[at], -1)
    open_ = np.flatnonzero((have != key) & (have != -1))
    while len(open_):
        at[open_] = (at[open_] + 1) & (len(v.pair_keys) - 1)
        have = v.pair_keys[at[open_]]
        out[open_] = np.where(have == key[open_], v.pair_values[at[open_]], -1)
        open_ = open_[(have != key[open_]) & (have != -1)]
    return out


def _heap_merge(v: Vocabulary, sym: list[int]) -> list[int]:
    """The starts of the symbols that are left of one long part; ``sym`` is changed in place."""
    n = len(sym)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    a = np.array(sym)
    merged = _lookup(v, a[:-1], a[1:]).tolist()
    heap = [(int(v.score_rank[m]), i, sym[i], sym[i + 1], m) for i, m in enumerate(merged) if m >= 0]
    heapq.heapify(heap)

    def add(i: int, j: int) -> None:
        m = int(_lookup(v, np.array([sym[i]]), np.array([sym[j]]))[0])
        if m >= 0:
            heapq.heappush(heap, (int(v.score_rank[m]), i, sym[i], sym[j], m))

    while heap:
        _, i, x, y, m = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or sym[i] != x or j >= n or sym[j] != y:
            continue
        sym[i], alive[j] = m, False
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            add(i, after[i])
        if before[i] >= 0:
            add(before[i], i)
    return [i for i in range(n) if alive[i]]


def merge(v: Vocabulary, sym: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges every part of ``sizes`` symbols; returns what is left: part, place of the first character, symbol, in order."""
    begin = np.cumsum(sizes) - sizes
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for p in np.flatnonzero(sizes > LONG).tolist():
        own = sym[begin[p] : begin[p] + sizes[p]].tolist()
        left = _heap_merge(v, own)
        done.append((np.full(len(left), p), begin[p] + np.array(left), np.array([own[i] for i in left])))
    short = np.flatnonzero((sizes <= LONG) & (sizes > 0))
    at = K.ragged(begin[short], sizes[short])
    part, sym = np.repeat(short, sizes[short]), sym[at].astype(np.int64)

    def ranks(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged piece and rank of the pair at i and i + 1."""
        j = np.minimum(i + 1, len(sym) - 1)
        m = _lookup(v, sym[i], sym[j])
        m[(j == i) | (part[i] != part[j])] = -1
        return m, np.where(m >= 0, v.score_rank[m], NONE)

    if len(sym):
        piece, rank = ranks(np.arange(len(sym)))
    while len(sym):
        new = np.ones(len(sym), dtype=bool)
        new[1:] = part[1:] != part[:-1]
        first = np.flatnonzero(new)
        best = np.minimum.reduceat(rank << np.int64(22) | np.minimum(np.arange(len(sym)) - np.repeat(first, np.diff(np.append(first, len(sym)))), (1 << 22) - 1), first)
        live = best >> np.int64(22) < NONE
        if not live.all():
            over = ~np.repeat(live, np.diff(np.append(first, len(sym))))
            done.append((part[over], at[over], sym[over]))
            keep = ~over
            part, at, sym, piece, rank = part[keep], at[keep], sym[keep], piece[keep], rank[keep]
            sizes_left = np.diff(np.append(first, len(over)))[live]
            first, best = np.cumsum(sizes_left) - sizes_left, best[live]
            if not len(sym):
                break
        where = first + (best & np.int64((1 << 22) - 1))
        sym[where] = piece[where]
        keep = np.ones(len(sym), dtype=bool)
        keep[where + 1] = False
        shift = np.cumsum(keep) - 1
        part, at, sym, piece, rank = part[keep], at[keep], sym[keep], piece[keep], rank[keep]
        where = shift[where]
        touched = np.concatenate((where, where[where > 0] - 1))
        piece[touched], rank[touched] = ranks(touched)
    if not done:
        z = np.zeros(0, np.int64)
        return z, z, z
    part, at, sym = (np.concatenate([d[i] for d in done]) for i in range(3))
    order = np.argsort(at, kind="stable")
    return part[order], at[order], sym[order]


class Encoder:
    """Encodes flat buffers of normalised text; keeps the pieces of parts it has seen."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.chars = CharacterMap(v.charsmap)
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, dtype=K.U64)
        self.places = np.zeros((0, 4), dtype=np.int64)
        self.pooled = 0
        self.flat: np.ndarray | None = None
        self.raw = np.zeros(0, dtype=np.uint8)

    def _parts(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of the parts; every document starts one."""
        cut = np.ones(len(flat), dtype=bool)
        cut[1:] = ~self.v.joined[flat[:-1], flat[1:]] & (flat[1:] & 0xC0 != 0x80)
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        start = np.flatnonzero(cut)
        return start, np.diff(np.append(start, len(flat)))

    def _pieces(self, flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts, one after another, and how many each has."""
        v = self.v
        raw = flat[K.ragged(start, length)]
        code = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
        lead = raw & 0xC0 != 0x80
        sizes = np.add.reduceat(lead, np.cumsum(length) - length, dtype=np.int64)
        part, at, sym = merge(v, v.char_symbol[code], sizes)
        known = sym < v.size
        width = np.diff(np.append(np.flatnonzero(lead), len(raw)))
        if not v.byte_fallback:
            return np.where(known, sym, v.unknown).astype(np.int32), np.bincount(part, minlength=len(start))
        n = np.where(known, 1, width[at])
        ids = np.repeat(np.where(known, sym, -1), n)
        lost = np.flatnonzero(~known)
        ids[ids < 0] = v.byte_ids[raw[K.ragged(np.flatnonzero(lead)[at[lost]], n[lost])]]
        return ids.astype(np.int32), np.bincount(part, weights=n, minlength=len(start)).astype(np.int64)

    def _keep(self, flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Adds parts to the pools; where their ids begin there and how many they are, and the same of their bytes."""
        ids, counts = self._pieces(flat, start, length)
        places = np.stack((self.pooled + np.cumsum(counts) - counts, counts, len(self.raw) + np.cumsum(length) - length, length), axis=1)
        self.pooled += len(ids)
        self.flat = ids if self.flat is None else np.concatenate((self.flat, ids))
        self.raw = np.concatenate((self.raw, flat[K.ragged(start, length)]))
        return places

    def encode(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents with begin and end ids, and their offsets."""
        v = self.v
        if len(self.keys) > CACHE:
            self.forget()
        docs = len(offsets) - 1
        start, length = self._parts(flat, offsets) if len(flat) else (np.zeros(0, np.int64),) * 2
        keys = K.range_hashes(flat, start, start + length) if len(start) else np.zeros(0, K.U64)
        distinct, first, of = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        have = np.zeros(len(distinct), dtype=bool)
        inside = at < len(self.keys)
        have[inside] = self.keys[at[inside]] == distinct[inside]
        fresh = np.flatnonzero(~have)
        if len(fresh):
            own = first[fresh]
            places = self._keep(flat, start[own], length[own])
            self.keys = np.insert(self.keys, at[fresh], distinct[fresh])
            self.places = np.insert(self.places, at[fresh], places, axis=0)
        place = self.places[np.searchsorted(self.keys, distinct)][of] if len(distinct) else np.zeros((0, 4), np.int64)
        # a part is that of its hash only if the bytes are the same
        same = place[:, 3] == length
        cells = np.flatnonzero(same)
        equal = flat[K.ragged(start[cells], length[cells])] == self.raw[K.ragged(place[cells, 2], length[cells])]
        same[np.repeat(cells, length[cells])[~equal]] = False
        odd = np.flatnonzero(~same)
        if len(odd):
            place[odd] = self._keep(flat, start[odd], length[odd])
        doc = np.searchsorted(offsets, start, side="right") - 1
        sizes = np.bincount(doc, weights=place[:, 1], minlength=docs).astype(np.int64) + (v.begin >= 0) + (v.end >= 0)
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        out = np.empty(bounds[-1], dtype=np.int32)
        inner = np.ones(len(out), dtype=bool)
        if v.begin >= 0:
            inner[bounds[:-1]] = False
            out[bounds[:-1]] = v.begin
        if v.end >= 0:
            inner[bounds[1:] - 1] = False
            out[bounds[1:] - 1] = v.end
        if len(place):
            out[inner] = self.flat[K.ragged(place[:, 0], place[:, 1])]
        return out, bounds

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids with their offsets, and the source byte range of each id, for raw texts."""
        v = self.v
        docs = len(offsets) - 1
        filled = np.diff(offsets) > 0
        plain = not v.charsmap and not v.trim
        if plain and len(data) > 2:
            plain = not ((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)).any()
        if plain:
            add = int(v.dummy_prefix)
            lengths = np.diff(offsets) + add * filled
            bounds = np.concatenate(([0], np.cumsum(lengths)))
            flat = np.full(bounds[-1], 32, dtype=np.uint8)
            flat[K.ragged(bounds[:-1] + add * filled, np.diff(offsets))] = data
        else:
            raw = data.tobytes()
            made = [normalise(raw[a:b].decode("utf-8", "replace"), v, self.chars) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            bounds = np.concatenate(([0], np.cumsum([len(m[0]) for m in made]))).astype(np.int64)
            flat = np.frombuffer(b"".join(m[0] for m in made), np.uint8)
        ids, out = self.encode(flat, bounds)
        length = v.raw_length[ids].astype(np.int64)
        if not v.byte_fallback:
            length[ids == v.unknown] = 1
        end = np.cumsum(length)
        begin = end - length
        doc = np.repeat(np.arange(docs), np.diff(out))
        base = np.append(begin, 0)[np.minimum(out[:-1], len(begin))]
        if plain:
            shift = base + add * filled
            begin, end = np.maximum(begin - shift[doc], 0), np.maximum(end - shift[doc], 0)
        else:
            first = np.append(np.concatenate([np.array(m[1], dtype=np.int64) for m in made]), 0)
            last = np.append(np.concatenate([np.array(m[2], dtype=np.int64) for m in made]), 0)
            size = np.diff(offsets)[doc]
            a, b = np.minimum(begin, len(first) - 1), np.minimum(np.maximum(end - 1, 0), len(last) - 1)
            empty = length == 0
            begin, end = np.where(empty, np.where(ids == v.begin, 0, size), first[a]), np.where(empty, np.where(ids == v.begin, 0, size), last[b])
        return ids, out, begin.astype(np.int32), end.astype(np.int32)


def _replace_invalid(raw: bytes) -> bytes:
    """Every byte that starts no valid UTF-8 sequence becomes a replacement character."""
    out, at = [], 0
    while at < len(raw):
        n = 1 if raw[at] < 0x80 else 2 if raw[at] >> 5 == 6 else 3 if raw[at] >> 4 == 14 else 4 if raw[at] >> 3 == 30 else 0
        try:
            if not n:
                raise UnicodeDecodeError("utf-8", raw, at, at + 1, "no start")
            raw[at : at + n].decode()
            out.append(raw[at : at + n])
            at += n
        except UnicodeDecodeError:
            out.append("�".encode())
            at += 1
    return b"".join(out)


def decode(v: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all id sequences and their offsets."""
    docs = len(bounds) - 1
    start = v.out_offsets[ids]
    length = v.out_offsets[ids + 1] - start
    if v.dummy_prefix or v.trim:
        # the space mark in front of the text goes
        content = np.flatnonzero(length > 0)
        at = np.searchsorted(content, bounds[:-1])
        ok = at < len(content)
        lead = content[at[ok]]
        lead = lead[lead < bounds[1:][ok]]
        lead = lead[(v.out_bytes[start[lead]] == 32) & ~v.is_byte[ids[lead]] & (ids[lead] != v.unknown)]
        start[lead] += 1
        length[lead] -= 1
    flat = v.out_bytes[K.ragged(start, length)]
    sizes = np.concatenate(([0], np.cumsum(length)))
    offsets = sizes[bounds]
    raw = flat.tobytes()
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        parts = [_replace_invalid(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        flat = np.frombuffer(b"".join(parts), np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    assert len(offsets) == docs + 1
    return flat, offsets


def encode_texts(docs: DataFrame, model: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids with begin and end ids, starts and ends (source bytes of each id), and decoded, what decode(ids) gives, of each row."""
    kind = docs.schema[doc_id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(load(model))

    def run(batches):
        coder = Encoder(shared.value)
        for batch in batches:
            data, offsets = K.buffers(batch.column(1))
            for i, j in K.slices(offsets, SLICE):
                ids, bounds, begin, end = coder.texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                flat, out = decode(coder.v, ids, bounds)
                lists = pa.array(bounds.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        *(pa.ListArray.from_arrays(lists, pa.array(x)) for x in (ids, begin, end)),
                        pa.StringArray.from_buffers(j - i, pa.py_buffer(out.astype(np.int32)), pa.py_buffer(flat)),
                    ],
                    names=["doc_id", "ids", "starts", "ends", "decoded"],
                )

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, RESULT.format(id=kind))
