"""Archive, codec, personal data, licences, neighbours and the pipeline."""

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from finpanel.llm import crosspolytope, licences, pii, piececodec, queries, warcstore
from finpanel.llm.storage import fresh_path

SF = "/root/testdata/sf0.001"


def test_archive(spark):
    rows = [(1, "u1", "same", 0), (2, "u2", "same", 0), (3, None, None, 0), (4, "u4", "", 1), (None, "u5", "same", 1), (5, "u6", "own é", 1), (6, "u7", "twice", 1), (6, "u7", "twice", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    path = fresh_path(spark, "t")
    warcstore.write_archive(pages, path)
    records = warcstore.read_archive(spark, path)
    got = sorted(map(tuple, warcstore.index(records).collect()), key=str)
    sha = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    want = [(1, 4, sha("same"), "revisit", 2), (2, 4, sha("same"), "response", None), (3, 0, sha(""), "revisit", 4), (4, 0, sha(""), "response", None), (None, 4, sha("same"), "revisit", 2), (5, 6, sha("own é"), "response", None), (6, 5, sha("twice"), "response", None), (6, 5, sha("twice"), "response", None)]
    assert got == sorted(want, key=str)
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    raw = [bytes(r.record) for r in records.collect()]
    for r in raw:
        head, _, rest = r.partition(b"\r\n\r\n")
        n = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1\r\n") and rest[n:] == b"\r\n\r\n"
    empty = fresh_path(spark, "t")
    warcstore.write_archive(pages.limit(0), empty)
    assert warcstore.index(warcstore.read_archive(spark, empty)).count() == 0


def test_headers_hold_no_lines_of_urls(spark):
    """Line ends, separators and header text in a url stay in its line, and what is read comes from the records' bytes."""
    urls = [f"http://a/{c}WARC-Refers-To: <urn:page:99>" for c in ("\r\n", "\n", "\u0085", "\u2028", "\u2029", "\x0b", "\x0c", "\r", "")] + ["http://b/%0Aü?q=1", "x" * 70000]
    pages = spark.createDataFrame([(i, u, f"page {i} \r\n\r\nWARC-Type: revisit\r\n") for i, u in enumerate(urls)], "page_id long, url string, html string")
    path = fresh_path(spark, "t")
    warcstore.write_archive(pages, path, date="2024-05-06T07:08:09Z")
    records = warcstore.read_archive(spark, path)
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in warcstore.index(records).collect()) == [(i, "response", None) for i in range(len(urls))]
    got = {int(re.search(rb"<urn:page:(\d+)>", r.record)[1]): bytes(r.record).partition(b"\r\n\r\n")[0].decode().split("\r\n") for r in records.collect()}
    assert all(len(h) == 8 and "WARC-Date: 2024-05-06T07:08:09Z" in h for h in got.values())
    assert f"WARC-Target-URI: {urls[9]}" in got[9] and "WARC-Target-URI: http://a/%E2%80%A8WARC-Refers-To: <urn:page:99>" in got[3]


def test_archive_minimum_and_damage(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    path = fresh_path(spark, "t")
    warcstore.write_archive(pages, path, min_bytes=3)
    kinds = {r.page_id: r.record_type for r in warcstore.index(warcstore.read_archive(spark, path)).collect()}
    assert kinds == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"xx")).write.parquet(f"{path}/bad")
    spark.read.parquet(f"{path}/bad").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="payload and digest differ"):
        warcstore.read_archive(spark, path).collect()


def test_codec_matches_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
    texts = [None, "", " ", "a", "  two  spaces ", "new\nline\ttab", "日本語 ▁ mark", "x" * 300, " " * 70 + "b", "\x00 <s> </s> <0x41>", "é" * 60 + " fin"] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    rows = {r.doc_id: r for r in piececodec.encode_texts(docs, queries.model_path()).collect()}
    for i, t in enumerate(texts):
        ids = [1, *sp.encode(t or ""), 2]
        assert rows[i].ids == ids and rows[i].decoded == sp.decode(ids)
        if t and "▁" not in t:
            raw = t.encode()
            assert b"".join(raw[a:b] for a, b in zip(rows[i].starts, rows[i].ends, strict=True)) == raw
    assert piececodec.encode_texts(docs.limit(0), queries.model_path()).count() == 0


def test_cached_parts_are_compared(monkeypatch):
    """Parts of one hash are told apart by their bytes, in one slice and from the cache."""
    import pyarrow as pa
    import sentencepiece

    from finpanel.llm import kernels

    monkeypatch.setattr(kernels, "range_hashes", lambda data, start, end, which=0: np.zeros(len(start), np.uint64))
    coder, sp = piececodec.Encoder(piececodec.load(queries.model_path())), sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
    for texts in (["one two\nthree", "four"], ["five\nsix one", "two"]):
        ids, bounds, _, _ = coder.texts(*kernels.buffers(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [[1, *sp.encode(t), 2] for t in texts]


def test_compiled_character_map():
    """A public rule set, normalised as the library does."""
    import sentencepiece

    n = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False)
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    m.ParseFromString(n.serialized_model_proto())
    v = piececodec.load(queries.model_path())
    v.charsmap, v.dummy_prefix, v.trim = bytes(m.normalizer_spec.precompiled_charsmap), False, False
    chars = piececodec.CharacterMap(v.charsmap)
    for text in ("ｆｕｌｌ ｗｉｄｔｈ", "ﬁne ① Ⅳ", "é plain", "tab\tand　space", "ｶﾞ", ""):
        out, start, end = piececodec.normalise(text, v, chars)
        assert out.decode() == n.normalize(text)
        raw = text.encode()
        assert all(0 <= a <= b <= len(raw) for a, b in zip(start, end, strict=True)) and (not raw or end[-1] == len(raw))


PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        n = int(c)
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        s += n
    return s % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), m[0]))
    return sorted(out)


TRICKY = [None, "", "a@b", "a@b.c", "x@y.com_foo@z.org", "é a.b+c@d-e.f.g.", "1.2.3.4 1.2.3.400 001.02.3.4.5 99999999999999999999.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (338) 555-7198, +12345678 +1..2", "4111111111111111" * 3, "1 " * 9000, "😀 +49 30 1234567 😀 a@b.de", "+" + "1" * 20000]


def test_base_spans(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TRICKY)], "doc_id long, text string, base string").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select((F.col("doc_id") + 100).alias("doc_id"), "text", F.lit("x").alias("base")))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.find_spans(docs).collect():
        assert [tuple(s) for s in r.base] == base_spans(texts[r.doc_id]), r.doc_id
    assert pii.find_spans(docs.limit(0)).count() == 0


def test_disclosing_terms(spark):
    """A nickname that stands beside one address only gives it away; common words and clean documents stay."""
    rows = [(i, f"line {i} of zorro wrote to z@mail.com the mail\nthe other line {i}", 1) for i in range(5)] + [(10 + i, f"the mail of day {i}\nsomebody wrote a line to the mail {i}", 1) for i in range(60)] + [(99, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    got = {r.doc_id: [s.value for s in r.terms] for r in pii.find_spans(docs).collect()}
    assert all("zorro" in got[i] and "the" not in got[i] and "mail" not in got[i] for i in range(5)) and all(got[10 + i] == [] for i in range(60))
    clean = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    assert "z@mail.com" not in clean[0].text and "[email]" in clean[0].text and "zorro" not in clean[0].text and clean[10].text == rows[5][1] and clean[99].text is None
    assert pii.sanitise(docs).columns == docs.columns


def dice(a, b):
    both = sum((a & b).values())
    return 2 * both / (sum(a.values()) + sum(b.values()))


def paragraph_runs(t):
    p = [x for x in re.split(r"\n\s*\n", t) if re.search(r"[^\W_]", x)]
    return ["\n\n".join(p[i:j]) for i in range(len(p)) for j in range(i + 2, len(p) + 1)]


def test_licences(spark):
    extra = ["", None, "Released under the MIT License.", "RELEASED under, the MIT license!", "text\nLicensed under CC BY-NC 4.0.\nmore", licences.TEMPLATES[4][1].replace(". ", ".\n"), "the license of nothing", "Licensed under the Apache License, Version 2.0."]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(extra)], "doc_id long, text string, score double").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select((F.col("doc_id") + 100).alias("doc_id"), "text", F.lit(0.5).alias("score")))
    known = [(n, licences.bigrams(t), at) for part, at in ((licences.TEMPLATES, 0.8), (licences.TEXTS, 0.9)) for n, t in part]
    got = {r.doc_id: (r.licence, round(r.score, 9)) for r in licences.scan(docs).collect()}
    for r in docs.collect():
        t = (r.text or "").lower()
        best = (0.0, None)
        for unit in {*t.split("\n"), *re.split(r"\n\s*\n", t), *paragraph_runs(t), t}:
            g = licences.bigrams(unit)
            for name, k, at in known:
                if g and (s := dice(g, k)) >= at:
                    best = min(best, (-s, name), key=lambda x: (x[0], x[1] or "~"))
        assert got[r.doc_id] == (best[1], round(-best[0], 9)), r.doc_id
    assert licences.scan(docs.limit(0)).count() == 0


def test_neighbours_find_nearly_all(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = vectors.collect()
    x = np.array([r.embedding for r in rows], dtype=float)
    ids = np.array([r.vec_id for r in rows])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for q in np.flatnonzero(ids % 50 == 0):
        s = unit @ unit[q]
        s[q] = -2
        want[int(ids[q])] = {int(ids[i]) for i in np.argsort(-s)[:5]}
    found = crosspolytope.neighbours(vectors, F.col("vec_id") % 50 == 0).collect()
    hit = sum(r.vec_id in want[r.query_id] for r in found)
    assert hit / sum(map(len, want.values())) >= 0.9
    assert all(r.query_id != r.vec_id for r in found)


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, None, 1), (5, [0.0, 0.0], 1), (6, [float("nan"), 1.0], 1), (7, [None, 1.0], 1), (8, [], 1), (9, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (50, [1.0, 0.0], 1), (50, [1.0, 0.0], 1), (10, [-1.0, 0.0], 1), (11, [1e-300, 1e-310], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = [tuple(r) for r in crosspolytope.neighbours(table, F.col("vec_id") % 50 == 0, probes=4).orderBy("query_id", "rank").collect()]
    assert [g[:3] for g in got if g[0] == 0] == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 11), (0, 5, 50)]
    assert [g[2] for g in got if g[0] == 50] == [0, 1, 2, 3, 11]
    assert crosspolytope.neighbours(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_neighbours_of_equal_cosine(spark):
    """Many vectors of one direction: ties go to the smaller ids; ids, ranks and scores against brute force."""
    rows = [(i, [float(x) * 2.0 ** (i % 41 - 20) for x in (1, 2, 3, 4)]) for i in range(60)] + [(100 + i, [1.0, 2.0, 3.0, 4.0 + 1e-13 * i]) for i in range(20)] + [(200 + i, [1.0, float(i % 7), -1.0, 0.5]) for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in crosspolytope.neighbours(table, F.col("vec_id") % 50 == 0, probes=8).collect())
    want = []
    for q, v in rows:
        if q % 50 == 0:
            raw = np.array(v).tobytes()
            others = [(i, np.array(w).tobytes()) for i, w in rows if i != q]
            near = sorted(zip((-crosspolytope.cosines(raw, [w for _, w in others])).tolist(), [i for i, _ in others], strict=True))[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near)]
    assert got == sorted(want)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        path = fresh_path(spark, name)
        stage(spark, docs, SF).write.parquet(path)
        out = spark.read.parquet(path)
        assert 0 < out.count() <= before
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            docs = out
    assert corpus_pipeline.run(spark, SF).count() == out.count()


def brute_disclosing(texts, alpha=1.1):
    """Terms that disclose an entity of a text, from plain counts over distinct lines and texts."""
    import math
    from collections import Counter

    def held(t):
        spans = base_spans(t)
        words = {m[0].lower() for m in re.finditer(r"[^\W_]+", t) if not any(s[0] < m.end() and m.start() < s[2] for s in spans)}
        return {(s[1], s[3].lower() if s[1] == 0 else s[3] if s[1] == 1 else re.sub("[^0-9]", "", s[3])) for s in spans}, words

    found = set()
    for units in ({line for t in texts for line in t.split("\n")}, set(texts)):
        nc, nt, both = Counter(), Counter(), Counter()
        for u in units:
            entities, words = held(u)
            nc.update(entities)
            nt.update(words)
            both.update((c, w) for c in entities for w in words)
        for (c, w), n in both.items():
            ic = math.log2(max(len(units) / (nc[c] + 1), 1))
            if ic + math.log2((n + 1) / (nt[w] + 1)) >= ic / alpha - 1e-9:
                found.add((c, w))
    return {t: {w for c in held(t)[0] for w in held(t)[1] if (c, w) in found} for t in texts}


def test_every_entity_is_judged(spark):
    """Entities that stand on one line only are judged, by words of their line and of the lines around it."""
    rows = [(0, "the mail of zorro went to z@mail.com\nthe masked rider of the line")] + [(1 + i, f"the mail of day number {i % 7} went to the line of the rider") for i in range(3000)]
    rows = [(i, f"{t}\nentry {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100 % 10]}{'efgh'[i // 1000]}") for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: {s.value for s in r.terms} for r in pii.find_spans(docs).filter("size(terms) > 0").collect()}
    assert set(got) == {0} and {"zorro", "masked"} <= got[0] and not {"the", "mail", "of", "went", "to", "line", "rider"} & got[0]
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = brute_disclosing(list(texts.values()))
    for r in pii.find_spans(spark.read.parquet(f"{SF}/documents.parquet")).collect():
        assert {s.value.lower() for s in r.terms} == want[texts[r.doc_id]], r.doc_id


def test_numbers_and_identifiers_are_judged(spark):
    """A number and an identifier that stand beside one address only give it away; a common number does not."""
    rows = [(i, f"customer 482913 emp4711 wrote to z@mail.com in 2024 about item {i}") for i in range(5)] + [(10 + i, f"customer of day {i} wrote in 2024 about item {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: {s.value for s in r.terms} for r in pii.find_spans(docs).collect()}
    assert all({"482913", "emp4711"} <= got[i] and not {"2024", "emp", "com"} & got[i] for i in range(5)) and not any(got[10 + i] for i in range(60))
    text = pii.sanitise(docs).filter("doc_id = 3").first().text
    assert "482913" not in text and "emp4711" not in text and "[number]" in text and "2024" in text


def test_sanitise_of_odd_tables(spark):
    """Columns of any name stay as they are, overlapping spans are replaced by the first, and characters outside ASCII don't shift them."""
    text = "é 😀 a@b.de +49 4111 1111 1111 1111 x\nü 1.2.3.4 end"
    docs = spark.createDataFrame([(1, text, "a", "b", "c", "d", "e"), (2, "clean", "a", "b", "c", "d", "e"), (3, None, None, None, None, None, None)], "doc_id long, text string, __t string, __h string, row string, base string, `terms.x` string")
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns
    got = {r[0]: r for r in clean.collect()}
    assert got[1][2:] == ("a", "b", "c", "d", "e") and got[2][1] == "clean" and got[3][1] is None
    spans, out, at = base_spans(text), "", 0
    for start, k, stop, _ in spans:
        if start >= at:
            out += text[at:start] + f"[{PATTERNS[k][0]}]"
        at = max(at, stop)
    assert re.sub(r"\[(term|number)\]", "*", got[1][1]) == re.sub(r"[^\W_]+", lambda m: m[0] if m[0] in ("email", "ip", "card", "phone") else "*", out + text[at:])
    assert pii.sanitise(docs.limit(0)).count() == 0


def test_a_text_of_many_spans(spark):
    """Some 2 MB with 40,000 addresses and a word beside each."""
    import time

    text = " ".join(f"word{i % 97} user{i}@mail.example.com é" for i in range(40000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    r = pii._base(pii._rows(docs, "doc_id", "text"), ["doc_id"]).select("doc_id", pii._public("base").alias("base")).first()
    assert [tuple(s) for s in r.base] == base_spans(text) and time.time() - began < 60


def test_whole_licences_are_found(spark):
    """The standard texts, with their disclaimers and a copyright line, in paragraphs."""
    full = [(n, x) for n, x in licences.TEMPLATES if n in ("BSD-3-Clause", "BSD-2-Clause", "ISC") and "DAMAGE" in x]
    assert len(full) == 3
    rows = [(i, "Copyright (c) 2020 The Authors\n\n" + x.replace(" THIS ", "\n\nTHIS ").replace(" THE SOFTWARE", "\n\nTHE SOFTWARE").replace(" 2. ", "\n\n2. ")) for i, (_, x) in enumerate(full)]
    got = {r.doc_id: r.licence for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: n for i, (n, _) in enumerate(full)}


def plain_best(text: str) -> tuple:
    """Licence and score by loops over all units and all runs of paragraphs."""
    best = (0.0, "")
    t = text.lower()
    units = [licences.bigrams(u) for u in {*t.split("\n"), *re.split(r"\n\s*\n", t), *paragraph_runs(t), t}]
    for part, at in ((licences.TEMPLATES, 0.8), (licences.TEXTS, 0.9)):
        for name, x in part:
            k = licences.bigrams(x)
            size = sum(k.values())
            for g in units:
                a = sum(g.values())
                if a and 0.6 * size <= a <= 1.6 * size and (score := dice(g, k)) >= at:
                    best = min(best, (-score, name))
    return best[1] or None, round(-best[0], 6)


OTHER = "This tool reads tables and writes reports.\n\nIt was made for people who like reports, and has many options which nobody has ever used, as far as anyone knows."


def test_licences_of_several_paragraphs_among_other_text(spark):
    """A licence in any number of paragraphs above and between other text is found, in operator and SQL alike; ties, repeats and nulls too."""
    import duckdb

    mit, isc = licences.TEMPLATES[4][1], licences.TEMPLATES[5][1]
    three = mit.replace(" The above", "\n\nThe above").replace(" THE SOFTWARE IS", "\n \nTHE SOFTWARE IS")

    def cut(text, parts):
        w = text.split(" ")
        at = [i * len(w) // parts for i in range(parts + 1)]
        return "\n\n".join(" ".join(w[a:b]) for a, b in zip(at, at[1:], strict=False))

    long = "\n\n".join(["other words " * 180] * 2)
    texts = [three + "\n\n" + OTHER, OTHER + "\n\n" + three + "\n\n" + OTHER, three, OTHER, None, "", three.replace("\n\n", "\n\n\n") + "\n\n" + OTHER + "\n\n" + three, "\n\n".join([OTHER] * 10 + [three] + [OTHER] * 10)]
    texts += [long + "\n\n" + cut(x, n) + "\n\n" + long for x, n in ((mit, 7), (mit, 12), (mit, 40), (isc, 2), (isc, 5))] + [cut(mit, 12) + "\n\n--\n\n" + cut(isc, 3) + "\n\n" + OTHER]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])]
    # one-word paragraphs, in the operator only: the SQL scores every run
    many = [(100, "\n\n".join("permission"[: i % 11] for i in range(3000))), (101, "\n\n".join(["permission is hereby granted"] * 2000 + cut(mit, 30).split("\n\n")))]
    table = spark.createDataFrame(rows + many, "doc_id long, text string")
    got = sorted((r.doc_id, r.licence, round(r.score, 6), r.n_units) for r in licences.scan(table).collect())
    assert [(r[0], r[1]) for r in got] == [(0, "MIT"), (0, "MIT"), (1, "MIT"), (2, "MIT"), (3, None), (4, None), (5, None), (6, "MIT"), (7, "MIT"), (8, "MIT"), (9, "MIT"), (10, "MIT"), (11, "ISC"), (12, "ISC"), (13, "ISC"), (100, None), (101, "MIT")]
    assert all(r[2] == 1 for r in got if r[0] in (8, 9, 10, 11, 12, 13)) and got[-1][2] > 0.97
    assert [(r[1], r[2]) for r in got[1:15]] == [plain_best(t or "") for t in texts]
    with duckdb.connect() as db:
        db.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}))
        want = db.execute(queries.ORACLE_SQL["op10_licences"]).fetchall()
    assert [r for r in got if r[0] < 100] == sorted((d, n, float(s), u) for d, n, s, u in want)


def test_whole_texts_of_long_licences(spark):
    """A file of a long licence is found alone and inside other text, changed a little too, and a third of it is none."""
    texts = dict(licences.TEXTS)
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} <= set(texts)
    gpl = texts["GPL-3.0"]
    rows = [(i, t) for i, t in enumerate(texts.values())]
    rows += [(20, OTHER + "\n\n" + gpl + "\n\n" + OTHER), (21, OTHER + "\n\n" + texts["LGPL-2.1"].replace("Library", "Framework") + "\n\n" + OTHER), (22, gpl[: len(gpl) // 3])]
    got = {r.doc_id: (r.licence, r.score) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == [(n, 1.0) for n in texts]
    assert got[20] == ("GPL-3.0", 1.0) and got[21][0] == "LGPL-2.1" and 0.9 <= got[21][1] < 1 and got[22][0] is None
