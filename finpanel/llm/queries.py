"""The registered queries of this subpackage: thin digests of the operators over whole tables."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finpanel.llm import blockrepeats, crosspolytope, decontam, filteraudit, langid, licences, metricjoin, pii, piececodec, simhash, spelling, warcstore, weaklabel
from finpanel.llm.kernels import buffers
from finpanel.llm.storage import fresh_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weaklabel.score_quality(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warcstore.write_archive(_table(spark, sf_dir, "pages"), path)
    return warcstore.index(warcstore.read_archive(spark, path))


def op4_block_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = blockrepeats.remove_repeats(_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def model_path() -> str:
    """The public BPE model that the environment provides."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _digests(batches):
    """Digests of encoded rows: ids as little-endian unsigned 32-bit integers, and the decoded text."""
    for batch in batches:
        ids = batch.column(1)
        offsets, raw = ids.offsets.to_numpy(), np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False)).astype("<u4").tobytes()
        text_raw = batch.column(2)
        data, bounds = buffers(text_raw)
        data = data.tobytes()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(np.diff(offsets).astype(np.int64)),
                pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]),
                pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]),
            ],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = piececodec.encode_texts(_table(spark, sf_dir, "documents"), model_path()).select("doc_id", "ids", "decoded")
    return coded.mapInArrow(_digests, f"doc_id {coded.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(_table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.describe("base"), 256).alias("base_sha256"), pii.describe("array_sort(concat(base, terms))").alias("spans"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspolytope.neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "licence", F.round("score", 6).alias("score"), "n_units")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metricjoin.near_sets(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_decontamination": op2_decontamination,
    "op3_warc": op3_warc,
    "op4_block_repeats": op4_block_repeats,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_simhash": op6_simhash,
    "op7_pii": op7_pii,
    "op8_language": op8_language,
    "op9_neighbours": op9_neighbours,
    "op10_licences": op10_licences,
    "op11_spelling": op11_spelling,
    "op12_filter_audit": op12_filter_audit,
    "op13_jaccard_join": op13_jaccard_join,
}

WORDS_2 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op2_decontamination": rf"""
WITH d AS (SELECT doc_id, {WORDS_2} AS w FROM documents),
b AS (SELECT item_id, {WORDS_2} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, cast(item_id AS VARCHAR) AS id FROM hit) GROUP BY 1)
SELECT d.doc_id, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(n_hit, 0) AS BIGINT) AS n_hit, cast(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op4_block_repeats": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT g, min(doc_id) AS least FROM g GROUP BY 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (g) WHERE least < doc_id) GROUP BY 1),
words AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
lost AS (SELECT doc_id, unnest(gone) AS i FROM gone),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM (SELECT * FROM words ANTI JOIN lost USING (doc_id, i)) GROUP BY 1)
SELECT d.doc_id, cast(len(w) AS BIGINT) AS n_words, cast(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
}

WORDS_10 = r"'[\p{L}\p{N}]+'"


def _base32(hexes: str) -> str:
    """DuckDB SQL for the base32 form of 40 hex digits."""
    five = [f"CAST('0x' || substr({hexes}, {5 * i + 1}, 5) AS INTEGER)" for i in range(8)]
    return " || ".join(f"substr('{warcstore.ALPHABET}', (({x} >> {s}) & 31) + 1, 1)" for x in five for s in (15, 10, 5, 0))


ORACLE_SQL["op3_warc"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT t, max(page_id) AS most FROM p GROUP BY t)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, {_base32("h")} AS payload_digest,
       CASE WHEN page_id <> most THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> most THEN most END AS refers_to
FROM p JOIN g USING (t)"""


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE_SQL["op10_licences"] = rf"""
WITH tw AS (SELECT i, licence, t, regexp_extract_all(lower(x), {WORDS_10}) AS w FROM (VALUES {", ".join(f"({i}, {_literal(n)}, {_literal(x)}, {0.8 if i < len(licences.TEMPLATES) else 0.9})" for i, (n, x) in enumerate(licences.TEMPLATES + licences.TEXTS))}) v(i, licence, x, t)),
tg AS (SELECT i, licence, t, len(w) - 1 AS size, w[k] || ' ' || w[k + 1] AS gram, count(*) AS m FROM (SELECT *, unnest(range(1, len(w))) AS k FROM tw) GROUP BY ALL),
pw AS (SELECT DISTINCT doc_id, list_filter(list_transform(string_split_regex(lower(text), '\n\s*\n'), lambda x: regexp_extract_all(x, {WORDS_10})), lambda w: len(w) > 0) AS p FROM documents),
runs AS (SELECT doc_id, p, i, unnest(range(i + 1, len(p) + 1)) AS j FROM (SELECT doc_id, p, unnest(range(1, len(p))) AS i FROM pw WHERE len(p) > 2)),
u AS (SELECT DISTINCT doc_id, unit FROM (SELECT doc_id, unnest(list_concat(list_concat(string_split(lower(text), chr(10)), string_split_regex(lower(text), '\n\s*\n')), [lower(text)])) AS unit FROM documents)),
uw AS (SELECT *, row_number() OVER () AS u FROM (SELECT doc_id, false AS run, regexp_extract_all(unit, {WORDS_10}) AS w FROM u
       UNION ALL SELECT doc_id, true AS run, flatten(p[i : j]) AS w FROM runs WHERE i > 1 OR j < len(p))),
ug AS (SELECT doc_id, run, u, len(w) - 1 AS a, w[k] || ' ' || w[k + 1] AS gram, count(*) AS n FROM (SELECT *, unnest(range(1, len(w))) AS k FROM uw) GROUP BY doc_id, run, u, len(w), w[k] || ' ' || w[k + 1]),
d AS (SELECT doc_id, run, u, licence, t, 2.0 * sum(least(n, m)) / (a + size) AS score FROM ug JOIN tg USING (gram) GROUP BY doc_id, run, u, a, i, licence, size, t),
best AS (SELECT doc_id, arg_min(licence, row(-score, licence)) AS licence, max(score) AS score, count(DISTINCT CASE WHEN NOT run THEN u END) AS n_units FROM d WHERE score >= t - 1e-12 GROUP BY doc_id)
SELECT documents.doc_id, licence, round(coalesce(score, 0.0), 6) AS score, coalesce(n_units, 0) AS n_units FROM documents LEFT JOIN best USING (doc_id)"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# the hash's table is made by its rule; near words share what is left without one code point, or are it
ORACLE_SQL["op11_spelling"] = rf"""
WITH RECURSIVE crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
runs AS (SELECT doc_id, r, count(*) AS m FROM (SELECT doc_id, unnest(regexp_extract_all({LOWER}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS r FROM documents) GROUP BY ALL),
keyed AS (SELECT r, m, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, octet_length(b) + 1), lambda i: CAST('0x' || substr(hex(b), 2 * i - 1, 2) AS BIGINT))), lambda s, x: xor(s >> 8, t[(xor(s, x) & 255) + 1]))) AS h
  FROM (SELECT r, m, encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r) AS b FROM runs WHERE length(r) >= 6), crc),
done AS (SELECT m, CASE WHEN h % 199 = 0 THEN substr(r, 1, CAST(h % length(r) AS BIGINT)) || substr(r, CAST(h % length(r) AS BIGINT) + 2) ELSE r END AS word FROM keyed),
w AS (SELECT word, CAST(sum(m) AS BIGINT) AS n, length(word) AS len FROM done WHERE length(word) >= 6 GROUP BY word HAVING sum(m) >= 5),
cuts AS (SELECT word, n, len, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, len + 1)) AS i FROM w)),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.len = b.len AND a.word <> b.word
  UNION SELECT c.word, c.n, w.word, w.n FROM cuts c JOIN w ON w.word = c.rest UNION SELECT w.word, w.n, c.word, c.n FROM cuts c JOIN w ON w.word = c.rest),
best AS (SELECT word, n, count(*) AS n_near, arg_min(other, row(-other_n, encode(other))) AS other, max(other_n) AS other_n FROM near GROUP BY word, n),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n FROM w LEFT JOIN best USING (word)),
steps AS (SELECT word, word AS root FROM forms UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON f.word = s.root WHERE f.form IS NOT NULL)
SELECT forms.word, forms.form, steps.root, forms.n, CAST(forms.n_near AS BIGINT) AS n_near, CAST(forms.form_n AS BIGINT) AS form_n
FROM forms JOIN steps ON steps.word = forms.word JOIN forms last ON last.word = steps.root AND last.form IS NULL"""

ORACLE_SQL["op12_filter_audit"] = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c,
  regexp_matches(t, '[#$%&*|]') AS d, coalesce(d.doc_id > least, false) AS e FROM d JOIN firsts USING (t) LEFT JOIN l ON l.doc_id = d.doc_id),
m AS (SELECT part, concat(CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END, CASE WHEN d THEN 'D' END, CASE WHEN e THEN 'E' END) AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM f GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
orders AS (SELECT p.k || q.k || r.k || s.k || t.k AS o FROM letters p, letters q, letters r, letters s, letters t WHERE len(list_distinct([p.k, q.k, r.k, s.k, t.k])) = 5),
gone AS (SELECT part, o, n, good, bad, fails, coalesce(list_min(list_transform(string_split(nullif(fails, ''), ''), lambda x: position(x IN o))), 6) AS gone FROM m, orders),
steps AS (SELECT part, o AS filter_order, s AS step, substr(o, s, 1) AS letter, sum(n) FILTER (gone > s) AS kept, sum(n) FILTER (gone = s) AS removed, sum(n) FILTER (gone < s AND contains(fails, substr(o, s, 1))) AS redundant,
  sum(n) FILTER (fails = substr(o, s, 1)) AS unique_fails, sum(good) FILTER (gone = s) AS good_lost, sum(bad) FILTER (gone = s) AS toxic_lost FROM gone, range(1, 6) r(s) GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
       CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(removed) OVER (PARTITION BY part, letter), 0) AS BIGINT) AS shapley FROM steps"""

ORACLE_SQL["op13_jaccard_join"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
b AS (SELECT p.doc_id AS x, q.doc_id AS y, count(*) AS k FROM s p JOIN s q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM b JOIN c p ON p.doc_id = x JOIN c q ON q.doc_id = y WHERE 100 * k >= 90 * (p.n + q.n - k)),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other)
SELECT d.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_shingles, least AS component_id
FROM d LEFT JOIN c ON c.doc_id = d.doc_id JOIN (SELECT doc_id, min(other) AS least FROM reach GROUP BY 1) m ON m.doc_id = d.doc_id"""
