"""Personal data, and the terms that give it away.

Base spans are emails, IP addresses, card numbers and phone numbers: leftmost non-overlapping matches of one pattern
each, of which those that fail their check are dropped. The values found are the protected entities.

Sanitisation is information-theoretic. There are two corpora: the distinct lines and the distinct texts. For an
entity c and a term t, PMI(c; t) = log2(N (n(c, t) + s) / ((n(c) + s) (n(t) + s))) says how much of the information
content IC(c) = log2(N / (n(c) + s)) a reader of t learns; the ``smoothing`` s defines it from one occurrence on, so
every entity is judged. A term discloses c if PMI(c; t) >= IC(c) / ``alpha`` in one of the two. Terms are words that
touch no base span, numbers among them. In documents that hold c, such terms are spans of kind ``term``. ``sanitise``
replaces spans by their kind, which generalises what they were, and terms by the class of term: a number or a word.

Everything is DataFrame and SQL functions. Texts don't travel: spans are computed where a text is read, carry the text's
hash, and meet its disclosing terms by it. The patterns use possessive groups, which match the same and need no stack
for long runs; arrays are folded in blocks of about the root of their size, as an array that grows is copied.

Defined results: null and empty texts have no spans; a null id is an id like any other; repeated rows have the same
spans; equal lines count once in the statistics, in however many documents they stand; further columns are ignored
(``find_spans``) or kept (``sanitise``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finpanel.llm.storage import cut, split

KINDS = ("email", "ip", "card", "phone")
#: A match that begins inside a run of a pattern's first characters could begin at the run's first one as well. So emails and
#: IPs begin there, or where the last match ended (\\G), and a long run is read once, not again from each of its characters.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"[\p{L}\p{N}]+"
_TERM = TERM.replace("\\", "\\\\")  # in SQL
#: A condition on text; one without such a character has no span.
MARKED = "text rlike '[0-9@]'"
#: Rows of one long that a broadcast may hold.
BROADCAST_KEYS = 1_000_000
#: Bytes of rows that a broadcast may hold.
BROADCAST_BYTES = 8 << 20
#: A span inside this module; ``byte`` is where it begins in the UTF-8 text.
SPAN = "struct<start:int,kind:int,stop:int,value:string,byte:int>"
NO_SPANS = f"cast(array() as array<{SPAN}>)"


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


#: SQL conditions on a match x.
CHECKS = {
    "email": "true",
    "ip": r"forall(split(x.value, '\\.'), p -> length(ltrim('0', p)) <= 3 and cast(concat('0', ltrim('0', p)) as int) <= 255)",
    "card": f"length({_digits('x.value')}) between 12 and 19 and aggregate(sequence(1, length({_digits('x.value')})), 0, (a, i) -> a + case when i % 2 = 1 then cast(substr(reverse({_digits('x.value')}), i, 1) as int) else cast(substr('0246813579', cast(substr(reverse({_digits('x.value')}), i, 1) as int) + 1, 1) as int) end) % 10 = 0",
    "phone": f"length({_digits('x.value')}) between 9 and 15",
}


def _blocks(array: str, body: str) -> str:
    """SQL that puts together what ``body`` makes of each block [lo, hi) of about the root of an array's places, so that arrays grown in a block stay short; k numbers the blocks."""
    return f"flatten(transform(sequence(0, size({array}) - 1, cast(ceil(sqrt(size({array}))) as int)), (lo, k) -> transform(array(least(lo + cast(ceil(sqrt(size({array}))) as int), size({array}))), hi -> {body})[0]))"


def _placed(matches: str, between: str, kind: int) -> str:
    """SQL for the spans of matches and of the pieces between them."""
    move = f"named_struct('at', a.at + length({between}[i]) + length({matches}[i]), 'byte', a.byte + octet_length({between}[i]) + octet_length({matches}[i])"
    sums = _blocks(matches, f"array(aggregate(sequence(lo, hi - 1), named_struct('at', 0, 'byte', 0), (a, i) -> {move})))")
    starts = f"aggregate({sums}, named_struct('at', 0, 'byte', 0, 'out', cast(array() as array<struct<at:int,byte:int>>)), (a, x) -> named_struct('at', a.at + x.at, 'byte', a.byte + x.byte, 'out', concat(a.out, array(named_struct('at', a.at, 'byte', a.byte)))), a -> a.out)"
    span = f"named_struct('start', a.at + length({between}[i]), 'kind', {kind}, 'stop', a.at + length({between}[i]) + length({matches}[i]), 'value', {matches}[i], 'byte', a.byte + octet_length({between}[i]))"
    body = f"aggregate(sequence(lo, hi - 1), named_struct('at', begin[k].at, 'byte', begin[k].byte, 'out', {NO_SPANS}), (a, i) -> {move}, 'out', concat(a.out, array({span}))), a -> a.out)"
    return f"case when size({matches}) > 0 then transform(array({starts}), begin -> {_blocks(matches, body)})[0] else {NO_SPANS} end"


def _apart(spans: str, base: str) -> str:
    """SQL for the spans that touch no base span; both stand in order."""
    near = f"filter({base}, x -> x.start < {spans}[hi - 1].stop and {spans}[lo].start < x.stop)"
    body = f"transform(array({near}), near -> filter(slice({spans}, lo + 1, hi - lo), t -> not exists(near, x -> x.start < t.stop and t.start < x.stop)))[0]"
    return f"case when coalesce(size({spans}), 0) > 0 then {_blocks(spans, body)} else {NO_SPANS} end"


def _once(value: Column, name: str) -> Column:
    """A column that is computed once: filters on it are not pushed below, where its parts would be computed again for each use."""
    return F.explode(F.array(value)).alias(name)


def _base(rows: DataFrame, keep: list[str], *, text: str = "text") -> DataFrame:
    """``keep`` and base, the checked base spans of a text column in order of start, then kind; ``rows`` are made here, so that no name clashes."""
    maybe = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    digit = F.col(text).rlike("[0-9]")
    none = F.array().cast("array<string>")
    cut_up = rows
    for k in KINDS:
        some = maybe.get(k, digit)
        pattern = F.lit(PATTERNS[k])
        cut_up = cut_up.withColumn(f"m_{k}", F.when(some, F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(none))
        cut_up = cut_up.withColumn(f"p_{k}", F.when(some, F.split(text, pattern, -1)).otherwise(none))
    spans = [F.expr(f"filter({_placed(f'm_{k}', f'p_{k}', i)}, x -> {CHECKS[k]})") for i, k in enumerate(KINDS)]
    return cut_up.select(*keep, _once(F.array_sort(F.concat(*spans)), "base"))


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), t.alias("text"), F.xxhash64(t).alias("h"))


def _entity(kind: Column, value: Column) -> Column:
    """Kind and normal form of a value."""
    return F.concat(F.element_at(F.array(*[F.lit(k) for k in KINDS]), kind + 1), F.lit(":"), F.when(kind == 0, F.lower(value)).when(kind == 1, value).otherwise(F.regexp_replace(value, "[^0-9]", "")))


def _with_words(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and words, the lower-cased words of each text that touch no base span, each once, from rows with text and base."""
    some = F.size("base") > 0
    none = F.array().cast("array<string>")
    whole = F.regexp_extract_all("text", F.lit(TERM), F.lit(0))
    x = rows.select(*keep, "base", whole.alias("w"), F.when(some, F.split("text", TERM, -1)).otherwise(none).alias("g"))
    x = x.select(*keep, "base", "w", _once(F.expr(f"case when size(base) > 0 then {_placed('w', 'g', len(KINDS))} else {NO_SPANS} end"), "placed"))
    left = f"case when size(base) > 0 then transform({_apart('placed', 'base')}, t -> lower(t.value)) else transform(w, v -> lower(v)) end"
    return x.select(*keep, _once(F.expr(f"array_distinct({left})"), "words"))


def _uses(rows: DataFrame) -> DataFrame:
    """level (0 for a line, 1 for a whole text), u (the hash of the line or text) and its words, of all lines and texts."""
    # no base pattern matches a line end, so the spans of a text are those of its lines
    lines = _base(rows.select("h", F.explode(F.split("text", "\n")).alias("text")), ["h", "text"])
    lines = _with_words(lines.select("h", F.xxhash64("text").alias("lh"), "text", "base"), ["h", "lh"])
    return lines.select(F.explode(F.array(F.struct(F.lit(0).alias("level"), F.col("lh").alias("u")), F.struct(F.lit(1).alias("level"), F.col("h").alias("u")))).alias("x"), "words").select("x.level", "x.u", F.explode("words").alias("term"))


def _pairs(rows: DataFrame) -> DataFrame:
    """level, u, entity and term of each line and text that holds both."""
    line = F.transform(F.split("text", "\n"), lambda x: F.struct(F.lit(0).alias("level"), F.xxhash64(x).alias("u"), x.alias("text")))
    units = rows.filter(MARKED).select(F.explode(F.concat(line, F.array(F.struct(F.lit(1).alias("level"), F.col("h").alias("u"), F.col("text").alias("text"))))).alias("x")).select("x.*")
    held = _base(units.filter(MARKED), ["level", "u", "text"]).filter(F.size("base") > 0).dropDuplicates(["level", "u"])
    held = held.withColumn("entities", F.array_distinct(F.transform("base", lambda b: _entity(b["kind"], b["value"]))))
    held = _with_words(held, ["level", "u", "entities"])
    return held.select("level", "u", "words", F.explode("entities").alias("entity")).select("level", "u", "entity", F.explode_outer("words").alias("term"))


def disclosing_terms(rows: DataFrame, pairs: DataFrame, *, smoothing: float = 1.0, alpha: float = 1.1) -> DataFrame:
    """entity and term of the terms that disclose an entity, from the texts of ``_rows`` and their ``_pairs``."""
    totals = rows.select("h", F.explode(F.split("text", "\n")).alias("line")).agg(F.countDistinct(F.xxhash64("line")), F.countDistinct("h")).first()
    total = F.when(F.col("level") == 0, F.lit(float(max(1, totals[0])))).otherwise(F.lit(float(max(1, totals[1]))))
    sizes = pairs.select("level", "entity", "u").distinct().groupBy("level", "entity").agg(F.count(F.lit(1)).alias("nc"))
    both = pairs.filter("term is not null").groupBy("level", "entity", "term").agg(F.count(F.lit(1)).alias("both")).join(sizes, ["level", "entity"])
    # PMI >= IC / alpha holds if n(t) <= most, so a term that stands in more of them is out whatever its exact count
    most = (F.col("both") + smoothing) * F.pow(F.greatest(total / (F.col("nc") + smoothing), F.lit(1.0)), F.lit(1 - 1 / alpha)) - smoothing
    both = cut(both.select("level", "entity", "term", F.xxhash64("level", "term").alias("key"), most.alias("most")))
    limits = cut(both.groupBy("key").agg(F.max("most").alias("most")))
    # only the terms that stand beside an entity are counted
    uses = _uses(rows).select("u", F.xxhash64("level", "term").alias("key")).join(_few(limits.select("key"), BROADCAST_KEYS), "key", "left_semi")
    rough = uses.groupBy("key").agg(F.approx_count_distinct("u", 0.2).alias("about"))
    rare = cut(limits.join(rough, "key").filter(F.col("about") <= 3 * F.col("most") + 20).select("key"))
    counts = uses.join(_few(rare, BROADCAST_KEYS), "key", "left_semi").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("nt"))
    return both.join(counts, "key").filter(F.col("nt") <= F.col("most") + 1e-9).select("entity", "term").distinct()


def _few(table: DataFrame, most: int, weight: Column | None = None) -> DataFrame:
    """A written table for a join: broadcast if its rows, or their weights in bytes, are counted as few, shuffled else."""
    size = table.agg(F.sum(weight)).first()[0] if weight is not None else table.count()
    return F.broadcast(table) if (size or 0) <= most else table


def _term_spans(rows: DataFrame, smoothing: float, alpha: float) -> DataFrame:
    """h and terms, the spans of disclosing terms, of the texts that have some."""
    pairs = cut(_pairs(rows))
    given_away = pairs.filter("level = 1").join(disclosing_terms(rows, pairs, smoothing=smoothing, alpha=alpha), ["entity", "term"])
    given_away = cut(given_away.groupBy(F.col("u").alias("h")).agg(F.collect_set("term").alias("terms")))
    length = F.expr("aggregate(terms, 32L, (a, t) -> a + 16 + octet_length(t))")
    there = _few(given_away, BROADCAST_BYTES, length)
    texts = rows.filter(MARKED)
    texts = texts if there is not given_away else split(texts, "h", given_away.select("h"))[0]
    texts = texts.join(there, "h").select("h", "text", "terms")
    words = texts.select("h", "terms", F.regexp_extract_all("text", F.lit(TERM), F.lit(0)).alias("w"), F.split("text", TERM, -1).alias("g"))
    words = words.select("h", "terms", _once(F.expr(_placed("w", "g", len(KINDS))), "placed"))
    # the terms by a hash, so that a word is looked up among a few
    n = "cast(ceil(sqrt(size(terms))) as int)"
    table = f"transform(sequence(0, {n} - 1), k -> filter(terms, t -> pmod(xxhash64(t), {n}) = k))"
    found = f"transform(array({table}), held -> filter(placed, x -> array_contains(held[cast(pmod(xxhash64(lower(x.value)), {n}) as int)], lower(x.value))))[0]"
    return cut(words.select("h", F.expr(found).alias("terms")).dropDuplicates(["h"]))


def _span_bytes(terms: str = "terms") -> Column:
    return F.expr(f"aggregate({terms}, 32L, (a, t) -> a + 48 + octet_length(t.value))")


def _public(spans: str) -> Column:
    return F.transform(spans, lambda x: F.struct(*[x[c].alias(c) for c in ("start", "kind", "stop", "value")]))


def find_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", smoothing: float = 1.0, alpha: float = 1.1) -> DataFrame:
    """doc_id, h (the text's hash), base and terms of each row: arrays of start, kind (place in KINDS, or their number for a term), stop and value, in code points."""
    rows = _rows(docs, doc_id, text)
    base = cut(_base(rows, ["doc_id", "h"]))
    joined = base.join(_few(_term_spans(rows, smoothing, alpha), BROADCAST_BYTES, _span_bytes()), "h", "left")
    return joined.select("doc_id", "h", "base", F.expr(_apart("terms", "base")).alias("terms")).select("doc_id", "h", _public("base").alias("base"), _public("terms").alias("terms"))


def describe(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = ", ".join(f"'{k}'" for k in (*KINDS, "term"))
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', element_at(array({names}), x.kind + 1), cast(x.start as string), cast(x.stop as string))), ',')")


def sanitise(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", smoothing: float = 1.0, alpha: float = 1.1) -> DataFrame:
    """``docs`` with all columns; in the text each span is replaced by its kind in brackets, overlapping ones by the first."""
    rows = _rows(docs, doc_id, text)
    written = _term_spans(rows, smoothing, alpha)
    terms = _few(written, BROADCAST_BYTES, _span_bytes())
    # the row is one column here, so that its names clash with none
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    held = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"), t.alias("text"), F.xxhash64(t).alias("h"))
    # a text without terms needs no join
    some, rest = (held, held.limit(0)) if terms is not written else split(held, "h", written.select("h"))
    held = _base(some, ["row", "text", "h"]).join(terms, "h", "left")
    if terms is written:
        held = held.unionByName(_base(rest, ["row", "text", "h"]).withColumn("terms", F.expr(NO_SPANS)))
    held = held.select("row", "text", F.col("base"), F.expr(_apart("terms", "base")).alias("terms")).select("row", "text", F.array_sort(F.concat("base", "terms")).alias("spans"))
    names = ", ".join(f"'[{k}]'" for k in KINDS)
    label = f"case when x.kind < {len(KINDS)} then element_at(array({names}), x.kind + 1) when x.value rlike '^\\\\p{{N}}+$' then '[number]' else '[term]' end"
    # what the spans before a block cover, in code points and bytes
    far = "named_struct('at', greatest(a.at, spans[i].stop), 'byte', greatest(a.byte, spans[i].byte + octet_length(spans[i].value)))"
    ends = _blocks("spans", f"array(aggregate(sequence(lo, hi - 1), named_struct('at', 0, 'byte', 0), (a, i) -> {far}))")
    starts = f"aggregate({ends}, named_struct('at', 0, 'byte', 0, 'out', cast(array() as array<struct<at:int,byte:int>>)), (a, x) -> named_struct('at', greatest(a.at, x.at), 'byte', greatest(a.byte, x.byte), 'out', concat(a.out, array(named_struct('at', a.at, 'byte', a.byte)))), a -> concat(a.out, array(named_struct('at', a.at, 'byte', a.byte))))"
    piece = f"array(cast(substring(raw, a.byte + 1, x.byte - a.byte) as string), {label})"
    body = f"""aggregate(slice(spans, lo + 1, hi - lo), named_struct('at', begin[k].at, 'byte', begin[k].byte, 'out', cast(array() as array<string>)), (a, x) -> named_struct(
        'at', greatest(a.at, x.stop), 'byte', greatest(a.byte, x.byte + octet_length(x.value)), 'out', case when x.start >= a.at then concat(a.out, {piece}) else a.out end), a -> a.out)"""
    rest = "cast(substring(raw, element_at(begin, -1).byte + 1) as string)"
    new = f"transform(array(cast(text as binary)), raw -> transform(array({starts}), begin -> concat(array_join({_blocks('spans', body)}, ''), {rest}))[0])[0]"
    changed = F.expr(f"case when size(spans) > 0 then {new} end")
    at = docs.columns.index(text)
    out = held.select("row", F.coalesce(changed, F.col(f"row.c{at}").cast("string")).cast(docs.schema[text].dataType).alias("new"))
    return out.select(*[F.col("new").alias(c) if i == at else F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
