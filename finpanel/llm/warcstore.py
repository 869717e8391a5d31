"""A content-addressed archive of WARC records.

``write_archive`` keeps the exact header of every record in one table and each distinct payload once, under its
SHA-256 digest, in another. ``read_archive`` joins the two, checks every payload against its digest and rebuilds the
records byte by byte: header, payload and the two line ends behind it. Of the records with equal payloads of at least
``min_bytes`` bytes, the one with the largest id is a response; the others revisit it and have an empty block, and
their full payload comes from the store.

Payloads are shuffled once, when they are read back. Digests that occur several times are written as a small table
first; Spark broadcasts it below its size limit and sorts and splits it otherwise.

Controls and line separators in a url are written as %XX. ``index`` reads the rebuilt records only, but for the payloads
of revisits.

Defined results: a null payload is an empty one; a null url has no target header; a record with a null id revisits the
largest id that is not null, and is a response if there is none; repeated rows with the largest id are all responses,
their payload is stored once; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed values of base32
END = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 form of the SHA-1 of a binary column: 5 hex digits at a time make 4 characters."""
    digest = F.sha1(payload)
    out = []
    for i in range(8):
        bits = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(ALPHABET), F.shiftright(bits, s).bitwiseAND(F.lit(31)) + F.lit(1), F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _escaped(url: Column) -> Column:
    """A url with controls and line separators as %XX, so that none of it can end a header line or begin one."""
    out = url
    for code in (*range(32), *range(127, 160), 0x2028, 0x2029):
        out = F.replace(out, F.lit(chr(code)), F.lit("".join(f"%{b:02X}" for b in chr(code).encode())))
    return F.when(url.rlike(r"[\x00-\x1F\x7F-\x9F\u2028\u2029]"), out).otherwise(url)


def _header(kind: Column, page_id: Column, url: Column, digest: Column, length: Column, refers_to: Column, date: Column) -> Column:
    """The header of a record, to the empty line."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(END))).otherwise(F.lit(""))
    return F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), refers_to.cast("string"), F.lit(">"))),
        line("WARC-Target-URI", _escaped(url)),
        line("WARC-Date", date),
        F.when(kind == "revisit", F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{END}")).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.lit(f"Content-Type: text/html; charset=utf-8{END}"),
        line("Content-Length", F.when(kind == "revisit", F.lit(0).cast("long")).otherwise(length)),
        F.lit(END),
    )


def write_archive(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", payload: str = "html", date: str = "1970-01-01T00:00:00Z", min_bytes: int = 0) -> None:
    """Writes the tables ``headers`` (digest, header) and ``payloads`` (digest, payload) below ``path``, a folder that all machines share; ``date`` is the WARC-Date of all records."""
    spark = pages.sparkSession
    raw = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), raw.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    several = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("first")).filter("n > 1")
    several.select("digest", "first").write.parquet(f"{path}/several")
    several = spark.read.parquet(f"{path}/several").withColumn("shared", F.lit(True))
    rows = rows.join(several, "digest", "left")
    size = F.octet_length("payload").cast("long")
    again = F.coalesce(F.col("first").isNotNull() & (size >= min_bytes) & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first"))), F.lit(False))
    kind = F.when(again, "revisit").otherwise("response")
    header = _header(kind, F.col("page_id"), F.col("url"), base32_sha1(F.col("payload")), size, F.when(again, F.col("first")), F.lit(date))
    rows.select("digest", header.cast("binary").alias("header")).write.parquet(f"{path}/headers")
    held = rows.filter(~again).select("digest", "payload", F.coalesce("shared", F.lit(False)).alias("shared"))
    once = held.filter("shared").dropDuplicates(["digest"])
    held.filter("not shared").unionByName(once).select("digest", "payload").write.parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """header, payload (the full one, of revisits too), digest and record (the bytes of the WARC record); a payload that doesn't fit its digest is an error."""
    headers = spark.read.parquet(f"{path}/headers")
    payloads = spark.read.parquet(f"{path}/payloads")
    joined = headers.join(payloads, "digest", "left")
    sound = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload and digest differ: "), F.col("digest"))).cast("binary"))
    block = F.when(field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return joined.select("header", sound.alias("payload"), "digest").withColumn("record", F.concat("header", block, F.lit((END + END).encode())))


def field(name: str, header: str = "header") -> Column:
    """A field of a header, null if it isn't there; only CR LF ends a line."""
    return F.nullif(F.regexp_extract(F.col(header).cast("string"), rf"(?:^|\n){name}: ([^\r\n]*)\r\n", 1), F.lit(""))


def parse(records: DataFrame) -> DataFrame:
    """head, the header to its empty line, and block, as many bytes behind it as it says, cut out of the bytes of ``record``; payload as it is."""
    blank = F.expr(r"length(substring_index(decode(record, 'ISO-8859-1'), '\r\n\r\n', 1))").alias("blank")
    x = records.select("record", "payload", blank).withColumn("head", F.expr("cast(substring(record, 1, blank + 4) as string)"))
    return x.withColumn("size", field("Content-Length", "head").cast("int")).select("head", F.expr("substring(record, blank + 5, size)").alias("block"), "payload")


def index(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to, read from the bytes of the records of ``read_archive``; a revisit's payload is the one of the store."""
    number = lambda name: F.nullif(F.regexp_extract(field(name, "head"), r"^<urn:page:(-?\d+)>$", 1), F.lit("")).cast("long")
    kind = field("WARC-Type", "head")
    x = parse(records).select("head", kind.alias("record_type"), F.when(kind == "revisit", F.col("payload")).otherwise(F.col("block")).alias("body"))
    return x.select(
        number("WARC-Record-ID").alias("page_id"), F.octet_length("body").cast("long").alias("payload_bytes"), base32_sha1(F.col("body")).alias("payload_digest"), "record_type", number("WARC-Refers-To").alias("refers_to"),
    )
