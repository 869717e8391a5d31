"""File sources and sinks; every schema is declared, nothing is inferred."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finpanel.operators.reshape import to_long

BARS = T.StructType([T.StructField("date", T.DateType()), *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume", "turnover", "unadjusted_close", "dividend")]])
ORDER = ["assetid", "symbol", "date", "is_delisted", "delist_ym", "open", "high", "low", "close", "volume", "turnover", "unadjusted_close", "dividend"]


def parse_file_name(name: Column) -> dict[str, Column]:
    """S-2: id, symbol, delisted flag and month from ``<id>_<symbol>[-YYYYMM].csv`` file names, with or without folders."""
    stem = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.csv$", "")
    month = F.nullif(F.regexp_extract(stem, r"-(\d{6})(?:\.[a-z]+)?$", 1), F.lit(""))
    symbol = F.regexp_replace(F.regexp_replace(stem, r"^\d+_", ""), r"(?:-\d{6})?(?:\.[a-z]+)?$", "")
    return {"assetid": F.nullif(F.regexp_extract(stem, r"^(\d+)_", 1), F.lit("")).cast("long"), "symbol": symbol, "is_delisted": month.isNotNull(), "delist_ym": (F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 5, 2).cast("int"))}


def rename_columns(df: DataFrame, names: dict[str, str], order: list[str] | None = None) -> DataFrame:
    """S-3: renamed, lower-cased columns in a fixed order; columns of the order that are missing stay out."""
    out = df.withColumnsRenamed(names)
    out = out.withColumnsRenamed({c: c.lower() for c in out.columns})
    return out.select(*[c for c in order if c in out.columns]) if order else out


def csv_panel(spark: SparkSession, listed: str, delisted: str) -> DataFrame:
    """S-1: the bar files of two folders as one panel, id and symbol from each file's name."""
    def folder(path: str) -> DataFrame:
        raw = spark.read.schema(BARS).option("header", True).csv(path)
        return raw.select("*", F.col("_metadata.file_name").alias("__f")).select(*[c.alias(n) for n, c in parse_file_name(F.col("__f")).items()], *BARS.names)

    both = folder(listed).withColumn("is_delisted", F.lit(False)).unionByName(folder(delisted).withColumn("is_delisted", F.lit(True)))
    return both.select(*ORDER)


def fx_series(spark: SparkSession, path: str, pair: str) -> DataFrame:
    """S-12: one currency pair's daily bars with the pair and its quote currency."""
    schema = T.StructType([T.StructField("date", T.DateType()), *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close")]])
    return spark.read.schema(schema).option("header", True).csv(path).withColumn("pair", F.lit(pair)).withColumn("currency", F.lit(pair[-3:])).orderBy("date")


def membership_intervals(spark: SparkSession, paths: dict[str, str], index_name: str) -> DataFrame:
    """S-6: the interval file of one index; an unknown name raises."""
    if index_name not in paths:
        raise ValueError(f"unknown index {index_name!r}; known: {', '.join(sorted(paths))}")
    schema = "symbol string, assetid long, start_date date, end_date date, trading_days int"
    return spark.read.schema(schema).option("header", True).csv(paths[index_name]).withColumn("index_name", F.lit(index_name))


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S-7: saved API payloads, a list of objects or one object for each file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def observations(payload: DataFrame, column: str = "observations") -> DataFrame:
    """S-7: date and value of a nested list of observations, "." and blanks as null."""
    x = payload.select(F.explode(column).alias("o")).select("o.*")
    return x.select(F.col("date").cast("date").alias("date"), F.expr("try_cast(nullif(nullif(trim(value), '.'), '') as double)").alias("value"))


def wide_prices(df: DataFrame, assets: list[str], by: str = "date") -> DataFrame:
    """S-11: a wide price table as asset, date and level, for those of the assets that exist."""
    return to_long(df, [by], assets).withColumnsRenamed({"variable": "asset", "value": "level"})


def write_stage(df: DataFrame, path: str, *, by: list[str] | None = None) -> None:
    """S-5: a Parquet stage, partitioned where asked."""
    w = df.write.mode("overwrite").option("compression", "snappy")
    (w.partitionBy(*by) if by else w).parquet(path)


def read_stage(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """S-5: a stage again; the columns named are all that is scanned."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_bucketed(df: DataFrame, table: str, path: str, *, key: str, by: str, buckets: int = 64) -> DataFrame:
    """S-5: a Parquet stage as a table at a shared path, in ``buckets`` by ``key``, one file each, sorted by ``key`` and ``by``.

    Roll-ups and windows by the key, with whatever else, and joins of such tables on it read the buckets as they lie: no
    exchange. Joins on the key and more columns do so too where spark.sql.requireAllClusterKeysForCoPartition is false. The number of buckets bounds the tasks, so it should follow the data.
    """
    df.repartition(buckets, key).write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key, by).saveAsTable(table)
    return df.sparkSession.table(table)


def write_csv(df: DataFrame, path: str) -> None:
    """S-8: a CSV sink with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def is_safe_path(path: Column) -> Column:
    """A relative path that stays below its root."""
    parts = F.split(path, "/")
    return F.coalesce((F.trim(path) != "") & (path != ".") & ~path.startswith("/") & ~F.exists(parts, lambda p: (p == "..") | (p == "")), F.lit(False))


def manifest_audit(manifest: DataFrame, root: DataFrame) -> DataFrame:
    """S-9: each manifest entry with whether its path is safe and unique and whether the file is there with its size.

    ``manifest`` has table_files (an array of table, relative_path and bytes); ``root`` has relative_path and length, as
    ``spark.read.format("binaryFile")`` lists them without reading any content.
    """
    e = manifest.select(F.explode("table_files").alias("f")).select("f.table", "f.relative_path", "f.bytes")
    n = e.groupBy("relative_path").agg(F.count(F.lit(1)).alias("n"))
    x = e.join(n, "relative_path", "left").join(root.select("relative_path", "length"), "relative_path", "left")
    status = F.when(~is_safe_path(F.col("relative_path")), "unsafe").when(F.col("n") > 1, "duplicate").when(F.col("length").isNull(), "missing").when(F.col("length") != F.col("bytes"), "size").otherwise("ok")
    return x.select("table", "relative_path", "bytes", "length", status.alias("status"))


def listed_files(spark: SparkSession, root: str) -> DataFrame:
    """relative_path and length of all files below a folder, which may be named with its scheme or without; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    plain = re.sub(r"^[a-z0-9+.-]+:/+", "/", root).rstrip("/")
    return files.select(F.expr(f"substring(path, instr(path, '{plain}/') + {len(plain) + 1})").alias("relative_path"), "length")


def product_bytes(audit: DataFrame) -> DataFrame:
    """S-9: files and bytes of each product's table; raises in the query on unsafe or duplicate paths."""
    bad = F.col("status").isin("unsafe", "duplicate")
    ok = audit.withColumn("bytes", F.when(bad, F.raise_error(F.concat(F.lit("bad path: "), F.coalesce("relative_path", F.lit("null")))).cast("long")).otherwise(F.col("bytes")))
    return ok.groupBy("table").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
