"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few longs that a broadcast may hold.
BROADCAST_ROWS = 100_000
#: Places of one bit for each key of a mark.
PLACES = 16
#: Spark's setting by which the shuffle files of an execution go when it ends.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where none is named, a temporary folder in local mode (tests), and an error on a cluster."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        named = tempfile.mkdtemp(prefix="finpanel-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and reads it back from there, so that lost executors lose nothing; what was shuffled for it is released."""
    shared_dir(df.sparkSession)
    conf = df.sparkSession.conf
    was = conf.get(RELEASE, "false")
    conf.set(RELEASE, "true")
    try:
        return df.select("*").checkpoint()  # a new frame takes the setting
    finally:
        conf.set(RELEASE, was)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to a new path in the shared folder, once, and reads it back."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(table: DataFrame) -> DataFrame:
    """A written table of short rows for a join: broadcast if its rows are counted as few, shuffled else."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def split(rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` that may have their ``key``, a hash, in the one column of the written ``keys``, and those that surely don't.

    Long rows that need no join stay where they are. Keys are told by a bit in one of 16 places for each, so that the
    broadcast is two bytes a key, and one in 16 of the other rows may be taken for one of them.
    """
    n = max(1 << 15, PLACES * keys.count())
    place = lambda c: F.pmod(F.coalesce(c, F.lit(0)), F.lit(n)) + 1
    at = keys.select(place(F.col(keys.columns[0])).alias("at")).select(F.bitmap_bucket_number("at").alias("__bucket"), F.bitmap_bit_position("at").alias("bit"))
    marks = F.broadcast(cut(at.repartition("__bucket").groupBy("__bucket").agg(F.bitmap_construct_agg("bit").alias("__bits"))))
    bit = F.bitmap_bit_position(place(F.col(key)))
    byte = F.conv(F.hex(F.substring("__bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = rows.withColumn("__bucket", F.bitmap_bucket_number(place(F.col(key)))).join(marks, "__bucket", "left")
    maybe = F.coalesce(F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(bit, F.lit(8)))), F.lit(2)) == 1, F.lit(False))
    return held.filter(maybe).select(*rows.columns), held.filter(~maybe).select(*rows.columns)
