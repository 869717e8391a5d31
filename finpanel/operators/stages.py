"""Where lineage is cut: the folder that driver and executors share; and ordered scans over its partitions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where none is named, as in tests, a temporary one in local mode, and an error on a cluster."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        named = tempfile.mkdtemp(prefix="finpanel-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to that folder and reads it from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in that folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to that folder as Parquet and reads it from there: for rows that several passes read some columns of."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def ordered_parts(rows: DataFrame, *by: Column, parts: int | None = None) -> DataFrame:
    """``rows`` in range partitions by ``by``, kept, with the number of their partition as __part, which grows with ``by``.

    The partitions are written, as a second run of a range exchange may cut them elsewhere. Rows that compare as equal stand
    in one partition, so ``by`` should end with something that tells ties apart.
    """
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartitionByRange(n, *by).withColumn("__part", F.spark_partition_id()))


def over_parts(*aggregates: Column, parts: DataFrame, carry: dict[str, Column]) -> DataFrame:
    """__part with each of ``carry``, window expressions over one row of ``aggregates`` for each partition; as many rows as partitions."""
    return parts.groupBy("__part").agg(*aggregates).select("__part", *[c.alias(n) for n, c in carry.items()])


def before_part():
    """The window of the partitions before one, over a row for each."""
    return Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)


def behind_part():
    """The window of the partitions behind one."""
    return Window.orderBy("__part").rowsBetween(1, Window.unboundedFollowing)
