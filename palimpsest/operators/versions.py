"""The version log: rows (k, ts, v), where a null v is a tombstone and (k, ts) is unique."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION_SCHEMA = T.StructType(
    [T.StructField("k", T.BinaryType(), False), T.StructField("ts", T.LongType(), False), T.StructField("v", T.BinaryType())]
)


def events_log(spark: SparkSession, sf_dir: str, read_ts: int | None = None) -> DataFrame:
    """The events table as a log: user, sequence number, event type; an error event deletes the key.

    ``read_ts`` is applied to the stored column, so that it reaches the Parquet scan.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    if read_ts is not None:
        e = e.filter(F.col("event_id") <= read_ts - 1)
    return e.select(F.col("user_id").alias("k"), (F.col("event_id") + 1).alias("ts"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("v"))


def latest_ts(log: DataFrame) -> int:
    """The newest commit, 0 for an empty log."""
    return log.agg(F.coalesce(F.max("ts"), F.lit(0))).first()[0]


def live(df: DataFrame, value: str = "v") -> DataFrame:
    """Rows that are not tombstones."""
    return df.filter(F.col(value).isNotNull())
