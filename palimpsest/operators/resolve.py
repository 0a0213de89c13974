"""Version resolution: the newest version of each key that a reader may see."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.versions import live


def visible(log: DataFrame, read_ts: int | None = None) -> DataFrame:
    """Versions at or before ``read_ts`` (all, if it is None)."""
    return log if read_ts is None else log.filter(F.col("ts") <= read_ts)


def newest(log: DataFrame, read_ts: int | None = None) -> DataFrame:
    """(k, ts, v): the newest visible version per key, tombstones included.

    max(struct) keeps a null v with its ts, so deletes win where they should, and combines before the shuffle.
    """
    top = visible(log, read_ts).groupBy("k").agg(F.max(F.struct("ts", "v")).alias("top"))
    return top.select("k", "top.ts", "top.v")


def newest_by_window(log: DataFrame, read_ts: int | None = None) -> DataFrame:
    """The same rows by row_number() = 1, for values that max() can't order (maps)."""
    w = Window.partitionBy("k").orderBy(F.desc("ts"))
    return visible(log, read_ts).withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def snapshot(log: DataFrame, read_ts: int | None = None) -> DataFrame:
    """(k, ts, v): the live state at ``read_ts``."""
    return live(newest(log, read_ts))


def get(log: DataFrame, key, read_ts: int | None = None) -> DataFrame:
    """The live version of one key: the key predicate reaches the scan before anything is resolved."""
    return snapshot(log.filter(F.col("k") == F.lit(key)), read_ts)


def get_version(log: DataFrame, versions: DataFrame) -> DataFrame:
    """(k, ts, v): exactly the versions asked for (k, ts), tombstones included."""
    return log.join(versions.select("k", "ts"), ["k", "ts"], "left_semi")
