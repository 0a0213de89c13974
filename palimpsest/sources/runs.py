"""Sorted runs as Parquet: writing, reading and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_run(rows: DataFrame, path: str, files: int = 1, mode: str = "errorifexists") -> None:
    """Writes (k, ts, v) sorted by key and descending ts, key-disjoint over ``files`` files, with a Bloom filter on k."""
    rows.repartitionByRange(files, "k").sortWithinPartitions("k", F.desc("ts")).write.mode(mode).option("parquet.bloom.filter.enabled#k", "true").parquet(path)


def read_runs(spark: SparkSession, paths: list[str], schema=None) -> DataFrame:
    """The union of runs; row groups outside a key predicate are skipped by their statistics."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(*paths)


def replay_log(records: DataFrame) -> DataFrame:
    """(k, ts, v) of a write-ahead log (k, ts, v, seq): of equal (k, ts) the last record counts."""
    return records.groupBy("k", "ts").agg(F.max(F.struct("seq", "v")).alias("x")).select("k", "ts", "x.v")
