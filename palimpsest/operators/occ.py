"""Optimistic concurrency: conflicts of read sets with later commits, reader watermarks, reads inside a transaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.asof import last_before
from palimpsest.operators.merge import merge_two
from palimpsest.operators.versions import live


def conflicts(reads: DataFrame, commits: DataFrame) -> DataFrame:
    """Reads (k, read_ts, end_ts, ..) that a commit (k, commit_ts) after read_ts and before end_ts invalidates.

    Exact keys, so no false alarms from hashes. The first commit after a read decides: an as-of lookup over both in
    falling order of time, in which a key with many reads and commits is no product of the two.
    """
    asked = reads.select("k", (F.col("read_ts") * -2).alias("__order"), F.struct(*reads.columns).alias("__read"), F.lit(None).cast("long").alias("__at"))
    made = commits.select("k", (F.col("commit_ts") * -2 + 1).alias("__order"), F.lit(None).cast(asked.schema["__read"].dataType).alias("__read"), F.col("commit_ts").cast("long").alias("__at"))
    found = last_before(asked.unionByName(made), "k", "__order", F.col("__at"), "__first")
    return found.filter("__read is not null and __first < __read.end_ts").select("__read.*")


def aborted(txns: DataFrame, reads: DataFrame, writes: DataFrame, commits: DataFrame) -> DataFrame:
    """Transactions (txn) that must abort: they write something and something they read was committed since.

    Overlapping writes alone never abort a transaction, nor does reading alone.
    """
    writers = txns.join(writes.select("txn"), "txn", "left_semi")
    return writers.join(conflicts(reads, commits).select("txn"), "txn", "left_semi")


def read_in_txn(local: DataFrame, committed: DataFrame) -> DataFrame:
    """(k, v) a transaction sees: its own writes over the snapshot; its own tombstones hide rows."""
    return live(merge_two(local.select("k", "v"), committed.select("k", "v"), ["k"]))


def watermark(readers: DataFrame, latest: int | None = None) -> DataFrame:
    """(watermark): the oldest active read_ts of events (ts, delta = +1 begin or -1 end), else ``latest``."""
    active = readers.groupBy("ts").agg(F.sum("delta").alias("n")).filter("n > 0")
    return active.agg(F.coalesce(F.min("ts"), F.lit(latest).cast("long")).alias("watermark"))


def forget_commits(commits: DataFrame, watermark_ts: int) -> DataFrame:
    """Commits that a running transaction may still conflict with."""
    return commits.filter(F.col("commit_ts") >= watermark_ts)


def next_commit(log: DataFrame) -> DataFrame:
    """Adds ``next_ts``: the commit after this one on the same key, null for the newest."""
    return log.withColumn("next_ts", F.lead("ts").over(Window.partitionBy("k").orderBy("ts")))
