"""Merges of sorted runs: k-way and two-way by priority, and concatenation of disjoint runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_runs(runs: list[DataFrame], keys: list[str]) -> DataFrame:
    """The union of runs; of rows with equal keys the one of the earliest run stays. Tombstones stay.

    The minimum of (priority, other columns) per key combines before the shuffle, so a key that every run holds is
    no larger a group than one that a single run holds.
    """
    others = [c for c in runs[0].columns if c not in keys]
    every = reduce(DataFrame.unionByName, (r.withColumn("__prio", F.lit(i)) for i, r in enumerate(runs)))
    best = every.groupBy(*keys).agg(F.min(F.struct("__prio", *others)).alias("__best"))
    return best.select(*keys, *(F.col("__best")[c].alias(c) for c in others))


def merge_two(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of ``first`` and those of ``second`` whose key it lacks."""
    return first.unionByName(second.join(first.select(*keys), keys, "left_anti"))


def concat(runs: list[DataFrame]) -> DataFrame:
    """The union of runs that share no keys."""
    return reduce(DataFrame.unionByName, runs)


def disjointness(stats: DataFrame) -> DataFrame:
    """Adds ``disjoint`` to run statistics: a run begins after the one before it (by first key) ends.

    The window runs over one row per run.
    """
    before = F.lag("last_key").over(Window.orderBy("first_key", "last_key"))
    return stats.withColumn("disjoint", F.coalesce(before < F.col("first_key"), F.lit(True)))


def run_stats(rows: DataFrame, run: str = "run_id", key: str = "k") -> DataFrame:
    """First and last key, newest ts and number of rows of each run."""
    return rows.groupBy(run).agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.max("ts").alias("max_ts"), F.count("*").alias("n_rows"))


def seek(rows: DataFrame, targets: DataFrame, run: str = "run_id", key: str = "k") -> DataFrame:
    """For each (run, target) the first key of the run that is not below the target, null past its end.

    Both are put in one order within the run; runs have a bounded size.
    """
    both = rows.select(run, F.col(key).alias("at"), F.lit(None).cast("long").alias("target"), F.col(key).alias("hit")).unionByName(
        targets.select(run, F.col("target").alias("at"), F.col("target").cast("long").alias("target"), F.lit(None).cast("long").alias("hit"))
    )
    # Keys equal to a target come after it.
    w = Window.partitionBy(run).orderBy("at", F.col("hit").isNotNull()).rowsBetween(0, Window.unboundedFollowing)
    return both.withColumn("found", F.first("hit", ignorenulls=True).over(w)).filter("target is not null").select(run, "target", "found")
