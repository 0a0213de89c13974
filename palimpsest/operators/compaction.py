"""Compaction: garbage collection of versions below a watermark, the level picker, and its effect on the levels."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import scratch


def collect_garbage(log: DataFrame, watermark: int, bottom: bool = True) -> DataFrame:
    """Versions that some reader at or above ``watermark`` can still see.

    All versions above the watermark stay, and of those at or below it the newest of each key, unless that is a
    tombstone and nothing older lies below (``bottom``). One aggregate finds the old version that stays; no window
    orders a key's history.
    """
    new = log.filter(F.col("ts") > watermark)
    old = log.filter(F.col("ts") <= watermark).groupBy("k").agg(F.max(F.struct("ts", "v")).alias("x")).select("k", "x.ts", "x.v")
    return new.unionByName(old.filter("v is not null") if bottom else old)


def collect_garbage_lazily(log: DataFrame, watermark: int) -> DataFrame:
    """A variant that keeps one version more: the newest of a key doesn't count as the one at or below the watermark."""
    by = Window.partitionBy("k").orderBy(F.desc("ts"))
    d = log.withColumn("rn", F.row_number().over(by))
    old = (F.col("ts") <= watermark) & (F.col("rn") > 1)
    d = d.withColumn("rb", F.row_number().over(Window.partitionBy("k", old).orderBy(F.desc("ts"))))
    # A key whose newest version is a tombstone at or below the watermark goes.
    d = d.withColumn("dead", F.max(((F.col("rn") == 1) & F.col("v").isNull() & (F.col("ts") <= watermark)).cast("int")).over(Window.partitionBy("k")))
    keep = (F.col("ts") > watermark) | (F.col("rn") == 1) | (F.col("rb") == 1)
    return d.filter((F.col("dead") == 0) & keep).select("k", "ts", "v")


def sorted_runs(log: DataFrame, runs: int) -> DataFrame:
    """The log in key-disjoint, sorted partitions; a key is never split over two."""
    return log.repartitionByRange(runs, "k").sortWithinPartitions("k", F.desc("ts"))


def split_runs(rows: DataFrame, run_bytes: int, size: Column, files: int = 32) -> DataFrame:
    """Adds ``run_id``: rows in key order are cut into runs of about ``run_bytes``, only where the key changes.

    Bytes are summed by key first. Running totals are taken inside key ranges, which are written down so that they stay
    what they are, and over one row per range.
    """
    at = scratch(rows.sparkSession, "ranges")
    by_key = rows.groupBy("k").agg(F.sum(size).alias("__bytes"))
    by_key.repartitionByRange(files, "k").withColumn("__range", F.spark_partition_id()).write.parquet(at)
    by_key = rows.sparkSession.read.parquet(at)
    before = lambda what, w: F.coalesce(F.sum(what).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = by_key.groupBy("__range").agg(F.sum("__bytes").alias("__all"))
    ranges = ranges.select("__range", before("__all", Window.orderBy("__range")).alias("__ahead"))
    inside = by_key.withColumn("__inside", before("__bytes", Window.partitionBy("__range").orderBy("k"))).join(F.broadcast(ranges), "__range")
    return rows.join(inside.select("k", F.floor((F.col("__ahead") + F.col("__inside")) / run_bytes).alias("run_id")), "k")


@dataclass(frozen=True)
class Options:
    """What a store can be tuned by."""

    run_bytes: int = 2 << 20
    strategy: str = "simple"  # or none
    size_ratio_percent: int = 10
    level0_trigger: int = 10
    max_levels: int = 7
    serializable: bool = False
    pending: bool = False  # single writes collect in memory until run_bytes of them freeze
    run_limit: int = 100  # frozen groups that may wait

    @classmethod
    def from_config(cls, config: str | dict) -> Options:
        """Options from a JSON configuration: its "lsm" part, with defaults for what it lacks."""
        lsm = (json.loads(config) if isinstance(config, str) else config).get("lsm", {})
        named = {"target_sst_size": "run_bytes", "num_memtable_limit": "run_limit", "serializable": "serializable"}
        found = {to: lsm[key] for key, to in named.items() if key in lsm}
        how = lsm.get("compaction_options")
        if how == "NoCompaction":
            found["strategy"] = "none"
        elif isinstance(how, dict) and set(how) == {"Simple"}:
            simple = how["Simple"]
            found |= {to: simple[key] for key, to in (("size_ratio_percent", "size_ratio_percent"), ("level0_file_num_compaction_trigger", "level0_trigger"), ("max_levels", "max_levels")) if key in simple}
        elif how is not None:
            raise ValueError("compaction_options must be Simple or NoCompaction")
        # Without a log, writes are durable once they are flushed.
        return cls(pending=not lsm.get("enable_wal", True), **found)

    def levels(self) -> int:
        return self.max_levels if self.strategy == "simple" else 1


def pick(levels: DataFrame, options: Options = Options()) -> DataFrame:
    """(upper, lower, bottom): the compaction that the simple-leveled strategy runs next, at most one row.

    ``levels`` has a row (level, files) for each level from 0. Level 0 takes part from ``level0_trigger`` files on. The
    first level fires whose next level holds less than ``size_ratio_percent`` of its files; nothing divided by nothing,
    and something by nothing, never fires.
    """
    ratio = F.try_divide(F.lead("files").over(Window.orderBy("level")).cast("double"), F.col("files").cast("double"))
    d = levels.withColumn("ratio", ratio).filter((F.col("level") < options.max_levels) & ((F.col("level") > 0) | (F.col("files") >= options.level0_trigger)))
    fires = d.filter(F.col("ratio") < options.size_ratio_percent / 100)
    first = fires.agg(F.min("level").cast("int").alias("upper")).filter("upper is not null")
    return first.select("upper", (F.col("upper") + 1).alias("lower"), (F.col("upper") + 1 == options.max_levels).alias("bottom"))


def apply_compaction(runs: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Runs (run_id, level) after a compaction: inputs go, outputs come."""
    return runs.join(inputs.select("run_id"), "run_id", "left_anti").unionByName(outputs)


def space_amplification(levels: DataFrame) -> DataFrame:
    """(percent): files of all levels but the last, per hundred files of the last."""
    last = F.max(F.struct("level", "files"))["files"]
    return levels.agg((F.try_divide((F.sum("files") - last).cast("double"), last.cast("double")) * 100).alias("percent"))


def replay(records: DataFrame) -> DataFrame:
    """(run_id): runs that a manifest leaves alive: made by a flush or a compaction and not consumed since."""
    made = records.filter("kind in ('flush', 'output')").select("run_id").distinct()
    return made.join(records.filter("kind = 'input'").select("run_id").distinct(), "run_id", "left_anti")
