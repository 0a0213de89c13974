"""Streams of changes: every micro-batch becomes runs of the log, and the newest version wins when it is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.resolve import snapshot
from palimpsest.sources import commands
from palimpsest.sources.store import Store


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of (k, ts, v)."""
    path = f"{sf_dir}/events.parquet"
    e = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*" if not path.endswith("/") else path)
    return e.select(F.col("user_id").alias("k"), (F.col("event_id") + 1).alias("ts"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("v"))


def append_to_log(changes: DataFrame, path: str, checkpoint: str) -> None:
    """Writes all changes that have arrived to Parquet under ``path`` and ends.

    Appending needs no state and no shuffle. The file sink commits a micro-batch as a whole and exactly once, so a
    restart replays nothing; arrival order does not matter, as readers compare ts.
    """
    changes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upsert_latest(changes: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """(k, ts, v): the live state after all changes that have arrived."""
    append_to_log(changes, path, checkpoint)
    return snapshot(changes.sparkSession.read.parquet(path))


def latest_by_state(changes: DataFrame) -> DataFrame:
    """(k, ts, v) as a streaming aggregate: state holds one version per key, replays and late rows change nothing.

    For update or complete output mode.
    """
    return changes.groupBy("k").agg(F.max(F.struct("ts", "v")).alias("x")).select("k", "x.ts", "x.v")


def serve_stream(lines: DataFrame, store: Store, answers: str, checkpoint: str) -> None:
    """Answers a stream of JSON requests (seq, line) from ``store``, applies its writes and ends when all are answered.

    Each micro-batch is answered in the order of seq and its writes are one commit with the batch's number. Answers are
    written to a folder of their own first, so a batch that runs again writes the same answers and commits once. The parsed
    requests are kept while the batch is worked on (in memory and on disk), so a line is read and parsed once.
    """

    def step(batch: DataFrame, number: int) -> None:
        if number <= store.state["batch"]:
            return
        asked = batch.select("seq", commands.parse_json(F.col("line")).alias("c")).select("seq", "c.*").persist()
        try:
            asked.count()  # else the stages that read it first, which run side by side, would each parse all lines
            state = store.scan().select(F.col("k").cast("string").alias("k"), F.col("v").cast("string").alias("v"))
            commands.answer_json(commands.serve(asked, state)).write.mode("overwrite").parquet(f"{answers}/batch={number}")
            ops = commands.mutations(asked)
            store.write_frame(ops.select("seq", "op", F.encode("k", "UTF-8").alias("k"), F.encode("v", "UTF-8").alias("v")), batch=number)
        finally:
            asked.unpersist()

    lines.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
