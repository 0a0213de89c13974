"""Writes: puts, deletes and atomic batches append rows that share one new timestamp."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.versions import latest_ts


def last_per_key(ops: DataFrame) -> DataFrame:
    """The last operation of each key of a batch (seq, op, k, v), as (k, v) with a null v for a delete."""
    value = F.when(F.col("op") == "put", F.col("v"))
    return ops.groupBy("k").agg(F.max(F.struct("seq", value.alias("v"))).alias("x")).select("k", "x.v")


def _is_empty(c) -> object:
    return F.length(c.cast("string").cast("binary")) == 0


def checked(ops: DataFrame) -> DataFrame:
    """``ops``, failing at run time on a null or empty key, on a put of a null or empty value and on another op."""
    k, v, op = F.col("k"), F.col("v"), F.col("op")
    bad = k.isNull() | _is_empty(k) | ((op == "put") & (v.isNull() | _is_empty(v))) | op.isNull() | ~op.isin("put", "del")
    said = F.raise_error(F.lit("a write needs a key, and a put needs a value"))
    return ops.withColumn("op", F.when(F.coalesce(bad, F.lit(True)), said.cast("string")).otherwise(op))


def write_batch(log: DataFrame, ops: DataFrame, ts: int | None = None) -> DataFrame:
    """The log with the batch appended at one timestamp, the next one if none is given."""
    at = latest_ts(log) + 1 if ts is None else ts
    return log.unionByName(last_per_key(checked(ops)).select("k", F.lit(at).cast("long").alias("ts"), "v"))


def put(log: DataFrame, rows: DataFrame, ts: int | None = None) -> DataFrame:
    return write_batch(log, rows.select(F.lit(0).alias("seq"), F.lit("put").alias("op"), "k", "v"), ts)


def delete(log: DataFrame, keys: DataFrame, ts: int | None = None) -> DataFrame:
    """Deleting a key that does not exist is no error."""
    return write_batch(log, keys.select(F.lit(0).alias("seq"), F.lit("del").alias("op"), "k", F.lit(None).cast(log.schema["v"].dataType).alias("v")), ts)


def assign_runs(rows: DataFrame, run_bytes: int, order: str = "ts", size=None, span: int = 1 << 16) -> DataFrame:
    """Adds ``run_id``: rows in write order are cut into runs of about ``run_bytes`` (the bytes before a row decide).

    The running total is taken in two levels: within spans of the order column, and over one row per span, so no task
    orders the whole log.
    """
    from pyspark.sql import Window

    bytes_ = size if size is not None else F.octet_length(F.col("k").cast("string")) + F.coalesce(F.octet_length(F.col("v").cast("string")), F.lit(0)) + 8
    d = rows.withColumn("__bytes", bytes_.cast("long")).withColumn("__span", F.floor(F.col(order) / span))
    sums = d.groupBy("__span").agg(F.sum("__bytes").alias("__all"))
    ahead = sums.withColumn("__ahead", F.coalesce(F.sum("__all").over(Window.orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__all")
    inside = F.coalesce(F.sum("__bytes").over(Window.partitionBy("__span").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.withColumn("__inside", inside).join(ahead, "__span")
    return d.withColumn("run_id", F.floor((F.col("__ahead") + F.col("__inside")) / run_bytes)).drop("__bytes", "__span", "__inside", "__ahead")
