"""As-of lookups: the last value before each row of a key's sequence, whatever share of the rows the key has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_before(rows: DataFrame, key: str, order: str, value: Column, out: str, span: int = 1 << 16, first: DataFrame | None = None) -> DataFrame:
    """Adds ``out``: the last non-null ``value`` among the key's rows with a smaller ``order``; if there is none, what
    ``first`` (key, value), with one row a key, has for the key, else null.

    Rows are ordered within spans of the order column. A span's last value is carried on over one row per key and span
    and takes part in the next spans as a row before all others, so the rows are dealt out once, by key and span, and joined
    to nothing: a key with most of the rows, or none at all (null), is as many tasks' work as it has spans.
    """
    d = rows.withColumn("__value", value).withColumn("__span", F.floor(F.col(order) / span))
    ends = d.groupBy(key, "__span").agg(F.max(F.when(F.col("__value").isNotNull() & F.col(order).isNotNull(), F.struct(order, "__value"))).alias("__end"))
    carried = F.last("__end", ignorenulls=True).over(Window.partitionBy(key).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1))["__value"]
    starts = ends.select(key, "__span", carried.alias("__value"))
    if first is not None:
        at, known = first.columns
        starts = starts.join(first.select(F.col(at).alias("__key"), F.col(known).alias("__first")), F.col(key) == F.col("__key"), "left")
        starts = starts.select(key, "__span", F.coalesce("__value", "__first").alias("__value"))
    starts = starts.filter("__value is not null").withColumn("__row", F.lit(False))
    d = d.withColumn("__row", F.lit(True)).unionByName(starts, allowMissingColumns=True)
    before = Window.partitionBy(key, "__span").orderBy("__row", order).rowsBetween(Window.unboundedPreceding, -1)
    return d.withColumn(out, F.last("__value", ignorenulls=True).over(before)).filter("__row").drop("__value", "__span", "__row")
