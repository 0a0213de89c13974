"""Packing into length buckets whose boundaries minimise padding, and token-budget batches inside each bucket."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, n_words

#: Lengths up to EXACT are histogram cells of their own; above, a cell spans 1 / 256 of its lower end. So a table with
#: lengths up to 2**31 has at most 4096 + 19 * 256 cells.
EXACT, FINE = 4096, 256
#: Rows of a bucket that are ordered together.
SHARD = 1 << 16


def cell(length: Column) -> Column:
    """The smallest length of the histogram cell that holds ``length``."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double") / EXACT)) + 12 - 8).cast("long")
    return F.when(length <= EXACT, length).otherwise(length - length % F.greatest(step, F.lit(1)))


def boundaries(tops: np.ndarray, counts: np.ndarray, sums: np.ndarray, buckets: int) -> list[int]:
    """Bucket boundaries (rising, the last is the largest length) at the least total padding.

    tops: the largest length of each cell, rising; counts and sums: rows and total length of each. A bucket pads its
    rows to its boundary. Dynamic program over (bucket, last cell): best[j] = min over i of best[i] + padding of the
    cells i+1..j in one bucket.
    """
    n = len(tops)
    if not n:
        return []
    c, s = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(sums)])
    best = np.full(n + 1, np.inf)
    best[0] = 0
    cut_at = []
    for _ in range(min(buckets, n)):
        new, at = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
        new[0] = 0
        for j in range(1, n + 1):
            cost = best[:j] + tops[j - 1] * (c[j] - c[:j]) - (s[j] - s[:j])
            at[j] = int(np.argmin(cost))
            new[j] = cost[at[j]]
        best = new
        cut_at.append(at)
    out, j = [], n
    for at in reversed(cut_at):
        if j == 0:
            break
        out.append(int(tops[j - 1]))
        j = int(at[j])
    return out[::-1]


def histogram(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    got = rows.groupBy(cell(F.col("length")).alias("cell")).agg(F.max("length").alias("top"), F.count("*").alias("n"), F.sum("length").alias("s")).collect()
    got.sort(key=lambda r: r.top)
    return tuple(np.array([r[k] for r in got], dtype=np.int64) for k in ("top", "n", "s"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 16, budget: int = 32768, length: Column | None = None) -> DataFrame:
    """(id, length, bucket, bucket_length, batch, place, padding) for every row.

    A row of ``length`` words goes to the first bucket that holds it and is padded to that bucket's length. A batch
    holds budget // bucket_length rows of one bucket (one, if a row is longer than the budget), numbered from 0 in each
    bucket; only a bucket's last batch may hold fewer. Rows are dealt to shards by a hash and ordered in each, and the
    shards' counts give every row its place, so no window runs over a bucket. A null text has length 0 and is packed
    with the empty ones. Repeated rows are packed one by one; rows equal in id and length may swap places.
    """
    size = n_words(F.col(text_col)) if length is None else F.coalesce(length, F.lit(0)).cast("long")
    rows = cut(docs.select(F.col(id_col).alias("id"), size.alias("length"), F.xxhash64(F.col(id_col)).alias("h"), F.monotonically_increasing_id().alias("rid")))
    tops, counts, sums = histogram(rows)
    bounds = boundaries(tops, counts, sums, buckets)
    if not bounds:
        bounds = [0]
    shards = max(1, int(counts.sum() // SHARD)) if len(counts) else 1
    index = F.size(F.filter(F.array(*(F.lit(b).cast("long") for b in bounds)), lambda b: b < F.col("length")))
    d = rows.withColumn("bucket", index).withColumn("bucket_length", F.element_at(F.array(*(F.lit(b).cast("long") for b in bounds)), F.col("bucket") + 1))
    # The row number, fixed by the checkpoint, spreads rows of one id (or of none) over the shards.
    d = d.withColumn("shard", F.pmod(F.xxhash64("h", "rid"), F.lit(shards)).cast("int"))
    d = d.withColumn("at", F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("h", "id", "rid")) - 1)
    held = d.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    ahead = held.withColumn("ahead", F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    d = d.join(ahead, ["bucket", "shard"])
    per = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_length"), F.lit(1)))).cast("long")
    rank = F.col("ahead") + F.col("at")
    return d.select("id", "length", "bucket", "bucket_length", F.floor(rank / per).cast("long").alias("batch"), (rank % per).cast("long").alias("place"), (F.col("bucket_length") - F.col("length")).alias("padding"))
