"""Bloom filters of runs, as sets of bit positions, and their probe."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.scalars import bloom_positions


def bits_for(keys: int, share: float = 0.01) -> int:
    """Bits of a filter of ``keys`` keys of which a probe lets through that share of absent ones, a multiple of 64."""
    return max(64, -(-int(keys * -math.log(share) / math.log(2) ** 2) // 64) * 64)


def build(keys: DataFrame, run: str = "run_id", key: str = "k", bits: int = 1 << 13, probes: int = 3) -> DataFrame:
    """(run, word, bits): the filter of each run as 64-bit words, folded by OR; a run has bits / 64 rows at most."""
    at = keys.select(run, F.explode(F.array(*bloom_positions(F.col(key), bits, probes))).alias("p"))
    bit = F.expr("shiftleft(1L, cast(p % 64 as int))")
    return at.groupBy(run, F.floor(F.col("p") / 64).alias("word")).agg(F.bit_or(bit).alias("bits"))


def maybe_present(filters: DataFrame, keys: DataFrame, run: str = "run_id", key: str = "k", bits: int = 1 << 13, probes: int = 3) -> DataFrame:
    """The (run, key) pairs that a run's filter does not rule out."""
    at = keys.select(run, key, F.explode(F.array(*bloom_positions(F.col(key), bits, probes))).alias("p"))
    at = at.withColumn("word", F.floor(F.col("p") / 64))
    hit = at.join(filters, [run, "word"], "left")
    set_ = F.coalesce(F.expr("(shiftright(bits, cast(p % 64 as int)) & 1) = 1"), F.lit(False))
    return hit.groupBy(run, key).agg(F.bool_and(set_).alias("maybe")).filter("maybe").select(run, key)
