"""Key bounds: included, excluded or open ends, as predicates on rows and on runs."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.resolve import snapshot


@dataclass(frozen=True)
class Bound:
    kind: str
    key: Any = None

    def above(self, col: Column) -> Column:
        """``col`` lies on the right side of this lower bound. An excluded key excludes all of its versions."""
        return F.lit(True) if self.kind == "open" else col >= F.lit(self.key) if self.kind == "included" else col > F.lit(self.key)

    def below(self, col: Column) -> Column:
        return F.lit(True) if self.kind == "open" else col <= F.lit(self.key) if self.kind == "included" else col < F.lit(self.key)


OPEN = Bound("open")


def included(key: Any) -> Bound:
    return Bound("included", key)


def excluded(key: Any) -> Bound:
    return Bound("excluded", key)


def in_range(col: Column, low: Bound = OPEN, high: Bound = OPEN) -> Column:
    """Both ends hold for every row; on a stored key the predicate reaches the scan."""
    return low.above(col) & high.below(col)


def scan(log: DataFrame, low: Bound = OPEN, high: Bound = OPEN, read_ts: int | None = None) -> DataFrame:
    """(k, ts, v): live keys in the range at ``read_ts``, in key order."""
    return snapshot(log.filter(in_range(F.col("k"), low, high)), read_ts).orderBy("k")


def prefix_bounds(prefix: str) -> tuple[Bound, Bound]:
    """The range of all keys that start with ``prefix``."""
    if not prefix:
        return OPEN, OPEN
    return included(prefix), excluded(prefix[:-1] + chr(ord(prefix[-1]) + 1))


def overlapping(runs: DataFrame, low: Bound = OPEN, high: Bound = OPEN) -> DataFrame:
    """Runs (first_key, last_key, ..) that may hold keys of the range."""
    return runs.filter(low.above(F.col("last_key")) & high.below(F.col("first_key")))
