"""Mixing sources to target weights by capped water-filling, with DataFrame operations only.

Every source gets its weight's share of all words. Targets stop at ``epochs`` times the source's size; what lies above
is dealt again by weight until none is above. A source's target is then taken as whole repetitions of all its
documents and a seeded sample for the fraction that is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, n_words

#: The 60-bit hash is cut into 4096 bins to find where a source's fraction ends.
BIN_SHIFT = 48


def targets(sizes: DataFrame, epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size) to (source, source_size, target). One row per source; a null source is one as well.

    Closed form of the resharing loop: by rising cap per weight, the level of water over the sources not yet capped is
    (all - caps so far) / (weights left); the first source whose cap is not below that level ends the capped ones. The
    windows run over the table of sources, one row each, never over documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), ((F.row_number().over(order) - 1) % n + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("cap", F.lit(epochs) * F.col("source_size"))
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    rising = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    after = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    s = s.withColumn("level", level)
    # least() skips a null level: then every source is capped.
    s = s.withColumn("level", F.min_by("level", F.when(F.col("level") <= F.col("ratio"), F.col("ratio"))).over(every))
    return s.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")).alias("target"))


def chance(*cols: Column, seed: int) -> Column:
    """60 seeded pseudo-random bits of the columns, from md5, so another engine can repeat them."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("")) for c in cols))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def quotas(rows: DataFrame, epochs: int, weights: tuple[int, ...]) -> DataFrame:
    """(s, source_size, target, whole, end_h, end_words, end_size) for each source of ``rows`` (source, size, h).

    whole: repetitions of every document. The fraction left of the target holds the documents with a hash below end_h,
    and end_words of the end_size words at end_h; without a fraction these three are null. The fraction ends where a
    running sum in hash order reaches it: sums per hash bin find the bin, and only that bin's documents are ordered, so
    no window runs over a source.
    """
    sized = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    q = targets(sized, epochs, weights).withColumnRenamed("source", "s")
    q = q.withColumn("whole", F.coalesce(F.floor(F.try_divide("target", F.col("source_size").cast("double"))), F.lit(0)).cast("long"))
    q = cut(q.withColumn("rest", F.floor("target").cast("long") - F.col("whole") * F.col("source_size")))

    hash_bin = F.shiftrightunsigned("h", BIN_SHIFT)
    bins = rows.groupBy("source", hash_bin.alias("bin")).agg(F.sum("size").alias("words"))
    running = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # 4096 rows a source at most
    bins = bins.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
    reached = "before < rest and before + words >= rest"
    last = bins.join(q.select("s", "rest"), _same("source", "s")).filter(reached).select("s", "rest", "bin", F.col("before").alias("ahead"))
    at = rows.join(last, _same("source", "s") & (hash_bin == F.col("bin"))).groupBy("s", "rest", "ahead", "h").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("s").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("before", F.col("ahead") + F.coalesce(F.sum("words").over(order), F.lit(0))).filter(reached)
    ends = at.select(F.col("s").alias("e"), F.col("h").alias("end_h"), (F.col("rest") - F.col("before")).alias("end_words"), F.col("words").alias("end_size"))
    return cut(q.join(ends, _same("s", "e"), "left").select("s", "source_size", "target", "whole", "end_h", "end_words", "end_size"))


#: A table of sources with at most so many rows is broadcast; a larger one is joined as Spark sees fit.
BROADCAST_ROWS = 10_000


def _with_quota(rows: DataFrame, source: str, q: DataFrame) -> DataFrame:
    small = q.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(q) if small else q, _same(source, "s"))


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    return cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), chance(F.col(id_col), seed=seed).alias("h")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: int = 7) -> DataFrame:
    """(id, source, size, source_size, target, whole, part, taken) for every row.

    ``whole``: repetitions of the entire document. ``part``: words of it in the fractional repetition: all of them if
    the document's seeded hash comes before the place where the source's fraction is reached, the first few in the one
    document in which it is reached, else 0. taken = whole * size + part, at most epochs * size, and the sum over a
    source is its target rounded down.

    A null text has size 0; a null source is a source, sorted last; a null id is hashed as empty. Rows of one id share
    a hash and are ordered by size among themselves. All rows are returned; an empty table gives none.
    """
    rows = _rows(docs, id_col, text_col, source_col, seed)
    d = _with_quota(rows, "source", quotas(rows, epochs, weights))
    at_end = F.coalesce(F.col("h") == F.col("end_h"), F.lit(False))
    others = d.filter(~at_end).withColumn("part", F.when(F.col("h") < F.col("end_h"), F.col("size")).otherwise(F.lit(0)))
    before = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    ends = d.filter(at_end).withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("end_words") - F.coalesce(F.sum("size").over(before), F.lit(0)))))
    taken = F.col("whole") * F.col("size") + F.col("part")
    return others.unionByName(ends).select("id", "source", "size", "source_size", "target", "whole", F.col("part").cast("long"), taken.cast("long").alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: int = 7) -> DataFrame:
    """The mix itself: the rows of ``docs``, with all their columns, each as often as the mix takes it.

    As :func:`mix`, but documents stay whole: the one in which a source's fraction is reached is taken once more if at
    least half of it is in the fraction. Texts are not shuffled; only sizes per source and hash bin are.
    """
    q = quotas(_rows(docs, id_col, text_col, source_col, seed), epochs, weights)
    q = q.select("s", "whole", "end_h", (F.col("end_words") * 2 >= F.col("end_size")).alias("end_in"))
    q = q.select(*(F.col(c).alias(f"__mix_{c}") for c in q.columns)).withColumnRenamed("__mix_s", "s")
    names = [F.col(f"`{c}`") for c in docs.columns]
    d = docs.select(F.struct(*names).alias("row"), F.col(source_col).alias("__mix_source"), chance(F.col(id_col), seed=seed).alias("h"))
    more = F.when(F.col("h") < F.col("__mix_end_h"), 1).when((F.col("h") == F.col("__mix_end_h")) & F.col("__mix_end_in"), 1).otherwise(0)
    d = _with_quota(d, "__mix_source", q).withColumn("copies", (F.col("__mix_whole") + more).cast("int"))
    return d.filter("copies > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")
