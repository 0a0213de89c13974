"""Document fingerprints by one-permutation MinHash, with DataFrame operations only.

All shingles are hashed once. The top bits of a hash name its bin, a bin keeps its least hash, empty bins borrow from
a bin that a seeded walk reaches first (optimal densification), and the low bits of each bin are the fingerprint.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import ascii_lower, cut

BINS_LOG2, LOW_BITS, SHINGLE = 7, 8, 5
BINS = 1 << BINS_LOG2
_SPACE = r"[\x20\x09-\x0D]+"
_LEAST = -(1 << 63)
#: The bits of a hash below its bin, and each bin's greatest hash (signed).
_REST = (1 << (64 - BINS_LOG2)) - 1
_GREATEST = [((b - BINS // 2) << (64 - BINS_LOG2)) + _REST for b in range(BINS)]
#: An empty bin walks over all bins from its own start with its own odd stride.
_random = random.Random(5)
_STARTS, _STRIDES = [_random.randrange(BINS) for _ in range(BINS)], [_random.randrange(BINS // 2) * 2 + 1 for _ in range(BINS)]


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: the low bits of all bins as array<tinyint>, empty for a text without words.

    Words are folded to lower case (A-Z) and joined to shingles of five; a text with fewer words is one shingle. Each
    step is a column of its own, as a lambda works out anew what it doesn't find as a column.
    """
    t = f"__{out}_"
    low = (1 << LOW_BITS) - 1
    words = F.array_remove(F.split(ascii_lower(F.col(text)), _SPACE), "")
    df = df.withColumn(t + "w", F.transform(words, lambda w: F.xxhash64(w)))
    w = F.col(t + "w")
    shingles = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(SHINGLE))))
    df = df.withColumn(t + "h", F.sort_array(F.concat(F.array(*(F.lit(x) for x in _GREATEST)), F.when(F.size(w) >= SHINGLE, shingles).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>")))))
    h = F.col(t + "h")
    # A signed shift keeps the bins in the order of the sorted hashes. The greatest hash of each bin is among them, so
    # the first of each bin is found for all bins, and is that one where a bin is empty.
    bin_of = lambda x: F.shiftright(x, 64 - BINS_LOG2)
    df = df.withColumn(t + "m", F.filter(h, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(h, i - 1)))))
    value = lambda x: (x.bitwiseAND(F.lit(low)) - 128).cast("tinyint")
    empty = lambda x: x.bitwiseAND(F.lit(_REST)) == _REST
    df = df.withColumn(t + "v", F.transform(t + "m", lambda x: F.when(~empty(x), x)))
    v = F.col(t + "v")
    starts, strides = (F.array(*(F.lit(k) for k in ks)) for ks in (_STARTS, _STRIDES))

    def probe(j: Column, a: Column | int) -> Column:
        return F.get(v, (F.get(starts, j) + F.get(strides, j) * a) % BINS)

    def filled(x: Column, j: Column) -> Column:
        walk = F.filter(F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda a: probe(j, a)), lambda y: y.isNotNull())
        # A borrowed hash is mixed with the bin: else all bins of a text of one shingle would agree by chance at once.
        return F.when(x.isNotNull(), value(x)).otherwise(value(F.xxhash64(F.coalesce(*(probe(j, a) for a in range(8)), F.get(walk, 0)), j)))

    some = F.size(F.array_compact(v))
    df = df.withColumn(out, F.when(some == 0, F.array().cast("array<tinyint>")).when(some == BINS, F.transform(v, value)).otherwise(F.transform(v, filled)))
    return df.drop(*(t + x for x in "whmv"))


def packed(fp: Column) -> Column:
    """Hexadecimal string of a fingerprint; empty for a text without words."""
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x.cast("int") + 128)), 2, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance: the share of equal bins, corrected for low bits that agree by chance."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-LOW_BITS
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1 - chance)))


#: Bits of an id that a level of `above` puts together: a group holds 2**bits ids or groups at most.
LEVELS = (13, 20, 20)


def above(ids: DataFrame) -> DataFrame:
    """(key, chars) with distinct long keys to (key, above, above_chars): the row with the next larger key.

    The largest key is followed by the smallest. Keys are grouped by their upper bits; the last of a group is followed by
    the first of the next group that isn't empty, found the same way one level up. No level puts more than 2**20 rows
    in one window group, however the keys lie.
    """

    def lead(df: DataFrame, by: Column | None, order: str, what: Column) -> Column:
        return F.lead(what).over((Window.partitionBy(by) if by is not None else Window.partitionBy()).orderBy(order))

    level = ids.withColumn("first", F.struct("key", "chars")).withColumn("at", F.col("key"))
    stack = []
    for bits in LEVELS:
        level = level.withColumn("up", F.shiftright("at", bits))
        stack.append(level.withColumn("then", lead(level, F.col("up"), "at", F.col("first"))))
        level = level.groupBy(F.col("up").alias("at")).agg(F.min("first").alias("first"))
    # The top level has 2**11 rows at most.
    top = level.withColumn("then", lead(level, None, "at", F.col("first")))
    least = F.min("first").over(Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    top = top.withColumn("then", F.coalesce("then", least))
    for low in reversed(stack):
        up = top.select(F.col("at").alias("up"), F.col("then").alias("up_then"))
        top = low.join(up, "up").withColumn("then", F.coalesce("then", "up_then"))
    return top.select("key", F.col("then.key").alias("above"), F.col("then.chars").alias("above_chars"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The edited text replaces the last third of a text's code points by the first as many (or all) of the next
    document's, in descending order of ids; after the last comes the first, and a single document follows itself. A
    null text is an empty one; a null id comes after all others. Rows of one id are each fingerprinted; as the next
    document such an id stands for its smallest text. Only ids and lengths are ordered; texts move once by id, and
    the part that the edit needs once more.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST))
    base = with_fingerprint(docs.select(key.alias("key"), text.alias("text")), "text", "fp")
    ids = cut(docs.select(key.alias("key"), F.length(text).cast("long").alias("chars")).groupBy("key").agg(F.max("chars").alias("chars"), F.count("*").alias("n")))
    takers = cut(above(ids.select("key", "chars")))
    given = base.join(takers, "key")
    if ids.filter("n > 1").limit(1).count():
        least = given.groupBy("key").agg(F.min(F.struct("text", "fp", "above", "above_chars")).alias("x"))
        given = least.select("key", "x.*")
    third = lambda n: F.floor(n / F.lit(3)).cast("int")
    given = given.select(F.col("above").alias("key"), F.substring("text", F.lit(1), third(F.col("above_chars"))).alias("piece"), F.col("fp").alias("next_fp"))
    d = base.join(given, "key").withColumn("n_chars", F.length("text").cast("long"))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - third(F.col("n_chars"))).cast("int")), F.substring("piece", F.lit(1), third(F.col("n_chars"))))
    d = d.select("key", "n_chars", "fp", "next_fp", edited.alias("edited"))
    d = with_fingerprint(d.withColumn("sha", F.sha2(F.col("edited").cast("binary"), 256)), "edited", "efp")
    return d.select(F.when(F.col("key") != _LEAST, F.col("key")).alias("id"), "n_chars", F.col("sha").alias("edited_sha256"), packed(F.col("fp")).alias("fingerprint"), packed(F.col("efp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
