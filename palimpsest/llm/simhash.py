"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint holds 64 majority bits of the shingle hashes. To find all pairs within ``max_bits``, correlated bits
are grouped into partitions, each partition gets its own threshold from a dynamic program over estimated candidate
counts, the thresholds are probed by equi-joins, and every candidate is verified on all 64 bits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import written
from palimpsest.llm.components import Union, connected_components

BITS = 64
SEED = 42
#: Hashes whose bits are summed at a time.
CHUNK = 1 << 15
#: Fingerprints in a block; the pairs of two blocks are verified together.
SIDE = 128
#: Of more connected fingerprints no pairs are made as rows. Their texts are dealt to blocks of BLOCK texts or SHINGLES
#: hashes, and a task searches the pairs of two blocks and verifies them.
LARGE, BLOCK, SHINGLES = 256, 2048, 1 << 20
#: Candidate pairs that a task looks at at a time, and rows of a key beyond which those linked already are passed over.
AT_ONCE, CROWD = 1 << 16, 512


def _remixed(h: np.ndarray, times: int) -> np.ndarray:
    """Other hashes made of 64-bit hashes: ``times`` rounds of a bijective mixer, in which every bit depends on all."""
    for _ in range(times):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(31))
    return h


def simhashes(data: bytes | None, shingle: int = 3, prints: int = 1) -> list[int]:
    """``prints`` fingerprints of a UTF-8 text as unsigned integers; zeros without words.

    The first is made of the shingles' hashes, each further one of the same hashes mixed once more.
    """
    words = data.lower().split() if data else []
    if not words:
        return [0] * prints
    text = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    if n == 1:
        h = np.array([xxhash.xxh64_intdigest(text, SEED)], dtype=np.uint64)
        return [int(_remixed(h, k)[0]) for k in range(prints)]
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    digest, seed, ends = xxhash.xxh64_intdigest, SEED, ends.tolist()
    counts = np.zeros((prints, BITS), dtype=np.int64)
    for at in range(0, n, CHUNK):
        to = min(n, at + CHUNK)
        h = np.array([digest(text[s:e], seed) for s, e in zip(starts[at:to], ends[at + shingle - 1 : to + shingle - 1], strict=True)], dtype="<u8")
        for k in range(prints):
            h = _remixed(h, 1) if k else h
            counts[k] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return [int.from_bytes(np.packbits(c * 2 > n, bitorder="little").tobytes(), "little") for c in counts]


def simhash(data: bytes | None, shingle: int = 3) -> int:
    """Fingerprint of a UTF-8 text as an unsigned integer; 0 without words."""
    return simhashes(data, shingle)[0]


def fingerprints(text: Column, shingle: int = 3, prints: int = 1) -> Column:
    """The fingerprints of a text column as an array of signed longs (the same 64 bits)."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = np.array([simhashes(x.as_py(), shingle, prints) for x in batch], dtype=np.uint64).view(np.int64)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * prints), pa.array(found.ravel()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<long>")(text.cast("binary"))


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """The fingerprint of a text column as a signed long."""
    return fingerprints(text, shingle)[0]


# --- the plan: partitions of bits and their thresholds ---


def _both_set(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each pair of bits how many have both, over all fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).astype("<u8")
            for at in range(0, len(fp), 8192):
                bits = np.unpackbits(fp[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
                total, n = total + bits.T @ bits, n + len(bits)
        if n:
            i, j = np.triu_indices(BITS)
            yield pa.RecordBatch.from_arrays([pa.array([-1, *i], pa.int32()), pa.array([-1, *j], pa.int32()), pa.array([n, *total[i, j].astype(np.int64)], pa.int64())], names=["i", "j", "n"])

    rows = prints.select("fp").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both, n = np.zeros((BITS, BITS)), 0
    for r in rows:
        if r.i < 0:
            n = r.n
        else:
            both[r.i, r.j] = both[r.j, r.i] = r.n
    return n, both


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of near-equal size, each grown from a seed by the strongest mean correlation."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, groups = list(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        group = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (corr[b, group].mean(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def within(p: np.ndarray, most: int) -> np.ndarray:
    """Chance that two independent fingerprints differ in at most 0, 1 .. ``most`` of the bits (set with chances p)."""
    dist = np.zeros(most + 1)
    dist[0] = 1.0
    for q in 2 * p * (1 - p):
        dist[1:] = dist[1:] * (1 - q) + dist[:-1] * q
        dist[0] *= 1 - q
    return np.cumsum(dist)


def allocate(costs: np.ndarray, budget: int) -> tuple[float, list[int]]:
    """Thresholds (-1: partition unused) that sum to ``budget`` at the least total cost, by dynamic programming.

    ``costs[i, t + 1]`` is the cost of threshold t in partition i.
    """
    m, width = costs.shape
    reach = {0: (0.0, [])}  # the sum of (threshold + 1) so far: cost, thresholds
    for i in range(m):
        then: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in reach.items():
            for t in range(width):
                new = (cost + costs[i, t], [*chosen, t - 1])
                if total + t not in then or new < then[total + t]:
                    then[total + t] = new
        reach = then
    return reach[budget + m]


#: Cost of a compared candidate pair (two rows that meet in a join), of a probed key and of an indexed key (rows that are
#: shuffled and sorted).
CANDIDATE, PROBE, INDEX = 0.25, 1.0, 1.0


def plan(prints: DataFrame, max_bits: int, apart: str | None = None, most_parts: int = 4) -> list[tuple[list[int], int]]:
    """[(bits, threshold)]: a pair within ``max_bits`` is within the threshold of at least one group of bits.

    m groups whose thresholds sum to max_bits - m + 1 have that property. Candidate counts come from statistics of
    all fingerprints: the exact number of pairs with equal bits in a group, and for larger distances those that
    independent bits with the measured chances make besides. (Pairs of one cluster have equal bits; multiplying them
    as well would make a large cluster look like a large corpus.) With ``apart`` only pairs with different values in
    that column count.
    """
    n, both = _both_set(prints)
    if n < 2:
        return [(list(range(BITS)), max_bits)] if max_bits <= 1 else [(list(range(32)), 1), (list(range(32, 64)), max_bits - 2)]
    options = {m: group_bits(n, both, m) for m in range(2, min(most_parts, max_bits + 1) + 1)}
    groups = [(m, i, mask(g)) for m, gs in options.items() for i, g in enumerate(gs)]
    keys = F.explode(F.array(*(F.struct(F.lit(k).alias("g"), F.col("fp").bitwiseAND(F.lit(x[2])).alias("key")) for k, x in enumerate(groups)))).alias("x")
    if apart:
        by = prints.select(keys, apart).groupBy("x.g", "x.key", apart).agg(F.count("*").cast("double").alias("n")).groupBy("g", "key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
    else:
        by = prints.select(keys).groupBy("x.g", "x.key").agg(F.count("*").cast("double").alias("n")).withColumn("own", F.col("n"))
    pairs = by.groupBy("g").agg(F.sum((F.col("n") * F.col("n") - F.col("own")) / 2).alias("pairs"))
    same = {groups[r.g][:2]: r.pairs for r in pairs.collect()}
    p, best = np.diag(both) / n, None
    for m, gs in options.items():
        costs = np.zeros((m, max_bits + 2))
        for i, g in enumerate(gs):
            chance = within(p[g], max_bits)
            for t in range(max_bits + 1):
                probes = 1 + len(g) / 2 if t == 1 else sum(comb(len(g), k) for k in range(t + 1))
                found = same[m, i] + n * (n - 1) / 2 * (chance[t] - chance[0])
                costs[i, t + 1] = CANDIDATE * found + n * (PROBE * probes + INDEX)
        cost, chosen = allocate(costs, max_bits - m + 1)
        if best is None or cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(gs, chosen, strict=True) if t >= 0])
    return best[1]


def mask(bits: list[int]) -> int:
    """The bits as a signed long."""
    x = sum(1 << b for b in bits)
    return x - (1 << BITS) if x >= 1 << (BITS - 1) else x


def _keyed(flips: Column, key: Column, part: int) -> Column:
    return F.transform(flips, lambda b: F.struct(F.lit(part).alias("part"), key.bitwiseXOR(b).alias("key"), (b != 0).alias("flipped")))


def links(prints: DataFrame, max_bits: int, parts: list[tuple[list[int], int]], apart: str | None = None, node: str = "fp", besides: str | None = None) -> DataFrame:
    """(u, v): all pairs of rows whose fingerprints (column fp) differ in 1 to ``max_bits`` bits, by their values in column
    ``node``, each once if the rows are distinct.

    With ``apart`` (u, v, of_u, of_v): only pairs with different values in that column, which are of_u and of_v, and
    those with equal fingerprints too. ``besides``: a column of other fingerprints (array); pairs of which one of these is
    within ``max_bits`` are left out.

    A side offers its own bits of a partition, the other side its bits with up to ``threshold`` of them flipped. At
    threshold 1 only zeros are flipped to ones: of two keys one bit apart, one has a zero there. A pair is made in the
    first partition in which it is within the threshold and nowhere else, so no pairs are made to be made distinct.
    """
    fp = F.col("fp")
    offered, probed, first = [], [], F.lit(True)
    differ = F.col("fp_u").bitwiseXOR(F.col("fp_v"))
    for k, (bits, threshold) in enumerate(parts):
        key = fp.bitwiseAND(F.lit(mask(bits)))
        offered.append(F.struct(F.lit(k).alias("part"), key.alias("key")))
        one = [mask([b]) for b in bits]
        if threshold <= 1:
            flips = F.filter(F.array(*(F.lit(x) for x in [0, *one[: len(one) * threshold]])), lambda b: fp.bitwiseAND(b) == 0)
        else:
            flips = F.array(*(F.lit(mask(list(c))) for t in range(threshold + 1) for c in combinations(bits, t)))
        probed.append(_keyed(flips, key, k))
        first = first & ((F.col("part") <= k) | (F.bit_count(differ.bitwiseAND(F.lit(mask(bits)))) > threshold))
    # Pairs with equal keys, and those whose flips go both ways, meet from both sides.
    both_ways = F.col("flipped") & F.col("part").isin([k for k, (_, t) in enumerate(parts) if t <= 1])
    wanted = (F.col("of_u") != F.col("of_v")) & (F.bit_count(differ) <= max_bits) & first & (both_ways | (F.col("u") < F.col("v")))
    if besides:
        wanted = wanted & F.forall(F.zip_with("be_u", "be_v", lambda x, y: F.bit_count(x.bitwiseXOR(y))), lambda n: n > max_bits)
    names = lambda x: [F.col(node).alias(x), fp.alias(f"fp_{x}"), F.col(apart or "fp").alias(f"of_{x}"), *([F.col(besides).alias(f"be_{x}")] if besides else [])]
    kept = lambda x: [x, f"fp_{x}", f"of_{x}", *([f"be_{x}"] if besides else []), "x.*"]
    left = prints.select(*names("u"), F.explode(F.array(*offered)).alias("x")).select(*kept("u"))
    right = prints.select(*names("v"), F.explode(F.concat(*probed)).alias("x")).select(*kept("v"))
    found = left.join(right, ["part", "key"]).filter(wanted)
    turned = F.col("u") > F.col("v")
    pair = lambda x, y: [F.when(turned, F.col(y)).otherwise(F.col(x)).alias(x), F.when(turned, F.col(x)).otherwise(F.col(y)).alias(y)]
    return found.select(*pair("u", "v"), *(pair("of_u", "of_v") if apart else []))


def _bits_apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count((x ^ y).view(np.uint64))


class _Labels:
    """Union-find over 0 .. n - 1 by arrays: ``of[x]`` is the least number that x is linked with."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def link(self, x: np.ndarray, y: np.ndarray) -> None:
        while True:
            a, b = self.of[x], self.of[y]
            apart = a != b
            if not apart.any():
                return
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            np.minimum.at(self.of, np.maximum(a, b), np.minimum(a, b))
            while (up := self.of[self.of]).tobytes() != self.of.tobytes():
                self.of = up


def _meet(part: np.ndarray, key: np.ndarray, fp: np.ndarray, node: np.ndarray, probe: np.ndarray, max_bits: int) -> _Labels:
    """Links of ``node`` (0 .. n - 1) over all pairs of rows with one part and key, one of them no probe, within ``max_bits``."""
    labels = _Labels(int(node.max()) + 1)
    by = np.lexsort((probe, key, part))  # of a key the offered rows come first
    part, key, fp, node, probe = part[by], key[by], fp[by], node[by], probe[by]
    starts = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (key[1:] != key[:-1])])
    sizes = np.diff(np.r_[starts, len(key)])
    offered = np.add.reduceat((~probe).astype(np.int64), starts)
    # A row meets the offered rows before it.
    start, most = np.repeat(starts, sizes), np.repeat(offered, sizes)
    meets = np.minimum(np.arange(len(key)) - start, most)
    meets[np.repeat((offered > CROWD), sizes)] = 0
    rows = np.flatnonzero(meets)
    ends = np.cumsum(meets[rows])
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        some, at = rows[at:to], to
        n = meets[some]
        x = np.repeat(some, n)
        y = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) + start[x]
        near = _bits_apart(fp[x], fp[y]) <= max_bits
        labels.link(node[x[near]], node[y[near]])
    for k in np.flatnonzero(offered > CROWD):
        among = slice(starts[k], starts[k] + offered[k])
        for a in range(starts[k], starts[k] + sizes[k], CROWD):
            b = min(a + CROWD, starts[k] + sizes[k])
            mine, theirs = labels.of[node[a:b]], labels.of[node[among]]
            for label in np.unique(mine):
                x, y = a + np.flatnonzero(mine == label), starts[k] + np.flatnonzero(theirs != label)
                step = max(1, AT_ONCE // max(1, len(x)))
                for c in range(0, len(y), step):
                    i, j = np.nonzero(_bits_apart(fp[x][:, None], fp[y[c : c + step]][None, :]) <= max_bits)
                    labels.link(node[x[i]], node[y[c + j]])
    return labels


def tied(tables: list[tuple[DataFrame, list[tuple[list[int], int]]]], max_bits: int, node: str = "fp", flips: bool = True) -> DataFrame:
    """(u, v): links that join the same values of column ``node`` as all pairs of rows within ``max_bits`` (column fp) do.

    ``tables``: rows and the plan for them; rows of different tables don't meet. Rows that share a key are compared in one
    task, which sends a link for each value that it ties to a smaller one: no pair becomes a row, however large a group is.
    Without ``flips`` only rows with equal bits in a group meet.
    """
    fp, out, before = F.col("fp"), [], 0
    for rows, parts in tables:
        keys = []
        for k, (bits, threshold) in enumerate(parts, before):
            most = threshold if flips else 0
            flipped = F.array(*(F.lit(mask(list(c))) for t in range(most + 1) for c in combinations(bits, t)))
            # At threshold 1 flips of zeros do, as in links.
            flipped = F.filter(flipped, lambda b: fp.bitwiseAND(b) == 0) if most == 1 else flipped
            keys.append(_keyed(flipped, fp.bitwiseAND(F.lit(mask(bits))), k))
        before += len(parts)
        out.append(rows.select(F.col(node).alias("node"), "fp", F.explode(F.concat(*keys)).alias("x")).select("x.*", "fp", "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches if batch.num_rows]
        if held:
            part, key, probe, own, of = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            names, of = np.unique(of, return_inverse=True)
            root = _meet(part, key, own, of, probe, max_bits).of
            u = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(names[u]), pa.array(names[root[u]])], names=["u", "v"])

    every = out[0]
    for x in out[1:]:
        every = every.unionAll(x)
    # Written: a stage that ties and makes a forest would hold two Python workers for each core.
    return written(every.repartition("part", "key").mapInArrow(run, "u long, v long"), "tied")


def _shingle_set(text: Column, shingle: int) -> Column:
    """Sorted different 64-bit hashes of a text's shingles; of a text with fewer words, of the whole; none without."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sets = []
            for x in batch:
                w = x.as_py().lower().split() if x.is_valid else []
                n = max(1, len(w) - shingle + 1) if w else 0
                h = np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(w[i : i + shingle])) for i in range(n)], dtype=np.uint64).view(np.int64))
                sets.append(pa.array(h))
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays(sets) if sets else pa.array([], pa.int64()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<long>")(text.cast("binary"))


def _own(rows: DataFrame, classes: DataFrame, prints: int) -> list[DataFrame]:
    """For each of the ``prints`` fingerprints (node, fp, root): it, the first one and its class; further ones with those
    before them (before)."""
    out = [classes.select(F.col("fp").alias("node"), "fp", "root")]
    for k in range(1, prints):
        own = rows.select(F.col("fp").alias("node"), F.slice(F.concat(F.array("fp"), "more"), 1, k).alias("before"), F.col("more")[k - 1].alias("value")).distinct()
        own = own.join(classes.select(F.col("fp").alias("node"), "root"), "node")
        out.append(written(own.select("node", "before", F.col("value").alias("fp"), "root"), "prints"))
    return out


def _clusters(own: list[DataFrame], plans: list, classes: DataFrame, bits: int) -> DataFrame:
    """(root, c, n) of all classes that are connected with others over pairs within ``bits``: c stands for what is
    connected, n is its number of fingerprints.

    Pairs with equal keys connect most of a large group; then only what is still apart sends links.
    """
    first = connected_components(tied(list(zip(own, plans, strict=True)), bits, "root", flips=False)).withColumnRenamed("root", "c").withColumnRenamed("node", "root")
    now = [x.join(first, "root", "left").select("fp", F.coalesce("c", "root").alias("c")).distinct() for x in own]
    then = connected_components(tied(list(zip(now, plans, strict=True)), bits, "c")).select(F.col("node").alias("c"), F.col("root").alias("to"))
    found = classes.select("root", F.lit(1).alias("n")).groupBy("root").agg(F.count("*").alias("n")).join(first, "root", "left").withColumn("c", F.coalesce("c", "root"))
    found = found.join(then, "c", "left").select("root", "n", F.coalesce("to", "c").alias("c"))
    whole = found.groupBy("c").agg(F.sum("n").alias("of"), F.count("*").alias("classes")).filter("classes > 1")
    return written(found.join(whole, "c").select("root", "c", F.col("of").alias("n")), "clusters")


def _near(own: list[DataFrame], plans: list, bits: int, roots: DataFrame) -> DataFrame:
    """(u, v, of_u, of_v): fingerprints (the first ones) of different classes in ``roots``, and these, of which some of the
    fingerprints of two texts differ in at most ``bits`` bits."""
    out = None
    for x, parts in zip(own, plans, strict=True):
        found = links(x.join(roots, "root", "left_semi"), bits, parts, "root", "node", "before" if out else None)
        out = out.unionByName(found) if out else found
    return written(out, "near")


def _sets(docs: DataFrame, id_col: str, text_col: str, rows: DataFrame, asked: DataFrame, shingle: int) -> DataFrame:
    """(fp, set, n): the shingle sets of all different texts of the fingerprints in ``asked`` (fp); equal texts (rows: id, fp,
    text_hash) are read once, and texts that differ in nothing but case and space have one set."""
    asked = rows.join(asked, "fp").groupBy("fp", "text_hash").agg(F.min("id").alias("__rep"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("__hash", F.xxhash64("text"))
    texts = texts.join(asked.hint("merge"), (F.col("__hash") == F.col("text_hash")) & F.col("id").eqNullSafe(F.col("__rep")))
    return written(texts.select("fp", _shingle_set(F.col("text"), shingle).alias("set")).distinct().withColumn("n", F.size("set")).filter("n > 0"), "sets")


def _dealt(near: DataFrame) -> DataFrame:
    """``near`` with (c, a, b), the group in which a pair is verified.

    Fingerprints that are connected over pairs are dealt to blocks of about SIDE, and the pairs of two blocks are one
    group: a text goes to a group for each block that its fingerprint has pairs with, not for each pair. What is connected
    and fits one block shares a group with others.
    """
    found = connected_components(near)
    sizes = found.groupBy("root").agg(F.ceil(F.count("*") / SIDE).alias("blocks"))
    place = written(found.join(sizes, "root").select(F.col("node").alias("u"), F.col("root").alias("c"), "blocks"), "place")
    bins = max(1, -(-place.count() // SIDE))
    x, y = (F.pmod(F.xxhash64(n), F.col("blocks")).cast("int") for n in ("u", "v"))
    whole = F.col("blocks") == 1
    c = F.when(whole, F.pmod(F.xxhash64("c"), F.lit(bins))).otherwise(F.col("c"))
    keys = [c.alias("c"), F.when(whole, -1).otherwise(F.least(x, y)).alias("a"), F.when(whole, -1).otherwise(F.greatest(x, y)).alias("b")]
    return written(near.join(place, "u").select(*keys, "u", "v", "of_u", "of_v"), "dealt")


def _asked(dealt: DataFrame) -> DataFrame:
    """(c, a, b, fp): the fingerprints of each group."""
    ends = [dealt.select("c", "a", "b", F.col(x).alias("fp")).distinct() for x in ("u", "v")]
    return ends[0].unionByName(ends[1]).distinct()


def _alike(dealt: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) of fingerprints that belong to two texts, one of each, which share ``similarity`` of their shingles.

    All texts of both are compared, unless the classes of the two are joined by other links of the same group already:
    the links join the same classes as those of all pairs.
    """

    def run(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        by, joined, found = defaultdict(list), Union(), []
        for fp, s in zip(texts["fp"].to_pylist(), texts["set"], strict=True):
            by[fp].append(s.values.to_numpy())

        def alike(s: np.ndarray, t: np.ndarray) -> bool:
            if min(len(s), len(t)) < similarity * max(len(s), len(t)):
                return False
            shared = len(np.intersect1d(s, t, assume_unique=True))
            return shared >= similarity * (len(s) + len(t) - shared)

        for u, v, x, y in zip(*(pairs[n].to_pylist() for n in ("u", "v", "of_u", "of_v")), strict=True):
            if joined.find(x) != joined.find(y) and any(alike(s, t) for s in by.get(u, ()) for t in by.get(v, ())):
                joined.link(x, y)
                found.append((u, v))
        return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})

    texts = sets.join(_asked(dealt), "fp").select(F.col("c").alias("of_c"), F.col("a").alias("of_a"), F.col("b").alias("of_b"), "fp", "set")
    return texts.groupBy("of_c", "of_a", "of_b").cogroup(dealt.groupBy("c", "a", "b")).applyInArrow(run, "u long, v long")


def _blocks(texts: DataFrame) -> DataFrame:
    """``texts`` (c, of, fp, prints, set, n) with (a, b, side), once for each group of two blocks of c that a text goes to.

    A class of a block or more has blocks of its own, others share some. Two blocks of one class make no group, nor do
    those of different c; every other pair of texts meets in one group, as sides 0 and 1, or in a block of its own.
    """
    weight = texts.groupBy("c", "of").agg(F.greatest(F.count("*") / BLOCK, F.sum("n") / SHINGLES).alias("w"))
    name = F.when(F.col("w") >= 1, F.col("of").cast("string")).otherwise("")
    weight = written(weight.select("c", "of", name.alias("name"), "w"), "weights")
    sizes = written(weight.groupBy("c", "name").agg(F.ceil(F.sum("w")).cast("int").alias("m")), "blocks")
    every = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda i: F.struct("name", i.alias("i")))
    others = sizes.groupBy("c").agg(F.flatten(F.collect_list(every)).alias("others"))
    mine = F.struct("name", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int").alias("i"))
    placed = weight.join(sizes, ["c", "name"]).join(others, "c").select("c", "of", "name", "m", "others")
    placed = texts.join(placed, ["c", "of"]).withColumn("mine", mine)
    placed = placed.withColumn("other", F.explode(F.filter("others", lambda x: (x["name"] != F.col("name")) | (F.col("name") == "")))).drop("others")
    return placed.select("c", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "of", "fp", "prints", "set")


def _alike_in(fp: np.ndarray, of: np.ndarray, side: np.ndarray, prints: list, sets: list[np.ndarray], within: bool, bits: int, similarity: float) -> list[tuple[int, int]]:
    """Pairs of places whose fingerprints are within ``bits`` and whose sets share ``similarity``: they join the same
    classes (of) as all such pairs of the two sides, or of one if ``within``."""
    labels = np.unique(of, return_inverse=True)[1]
    lengths = np.array([len(x) for x in sets])
    codes = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(lengths)[:-1])
    mark = np.zeros(int(max(c.max() for c in codes)) + 1, dtype=bool)
    # Further fingerprints: places and values, by number.
    more = []
    for k in range(len(prints[0][0])):
        at = [(i, x[k]) for i, xs in enumerate(prints) for x in xs]
        more.append((np.array([i for i, _ in at]), np.array([x for _, x in at], dtype=np.int64)))
    out = []
    for i in np.flatnonzero(side == 0):
        near = _bits_apart(fp, fp[i]) <= bits
        for k, (at, values) in enumerate(more):
            for x in {x[k] for x in prints[i]}:
                near[at[_bits_apart(values, np.int64(x)) <= bits]] = True
        near &= (labels != labels[i]) & (np.minimum(lengths, lengths[i]) >= similarity * np.maximum(lengths, lengths[i]))
        if within:
            near[: i + 1] = False
        else:
            near[side == 0] = False
        js = np.flatnonzero(near)
        if not len(js):
            continue
        mark[codes[i]] = True
        shared = np.add.reduceat(mark[np.concatenate([codes[j] for j in js])].astype(np.int64), np.cumsum(lengths[js]) - lengths[js])
        mark[codes[i]] = False
        js = js[shared >= similarity * (lengths[i] + lengths[js] - shared)]
        if len(js):
            joined, first = np.unique(labels[js], return_index=True)
            labels[np.isin(labels, joined)] = labels[i]
            out += [(i, j) for j in js[first]]
    return out


def _alike_large(texts: DataFrame, bits: int, similarity: float) -> DataFrame:
    """Links (u, v) as of :func:`_alike`, for ``texts`` (c, of, fp, prints, set, n); the pairs are searched in the tasks."""

    def run(texts: pa.Table) -> pa.Table:
        fp, of, side = (texts[n].to_numpy() for n in ("fp", "of", "side"))
        sets = [s.values.to_numpy() for s in texts["set"]]
        found = _alike_in(fp, of, side, texts["prints"].to_pylist(), sets, texts["a"][0].as_py() == texts["b"][0].as_py(), bits, similarity)
        return pa.table({"u": pa.array([fp[i] for i, _ in found], pa.int64()), "v": pa.array([fp[j] for _, j in found], pa.int64())})

    return _blocks(texts).groupBy("c", "a", "b").applyInArrow(run, "u long, v long")


def _widened(docs: DataFrame, id_col: str, text_col: str, rows: DataFrame, prints: DataFrame, classes: DataFrame, bits: int, of: int, similarity: float, shingle: int) -> DataFrame:
    """The classes after linking what is near by any of ``of`` fingerprints and alike."""
    own = _own(rows, classes, of)
    plans = [plan(x, bits, "root") for x in own]
    clusters = _clusters(own, plans, classes, bits)
    near = _near(own, plans, bits, clusters.filter(F.col("n") <= LARGE).select("root"))
    member = written(classes.join(clusters.filter(F.col("n") > LARGE), "root").select("fp", F.col("root").alias("of"), "c"), "member")
    ends = [near.select(F.col("u").alias("fp")), near.select(F.col("v").alias("fp")), member.select("fp")]
    sets = _sets(docs, id_col, text_col, rows, ends[0].unionByName(ends[1]).unionByName(ends[2]).distinct(), shingle)
    # Written: a stage that verifies and makes a forest would hold two Python workers for each core.
    edges = classes.filter("fp <> root").select(F.col("fp").alias("u"), F.col("root").alias("v")).unionByName(written(_alike(_dealt(near), sets, similarity), "alike"))
    if member.limit(1).count():
        more = F.collect_set("more" if of > 1 else F.array().cast("array<long>")).alias("prints")
        more = rows.join(member.select("fp"), "fp", "left_semi").groupBy("fp").agg(more)
        texts = written(sets.join(member, "fp").join(more, "fp"), "large")
        edges = edges.unionByName(written(_alike_large(texts, bits, similarity), "alike"))
    return _classes(prints, edges)


def _classes(prints: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, root, component_id) of all fingerprints (fp, least) for links between them."""
    roots = connected_components(edges)
    linked = prints.join(roots.select(F.col("node").alias("fp"), "root"), "fp")
    # A minimum per root and a join back: the groups are those of different fingerprints only.
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    member = linked.join(least, "root").select("fp", "root", "component_id")
    every = prints.join(member, "fp", "left")
    alone = F.col("root").isNull()
    # A table of its own: Spark can then split the rows of a fingerprint that many copies share.
    return written(every.select("fp", F.coalesce("root", "fp").alias("root"), F.when(alone, F.col("least")).otherwise(F.col("component_id")).alias("component_id")), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3, wide_bits: int | None = None, prints: int = 1, similarity: float = 0.8, verify_shingle: int = 5) -> DataFrame:
    """One row per input row: (id, fp, component_id, root, text_hash).

    Rows link if their fingerprints differ in at most ``max_bits`` bits; component_id is the smallest id that can
    be reached over links, root the smallest fingerprint. With ``wide_bits`` rows are also linked if their fingerprints
    are that near, or any of ``prints`` - 1 further ones made of the same shingles, and their texts share ``similarity``
    of their ``verify_shingle``-word shingles.

    Rows are folded to distinct fingerprints first, so exact copies never meet in a join, and only links between
    different fingerprints are searched. A null text has fingerprint 0, as an empty one; all of these link. A null id
    stays null and counts for no minimum (component_id is null where all ids are). Repeated rows are all returned;
    very long texts are hashed whole, in pieces; an empty table gives none. Other columns are not read, whatever they
    are called.
    """
    text = F.col(text_col)
    prints = prints if wide_bits is not None else 1
    rows = docs.select(F.col(id_col).alias("id"), fingerprints(text, shingle, prints).alias("fps"), F.xxhash64(text).alias("text_hash"))
    rows = rows.select("id", F.col("fps")[0].alias("fp"), F.slice("fps", 2, max(prints - 1, 1)).alias("more"), "text_hash")
    rows = written(rows if prints > 1 else rows.drop("more"), "simhash")
    distinct = written(rows.groupBy("fp").agg(F.min("id").alias("least")), "prints")
    classes = _classes(distinct, tied([(distinct, plan(distinct, max_bits))], max_bits))
    if wide_bits is not None:
        classes = _widened(docs, id_col, text_col, rows, distinct, classes, wide_bits, prints, similarity, verify_shingle)
    return rows.join(classes, "fp").select("id", "fp", "component_id", "root", "text_hash")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, all columns, without those that a near-duplicate with a smaller id stands for.

    ``how``: as for :func:`near_duplicates`. One row of each group stays: one with its smallest id, and if several texts
    of the group or repeated rows have that id, one of them. A group in which every id is null keeps one row as well.
    """
    found = near_duplicates(docs, id_col, text_col, **how)
    mine = F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull())
    texts = found.filter(mine).groupBy("root", "id", "text_hash").agg(F.count("*").alias("n"))
    one = texts.groupBy("root", "id").agg(F.min(F.struct("text_hash", "n")).alias("x"))
    # Equal texts have one fingerprint, so an id and a text are in one group only.
    kept = written(one.select(F.col("id").alias("__keep_id"), F.col("x.text_hash").alias("__keep_hash"), F.col("x.n").alias("__keep_n")), "kept")
    names = [F.col(f"`{c}`") for c in docs.columns]
    # Ids kept grow with the documents: the join is a shuffled one at every size.
    row = docs.select(F.struct(*names).alias("row"), F.col(id_col).alias("__id"), F.xxhash64(F.col(text_col)).alias("__hash"))
    row = row.join(kept.hint("merge"), (F.col("__hash") == F.col("__keep_hash")) & F.col("__id").eqNullSafe(F.col("__keep_id")))
    out = row.filter("__keep_n = 1").select("row.*")
    if kept.filter("__keep_n > 1").limit(1).count():
        out = out.unionByName(row.filter("__keep_n > 1").dropDuplicates(["__hash", "__id"]).select("row.*"))
    return out
