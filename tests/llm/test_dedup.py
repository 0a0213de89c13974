"""SimHash near-duplicates and connected components against brute force."""

import random
from itertools import combinations, product

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from palimpsest.llm import components, simhash
from palimpsest.llm.components import connected_components

DOCS = "doc_id long, text string"


def slow_simhash(text):
    words = ("" if text is None else text).encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "Two WORDS", "a b c", "É é x y\x0bz\x0c w", "the cat sat on the mat " * 50])
def test_fingerprint(spark, text):
    got = spark.createDataFrame([(1, text)], DOCS).select(simhash.fingerprint(F.col("text"))).first()[0]
    assert got % (1 << 64) == slow_simhash(text)


def test_the_hash_is_that_of_spark(spark):
    assert spark.sql("select xxhash64('a b c')").first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = " ".join(str(i * 7919 % 1000) for i in range(3000))
    whole = simhash.simhash(text.encode())
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert simhash.simhash(text.encode()) == whole == slow_simhash(text)


def test_components(spark):
    rng = random.Random(1)
    for n, m in ((1, 0), (60, 25), (60, 80), (200, 199)):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] if m != 199 else [(i, i + 1) for i in range(199)]
        got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
        linked = {x for a, b in links if a != b for x in (a, b)}
        want = groups(range(n), links)
        assert got == {x: want[x] for x in linked}


def test_components_beyond_one_task(spark, monkeypatch):
    """Star steps finish what one task may not hold; a task that holds too many nodes sends them on in parts."""
    monkeypatch.setattr(components, "HELD", 20)
    rng = random.Random(4)
    links = [*((i, i + 1) for i in range(150)), *((rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(90)), (7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "u long, v long").repartition(3)).collect()}
    want = groups(range(400), links)
    assert got == {x: want[x] for x in {x for a, b in links if a != b for x in (a, b)}}


def test_components_take_few_jobs(spark):
    """Jobs, stages and plans stay in the driver's memory; a long chain took some for every round."""
    links = spark.createDataFrame([(i, i + 1) for i in range(199)], "u long, v long")
    spark.sparkContext.setJobGroup("components", "")
    try:
        assert {r.root for r in connected_components(links).collect()} == {0}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("components")) <= 8


def prints(spark, rng, n=300):
    """Clusters of fingerprints at distances around the limit."""
    out = set()
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 6)):
            out.add(x)
            for b in rng.sample(range(64), rng.randrange(0, 6)):
                x ^= 1 << b
    values = [x - (1 << 64) if x >> 63 else x for x in out]
    return values, spark.createDataFrame([(v,) for v in values], "fp long")


def slow_links(values, most):
    return {(min(a, b), max(a, b)) for a, b in combinations(values, 2) if ((a ^ b) % (1 << 64)).bit_count() <= most}


@pytest.mark.parametrize("thresholds", [(1, 1), (2, 0), (3, -1), (1, 0, 0), (0, 0, 0, 0), (1, -1, 0, 0)])
def test_any_allocation_finds_all_links(spark, thresholds):
    values, df = prints(spark, random.Random(sum(thresholds) + len(thresholds)))
    m = len(thresholds)
    parts = [(list(range(i * 64 // m, (i + 1) * 64 // m)), t) for i, t in enumerate(thresholds) if t >= 0]
    got = [(r.u, r.v) for r in simhash.links(df, 3, parts).collect()]
    want = slow_links(values, 3)
    assert len(got) == len(set(got)) and set(got) == want and want


def test_the_plan_finds_all_links(spark):
    values, df = prints(spark, random.Random(8))
    parts = simhash.plan(df, 3)
    assert {tuple(r) for r in simhash.links(df, 3, parts).collect()} == slow_links(values, 3)


def test_allocation_is_optimal():
    rng = np.random.default_rng(2)
    for m, most in ((2, 3), (3, 3), (4, 3), (3, 5)):
        costs = np.cumsum(rng.random((m, most + 2)), axis=1)
        budget = most - m + 1
        best = min(sum(costs[i, t + 1] for i, t in enumerate(ts)) for ts in product(range(-1, most + 1), repeat=m) if sum(ts) == budget)
        cost, chosen = simhash.allocate(costs, budget)
        assert sum(chosen) == budget and cost == pytest.approx(best)


def test_bits_are_grouped_by_correlation():
    rng = np.random.default_rng(3)
    hidden = rng.random((4000, 4)) < 0.5
    bits = np.concatenate([hidden[:, [k % 4]] ^ (rng.random((4000, 1)) < 0.1) for k in range(64)], axis=1).astype(float)
    for g in simhash.group_bits(4000, bits.T @ bits, 4):
        assert len(g) == 16 and len({b % 4 for b in g}) == 1


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    rows = []
    for i in range(60):
        words = [word() for _ in range(rng.randrange(1, 300))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            rows.append((len(rows) * 3 + 1, " ".join(words)))
            words = list(words)
            words[rng.randrange(len(words))] = word()
    rows += [(900, None), (901, ""), (902, " \n"), (903, rows[0][1]), (903, rows[0][1]), (None, rows[0][1]), (None, "only nulls have this text"), (None, "only nulls have this text")]
    return rows


def test_near_duplicates_against_brute_force(spark):
    rows = corpus()
    # The clashing names must not disturb anything.
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], DOCS + ", id string, fp int, root string")
    got = simhash.near_duplicates(df).collect()
    fps = {slow_simhash(t) for _, t in rows}
    root = groups(fps, [(a, b) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= 3])
    least = {}
    for i, t in rows:
        r = root[slow_simhash(t)]
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    want = sorted(((i, slow_simhash(t), least[root[slow_simhash(t)]]) for i, t in rows), key=repr)
    assert sorted(((r.id, r.fp % (1 << 64), r.component_id) for r in got), key=repr) == want

    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == sorted({x for x in least.values() if x is not None})
    assert ids.count(None) == sum(x is None for x in least.values()) == 1


def slow_wide(rows, bits):
    """Component of each (id, text): groups within 3 bits, then groups whose first texts are near and alike."""

    def shingled(t):
        w = t.encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    fps = {t: slow_simhash(t) for _, t in rows}
    near = groups(set(fps.values()), [(a, b) for a, b in combinations(set(fps.values()), 2) if (a ^ b).bit_count() <= 3])
    rep = {}
    for _, t in sorted(rows):
        rep.setdefault(near[fps[t]], t)
    alike = []
    for x, y in combinations(rep, 2):
        if (fps[rep[x]] ^ fps[rep[y]]).bit_count() <= bits:
            s, t = shingled(rep[x]), shingled(rep[y])
            if len(s & t) >= 0.8 * len(s | t):
                alike.append((x, y))
    root = groups(set(fps.values()), [*alike, *near.items()])
    least = {}
    for i, t in sorted(rows):
        least.setdefault(root[fps[t]], i)
    return {i: least[root[fps[t]]] for i, t in rows}


def test_wide_links_are_verified(spark):
    """Near copies too far apart for max_bits link over their shingles; texts that only look alike don't."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    rows = []
    for i in range(40):
        words = [word() for _ in range(150)]
        rows.append((10 * i, " ".join(words)))
        for k, edits in enumerate((1, 2, 6)):
            copy = list(words)
            for at in rng.sample(range(150), edits):
                copy[at] = word()
            rows.append((10 * i + k + 1, " ".join(copy)))
    df = spark.createDataFrame([*rows, (10**6, None), (None, None)], DOCS)
    got = {r.id: r.component_id for r in simhash.near_duplicates(df, wide_bits=8).collect() if r.id is not None}
    assert got == dict(zip((i for i, _ in rows), every_pair(rows, 8), strict=True)) | {10**6: 10**6}
    narrow = {r.id: r.component_id for r in simhash.near_duplicates(df).collect() if r.id is not None}
    assert len(set(got.values())) < len(set(narrow.values()))


def every_pair(rows, bits, prints=1):
    """Component of each row (id, text) by its place: all pairs of rows are compared, whatever group they are in."""

    def shingled(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    fps, sets = [simhash.simhashes((t or "").encode(), 3, prints) for _, t in rows], [shingled(t) for _, t in rows]
    assert [f[0] for f in fps] == [slow_simhash(t) for _, t in rows]
    found = []
    for x, y in combinations(range(len(rows)), 2):
        d, s, t = [(a ^ b).bit_count() for a, b in zip(fps[x], fps[y], strict=True)], sets[x], sets[y]
        if d[0] <= 3 or min(d) <= bits and s and t and len(s & t) >= 0.8 * len(s | t):
            found.append((x, y))
    root = groups(range(len(rows)), found)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root[k]] = min((x for x in (least.get(root[k]), i) if x is not None), default=None)
    return [least[root[k]] for k in range(len(rows))]


def edits_of_edits():
    """Chains of copies, each an edit of the one before, in an order that has nothing to do with the ids."""
    rng = random.Random(23)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    texts = []
    for _ in range(12):
        words = [word() for _ in range(150)]
        for _ in range(14):
            texts.append(" ".join(words))
            words = list(words)
            for at in rng.sample(range(150), rng.choice([1, 1, 2, 3])):
                words[at] = word()
    rng.shuffle(texts)
    return [*enumerate(texts, 1), (900, texts[3].upper()), (901, texts[3]), (None, texts[7]), (None, None), (902, "")]


def test_wide_links_of_all_members(spark):
    """A near copy of any member of a group joins it, not only one of its first text."""
    rows = edits_of_edits()
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS), wide_bits=7).collect()
    want = every_pair(rows, 7)
    assert sorted(((r.id, r.component_id) for r in got), key=repr) == sorted(((i, c) for (i, _), c in zip(rows, want, strict=True)), key=repr)
    first = slow_wide([(i, t) for i, t in rows if i is not None and t], 7)
    assert len(set(want)) < len(set(first.values()))


def test_texts_of_a_large_group_are_sent_by_block(spark, monkeypatch):
    """Of many near copies of one text, a text is sent for each block of others, not for each pair; no link is lost."""
    monkeypatch.setattr(simhash, "SIDE", 16)
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    first, rows = [word() for _ in range(150)], []
    for k in range(120):
        words = list(first)
        for at in rng.sample(range(150), rng.choice([1, 2, 3, 5, 7])):
            words[at] = word()
        rows.append((k, " ".join(words)))
    seen, alike = [], simhash._alike

    def counted(dealt, sets, similarity):
        sent = sets.join(simhash._asked(dealt), "fp")
        seen.append((dealt.count(), dealt.select("c", "a", "b").distinct().count(), sent.count(), sets.count()))
        out = alike(dealt, sets, similarity).cache()
        seen.append(out.count())
        return out

    monkeypatch.setattr(simhash, "_alike", counted)
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS), wide_bits=7, prints=2).collect()
    want = every_pair(rows, 7, 2)
    assert sorted((r.id, r.component_id) for r in got) == sorted((i, c) for (i, _), c in zip(rows, want, strict=True))
    (pairs, groups_of, sent, texts), links = seen
    assert pairs > 500 and groups_of > 5 and sent <= 10 * texts and sent < pairs and links < pairs / 4


def edits_of_one(rng, n):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    first, out = [word() for _ in range(150)], []
    for _ in range(n):
        words = list(first)
        for at in rng.sample(range(150), rng.choice([1, 2, 3, 5, 7])):
            words[at] = word()
        out.append(" ".join(words))
    return out


def rows_made(spark, found):
    """The most rows that a join of the executed plans of ``found()`` made, and its result."""
    sql = spark._jsparkSession.sharedState().statusStore()
    before = sql.executionsCount()
    out, most = found(), 0
    runs = sql.executionsList()
    for e in (runs.apply(k) for k in range(before, runs.size())):
        values, nodes = sql.executionMetrics(e.executionId()), sql.planGraph(e.executionId()).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            for m in (node.metrics().apply(k) for k in range(node.metrics().size())):
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()) and "Join" in node.name():
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most, out


@pytest.mark.parametrize("block", [40, 2048])
def test_pairs_of_a_large_group_are_no_rows(spark, monkeypatch, block):
    """Rows joined grow with the texts of a group of near copies, not with their pairs; no link is lost."""
    monkeypatch.setattr(simhash, "LARGE", 50)
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "CROWD", 8)
    monkeypatch.setattr(simhash, "AT_ONCE", 100)
    rng = random.Random(37)
    texts = [*edits_of_one(rng, 220), *edits_of_one(rng, 160), *edits_of_one(rng, 8)]
    rows = [*enumerate(texts, 1), (900, texts[3].upper()), (901, texts[3]), (None, texts[7]), (None, None), (902, "")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, DOCS).cache()
    fps = {f for _, t in rows for f in [simhash.simhashes((t or "").encode(), 3, 2)[0]]}
    pairs = sum((a ^ b).bit_count() <= 7 for a, b in combinations(fps, 2))
    most, got = rows_made(spark, lambda: simhash.near_duplicates(df, wide_bits=7, prints=2).collect())
    want = every_pair(rows, 7, 2)
    assert sorted(((r.id, r.component_id) for r in got), key=repr) == sorted(((i, c) for (i, _), c in zip(rows, want, strict=True)), key=repr)
    assert len(set(want)) < len(set(every_pair(rows, 3)))
    assert pairs > 5000 and 0 < most <= 2 * len(rows)


def test_rows_of_a_key_are_tied_in_their_task(spark, monkeypatch):
    """Links of large and of small keys join the same as all pairs."""
    for crowd, at_once, thresholds in ((2, 7, (1, 1)), (512, 50, (2, 0)), (3, 1 << 20, (0, 0, 0, 0)), (4, 9, (3, -1))):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        monkeypatch.setattr(simhash, "AT_ONCE", at_once)
        values, df = prints(spark, random.Random(crowd))
        m = len(thresholds)
        parts = [(list(range(i * 64 // m, (i + 1) * 64 // m)), t) for i, t in enumerate(thresholds) if t >= 0]
        got = groups(values, [(r.u, r.v) for r in simhash.tied([(df, parts)], 3).collect()])
        assert got == groups(values, slow_links(values, 3)) and len(set(got.values())) < len(values)


def test_classes_larger_than_a_block(spark, monkeypatch):
    """A class of a block or more has blocks of its own; texts outside are compared with all of them."""
    monkeypatch.setattr(simhash, "LARGE", 20)
    monkeypatch.setattr(simhash, "SHINGLES", 2000)
    rows = edits_of_edits()
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS), wide_bits=12, prints=2).collect()
    want = every_pair(rows, 12, 2)
    assert sorted(((r.id, r.component_id) for r in got), key=repr) == sorted(((i, c) for (i, _), c in zip(rows, want, strict=True)), key=repr)


@pytest.mark.parametrize("prints", [2, 3])
def test_further_fingerprints_add_links(spark, prints):
    """Texts link if any of their fingerprints are near and they are alike."""
    rows = edits_of_edits()
    want = every_pair(rows, 6, prints)
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS), wide_bits=6, prints=prints).collect()
    assert sorted(((r.id, r.component_id) for r in got), key=repr) == sorted(((i, c) for (i, _), c in zip(rows, want, strict=True)), key=repr)


def test_one_row_of_a_group_stays_for_repeated_ids(spark):
    """One id with texts of two groups, a repeated row, and two texts of one group with one id."""
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, long), (1, long), (1, "quite another text with its own words"), (2, long), (5, "the third"), (5, "THE third"), (None, "x y z"), (None, "x y z")]
    got = [tuple(r) for r in simhash.keep_one(spark.createDataFrame(rows, DOCS)).collect()]
    assert sorted(((i, t.lower()) for i, t in got), key=repr) == sorted([(1, long), (1, "quite another text with its own words"), (5, "the third"), (None, "x y z")], key=repr)


def test_all_texts_of_a_fingerprint_are_compared(spark, monkeypatch):
    """Different texts with one fingerprint: the link hangs on any of them."""
    words = [f"w{k}" for k in range(60)]
    a, b, c = " ".join(words[::-1]), " ".join(words), " ".join([*words, "more"])
    prints_of = {a: 0b1, b: 0b1, c: 0b111111}
    monkeypatch.setattr(simhash, "fingerprints", lambda text, shingle=3, prints=1: F.array(F.when(text == c, F.lit(prints_of[c])).otherwise(F.lit(1)).cast("long")))
    for rows in ([(1, a), (5, b), (9, c)], [(5, a), (1, b), (9, c)], [(1, a), (None, b), (9, c)]):
        got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS), wide_bits=7).collect()
        assert {r.component_id for r in got} == {1}


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.keep_one(df).count() == 0


def test_one_hot_group(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("all the same words in every one of them").alias("text"))
    assert [tuple(r) for r in simhash.near_duplicates(df).groupBy("component_id").count().collect()] == [(0, 2000)]
