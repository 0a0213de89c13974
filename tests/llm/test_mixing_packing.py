"""Mixing and packing against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import mixing, packing
from palimpsest.llm.common import WORD, n_words

DOCS = "doc_id long, text string, source string"


def slow_targets(sizes, epochs=3, weights=(1, 2, 3)):
    """The resharing loop as it is described."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(epochs * sizes[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        target = {s: epochs * sizes[s] if s in capped else left * weight[s] / free for s in names}
        over = {s for s in names if s not in capped and target[s] > epochs * sizes[s]}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 7, 100, 5000]) + rng.randrange(20) for i in range(rng.randrange(1, 12))}
    if seed % 2:
        sizes[None] = 40
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(slow_targets(sizes))


def docs(seed=0, n=400):
    rng = random.Random(seed)
    sources = ["hot"] * 6 + ["a", "b", "c", None, "tiny"]
    rows = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.choice([0, 1, 5, 50, 300]))), rng.choice(sources)) for i in range(n)]
    return [*rows, (n, None, "a"), (None, "x y z", "b"), (None, "x y z", "b"), (5, "again and again", "hot"), (5, "again and again", "hot")]


def test_mix(spark):
    rows = docs()
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], DOCS + ", size int, h int, s int")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = slow_targets(sizes)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert {r.source_size for r in mine} == {sizes[s]} and mine[0].target == pytest.approx(want[s])
        assert abs(sum(r.taken for r in mine) - want[s]) < 1.001
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    key = lambda r: (repr(r.id), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix(df.repartition(7)).collect()))
    assert sorted(map(key, got)) != sorted(map(key, mixing.mix(df, seed=8).collect()))


def test_mixed_rows(spark):
    df = spark.createDataFrame([(*r, "z") for r in docs(3)], DOCS + ", row string")
    plan = {(r.id, r.source): r for r in mixing.mix(df).collect()}
    got = mixing.mixed(df)
    assert got.columns == df.columns
    counts = {(r.doc_id, r.source): r["count"] for r in got.groupBy("doc_id", "source").count().collect()}
    for k, r in plan.items():
        if k[0] not in (None, 5) and r.size:
            assert abs(counts.get(k, 0) * r.size - r.taken) <= r.size / 2, k


def test_mix_edge_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], DOCS)
    assert [(r.size, r.taken, r.target) for r in mixing.mix(blank).collect()] == [(0, 0, 0.0)] * 2
    one = spark.createDataFrame([(1, "a b", "x")], DOCS)
    assert [(r.size, r.taken) for r in mixing.mix(one).collect()] == [(2, 2)]


def test_word_rule(spark):
    texts = [None, "", "a", " a\tb\nc\x0bd\x0ce\rf ", "a b", "é ü"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(n_words(F.col("t"))).collect()]
    assert got == [0, 0, 1, 6, 1, 2] and WORD


def padding(lengths, bounds):
    return sum(min(b for b in bounds if b >= x) - x for x in lengths)


@pytest.mark.parametrize("seed", range(5))
def test_boundaries_are_optimal(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([3, 5, 8, 13, 40, 41, 100]) + rng.randrange(3) for _ in range(60)]
    tops = sorted(set(lengths))
    counts = [lengths.count(t) for t in tops]
    for k in (1, 2, 3, 4):
        got = packing.boundaries(np.array(tops), np.array(counts), np.array([t * c for t, c in zip(tops, counts, strict=True)]), k)
        best = min(padding(lengths, [*c, tops[-1]]) for j in range(k) for c in combinations(tops[:-1], j))
        assert len(got) <= k and got[-1] == tops[-1] and padding(lengths, got) == best


def test_cells(spark):
    lengths = [0, 1, 4095, 4096, 4097, 5000, 100_000, 10**7, 2**31]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lengths], "length long").select(packing.cell(F.col("length"))).collect()]
    assert got[:4] == lengths[:4]
    assert all(x - x / 256 - 1 <= c <= x for x, c in zip(lengths, got, strict=True))


def test_pack(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.choice([0, 1, 2, 30, 31, 200, 2000]), "z") for i in range(500)] + [(None, None, "z")] * 3 + [(7, "w w", "z")] * 5
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, length string"), buckets=4, budget=1000).collect()
    assert len(got) == len(rows)
    sizes = [len((t or "").split()) for _, t, _ in rows]
    tops = sorted(set(sizes))
    best = min(padding(sizes, [*c, tops[-1]]) for j in range(4) for c in combinations(tops[:-1], j))
    assert sum(r.padding for r in got) == best
    batches = {}
    for r in got:
        assert 0 <= r.padding == r.bucket_length - r.length
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for (bucket, batch), held in batches.items():
        per = max(1, 1000 // max(1, held[0].bucket_length))
        last = max(b for k, b in batches if k == bucket)
        assert sorted(r.place for r in held) == list(range(len(held)))
        assert len(held) == per if batch < last else len(held) <= per


def test_pack_over_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 50)
    df = spark.range(1000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text"))
    got = packing.pack(df, budget=30).collect()
    assert sorted((r.batch, r.place) for r in got) == [(b, p) for b in range(100) for p in range(10)]


def test_pack_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
