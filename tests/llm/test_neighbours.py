"""Nearest neighbours against brute force."""

import numpy as np
import pytest

from palimpsest.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>"


def slow(ids, x, every=50, k=5):
    u = neighbours.unit(x)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = (u * u[i]).sum(axis=1)
        other = np.flatnonzero(ids != ids[i])
        o = other[np.lexsort((ids[other], -s[other]))][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in o]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(a) for a in v], "z", 1) for i, v in zip(ids, x, strict=True)], SCHEMA + ", part string, rank int")


def clustered(n, dim=32, seed=0):
    rng = np.random.default_rng(seed)
    return (rng.normal(0, 1, (20, dim))[rng.integers(0, 20, n)] + rng.normal(0, 0.7, (n, dim))).astype(np.float32)


def test_recall(spark):
    x = clustered(3000)
    ids = np.arange(3000) * 5
    got, want = found(neighbours.search(frame(spark, ids, x))), slow(ids, x.astype(np.float64))
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    exact = {(q, i): s for q, v in want.items() for i, s in v}
    assert all(s == pytest.approx(exact[q, i], abs=1e-12) for q, v in got.items() for i, s in v if (q, i) in exact)


def test_hot_vector_ties_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS", 40)
    monkeypatch.setattr(neighbours, "QUERIES", 4)
    x = clustered(600, seed=1)
    x[::3] = x[0]
    ids = np.arange(600)
    got, want = found(neighbours.search(frame(spark, ids, x), parts=1)), slow(ids, x.astype(np.float64))
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    good = {0: [1.0, 0.0], 50: [1e-30, 1e-30], 51: [0.0, 2.0], 52: [-1.0, 0.0], 100: [3e38, 1e38]}
    rows = [*good.items(), (51, [0.0, 2.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (150, [0.0, 0.0])]
    got = found(neighbours.search(spark.createDataFrame(rows, SCHEMA)))
    ids = np.array(list(good))
    want = slow(ids, np.array(list(good.values()), dtype=np.float32).astype(np.float64))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(a[1] == pytest.approx(b[1], abs=1e-12) for q in want for a, b in zip(got[q], want[q], strict=True))


@pytest.mark.parametrize("rows", [[], [(0, None)], [(0, [1.0, 2.0])]])
def test_few_rows(spark, rows):
    got = neighbours.search(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and got.count() == 0


@pytest.mark.parametrize("again", [0, 3])
def test_small_parts_are_no_end(spark, again):
    """A query whose parts hold fewer than five other rows is compared with those of further parts."""
    side = np.array([[9.0, -9.0, 0.0], [0.0, 0.0, 0.0]])
    index = neighbours.Index(neighbours.Router(side, np.zeros(3), np.eye(3), np.zeros(3)))
    rows = [(50, [-1.0, 0.5]), *((50, [-1.0, 0.1 * k]) for k in range(again)), (51, [-1.0, 0.2]), *((k, [1.0, 0.1 * k]) for k in range(1, 12))]
    got = neighbours.search(spark.createDataFrame(rows, SCHEMA), index=index).collect()
    assert sorted(r["rank"] for r in got) == [1, 2, 3, 4, 5] and 51 in {r.vec_id for r in got} and 50 not in {r.vec_id for r in got}


def test_recall_outside_the_sample(spark, monkeypatch):
    """Two levels, learned from a tenth of the rows; a cluster of three far from all others gets whole answers."""
    monkeypatch.setattr(neighbours, "SAMPLE", 1000)
    monkeypatch.setattr(neighbours, "HELD_OUT", 1000)
    monkeypatch.setattr(neighbours, "MOST", 16)
    x = clustered(10_000, seed=4)
    x[[0, 50, 77]] = 40 + np.arange(96).reshape(3, 32) % 7
    ids = np.arange(len(x))
    got, want = found(neighbours.search(frame(spark, ids, x))), slow(ids, x.astype(np.float64))
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)


def test_one_id_with_many_vectors(spark):
    """It is one candidate and one query; nobody loses an answer to its copies."""
    x = clustered(400, seed=6)
    ids = np.where(np.arange(400) % 3 == 0, 50, np.arange(400) + 1000)
    got = found(neighbours.search(frame(spark, ids, x), parts=8))
    u = neighbours.unit(x.astype(np.float64))
    assert set(got) == {int(i) for i in ids if i % 50 == 0}
    for q, answer in got.items():
        best = {}
        for a in np.flatnonzero(ids == q):
            for b in np.flatnonzero(ids != q):
                best[int(ids[b])] = max(best.get(int(ids[b]), -2), float(u[a] @ u[b]))
        assert len({i for i, _ in answer}) == 5 and all(s == pytest.approx(best[i], abs=1e-12) for i, s in answer)


def test_parts_are_balanced():
    x = neighbours.unit(clustered(1000, seed=3).astype(np.float64))
    near = neighbours._nearest(x, x, 10, True)
    part = neighbours.balanced_parts(x, near, 8, np.random.default_rng(0))
    assert np.bincount(part, minlength=8).max() <= np.ceil(1.1 * 1000 / 8)
    inside = (part[near] == part[:, None]).mean()
    assert inside > 3 / 8
