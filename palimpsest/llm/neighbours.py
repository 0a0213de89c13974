"""Approximate nearest neighbours over learned partitions.

A neighbour graph of a bounded sample is cut into balanced parts with few edges between them; a small network learns
in which parts a vector and its neighbours lie. The number of parts grows with the square root of the table's; beyond
MOST parts each is cut again by a network of its own, learned from a sample of that part. Every row is indexed in its
most probable part; a query is compared with the rows of its most probable parts, as many as rows that nothing was
learned from need for the wanted recall, and of further ones until they hold enough rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import written

#: Rows that a network is learned from (half of all at most), rows that the number of probes is set with, and how many of
#: those are taken as queries: at most so many.
SAMPLE, HELD_OUT, ASKED = 8192, 8192, 1024
MOST, LINKS, HIDDEN, RECALL = 256, 10, 64, 0.95
#: Rows of a part, and queries, that are compared in one group.
ROWS, QUERIES = 4096, 4096


@dataclass
class Router:
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @property
    def arrays(self) -> tuple:
        return self.w1, self.b1, self.w2, self.b2

    @property
    def size(self) -> int:
        return self.w2.shape[1]

    def log_probs(self, unit: np.ndarray) -> np.ndarray:
        z = np.maximum(unit @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z = z - z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


@dataclass
class Index:
    """Parts are numbered through: those of top's part p from first[p] on. inner: the networks of parts that are cut again."""

    top: Router
    inner: dict[int, Router] = field(default_factory=dict)
    probes: int = 1

    @property
    def first(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum([self.inner[p].size if p in self.inner else 1 for p in range(self.top.size)])])

    def homes(self, vectors: np.ndarray) -> np.ndarray:
        u = unit(vectors)
        part = self.top.log_probs(u).argmax(axis=1)
        out = self.first[part]
        for p in np.unique(part):
            if int(p) in self.inner:
                mine = part == p
                out[mine] += self.inner[int(p)].log_probs(u[mine]).argmax(axis=1)
        return out

    def order(self, vectors: np.ndarray) -> np.ndarray:
        """All parts by falling probability, for each vector."""
        u = unit(vectors)
        log = self.top.log_probs(u)
        if self.inner:
            log = np.concatenate([log[:, [p]] + (self.inner[p].log_probs(u) if p in self.inner else 0) for p in range(self.top.size)], axis=1)
        return np.argsort(-log, axis=1, kind="stable")

    def probed(self, vectors: np.ndarray, held: np.ndarray, need: int) -> list[np.ndarray]:
        """The parts with rows (``held``: their number) among the ``probes`` most probable ones of each vector, and further
        ones by falling probability until they hold ``need`` rows."""
        out = []
        for at in range(0, len(vectors), 256):
            order = self.order(vectors[at : at + 256])
            n = held[order]
            take = (n > 0) & ((np.arange(n.shape[1]) < self.probes) | (np.cumsum(n, axis=1) - n < need))
            out += [o[t] for o, t in zip(order, take, strict=True)]
        return out


def unit(v: np.ndarray) -> np.ndarray:
    # The scale goes first, so that squares neither overflow nor vanish.
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _nearest(q: np.ndarray, base: np.ndarray, k: int, own: bool) -> np.ndarray:
    out = []
    for at in range(0, len(q), 128):
        s = q[at : at + 128] @ base.T
        if own:
            s[np.arange(len(s)), np.arange(at, at + len(s))] = -2
        np.negative(s, out=s)
        out.append(np.argpartition(s, min(k, s.shape[1]) - 1, axis=1)[:, :k])
    return np.concatenate(out)


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Part of each row: parts of at most 1.1 times the mean size, grown from seeds and refined by moving rows to the part
    that holds most of their graph neighbours, the most wanted moves first while there is room."""
    n = len(x)
    room = int(np.ceil(1.1 * n / parts))
    seeds = x[rng.choice(n, parts, replace=False)]
    want = x @ seeds.T
    part = np.full(n, -1)
    src = np.repeat(np.arange(n), near.shape[1])
    for _ in range(rounds):
        left = np.full(parts, room)
        order = np.argsort(-(want.max(axis=1)), kind="stable")
        choice = np.argsort(-want, axis=1, kind="stable")
        for i in order:
            for p in choice[i]:
                if left[p]:
                    part[i], left[p] = p, left[p] - 1
                    break
        want = np.zeros((n, parts), dtype=np.float32)
        np.add.at(want, (src, part[near.ravel()]), 1.0)
        np.add.at(want, (near.ravel(), part[src]), 1.0)
        want[np.arange(n), part] += 0.01
    return part


def learn(vectors: np.ndarray, parts: int, seed: int = 5) -> Router:
    """Router of a sample to ``parts`` parts (fewer, if the sample has fewer than 32 different vectors for each)."""
    rng = np.random.default_rng(seed)
    x = unit(np.unique(vectors, axis=0)).astype(np.float32)
    rng.shuffle(x)
    dim = vectors.shape[1]
    parts = max(1, min(parts, len(x) // 32))
    if parts == 1:
        return Router(*(np.zeros(d, dtype=np.float32) for d in ((dim, 1), 1, (1, 1), 1)))
    near = _nearest(x, x, LINKS, True)
    part = balanced_parts(x, near, parts, rng)
    goal = np.zeros((len(x), parts), dtype=np.float32)
    np.add.at(goal, (np.repeat(np.arange(len(x)), near.shape[1]), part[near.ravel()]), 1.0)
    goal[np.arange(len(x)), part] += 2.0
    goal /= goal.sum(axis=1, keepdims=True)
    w = [rng.normal(0, np.sqrt(2 / dim), (dim, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    w = [a.astype(np.float32) for a in w]
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(30):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            b = order[at : at + 256]
            h = np.maximum(x[b] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            g = (p / p.sum(axis=1, keepdims=True) - goal[b]) / len(b)
            gh = (g @ w[2].T) * (h > 0)
            t += 1
            for i, d in enumerate((x[b].T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                d = d + 1e-5 * w[i]
                m[i] += 0.1 * (d - m[i])
                v[i] += 0.001 * (d * d - v[i])
                w[i] -= (0.01 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return Router(*w)


def probes_for(index: Index, vectors: np.ndarray, recall: float = RECALL, k: int = 5) -> int:
    """Probes with which ``recall`` of the ``k`` nearest of these vectors are found; nothing was learned from them."""
    x = unit(np.unique(vectors, axis=0))
    np.random.default_rng(3).shuffle(x)
    if len(x) <= k:
        return int(index.first[-1])
    asked = x[:ASKED]
    home, near, ranks = index.homes(x), _nearest(asked.astype(np.float32), x.astype(np.float32), k, True), []
    for at in range(0, len(asked), 256):
        rank = np.argsort(index.order(asked[at : at + 256]), axis=1)
        ranks.append(np.take_along_axis(rank, home[near[at : at + 256]], axis=1).ravel())
    ranks = np.sort(np.concatenate(ranks))
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def top(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score): the k nearest ids among the candidates for each query but its own, ties to smaller ids.

    A fast product finds what may be among the k nearest; scores are sums over products of the original vectors scaled
    to length 1. Of equal vectors only the k + 1 smallest ids can be among the k nearest of any query. An id with
    several vectors counts once, by the nearest of them.
    """
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], np.ascontiguousarray(c[order])
    _, same = np.unique(c, axis=0, return_inverse=True)
    by = np.argsort(same.ravel(), kind="stable")
    s = same.ravel()[by]
    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    nth = np.empty(len(s), dtype=np.int64)
    nth[by] = np.arange(len(s)) - np.repeat(starts, np.diff(np.append(starts, len(s))))
    c_ids, c = c_ids[nth <= k], c[nth <= k]
    # So many rows may have the id of one that is among the nearest.
    deep = k * int(np.unique(c_ids, return_counts=True)[1].max(initial=1))
    cu, qu, out = unit(c), unit(q), []
    for at in range(0, len(q), 256):
        s = qu[at : at + 256] @ cu.T
        s[q_ids[at : at + 256, None] == c_ids[None]] = -9
        least = np.partition(s, len(c) - deep, axis=1)[:, len(c) - deep] if len(c) > deep else np.full(len(s), -2.0)
        i, j = np.nonzero((s >= least[:, None] - 1e-9) & (s > -3))
        exact = np.concatenate([(qu[at + i[a : a + 65536]] * cu[j[a : a + 65536]]).sum(axis=1) for a in range(0, len(i), 65536)]) if len(i) else np.zeros(0)
        o = np.lexsort((c_ids[j], -exact, i))
        i, j, exact = i[o], j[o], exact[o]
        if deep > k:
            once = np.sort(np.unique(np.stack([i, c_ids[j]]), axis=1, return_index=True)[1])
            i, j, exact = i[once], j[once], exact[once]
        first = np.searchsorted(i, i, side="left")
        keep = np.arange(len(i)) - first < k
        out.append((q_ids[at + i[keep]], c_ids[j[keep]], exact[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


_FOUND = "query_id long, vec_id long, score double"


def _share(col: str, of: Column | float) -> Column:
    """True for a share ``of`` all rows, chosen by a hash of id and vector."""
    return F.pmod(F.xxhash64(F.lit(col), "id", "v"), F.lit(1 << 30)) < F.lit(float(1 << 30)) * of


def _told(rows: DataFrame, f) -> list:
    """What f makes of all vectors of a small table, in one task on an executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_matrix(b.column(0)) for b in batches if len(b)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(f(np.concatenate(held) if held else np.zeros((0, 1))))], pa.binary())], names=["x"])

    return [pickle.loads(bytes(r.x)) for r in rows.select("v").repartition(1).mapInArrow(run, "x binary").collect()]


def build(rows: DataFrame, n: int, parts: int | None = None, k: int = 5) -> Index:
    """The index of ``n`` rows (id, v): about sqrt(n) parts, or ``parts``. Networks are learned and probes set on executors;
    the driver gets only the networks, MOST of at most MOST parts each."""
    parts = parts or int(np.ceil(np.sqrt(n)))
    f = min(SAMPLE / n, 0.5)
    most = min(parts, MOST)
    dim = rows.select(F.size("v")).first()[0]
    index = Index(Router(*_told(rows.filter(_share("learn", f)), lambda x: learn(x if len(x) else np.ones((1, dim)), most).arrays)[0]))
    if parts > MOST:
        shared = rows.sparkSession.sparkContext.broadcast(index)

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                home = shared.value.homes(_matrix(b.column(1))) if len(b) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(home.astype(np.int32))], names=["id", "v", "part"])

        homes = written(rows.mapInArrow(route, "id long, v array<double>, part int"), "parts")
        counts = {r.part: r.n for r in homes.groupBy("part").agg(F.count("*").alias("n")).collect()}
        cut = {p: min(MOST, round(c * parts / n)) for p, c in counts.items() if c * parts > 1.5 * n}

        def inner(key: tuple, table: pa.Table) -> pa.Table:
            p = key[0].as_py()
            return pa.table({"part": pa.array([p], pa.int32()), "x": pa.array([pickle.dumps(learn(_matrix(table["v"]), cut[p]).arrays)], pa.binary())})

        if cut:
            of = F.create_map(*(F.lit(x) for p in cut for x in (p, SAMPLE / counts[p])))[F.col("part")]
            sample = homes.filter(F.col("part").isin(list(cut))).filter(_share("learn", of)).select("part", "v")
            index.inner = {r.part: Router(*pickle.loads(bytes(r.x))) for r in sample.groupBy("part").applyInArrow(inner, "part int, x binary").collect()}
    rest = rows.filter(~_share("learn", f)).filter(_share("probe", min(1.0, HELD_OUT / max(1.0, n * (1 - f)))))
    index.probes = _told(rest, lambda x, index=index: probes_for(index, x, k=k))[0]
    return index


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, parts: int | None = None, index: Index | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id divisible by ``every`` the k nearest other ids found by cosine, or all if
    there are fewer.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with a null id or
    with another length than the most frequent one (the shorter of equals). A row repeated with its id counts once; an
    id with several vectors is one query and one candidate, at the least distance of any of them. Ties go to the
    smaller id. An empty table gives none; other columns are not read, whatever they are called.

    Networks are learned from SAMPLE rows at most (half of a small table), every row is indexed. Parts are compared in
    blocks of ROWS by QUERIES, whatever their size, so a part with most rows or most queries is many groups. A query
    whose parts hold fewer than k other ids is compared with all rows afterwards, in the same blocks.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null").filter(fine).dropDuplicates(["id", "v"])
    rows = written(rows, "vectors")
    sizes = sorted((-r.n, r.d) for r in rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect())
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("v") == sizes[0][1])
    index = index or build(rows, -sizes[0][0], parts, k)
    shared = spark.sparkContext.broadcast(index)
    leaves = int(index.first[-1])

    def route(batches: Iterator[pa.RecordBatch], parts_of) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.atleast_1d(p).tolist() for p in parts_of(shared.value, _matrix(b.column(1)))] if len(b) else []
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int32()))], names=["id", "v", "parts"])

    schema = "id long, v array<double>, parts array<int>"
    homes = written(rows.mapInArrow(lambda it: route(it, lambda i, x: i.homes(x)), schema).select("id", "v", F.col("parts")[0].alias("part")), "homes")
    held = np.zeros(leaves, dtype=np.int64)
    for r in homes.groupBy("part").agg(F.count("*").alias("n")).collect():
        held[r.part] = r.n
    queries = rows.filter(F.col("id") % every == 0)
    asked = written(queries.mapInArrow(lambda it: route(it, lambda i, x: i.probed(x, held, k + 1)), schema), "asked")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if len(left) and len(right):
            a, b, s = top(right["id"].to_numpy(), _matrix(right["v"]), left["id"].to_numpy(), _matrix(left["v"]), k)
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(s, pa.float64())})

    def nearest(q: DataFrame) -> DataFrame:
        """For queries (id, v, parts): the nearest rows of these parts."""
        q = q.select("id", "v", F.explode("parts").alias("part"))
        counts = {r.part: r.n for r in q.groupBy("part").agg(F.count("*").alias("n")).collect()}
        # A row for each part: at most MOST squared.
        cells = F.broadcast(spark.createDataFrame([(p, -(-int(held[p]) // ROWS), -(-n // QUERIES)) for p, n in counts.items()], "part int, blocks int, groups int"))
        spread = lambda n: F.pmod(F.xxhash64("id", "v"), F.col(n)).cast("int")
        every_one = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        by = ["part", "block", "group"]
        c = homes.join(cells, "part").withColumn("block", spread("blocks")).withColumn("group", every_one("groups")).select("id", "v", *by)
        q = q.join(cells, "part").withColumn("group", spread("groups")).withColumn("block", every_one("blocks")).select("id", "v", *by)
        found = c.groupBy(*by).cogroup(q.groupBy(*by)).applyInArrow(compare, _FOUND)
        best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    if not (held > 0).any() or asked.limit(1).count() == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = written(nearest(asked), "found")
    # Copies of a query's own id in its parts: these queries look everywhere.
    enough = found.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select(F.col("query_id").alias("id"))
    short = asked.join(enough, "id", "left_anti").filter(F.size("parts") < F.lit(int((held > 0).sum())))
    ids = [r.id for r in short.select("id").distinct().limit(1).collect()]
    if not ids:
        return found
    every_part = F.array(*(F.lit(int(p)) for p in np.flatnonzero(held)))
    more = asked.join(short.select("id").distinct(), "id", "left_semi").withColumn("parts", every_part)
    return found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(nearest(more))
