"""A hashed maximum-entropy language model: n-gram and skip features, a softmax over classes and one inside a class.

P(w | history) = P(class of w | history) * P(w | class, history). Both factors are log-linear. Their features are the
previous word, the word before it (a skip) and the n-gram of the classes of the last three words; each is hashed to a
row of weights, one weight per class (or per member of a class). Pairs of words were tried as a feature and made
held-out texts less likely.

The HEAD_CLASSES classes hold the most frequent words, MEMBERS each, by rank. All other words fall in TAIL_CLASSES
classes by their ending; endings are clustered by the endings they stand next to, over the whole training corpus. In
a tail class words keep their smoothed relative frequency, with half a count for all words never seen, so the
probabilities of all words and of the unseen ones of each class sum to one.

Training is one pass of gradient steps (Adagrad on batches) per input partition and the average of the partitions'
weights, by how often each row was used: the mixture-weight method for distributed maximum-entropy training. Every
training text is used whole.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import written

HEAD_CLASSES, MEMBERS, TAIL_CLASSES = 16, 32, 16
CLASSES, HEAD = HEAD_CLASSES + TAIL_CLASSES, HEAD_CLASSES * MEMBERS
ENDINGS = 512
ROWS_LOG2 = 15
#: At most so many of the most frequent words are sent to every task; the other words' counts are joined.
KNOWN = 1 << 18
#: The end of a text. It can't be a word, which holds no white space.
END = b"\n"
FIRST, BATCH, RATE, SHRINK = 512, 8192, 0.15, 4.0
#: Distinct words a counting task holds; tokens a scoring task handles at a time; weight rows in a block; fan-in.
HELD, SPAN, BLOCK, FAN = 400_000, 1 << 14, 256, 16
#: Tokens that a counting task counts at a time; sums of exponentials that need no shift of the exponents.
COUNTED, LEAST, MOST = 1 << 18, 1e-25, 1e25
#: Gradients of a row that are added one by one.
RUN = 8
_PUNCT = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))


def tokens(text: bytes | None) -> list[bytes]:
    """Words in lower case (A-Z only) and the end."""
    out = text.lower().split() if text else []
    out.append(END)
    return out


def ending(word: bytes) -> int:
    """Bucket of a word's last two bytes without trailing punctuation."""
    return zlib.crc32(word.rstrip(_PUNCT)[-2:]) % ENDINGS


class _Memo(dict):
    """Word to number, worked out once for each word; emptied when it is full."""

    def __init__(self, of, most: int = HELD):
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        x = self[word] = self.of(word)
        return x


class _Numbers(dict):
    """Word to its number, in the order in which words are first asked for."""

    def __missing__(self, word):
        x = self[word] = len(self)
        return x


# --- counts ---


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # Words are numbered as they come, END first; a chunk's numbers are counted together.
    words, pairs, endings = _Numbers(), np.zeros(ENDINGS * ENDINGS, dtype=np.int64), np.zeros(0, dtype=np.int64)
    counts, chunk, size = np.zeros(0, dtype=np.int64), [], 0

    def out(kind: int, words, keys, n) -> pa.RecordBatch:
        m = len(n)
        return pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int32)), pa.array(words, pa.binary()), pa.array(keys, pa.int32()), pa.array(n, pa.int64())], names=["kind", "word", "key", "n"])

    def add() -> None:
        nonlocal counts, endings, size
        ids = np.concatenate(chunk)
        endings = np.append(endings, np.array([ending(w) for w in islice(words, len(endings), None)], dtype=np.int64))
        n = np.bincount(ids, minlength=len(words))
        n[: len(counts)] += counts
        counts, e = n, endings[ids]
        # No pair goes from one text to the next.
        inside = np.flatnonzero(ids[:-1] != 0)
        np.add.at(pairs, e[inside] * ENDINGS + e[inside + 1], 1)
        chunk.clear()
        size = 0

    def flush() -> pa.RecordBatch:
        nonlocal counts, endings
        at = np.flatnonzero(counts)
        names = list(words)
        b = out(0, [names[k] for k in at], endings[at].astype(np.int32), counts[at])
        words.clear()
        words[END]  # noqa: B018
        counts = endings = np.zeros(0, dtype=np.int64)
        return b

    words[END]  # noqa: B018
    for batch in batches:
        for x in batch.column(0):
            text = tokens(x.as_py())
            chunk.append(np.fromiter(map(words.__getitem__, text), np.int64, len(text)))
            size += len(text)
            if size >= COUNTED or len(words) > HELD:
                add()
                if len(words) > HELD:
                    yield flush()
    if chunk:
        add()
    if len(counts):
        yield flush()
    at = np.flatnonzero(pairs)
    if len(at):
        yield out(1, [None] * len(at), at.astype(np.int32), pairs[at])


def cluster_endings(pairs: np.ndarray, k: int = TAIL_CLASSES, rounds: int = 20) -> np.ndarray:
    """Cluster of each ending (0 to k-1) by the endings before and after it: k-means on square roots of shares."""
    joint = pairs.reshape(ENDINGS, ENDINGS).astype(np.float64)
    weight = joint.sum(0) + joint.sum(1)
    x = np.sqrt(np.concatenate([joint / np.maximum(joint.sum(1, keepdims=True), 1), joint.T / np.maximum(joint.sum(0)[:, None], 1)], axis=1))
    used = np.flatnonzero(weight)
    out = np.arange(ENDINGS) % k
    if len(used) <= k:
        out[used] = np.arange(len(used))
        return out
    centres = [x[used[np.argmax(weight[used])]]]
    far = np.full(len(used), np.inf)
    for _ in range(k - 1):
        far = np.minimum(far, ((x[used] - centres[-1]) ** 2).sum(1))
        centres.append(x[used[np.argmax(far * np.sqrt(weight[used]))]])
    centres = np.array(centres)
    for _ in range(rounds):
        near = ((x[used][:, None] - centres[None]) ** 2).sum(2).argmin(1)
        for c in range(k):
            if (near == c).any():
                w = weight[used][near == c][:, None]
                centres[c] = (x[used][near == c] * w).sum(0) / w.sum()
    out[used] = near
    return out


@dataclass
class Model:
    """words: the known words by falling count, ``known`` at most. class_of and member_of are indexed by word code: rank
    of a known word, known + ending of any other, and bos, which stands before a text."""

    known: int
    words: list[bytes]
    counts: np.ndarray
    tokens: int
    distinct: int
    class_of: np.ndarray
    member_of: np.ndarray
    tail_log: np.ndarray  # by class: log10 of the mass of a tail class
    class_bias: np.ndarray
    member_bias: np.ndarray
    class_w: np.ndarray
    member_w: np.ndarray

    @property
    def bos(self) -> int:
        return self.known + ENDINGS

    @property
    def base_log(self) -> float:
        return math.log10(self.tokens + 0.5 * (self.distinct + 1))

    def coder(self) -> _Memo:
        rank, known = {w: k for k, w in enumerate(self.words)}, self.known
        return _Memo(lambda w: rank[w] if w in rank else known + ending(w))


NONE = np.float32(-1e30)


def blank(words: list[bytes], counts: np.ndarray, total: int, distinct: int, ending_mass: np.ndarray, ending_words: np.ndarray, cluster: np.ndarray, known: int = KNOWN) -> Model:
    """The model before training, which is the smoothed relative frequency of words.

    ending_mass, ending_words: tokens and distinct words of each ending over the whole training corpus.
    """
    bos = known + ENDINGS
    class_of = np.zeros(bos + 1, dtype=np.int64)
    member_of = np.full(bos + 1, -1, dtype=np.int64)
    ends = np.array([ending(w) for w in words], dtype=np.int64)
    class_of[: len(words)] = HEAD_CLASSES + cluster[ends] if len(words) else 0
    class_of[known:bos] = HEAD_CLASSES + cluster
    class_of[bos] = CLASSES
    n = min(HEAD, len(words))
    class_of[:n], member_of[:n] = np.arange(n) // MEMBERS, np.arange(n) % MEMBERS
    mass = ending_mass + 0.5 * ending_words
    np.subtract.at(mass, ends[:n], counts[:n] + 0.5)
    class_mass = np.zeros(CLASSES)
    np.add.at(class_mass, HEAD_CLASSES + cluster, np.maximum(mass, 0))
    class_mass[HEAD_CLASSES:] += 0.5
    member_bias = np.full((HEAD_CLASSES, MEMBERS), NONE, dtype=np.float32)
    for k in range(n):
        class_mass[k // MEMBERS] += counts[k] + 0.5
        member_bias[k // MEMBERS, k % MEMBERS] = math.log(counts[k] + 0.5)
    with np.errstate(divide="ignore"):
        bias = np.where(class_mass > 0, np.log(class_mass), NONE).astype(np.float32)
    zeros = lambda m: np.zeros((1 << ROWS_LOG2, m), dtype=np.float32)
    return Model(known, words, counts, total, distinct, class_of, member_of, np.log10(np.maximum(class_mass, 1e-300)), bias, member_bias, zeros(CLASSES), zeros(MEMBERS))


# --- features ---

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
_SHIFT = np.uint64(64 - ROWS_LOG2)


def features(m: Model, codes: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Rows of the three features of the words at positions ``at``; three bos stand before each text."""
    c1, c2, c3 = codes[at - 1], codes[at - 2], codes[at - 3]
    k = m.class_of
    a, b = c1.astype(np.uint64) + np.uint64(1), c2.astype(np.uint64) + np.uint64(1)
    kinds = ((k[c1] * (CLASSES + 1) + k[c2]) * (CLASSES + 1) + k[c3] + 1).astype(np.uint64)
    hashed = (a * _MIX[0], (b ^ (b << np.uint64(17))) * _MIX[4], (kinds ^ (kinds << np.uint64(23))) * _MIX[5])
    return [(h >> _SHIFT).astype(np.uint16) for h in hashed]


def inner(rows: list[np.ndarray], cls: np.ndarray) -> list[np.ndarray]:
    """Rows of the previous word and of the class n-gram inside a class."""
    y = (cls.astype(np.uint64) + np.uint64(1)) * _MIX[6]
    return [(((rows[k].astype(np.uint64) + np.uint64(1 + (k << 16))) * _MIX[1] ^ y) * _MIX[3] >> _SHIFT).astype(np.uint16) for k in (0, 2)]


def _logits(bias: np.ndarray, weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    # "clip" spares a copy; all rows are in the table.
    z = weights.take(rows[0], axis=0, mode="clip")
    part = np.empty_like(z)
    for r in rows[1:]:
        z += weights.take(r, axis=0, out=part, mode="clip")
    z += bias
    return z


def _exp(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """Exponentials of z less a shift of each row, their sums by row, and the shift: 0, or the largest of a row if some sum
    would be too large or small for floats."""
    with np.errstate(over="ignore"):
        e = np.exp(z)
        total = e @ np.ones(z.shape[1], dtype=z.dtype)
    if len(z) and LEAST < total.min() and total.max() < MOST:
        return e, total, 0.0
    shift = z.max(axis=1, initial=NONE)
    e = np.exp(z - shift[:, None])
    return e, e.sum(axis=1), shift


def _softmax(bias: np.ndarray, weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    e, total, _ = _exp(_logits(bias, weights, rows))
    e /= total[:, None]
    return e


def _log_softmax_at(bias: np.ndarray, weights: np.ndarray, rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    z = _logits(bias, weights, rows)
    mine = z[np.arange(len(y)), y]
    _, total, shift = _exp(z)
    return mine - shift - np.log(total)


def log_probs(m: Model, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural log of P(class) for all words at ``at``, times P(word | class) for those of head classes."""
    rows, y = features(m, codes, at), codes[at]
    cls, member = m.class_of[y], m.member_of[y]
    out = _log_softmax_at(m.class_bias, m.class_w, rows, cls).astype(np.float64)
    h = np.flatnonzero(member >= 0)
    if len(h):
        deep = inner([r[h] for r in rows], cls[h])
        out[h] += _log_softmax_at(m.member_bias[cls[h]], m.member_w, deep, member[h])
    return out


def _encode(m: Model, texts: list[list[bytes]], coder: _Memo) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all tokens with three bos before each text, and the positions of the tokens."""
    start = np.full(3, m.bos)
    flat = [x for words in texts for x in (start, np.fromiter(map(coder.__getitem__, words), np.int64, len(words)))]
    codes = np.concatenate(flat) if flat else np.zeros(0, dtype=np.int64)
    return codes, np.flatnonzero(codes != m.bos)


# --- training ---


class _Table:
    def __init__(self, weights: np.ndarray):
        self.w, self.acc, self.hits = weights.copy(), np.zeros(len(weights), np.float32), np.zeros(len(weights), np.float32)

    def push(self, rows: np.ndarray, grad: np.ndarray) -> None:
        """Adds the gradients of equal rows and makes one step on each row."""
        order = np.argsort(rows, kind="stable")
        s = rows[order]
        starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        n = np.diff(np.append(starts, len(s)))
        # Rows with most gradients first: those with more than k are the first ones. reduceat is slow on short runs.
        by = np.argsort(-n, kind="stable")
        starts, n = starts[by], n[by]
        total = grad.take(order[starts], axis=0)
        many = int(np.count_nonzero(n > RUN))
        for k in range(1, RUN):
            more = int(np.count_nonzero(n > k))
            total[many:more] += grad.take(order[starts[many:more] + k], axis=0)
        if many:
            at = np.cumsum(n[:many]) - n[:many]
            each = np.arange(n[:many].sum()) + np.repeat(starts[:many] - at, n[:many])
            total[:many] = np.add.reduceat(grad.take(order[each], axis=0), at, axis=0)
        r = s[starts]
        acc = self.acc[r] + np.einsum("ij,ij->i", total, total) / total.shape[1]
        self.acc[r] = acc
        total *= (RATE / np.sqrt(acc + 1e-4))[:, None]
        self.w[r] = self.w.take(r, axis=0) - total
        self.hits[r] += n


def step(m: Model, top: _Table, deep: _Table, codes: np.ndarray, at: np.ndarray) -> None:
    """One gradient step on the words at ``at``."""
    rows, y = features(m, codes, at), codes[at]
    cls, member = m.class_of[y], m.member_of[y]
    g = _softmax(m.class_bias, top.w, rows)
    g[np.arange(len(at)), cls] -= 1
    for r in rows:
        top.push(r, g)
    h = np.flatnonzero(member >= 0)
    if len(h):
        inside = inner([r[h] for r in rows], cls[h])
        g = _softmax(m.member_bias[cls[h]], deep.w, inside)
        g[np.arange(len(h)), member[h]] -= 1
        for r in inside:
            deep.push(r, g)


_BLOCK_SCHEMA = "layer int, block int, task int, hits binary, w binary"


def _blocks(layer: int, task: int, hits: np.ndarray, w: np.ndarray) -> Iterator[tuple]:
    for b in range(0, len(w), BLOCK):
        if hits[b : b + BLOCK].any():
            yield layer, b // BLOCK, task, hits[b : b + BLOCK].tobytes(), w[b : b + BLOCK].astype(np.float16).tobytes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    cols = list(zip(*rows, strict=True)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["layer", "block", "task", "hits", "w"])


def _merge(table: pa.Table) -> pa.Table:
    """The average of blocks by hits."""
    layer, block, task = (table.column(k)[0].as_py() for k in range(3))
    hits, total = np.zeros(BLOCK, np.float64), 0.0
    for h, w in zip(table.column(3), table.column(4), strict=True):
        n = np.frombuffer(h.as_py(), np.float32).astype(np.float64)
        hits, total = hits + n, total + n[:, None] * np.frombuffer(w.as_py(), np.float16).reshape(BLOCK, -1).astype(np.float64)
    mean = total / np.maximum(hits, 1)[:, None]
    return pa.Table.from_batches([_batch([(layer, block, task // FAN, hits.astype(np.float32).tobytes(), mean.astype(np.float16).tobytes())])])


def train(texts: DataFrame, m: Model) -> Model:
    """``m`` with weights trained on all texts in the binary column ``text``."""
    shared = texts.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        coder, top, deep, held, size, seen = model.coder(), _Table(model.class_w), _Table(model.member_w), [], 0, 0

        def learn() -> None:
            nonlocal held, size, seen
            codes, at = _encode(model, held, coder)
            while len(at):  # batches grow from FIRST to BATCH
                n = min(BATCH, max(FIRST, seen // 16))
                step(model, top, deep, codes, at[:n])
                at, seen = at[n:], seen + n
            held, size = [], 0

        for batch in batches:
            for x in batch.column(0):
                held.append(tokens(x.as_py()))
                size += len(held[-1])
                if size >= 4 * SPAN:
                    learn()
        if held:
            learn()
        task = TaskContext.get().partitionId()
        rows = [*_blocks(0, task, top.hits, top.w), *_blocks(1, task, deep.hits, deep.w)]
        for k in range(0, len(rows), 64):
            yield _batch(rows[k : k + 64])

    parts = texts.rdd.getNumPartitions()
    found = texts.mapInArrow(run, _BLOCK_SCHEMA)
    while True:  # a group holds FAN blocks at most
        found = found.groupBy("layer", "block", F.floor(F.col("task") / FAN)).applyInArrow(_merge, _BLOCK_SCHEMA)
        parts = -(-parts // FAN)
        if parts <= 1:
            break
    for r in found.collect():
        into = m.member_w if r.layer else m.class_w
        n = np.frombuffer(r.hits, np.float32)[:, None]
        into[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.w, np.float16).reshape(BLOCK, -1) * (n / (n + SHRINK))
    return m


# --- the whole ---


def prepare(texts: DataFrame, known: int = KNOWN) -> tuple[DataFrame, Model]:
    """The counts (word, n) of all tokens in the binary column ``text``, and the untrained model."""
    counted = texts.mapInArrow(_count, "kind int, word binary, key int, n long")
    counts = written(counted.groupBy("kind", "word", "key").agg(F.sum("n").alias("n")), "counts")
    vocabulary = counts.filter("kind = 0").select("word", "key", "n")
    pairs = np.zeros(ENDINGS * ENDINGS, dtype=np.int64)
    got = counts.filter("kind = 1").select("key", "n").toArrow()
    pairs[got["key"].to_numpy()] = got["n"].to_numpy()
    mass, distinct = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in vocabulary.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        mass[r.key], distinct[r.key] = r.n, r.v
    # The least count of which at most ``known`` words have as much, from a histogram with 8 bins an octave.
    octave = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    bins = sorted(((r.b, r.c, r.least) for r in vocabulary.groupBy(octave.alias("b")).agg(F.count("*").alias("c"), F.min("n").alias("least")).collect()), reverse=True)
    held, least = 0, None
    for _, c, n in bins:
        if (held := held + c) > known:
            break
        least = n
    frequent = vocabulary.filter(F.col("n") >= least).select("word", "n").toArrow().to_pylist() if least else []
    frequent.sort(key=lambda r: (-r["n"], r["word"]))
    words, n = [r["word"] for r in frequent], np.array([r["n"] for r in frequent], dtype=np.float64)
    return vocabulary.select("word", "n"), blank(words, n, int(mass.sum()), int(distinct.sum()), mass, distinct, cluster_endings(pairs), known)


_SCORED = "n_tokens long, n_known long, base double, score double, tail array<struct<word: binary, n: int>>"


def score_texts(m: Model, texts: list[bytes | None], coder: _Memo) -> list[tuple]:
    """(tokens, known tokens, sum of log10(c + 0.5) over them, log10 score of all but the counts of other words, those
    other words with their number) of each text.

    Texts are scored together, SPAN tokens at a time; a longer text is cut, and the three words before a later piece
    are its history.
    """
    words = [tokens(t) for t in texts]
    known, base, model = (np.zeros(len(words)) for _ in range(3))
    tails: list[Counter] = [Counter() for _ in words]
    log_c = np.log10(m.counts + 0.5) if len(m.counts) else np.zeros(1)
    flat: list[np.ndarray] = []
    size, start = 0, np.full(3, m.bos)
    at: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    place: list[np.ndarray] = []

    def flush() -> None:
        codes, pos, doc, nth = np.concatenate(flat), np.concatenate(at), np.concatenate(owner), np.concatenate(place)
        y = codes[pos]
        is_known, in_tail = y < m.known, m.member_of[y] < 0
        c = np.where(is_known, log_c[np.minimum(y, len(log_c) - 1)], 0.0)
        lp = log_probs(m, codes, pos) / math.log(10) + np.where(in_tail, c - m.tail_log[m.class_of[y]], 0.0)
        for sums, values in ((known, is_known), (base, c), (model, lp)):
            sums += np.bincount(doc, weights=values, minlength=len(words))
        for k in np.flatnonzero(~is_known):
            tails[doc[k]][words[doc[k]][nth[k]]] += 1
        for x in (flat, at, owner, place):
            x.clear()

    for k, w in enumerate(words):
        for a in range(0, len(w), SPAN):
            h = min(a, 3)
            piece = w[a - h : a + SPAN]
            flat += (start, np.fromiter(map(coder.__getitem__, piece), np.int64, len(piece)))
            at.append(np.arange(size + 3 + h, size + 3 + len(piece)))
            size += 3 + len(piece)
            owner.append(np.full(len(piece) - h, k))
            place.append(np.arange(a, a + len(piece) - h))
            if size >= SPAN:
                flush()
                size = 0
    if flat:
        flush()
    return [(len(w), int(n), float(b), float(s), t) for w, n, b, s, t in zip(words, known, base, model, tails, strict=True)]


def score(docs: DataFrame, training, id_col: str = "doc_id", text_col: str = "text", known: int = KNOWN) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score, training) for every row of ``docs``.

    ``training``: a boolean column, true for the rows that are learned from (null counts as false). n_known: tokens
    that occur in them; base_score: log10 probability of the text under smoothed relative frequencies; score: under the
    model. A null text is an empty one and consists of its end; without training texts every token has probability 1
    in the base. Repeated rows are all scored, and all learned from. Ids may be null or repeat. Counts of words beyond
    the ``known`` most frequent are joined by word; these words' rows are folded by document before.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    learned = F.coalesce(training, F.lit(False))
    texts = docs.filter(learned).select(text.alias("text"))
    vocabulary, m = prepare(texts, known)
    m = train(texts, m)
    shared = spark.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = shared.value.coder()
        item = pa.struct([("word", pa.binary()), ("n", pa.int32())])
        for batch in batches:
            for at in range(0, max(1, len(batch)), 512):
                got = score_texts(shared.value, [x.as_py() for x in batch[at : at + 512]], coder)
                cols = list(zip(*got, strict=True)) or [[]] * 5
                ends = np.cumsum([0, *map(len, cols[4])], dtype=np.int32)
                words = pa.StructArray.from_arrays([pa.array([w for t in cols[4] for w in t], pa.binary()), pa.array([n for t in cols[4] for n in t.values()], pa.int32())], fields=list(item))
                tails = pa.ListArray.from_arrays(pa.array(ends), words)
                part = pa.StructArray.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64()), tails], names=["n_tokens", "n_known", "base", "score", "tail"])
                parts = [part] if at == 0 else [*parts, part]
            yield pa.concat_arrays(parts)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    found = docs.select(F.col(id_col).alias("id"), learned.alias("training"), F.monotonically_increasing_id().alias("row"), F.arrow_udf(run, _SCORED)(text).alias("s"))
    rows = written(found.select("id", "training", "row", "s.*"), "scored")
    rest = rows.select("row", F.explode("tail").alias("t")).select("row", "t.word", F.col("t.n").cast("long").alias("n"))
    counted = rest.join(vocabulary.withColumnRenamed("n", "c"), "word", "left")
    log_c = F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))
    sums = counted.groupBy("row").agg(F.sum(log_c).alias("log_c"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more"))
    both = rows.drop("tail").join(sums, "row", "left")
    more, log_c = F.coalesce("more", F.lit(0)), F.coalesce("log_c", F.lit(0.0))
    return both.select("id", "n_tokens", (F.col("n_known") + more).alias("n_known"), F.lit(m.tokens).cast("long").alias("train_tokens"), (F.col("base") + log_c - F.col("n_tokens") * F.lit(m.base_log)).alias("base_score"), (F.col("score") + log_c).alias("score"), "training")
