"""One-permutation MinHash against a plain version, and the edit of the last third."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import minhash

DOCS = "doc_id long, text string"


def words(t):
    return ("" if t is None else t).encode().lower().split()


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def resemblance(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def corpus():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6)))
    return [(i * 10_007 - 50_000, " ".join(word() for _ in range(rng.choice([1, 3, 5, 20, 200, 2000])))) for i in range(60)]


def run(spark, rows, extra=True):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS + ", n_chars int, fp string") if extra else spark.createDataFrame(rows, DOCS)
    return minhash.fingerprints(df).collect()


def edited(a, b):
    n = len(a) // 3
    return a[: len(a) - n] + b[:n]


def test_edits_and_likeness(spark):
    rows = [*corpus(), (-7, None), (-6, ""), (-5, "ünï cödé " * 40), (2**40, "far away"), (None, "no id at all, so it comes last")]
    got = {r.id: r for r in run(spark, rows)}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    errors = []
    for i, (key, text) in enumerate(order):
        a, b = text or "", order[(i + 1) % len(order)][1] or ""
        e, r = edited(a, b), got[key]
        assert r.n_chars == len(a) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert (r.fingerprint == "") == (not words(a)) and len(r.fingerprint) in (0, 2 * minhash.BINS)
        errors += [r.near_edited - resemblance(a, e), r.near_next - resemblance(a, b)]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if a == e:
            assert r.edited_fingerprint == r.fingerprint and r.near_edited == 1
    assert max(map(abs, errors)) < 0.25 and abs(sum(errors)) / len(errors) < 0.02


def test_equal_texts_have_equal_fingerprints(spark):
    got = run(spark, [(1, "A b c d e f"), (2, "a B c\td e  f"), (3, "a b c d e g")])
    by = {r.id: r for r in got}
    assert by[1].fingerprint == by[2].fingerprint != by[3].fingerprint
    assert by[2].near_next == 1


@pytest.mark.parametrize("rows", [[(5, "a b c d e f g h i")], [(5, None)], [(None, "x y")]])
def test_a_single_document_follows_itself(spark, rows):
    (r,) = run(spark, rows)
    text = rows[0][1] or ""
    assert r.edited_sha256 == hashlib.sha256(edited(text, text).encode()).hexdigest() and r.near_next == 1


def test_repeated_ids(spark):
    rows = [(1, "b one two three four"), (1, "a one two three four"), (2, "z " * 9), (2, "z " * 9)]
    got = run(spark, rows)
    assert len(got) == 4
    nexts = [r.edited_sha256 for r in got if r.id == 2]
    assert nexts == [hashlib.sha256(edited("z " * 9, "a one two three four").encode()).hexdigest()] * 2


def test_no_documents(spark):
    assert run(spark, [], extra=False) == []


def test_above(spark):
    rng = random.Random(4)
    keys = sorted({rng.choice([rng.randrange(-100, 100), rng.randrange(-(2**62), 2**62), 2**33 * rng.randrange(-3, 3)]) for _ in range(400)})
    got = {r.key: (r.above, r.above_chars) for r in minhash.above(spark.createDataFrame([(k, k % 7) for k in keys], "key long, chars long")).collect()}
    assert got == {k: (n, n % 7) for k, n in zip(keys, keys[1:] + keys[:1], strict=True)}


def test_bins_and_densification(spark):
    """The plain algorithm: least hash of each bin, then a walk to a bin that is not empty."""
    texts = ["a b c d e f g h", " ".join(map(str, range(300))), " ".join(map(str, range(3000)))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.fp for r in minhash.with_fingerprint(df, "text", "fp").collect()}
    for i, t in enumerate(texts):
        w = [r[0] for r in spark.createDataFrame([(x.decode(),) for x in words(t)], "w string").select(F.xxhash64("w")).collect()]
        rows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        if rows:
            h = [r[0] for r in spark.createDataFrame(rows, "a long, b long, c long, d long, e long").select(F.xxhash64("a", "b", "c", "d", "e")).collect()]
        else:
            h = [spark.createDataFrame([(w,)], "w array<long>").select(F.xxhash64("w")).first()[0]]
        least = {}
        for x in h:
            b = (x >> (64 - minhash.BINS_LOG2)) + minhash.BINS // 2
            least[b] = min(x, least.get(b, x))
        want = []
        for b in range(minhash.BINS):
            walk = ((minhash._STARTS[b] + a * minhash._STRIDES[b]) % minhash.BINS for a in range(minhash.BINS))
            if b not in least:
                lent = spark.range(1).select(F.xxhash64(F.lit(least[next(x for x in walk if x in least)]), F.lit(b))).first()[0]
            want.append((least[b] if b in least else lent) % 256 - 128)
        assert got[i] == want
