"""Language identification and the maximum-entropy model."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import langid, maxent

DOCS = "doc_id long, text string, lang string"
SYLLABLES = {"xx": ["ka", "ro", "mi", "tu", "sek"], "yy": ["öl", "esch", "und", "ver", "gen"], "zz": ["eau", "que", "tion", "ai", "les"]}


def corpus(n=150, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        word = lambda lang=lang: "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 5)))
        rows.append((i, " ".join(word() for _ in range(rng.randrange(5, 80))), lang))
    return rows


def test_languages(spark):
    rows = corpus()
    train = spark.createDataFrame([r for r in rows if r[0] % 3], DOCS)
    asked = [r for r in rows if r[0] % 3 == 0]
    odd = [(1000, None, "xx"), (1001, "", "xx"), (1002, "12 — 34 !!", "yy"), (1003, "KA RO MI TU SEK", None), (None, "eau que tion", "zz"), (5, "öl esch", "yy"), (5, "öl esch", "yy"), (1004, "karomi " * 100_000, None)]
    df = spark.createDataFrame([(*r, "q", 0.5) for r in asked + odd], DOCS + ", score string, lang_pred double")
    got = {}
    for r in langid.identify_languages(df, train).collect():
        got.setdefault(r.id, []).append((r.lang_pred, r.score))
    assert all(got[i][0][0] == lang for i, _, lang in asked)
    assert got[1000] == got[1001] == got[1002] == [("und", 0.0)]
    assert got[1003][0][0] == got[1004][0][0] == "xx" and got[None][0][0] == "zz" and len(got[5]) == 2
    assert all(0 <= s <= 1 for x in got.values() for _, s in x)


def test_short_texts_get_a_language(spark):
    """A text with a letter but without an n-gram goes to the language with the most text."""
    train = spark.createDataFrame([(1, "ka ro mi tu sek " * 9, "xx"), (2, "eau que tion " * 99, "zz"), (3, "öl esch", "yy")], DOCS)
    df = spark.createDataFrame([(1, "a", None), (2, "I", None), (3, " é ", None), (4, "1", None), (5, "qqqqq", None)], DOCS)
    df = df.unionByName(spark.sql("select 6L doc_id, cast(unhex('FFFE') as string) text, cast(null as string) lang"))
    got = {r.id: (r.lang_pred, r.score) for r in langid.identify_languages(df, train).collect()}
    assert got == {1: ("zz", 0.0), 2: ("zz", 0.0), 3: ("zz", 0.0), 4: ("und", 0.0), 5: ("zz", 0.0), 6: ("und", 0.0)}


def test_filters_against_plain_sets(spark):
    """Shares from bit-sliced filters are those of plain sets of n-grams, and so is the language."""
    rows = corpus(seed=4)
    learned = [r for r in rows if r[0] % 3]
    counts = {lang: Counter() for lang in SYLLABLES}
    for _, text, lang in learned:
        b = (" " + text + " ").encode()
        counts[lang].update(g for g in (b[i : i + 4] for i in range(len(b) - 3)) if g != b"    ")
    share = {lang: {g: n / c.total() for g, n in c.items() if n / c.total() >= langid.MIN_SHARE} for lang, c in counts.items()}
    most = Counter()
    for x in share.values():
        for g, p in x.items():
            most[g] = max(most[g], p)
    plain = {lang: {g for g, p in x.items() if p >= langid.MIN_RATIO * most[g]} for lang, x in share.items()}
    filters = langid.train(spark.createDataFrame(learned, DOCS))
    assert filters.languages == sorted(plain)
    for _, text, _ in rows:
        b = (" " + text + " ").encode()
        grams = [b[i : i + 4] for i in range(len(b) - 3)]
        want = [sum(g in plain[lang] for g in grams) / len(grams) for lang in sorted(plain)]
        lang, score = langid.identify(filters, text)
        assert lang == sorted(plain)[int(np.argmax(want))] and score == pytest.approx(max(want), abs=0.002)


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], DOCS)
    df = spark.createDataFrame([(1, "some text", "xx")], DOCS)
    assert [(r.lang_pred, r.score) for r in langid.identify_languages(df, none).collect()] == [("und", 0.0)]
    assert langid.identify_languages(df, df.withColumn("lang", F.lit(None).cast("string"))).count() == 1
    assert langid.identify_languages(none, df).count() == 0


@pytest.mark.parametrize("languages", [3, 9, 70])
def test_filters_miss_nothing_and_know_their_rates(languages):
    rng = np.random.default_rng(languages)
    names = [f"l{i:03d}" for i in range(languages)]
    members = {n: rng.integers(0, 2**32, 20_000, dtype=np.uint32) for n in names}
    f = langid.build(names, members)
    for k in (0, languages // 2, languages - 1):
        assert langid.popcounts(f, members[names[k]])[k] == 20_000
    strange = rng.integers(0, 2**32, 200_000, dtype=np.uint32)
    assert langid.popcounts(f, strange) / 200_000 == pytest.approx(f.rates, abs=0.002)


def test_grams_are_the_bytes():
    g = langid._text_grams("Ab1é")
    data = b" ab \xc3\xa9 "
    assert g.tolist() == [int.from_bytes(data[i : i + 4], "little") for i in range(len(data) - 3)]


def test_blocks_change_nothing(monkeypatch):
    rng = np.random.default_rng(0)
    f = langid.build(["a", "b"], {k: rng.choice(langid._text_grams("the quick brown fox jumps over"), 10) for k in "ab"})
    text = "the quick brown fox jumps over the lazy dog " * 30
    whole = langid.identify(f, text)
    monkeypatch.setattr(langid, "BLOCK", 64)
    assert langid.identify(f, text) == whole


# --- the model ---


def score(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS + ", n_tokens int, word string")
    return maxent.score(df, (F.col("doc_id") % 5 != 1) | F.col("doc_id").isNull(), **kw).collect()


def test_base_counts_and_gain(spark):
    rows = corpus(400, 1) + [(2000, None, None), (2001, "", None), (2001, "", None), (None, "ka ro", None), (2006, "unseen_word " * 3, None)]
    got = score(spark, rows)
    counts = Counter()
    for i, t, _ in rows:
        if i is None or i % 5 != 1:
            counts.update(maxent.tokens((t or "").encode()))
    n, v = sum(counts.values()), len(counts)
    d = n + 0.5 * (v + 1)
    assert len(got) == len(rows) and {r.train_tokens for r in got} == {n}
    want = sorted((repr(i), len(w), sum(x in counts for x in w), sum(math.log10((counts[x] + 0.5) / d) for x in w)) for i, t, _ in rows for w in [maxent.tokens((t or "").encode())])
    have = sorted((repr(r.id), r.n_tokens, r.n_known, r.base_score) for r in got)
    assert [x[:3] for x in have] == [x[:3] for x in want]
    assert [x[3] for x in have] == pytest.approx([x[3] for x in want])
    held = [r for r in got if not r.training]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.03 * sum(r.n_tokens for r in held)
    assert all(r.score <= 1e-6 for r in got)


def test_joined_counts_change_nothing(spark):
    rows = corpus(120, 2)
    whole = sorted((r.id, r.base_score, r.score, r.n_known) for r in score(spark, rows))
    few = sorted((r.id, r.base_score, r.score, r.n_known) for r in score(spark, rows, known=40))
    assert [x[1] for x in few] == pytest.approx([x[1] for x in whole]) and [x[3] for x in few] == [x[3] for x in whole]


def test_probabilities_sum_to_one(spark):
    """Over all known words and the unseen ones of each tail class, after any history."""
    texts = spark.createDataFrame([(t.encode(),) for _, t, _ in corpus(600, 3)], "text binary")
    counts, m = maxent.prepare(texts)
    m = maxent.train(texts, m)
    assert np.abs(m.class_w).max() > 0 and len(m.words) > maxent.HEAD
    coder = m.coder()
    words = [*m.words]
    c = {r.word: r.n for r in counts.collect()}
    assert len(c) == len(words)
    for history in ([], [words[0]], [words[5], words[600], words[2]], [b"never", words[1], words[0]]):
        total = 0.0
        codes, at = maxent._encode(m, [[*history, w] for w in words], coder)
        last = at[np.flatnonzero(np.append(np.diff(at) > 1, True))]
        p = np.exp(maxent.log_probs(m, codes, last))
        for w, x in zip(words, p, strict=True):
            k = coder[w]
            total += x * (1 if m.member_of[k] >= 0 else (c[w] + 0.5) / 10 ** m.tail_log[m.class_of[k]])
        codes, at = maxent._encode(m, [[*history, b"x"]], coder)
        rows = maxent.features(m, codes, at[-1:])
        by_class = maxent._softmax(m.class_bias, m.class_w, rows)[0]
        total += sum(by_class[k] * 0.5 / 10 ** m.tail_log[k] for k in range(maxent.HEAD_CLASSES, maxent.CLASSES))
        assert total == pytest.approx(1, abs=2e-4)


def test_nothing_to_train_on(spark):
    got = score(spark, [(1, "a b", "xx"), (6, None, None)])
    assert [(r.train_tokens, r.n_known, r.base_score) for r in got] == [(0, 0, 0.0)] * 2
    assert score(spark, [(0, None, None)])[0].n_known == 1
    df = spark.createDataFrame([], DOCS)
    assert maxent.score(df, F.lit(True)).count() == 0


def test_a_gradient_step_lowers_the_loss(spark):
    texts = spark.createDataFrame([(t.encode(),) for _, t, _ in corpus(50, 4)], "text binary")
    _, m = maxent.prepare(texts)
    codes, at = maxent._encode(m, [maxent.tokens(t.encode()) for _, t, _ in corpus(50, 4)], m.coder())
    before = maxent.log_probs(m, codes, at).sum()
    top, deep = maxent._Table(m.class_w), maxent._Table(m.member_w)
    maxent.step(m, top, deep, codes, at[:500])
    m.class_w, m.member_w = top.w, deep.w
    assert maxent.log_probs(m, codes, at[:500]).sum() > maxent.log_probs(maxent.Model(**{**m.__dict__, "class_w": m.class_w * 0, "member_w": m.member_w * 0}), codes, at[:500]).sum()
    assert np.isfinite(before)


def test_counts_of_chunks_and_full_tables(monkeypatch):
    """Words, endings and pairs counted by number are those of a plain count, whatever a task holds at a time."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(0, 30))).encode() for _ in range(40)]
    want, pairs = Counter(w for t in texts for w in maxent.tokens(t)), Counter()
    for t in texts:
        e = [maxent.ending(w) for w in maxent.tokens(t)]
        pairs.update(a * maxent.ENDINGS + b for a, b in zip(e, e[1:], strict=False))
    for counted, held in ((1, 5), (50, 5), (50, 10**6), (10**6, 10**6)):
        monkeypatch.setattr(maxent, "COUNTED", counted)
        monkeypatch.setattr(maxent, "HELD", held)
        words, found = Counter(), Counter()
        for b in maxent._count(iter([pa.RecordBatch.from_arrays([pa.array(texts[a : a + 7], pa.binary())], names=["text"]) for a in range(0, 40, 7)])):
            for r in b.to_pylist():
                assert r["kind"] == 1 or r["key"] == maxent.ending(r["word"])
                (found if r["kind"] else words).update({r["key"] if r["kind"] else r["word"]: r["n"]})
        assert words == want and found == pairs


def test_exponentials_of_any_size():
    """Rows far apart, and too large or small for floats, have the shares that doubles give."""
    rng = np.random.default_rng(7)
    for shift in (0.0, 15.0, 200.0, -300.0):
        z = (rng.normal(size=(50, 8)) * 3 + shift * np.arange(50)[:, None] / 49).astype(np.float32)
        e, total, off = maxent._exp(z)
        d = z.astype(np.float64)
        want = np.log(np.exp(d - d.max(axis=1)[:, None]).sum(axis=1)) + d.max(axis=1)
        assert np.allclose(np.log(total) + off, want, rtol=1e-5, atol=1e-4)
        assert np.allclose(e / total[:, None], np.exp(d - want[:, None]), atol=1e-5)


def test_gradients_of_equal_rows_are_added():
    """Runs of all lengths, shorter and longer than RUN."""
    rng = np.random.default_rng(8)
    rows = np.repeat(np.arange(60), np.arange(60) % 25 + 1).astype(np.uint16)
    rng.shuffle(rows)
    grad = rng.normal(size=(len(rows), 4)).astype(np.float32)
    t = maxent._Table(np.zeros((64, 4), dtype=np.float32))
    t.push(rows, grad)
    total = np.zeros((64, 4))
    np.add.at(total, rows, grad)
    step = maxent.RATE * total / np.sqrt((total**2).mean(axis=1, keepdims=True) + 1e-4)
    assert max(np.bincount(rows)) > maxent.RUN and np.allclose(t.w, -step, atol=1e-5) and (t.hits == np.bincount(rows, minlength=64)).all()
