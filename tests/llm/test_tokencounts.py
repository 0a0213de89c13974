"""Token counts of sections against a plain version."""

import random

import numpy as np
import pytest
import tiktoken

from palimpsest.llm import tokencounts as tc

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def encoding():
    ranks, pattern = tc.ranks_of()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def plain(encoding, text, rule):
    """Character by character: which sections each token touches."""
    sections = text.splitlines(keepends=True) if "\r" not in text else None
    owner = [k for k, s in enumerate(sections) for _ in s]
    counts, at = [0.0] * max(1, len(sections)), 0
    place = [i for i, ch in enumerate(text) for _ in ch.encode()]
    for t in encoding.encode_ordinary(text):
        n = len(encoding.decode_single_token_bytes(t))
        own = [owner[i] for i in sorted(set(place[at : at + n]))]
        at += n
        if rule == "start":
            counts[own[0]] += 1
        elif rule == "majority":
            counts[max(sorted(set(own)), key=own.count)] += 1
        else:
            for k in own:
                counts[k] += 1 / len(own)
    return counts


TEXTS = ["one line", "two\nlines", "\n\n\na\n\n\n\nb\n", "end\n", "é ü\nß — 漢字 🙂🙂\nx", "a.\n\n\n   \n  b", "x" * 3000 + "\n" + "y" * 10]


@pytest.mark.parametrize("rule", tc.RULES)
def test_counts(spark, encoding, rule):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("ab \n.é漢") for _ in range(300)) for _ in range(10)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], DOCS + ", section string, n_tokens int")
    got = {}
    for r in sorted(tc.token_counts(df, rule=rule).collect(), key=lambda r: (r.id, r.section)):
        got.setdefault(r.id, []).append(r)
    for i, t in enumerate(texts):
        assert "".join(t[r.start_char : r.end_char] for r in got[i]) == t
        assert [r.n_tokens for r in got[i]] == pytest.approx(plain(encoding, t, rule))
        assert sum(r.n_tokens for r in got[i]) == pytest.approx(len(encoding.encode_ordinary(t)))


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "a\nb"), (3, "word " * 100_000)]
    got = tc.token_counts(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.id or 0, r.section, r.n_tokens) for r in got)[:5] == [(0, 0, 2.0), (0, 1, 1.0), (1, 0, 0.0), (2, 0, 0.0), (2, 0, 0.0)]
    assert [r.n_tokens for r in got if r.id == 3][0] >= 100_000
    assert tc.token_counts(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError, match="rule"):
        tc.token_counts(spark.createDataFrame(rows, DOCS), rule="other")


def test_attribution_over_three_sections():
    bounds = np.array([0, 2, 3, 9])
    start, end = np.array([0, 1, 5]), np.array([1, 5, 9])
    assert tc.attribute(start, end, bounds, "start").tolist() == [2, 0, 1]
    assert tc.attribute(start, end, bounds, "majority").tolist() == [1, 0, 2]
    assert tc.attribute(start, end, bounds, "split").tolist() == [1.25, 0.25, 1.5]


@pytest.mark.parametrize("text", [" " * 5000 + "x", "a \n" + "\n" * 6000 + "b", "x" + " \t" * 4000 + " y z", " " * 9000, "w" + "　" * 5000 + "é", "a" + "\n" * 4096 + " " * 4096 + " b"])
def test_long_runs_are_cut_where_the_pattern_cuts(encoding, text):
    assert tc.encode(encoding, text) == encoding.encode_ordinary(text)


@pytest.mark.parametrize("text", [" " * 2_000_000, " " * 1_000_000 + "x", "a" * 2_000_000, "7" * 2_000_000, "\n" * 1_000_000 + " b"])
def test_very_long_runs_do_not_crash(encoding, text):
    ids = tc.encode(encoding, text)
    assert encoding.decode(ids) == text
    assert sum(len(encoding.decode_single_token_bytes(i)) for i in ids) == len(text)


def test_blanks_bytes_and_empty_tables(spark):
    df = spark.sql("select 1L doc_id, concat(repeat(' ', 1000000), 'x') text union all select 2L, cast(unhex('61FF0A62') as string)")
    got = sorted((r.id, r.section, r.start_char, r.end_char) for r in tc.token_counts(df).collect())
    assert got == [(1, 0, 0, 1_000_001), (2, 0, 0, 3), (2, 1, 3, 4)]
    assert tc.token_counts(spark.createDataFrame([], DOCS)).count() == 0
