"""URL rules and the ratio of character models."""

import math
import random

import pytest

from palimpsest.llm import urls

PAGES = "page_id long, url string"


def judge(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES + ", host string, row int")
    return urls.judge(df).collect()


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("http://A.Example.NET/En/x?q#f", ("a.example.net", "/En/x", "net/", "block")),
        ("https://m.example.net/en/25#top", ("m.example.net", "/en/25", "example.net/en/", "allow")),
        ("https://example.net/en", ("example.net", "/en", "net/", "block")),
        ("x://badexample.com/de/1", ("badexample.com", "/de/1", None, None)),
        ("x://example.com/de/1?a=://b", ("example.com", "/de/1", "example.com/de/", "block")),
        ("http://a.org/fr/", ("a.org", "/fr/", "org/fr/", "allow")),
        ("http://net", ("net", "", None, None)),
        ("http://a.net?x/y", ("a.net", "", None, None)),
        ("http://a.net#/", ("a.net", "", None, None)),
        ("no scheme/net/", ("", "", None, None)),
        ("://", ("", "", None, None)),
        ("", ("", "", None, None)),
        (None, ("", "", None, None)),
        ("a b://u@h:80/p\nq?z", ("u@h:80", "/p\nq", None, None)),
    ],
)
def test_parts_and_rules(spark, url, want):
    (r,) = judge(spark, [(1, url)])
    assert (r.host, r.path, r.rule) == want[:3]
    assert r.verdict == (want[3] or "allow")  # nothing is learned from one URL


def test_models_separate(spark):
    rng = random.Random(0)
    good, bad = ["garden", "river", "museum", "letter"], ["xxq", "zzq", "qqz", "xqx"]
    rows = []
    for i in range(600):
        names, host = (good, "org/fr/") if i % 2 else (bad, "net/")
        name = "-".join(rng.choice(names) for _ in range(3))
        tail = {"org/fr/": "org/fr/", "net/": "net/en/"}[host]
        rows.append((i, f"http://{name}.{tail}{rng.randrange(1000)}"))
    asked = [(1000, "http://river-garden-letter.com/en/1"), (1001, "http://xxq-zzq-xqx.com/en/2"), (1001, "http://xxq-zzq-xqx.com/en/2"), (None, "http://museum-river.com/en/3"), (1002, "http://" + "xqx" * 50_000 + ".com/"), (1003, None)]
    got = judge(spark, rows + asked)
    assert len(got) == len(rows) + len(asked)
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r)
    assert [r.verdict for r in by[1001]] == ["block"] * 2 and by[1002][0].verdict == "block"
    assert by[1000][0].verdict == by[None][0].verdict == by[1003][0].verdict == "allow"
    assert all(r.verdict == ("allow" if r.id % 2 else "block") for r in got if r.id is not None and r.id < 600)


def test_ratio_is_the_interpolated_model(spark):
    """Witten-Bell interpolation by hand, over all orders."""
    train = [("abab", "allow", 3), ("abba", "block", 2), ("baab", "allow", 1)]
    model = urls.learn(spark.createDataFrame(train, "url string, verdict string, n long"))
    got = urls.ratios(spark.createDataFrame([(1, "abac")], "row long, url string"), model, "row").first().ratio
    n = {}
    for url, verdict, times in train:
        s = "\2" * 4 + url + "\3"
        for i in range(4, len(s)):
            for k in range(5):
                ctx = n.setdefault(s[i - k : i], {"allow": {}, "block": {}})[verdict]
                ctx[s[i]] = ctx.get(s[i], 0) + times
    kept = {c: v for c, v in n.items() if not c or sum(sum(x.values()) for x in v.values()) >= 2}

    def p(label, ctx, ch):
        out = 1 / 256
        for k in range(5):
            c = kept.get(ctx[4 - k :], {}).get(label)
            if c:
                out = (c.get(ch, 0) + len(c) * out) / (sum(c.values()) + len(c))
        return out

    s = "\2" * 4 + "abac\3"
    want = [math.log(p("allow", s[i - 4 : i], s[i])) - math.log(p("block", s[i - 4 : i], s[i])) for i in range(4, len(s))]
    assert got == pytest.approx(sum(want) / len(want))


def test_no_pages_and_one_class(spark):
    assert urls.judge(spark.createDataFrame([], PAGES)).count() == 0
    got = judge(spark, [(i, f"http://a{i}.net/") for i in range(20)] + [(99, "http://b.com/")])
    assert {r.verdict for r in got if r.id < 99} == {"block"}


def test_calibration(spark):
    rows = [(x / 100, "allow", 1) for x in range(-20, 100)] + [(x / 100, "block", 1) for x in range(-100, -30)]
    assert -0.31 < urls.calibrate(spark.createDataFrame(rows, "ratio double, verdict string, n long")) < -0.19
    assert urls.calibrate(spark.createDataFrame([(1.0, "allow", 1)], "ratio double, verdict string, n long")) == 0
