"""URL filtering by rules and, where none fits, by the ratio of two character language models.

One smoothed variable-order Markov model is learned from accepted URLs and one from rejected ones. A URL is judged by
the difference of the two log-likelihoods, divided by its length, against a threshold calibrated on URLs that neither
model has seen. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import ascii_lower, written

#: (host, start of the path, verdict). A rule fits its host and all subdomains.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
ORDER = 4
#: A context is kept if it is seen twice and makes up this share of all positions: at most 1 / CONTEXT_SHARE contexts
#: of each length; their following characters are kept by FOLLOWER_SHARE. That bounds what is broadcast.
CONTEXT_SHARE, FOLLOWER_SHARE, LEAST = 2e-5, 4e-6, 2
ALPHABET = 256.0
FOLDS = 5
#: URLs of a task that spreads them out by character, and rows of one (id, url) that are made at a time.
URLS, COPIES = 4096, 4096
_START, _END = "\u0002", "\u0003"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ://."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    ok = url.isNotNull() & (at > 0)
    return F.when(ok, ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))).otherwise(""), F.when(ok, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, like ``net/``, and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _windows(urls: DataFrame, *keep: str) -> DataFrame:
    """A row (keep, g) for each character and the end of a URL: g is the ORDER characters before it, and it."""
    text = F.concat(F.lit(_START * ORDER), ascii_lower(F.coalesce("url", F.lit(""))), F.lit(_END))
    # A column of its own, used often: the lambda then reads it and doesn't split again.
    chars = urls.select(*keep, F.split(text, "").alias("c"))
    c = F.col("c")
    grams = F.transform(F.sequence(F.lit(0), F.size(c) - ORDER - 1), lambda i: F.concat(*(F.get(c, i + k) for k in range(ORDER + 1))))
    return chars.filter(F.size(c) > ORDER).select(*keep, F.explode(grams).alias("g"))


def learn(urls: DataFrame, context_share: float = CONTEXT_SHARE, follower_share: float = FOLLOWER_SHARE, least: int = LEAST) -> DataFrame:
    """(context, na, ta, nr, tr, next): the model, for URLs in (url, verdict, n), n copies each.

    na: times the context occurs in accepted URLs, ta: distinct characters after it there; nr, tr: in rejected ones;
    next: counts (a, r) by character.
    """
    n = F.col("n")
    seen = _windows(urls.filter("verdict is not null"), "verdict", "n").groupBy("g").agg(F.sum(F.when(F.col("verdict") == "allow", n).otherwise(0)).alias("a"), F.sum(F.when(F.col("verdict") == "block", n).otherwise(0)).alias("r"))
    seen = written(seen, "grams")
    total = seen.agg(F.coalesce(F.sum(F.col("a") + F.col("r")), F.lit(0))).first()[0]
    out = None
    for k in range(ORDER + 1):
        gram = F.substring("g", ORDER + 1 - k, k + 1)
        g = seen.groupBy(gram.alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        g = g.select(F.substring("g", 1, k).alias("context"), F.substring("g", k + 1, 1).alias("ch"), "a", "r")
        kept = F.col("a") + F.col("r") >= follower_share * total
        entry = F.when(kept, F.struct(F.col("ch").alias("key"), F.struct("a", "r").alias("value")))
        level = g.groupBy("context").agg(F.sum("a").alias("na"), F.sum((F.col("a") > 0).cast("long")).alias("ta"), F.sum("r").alias("nr"), F.sum((F.col("r") > 0).cast("long")).alias("tr"), F.map_from_entries(F.collect_list(entry)).alias("next"))
        if k:
            level = level.filter(F.col("na") + F.col("nr") >= max(least, context_share * total))
        out = level if out is None else out.unionByName(level)
    return written(out, "urlmodel")


def ratios(urls: DataFrame, model: DataFrame, key: str) -> DataFrame:
    """(key, ratio): mean log-likelihood difference, accepted minus rejected, per character.

    A context interpolates its counts with the estimate of the context one shorter, Witten-Bell style; contexts that
    the model lacks are skipped, so the order varies from place to place.
    """
    d = _windows(urls, key).withColumn("ch", F.substring("g", ORDER + 1, 1))
    small = F.broadcast(model)  # bounded by context_share and follower_share
    pa, pr = F.lit(1 / ALPHABET), F.lit(1 / ALPHABET)
    for k in range(ORDER + 1):
        names = {c: f"{c}{k}" for c in model.columns}
        d = d.withColumn(f"at{k}", F.substring("g", ORDER + 1 - k, k)).join(small.select(*(F.col(c).alias(x) for c, x in names.items())), F.col(f"at{k}") == F.col(f"context{k}"), "left")
        n = F.try_element_at(F.col(f"next{k}"), F.col("ch"))
        d = d.withColumn(f"pa{k}", _mixed(n["a"], f"na{k}", f"ta{k}", pa)).withColumn(f"pr{k}", _mixed(n["r"], f"nr{k}", f"tr{k}", pr))
        pa, pr = F.col(f"pa{k}"), F.col(f"pr{k}")
        d = d.select(key, "g", "ch", pa, pr)
    return d.groupBy(key).agg(F.avg(F.log(pa) - F.log(pr)).alias("ratio"))


def _mixed(count: Column, n: str, kinds: str, shorter: Column) -> Column:
    return F.when(F.col(n) > 0, (F.coalesce(count, F.lit(0)) + F.col(kinds) * shorter) / (F.col(n) + F.col(kinds))).otherwise(shorter)


def calibrate(scored: DataFrame) -> float:
    """Threshold on ratio with the best mean of the two classes' accuracies on (ratio, verdict, n), in the middle of a
    gap and nearest to 0 of equals; 0 if a class is missing. Read off a histogram of at most 3201 bins."""
    b = F.greatest(F.lit(-1600), F.least(F.lit(1600), F.floor(F.col("ratio") * 200))).cast("int")
    bins: dict[int, list[int]] = {}
    for r in scored.groupBy(b.alias("b"), "verdict").agg(F.sum("n").alias("n")).collect():
        bins.setdefault(r.b, [0, 0])[r.verdict == "block"] += r.n
    good, bad = (sum(x[k] for x in bins.values()) for k in (0, 1))
    if not good or not bad:
        return 0.0
    best, below_good, below_bad = (0.5, 0.0), 0, 0
    held = sorted(bins)
    for k, after in zip(held, held[1:], strict=False):
        below_good, below_bad = below_good + bins[k][0], below_bad + bins[k][1]
        at = (k + 1 + after) / 400
        score = ((good - below_good) / good + below_bad / bad) / 2
        if (score, -abs(at)) > (best[0], -abs(best[1])):
            best = (score, at)
    return best[1]


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, context_share: float = CONTEXT_SHARE, follower_share: float = FOLLOWER_SHARE) -> DataFrame:
    """(id, host, path, rule, verdict, ratio) for every row; ratio is null where no model was asked.

    The longest fitting rule decides. Elsewhere the models do, learned from the URLs that a rule decides: a fifth of
    those (by hash of the URL) calibrates the threshold, the rest trains. A URL whose ratio is below the threshold is
    blocked; a null or empty URL is allowed, as there is nothing to hold against it. Repeated rows count as often as
    they occur and are all returned; null ids stay null; an empty table gives none. Ties of rules go to the one listed
    last, a ratio at the threshold is allowed. Very long URLs are read whole. Rows are folded by (id, url) and dealt out
    evenly before anything is spread out by character, and only bounded model tables are broadcast: contexts and
    characters after them below ``context_share`` and ``follower_share`` of all positions are not in them. Other columns
    are not read, whatever they are called.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).groupBy("id", "url").agg(F.count("*").alias("n"))
    host, path = host_and_path(F.col("url"))
    rows = rows.withColumn("host", host).withColumn("path", path)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = written(rows.withColumn("rule", rule).withColumn("verdict", verdict).withColumn("row", F.monotonically_increasing_id()), "urls")
    held = F.pmod(F.xxhash64("url"), F.lit(FOLDS)) == 0
    # URLs are few bytes and many characters: they are dealt by their number, not by their size.
    dealt = rows.filter("url is not null and url <> ''").repartition(max(1, -(-rows.count() // URLS)), "row")
    ruled = dealt.filter("verdict is not null")
    model = learn(ruled.filter(~held), context_share, follower_share)
    scored = written(ratios(dealt.filter(F.col("verdict").isNull() | held).select("row", "url"), model, "row"), "ratios")
    threshold = calibrate(ruled.filter(held).join(scored, "row"))
    out = rows.join(scored, "row", "left")
    own = F.when(F.col("ratio") < threshold, "block").otherwise("allow")
    out = out.withColumn("verdict", F.coalesce("verdict", own)).withColumn("__n", F.col("n"))
    # In two steps, so that a row repeated very often is no very large array.
    out = out.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / COPIES))))
    copies = F.least(F.lit(COPIES).cast("long"), F.col("__n") - F.col("__part") * COPIES).cast("int")
    return out.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), copies))).select("id", "host", "path", "rule", "verdict", "ratio")
