"""Language identification with bit-sliced Bloom filters over character n-grams.

Each language has a Bloom filter of the n-grams that are frequent in it. The filters are stored sliced by position:
slot p holds one bit per language, so three slot reads and an AND return all languages that contain an n-gram. A text
goes to the language with the highest share of contained n-grams, after the filters' false positives are taken out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import as_text

#: Bytes of an n-gram; its id is those bytes, so different n-grams never share one.
N = 4
SLOTS_LOG2 = 20
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: An n-gram belongs to a language if it has this share of the language's n-grams (which bounds a filter at
#: 1 / MIN_SHARE entries) and at least MIN_RATIO of the largest share it has in any language.
MIN_SHARE, MIN_RATIO = 1e-5, 0.1
UNKNOWN = "und"
#: Bytes that are handled at a time, and distinct n-grams a training task holds before it emits them.
BLOCK, HELD = 1 << 21, 1 << 21

_LETTER = regex.compile(r"\p{L}")
#: ASCII letters and bytes of other characters stay; all else is a space.
_CLASSES = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normalised(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "surrogatepass").translate(_CLASSES) + b" "


def grams(data: np.ndarray) -> np.ndarray:
    """Ids of all n-grams of a byte array, uint32 each."""
    if len(data) < N:
        return np.zeros(0, dtype=np.uint32)
    b = data.astype(np.uint32)
    return b[:-3] | (b[1:-2] << 8) | (b[2:-1] << 16) | (b[3:] << 24)


_BLANK = np.uint32(0x20202020)


def _text_grams(text: str) -> np.ndarray:
    g = grams(np.frombuffer(normalised(text), dtype=np.uint8))
    return g[g != _BLANK]


@dataclass
class Filters:
    """slots[s][p]: bits of languages 64 s to 64 s + 63 at slot p; rates: false positive rate by language; usual: the place
    of the language with the most n-grams, which stands for texts that say nothing."""

    languages: list[str]
    slots: list[np.ndarray]
    rates: np.ndarray
    usual: int = 0


def _places(ids: np.ndarray) -> list[np.ndarray]:
    x = ids.astype(np.uint64) + np.uint64(1)
    return [((x * np.uint64(m)) >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64) for m in MULTIPLIERS]


def build(languages: list[str], members: dict[str, np.ndarray], usual: int = 0) -> Filters:
    """Filters of the n-gram ids in ``members`` by language."""
    width = np.uint8 if len(languages) <= 8 else np.uint64
    per = 8 if len(languages) <= 8 else 64
    slots = [np.zeros(1 << SLOTS_LOG2, dtype=width) for _ in range(0, max(1, len(languages)), per)]
    rates = np.zeros(len(languages))
    for k, lang in enumerate(languages):
        bit = width(1 << (k % per))
        for p in _places(members.get(lang, np.zeros(0, dtype=np.uint32))):
            slots[k // per][p] |= bit
        rates[k] = np.mean(slots[k // per] & bit > 0) ** len(MULTIPLIERS)
    return Filters(languages, slots, rates, usual)


def popcounts(filters: Filters, ids: np.ndarray) -> np.ndarray:
    """For each language, how many of the n-grams its filter contains."""
    out, places = [], _places(ids)
    per = filters.slots[0].itemsize * 8
    for s in filters.slots:
        got = s[places[0]] & s[places[1]] & s[places[2]]
        if per == 8:
            by = np.bincount(got, minlength=256)
            out += [int(by[(np.arange(256) >> k) & 1 == 1].sum()) for k in range(8)]
        else:
            out += [int(np.count_nonzero(got & np.uint64(1 << k))) for k in range(64)]
    return np.array(out[: len(filters.languages)], dtype=np.float64)


def identify(filters: Filters, text: str | None) -> tuple[str, float]:
    """(language, share of the n-grams it explains); und and 0 without a letter or a learned language.

    A text too short for an n-gram, or without any that a filter holds, gets the language with the most text and 0.
    """
    if text is None or not filters.languages or not _LETTER.search(text):
        return UNKNOWN, 0.0
    data = np.frombuffer(normalised(text), dtype=np.uint8)
    hits, n = np.zeros(len(filters.languages)), 0
    for at in range(0, len(data) - N + 1, BLOCK):
        g = grams(data[at : at + BLOCK + N - 1])
        g = g[g != _BLANK]
        hits, n = hits + popcounts(filters, g), n + len(g)
    if not n:
        return filters.languages[filters.usual], 0.0
    share = np.maximum(hits / n - filters.rates, 0) / np.maximum(1 - filters.rates, 1e-9)
    k = int(np.argmax(share)) if share.any() else filters.usual  # languages are sorted: ties go to the first by code point
    return filters.languages[k], float(min(1.0, share[k]))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    waiting: dict[str, list[np.ndarray]] = {}
    size: dict[str, int] = {}

    def fold(lang: str) -> None:
        ids, n = np.unique(np.concatenate(waiting.pop(lang)), return_counts=True)
        if lang in held:
            both, at = np.unique(np.concatenate([held[lang][0], ids]), return_inverse=True)
            ids, n = both, np.bincount(at, weights=np.concatenate([held[lang][1], n])).astype(np.int64)
        held[lang], size[lang] = (ids, n), 0

    def out() -> Iterator[pa.RecordBatch]:
        for lang in list(waiting):
            fold(lang)
        for lang, (ids, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ids), pa.string()), pa.array(ids.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            lang, text = lang.as_py(), as_text(text)
            data = np.frombuffer(normalised(text), dtype=np.uint8)
            for at in range(0, len(data) - N + 1, BLOCK):
                g = grams(data[at : at + BLOCK + N - 1])
                g = g[g != _BLANK]
                waiting.setdefault(lang, []).append(g)
                size[lang] = size.get(lang, 0) + len(g)
                if size[lang] >= BLOCK:
                    fold(lang)
        if sum(len(x[0]) for x in held.values()) > HELD:
            yield from out()
    yield from out()


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_share: float = MIN_SHARE, min_ratio: float = MIN_RATIO) -> Filters:
    """Filters learned from all rows of ``docs`` that have a text and a language.

    N-gram counts of all rows are summed per language; the driver gets only the n-grams that pass ``min_share``, at most
    1 / min_share per language.
    """
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).cast("binary").alias("text")).filter("lang is not null and text is not null")
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(totals, "lang").filter(F.col("n") >= min_share * F.col("total")).select("lang", "gram", (F.col("n") / F.col("total")).alias("share"), "total")
    got = shares.toArrow().to_pandas()
    if got.empty:
        return build([], {})
    top = got.groupby("gram")["share"].transform("max")
    kept = got[got["share"] >= min_ratio * top]
    members = {lang: g["gram"].to_numpy().astype(np.uint32) for lang, g in kept.groupby("lang")}
    languages = sorted(members)
    size = got.groupby("lang")["total"].max()
    return build(languages, members, max(range(len(languages)), key=lambda k: (size[languages[k]], -k)))


def predict(text: Column, filters: Filters, spark) -> Column:
    """struct(lang, score) of a text column."""
    shared = spark.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [identify(shared.value, as_text(x)) for x in batch]
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["lang", "score"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "lang string, score double")(text.cast("binary"))


def identify_languages(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang_pred, score) for every row of ``docs``, learned from the labelled rows of ``training``.

    A null text, a text without a letter, and every text if nothing was learned get 'und' and score 0. Ties go to the
    language that sorts first; a text with a letter but without a learned n-gram gets the language with the most text
    and score 0. Whole texts of any length are read in blocks; bytes that aren't UTF-8 are no letters; repeated rows are
    all returned; columns other than the named ones are not read, whatever they are called.
    """
    filters = train(training, text_col, lang_col)
    found = docs.select(F.col(id_col).alias("id"), predict(F.col(text_col), filters, docs.sparkSession).alias("found"))
    return found.select("id", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
