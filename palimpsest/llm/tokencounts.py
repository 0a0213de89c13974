"""Token counts of a document's sections from one encoding of the whole document.

A document is encoded once. Its tokens' character spans are joined to the sections' spans, and a token that crosses a
boundary is allocated by an explicit rule, so the sections' counts sum to the document's.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import as_text

#: Longer runs of white space are encoded apart: the pattern's look-ahead goes back over a run, and its stack is bounded.
LONG_RUN = 4096
_RUN = regex.compile(rf"\p{{White_Space}}{{{LONG_RUN},}}")

#: start: the section of the token's first character; majority: the section with most of its characters, the first of
#: equals; split: to each section the share of its characters.
RULES = ("start", "majority", "split")


def ranks_of(path: str | None = None) -> tuple[dict[bytes, int], str]:
    """Token ranks of a .tiktoken file (default: the installed byte_bpe_50k) and the pattern that cuts texts."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, public_tokenizers.PATTERN


def encode(encoding: tiktoken.Encoding, text: str) -> list[int]:
    """Token ids of a whole text of any content.

    The pattern takes a run of white space as one piece but for its last character, which may belong to the word
    after it; a run that ends the text is one piece. So a long run can be cut out and encoded as that piece.
    """
    ids, at = [], 0
    for m in _RUN.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        ids += encoding.encode_ordinary(text[at : m.start()])
        ids += encoding._encode_single_piece(text[m.start() : end])
        at = end
    return ids + encoding.encode_ordinary(text[at:])


def spans(text: str, ids: list[int], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and the one after the last of each token; a token with part of a character holds it whole."""
    ends = np.cumsum(lengths[np.array(ids, dtype=np.int64)])
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    return char[np.concatenate([[0], ends[:-1]])], char[ends - 1] + 1


def attribute(start: np.ndarray, end: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section. bounds: the sections' first characters, rising from 0, and the text's length."""
    n = len(bounds) - 1
    first = np.searchsorted(bounds, start, side="right") - 1
    if rule == "start":
        return np.bincount(first, minlength=n).astype(np.float64)
    last = np.searchsorted(bounds, end - 1, side="right") - 1
    out = np.bincount(first[first == last], minlength=n).astype(np.float64)
    for i in np.flatnonzero(first != last):
        k = np.arange(first[i], last[i] + 1)
        share = np.minimum(end[i], bounds[k + 1]) - np.maximum(start[i], bounds[k])
        if rule == "majority":
            out[k[np.argmax(share)]] += 1
        else:
            out[k] += share / share.sum()
    return out


def section_bounds(text: str, separator: str = "\n") -> np.ndarray:
    """Sections end with the separator, which belongs to them; the last ends with the text."""
    out, at = [0], text.find(separator)
    while at >= 0:
        at += len(separator)
        if at < len(text):
            out.append(at)
        at = text.find(separator, at)
    return np.array([*out, len(text)], dtype=np.int64)


_SECTIONS = "array<struct<section: int, start_char: long, end_char: long, n_tokens: double>>"


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: str = "majority", separator: str = "\n", path: str | None = None) -> DataFrame:
    """(id, section, start_char, end_char, n_tokens) for every section of every row.

    Sections are the pieces of the text up to and with each separator. A null or empty text has one empty section
    without tokens. Repeated rows are all returned, an empty table gives none. Whole texts are encoded, very long ones and
    those of a single run of blanks, letters or digits too; a row's result is made from that row alone. With "majority"
    the first of sections with equally many characters of a token gets it. Bytes that aren't UTF-8 count as U+FFFD. Other
    columns are not read, whatever they are called.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ranks_of(path))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ranks, pattern = shared.value
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        lengths[list(ranks.values())] = [len(b) for b in ranks]
        kind = pa.struct([("section", pa.int32()), ("start_char", pa.int64()), ("end_char", pa.int64()), ("n_tokens", pa.float64())])
        for batch in batches:
            offsets, cols = [0], ([], [], [], [])
            for x in batch:
                text = as_text(x) or ""
                bounds = section_bounds(text, separator)
                n = len(bounds) - 1
                counts = attribute(*spans(text, encode(encoding, text), lengths), bounds, rule) if text else np.zeros(1)
                for c, part in zip(cols, (np.arange(n, dtype=np.int32), bounds[:-1], bounds[1:], counts), strict=True):
                    c.append(part)
                offsets.append(offsets[-1] + n)
            joined = [np.concatenate(c) if c else np.zeros(0) for c in cols]
            values = pa.StructArray.from_arrays([pa.array(a).cast(f.type) for a, f in zip(joined, kind, strict=True)], fields=list(kind))
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    d = docs.select(F.col(id_col).alias("id"), F.explode(F.arrow_udf(run, _SECTIONS)(F.col(text_col).cast("binary"))).alias("s"))
    return d.select("id", "s.*")
