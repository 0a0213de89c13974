"""Scalar functions of the engine as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def checksum(c: Column) -> Column:
    """CRC-32 of the UTF-8 or binary value."""
    return F.crc32(c.cast("binary"))


def encode(c: Column) -> Column:
    return F.encode(c, "UTF-8")


def decode(c: Column) -> Column:
    """Text of UTF-8 bytes; null if they aren't UTF-8."""
    return F.try_validate_utf8(c.cast("string"))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading characters that two strings share."""
    n = F.least(F.length(a), F.length(b))
    differ = F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.when(n == 0, F.lit(0)).otherwise(F.coalesce(F.get(differ, 0) - 1, n))


def pair_bytes(key: Column, value: Column) -> Column:
    """Bytes of a key and its value."""
    return F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))


def bloom_positions(key: Column, bits: int, probes: int = 3) -> list[Column]:
    """Bit positions of a key in a Bloom filter, from one 64-bit hash split in two (double hashing)."""
    h = F.xxhash64(key)
    low, high = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)
    return [F.pmod(low + i * high, F.lit(bits)) for i in range(probes)]
