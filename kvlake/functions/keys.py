"""Scalar functions of keys and values, as columns and, where the driver needs them, in Python."""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvlake.schema import N_SHARDS


def key2shard(key: Column, shards: int = N_SHARDS) -> Column:
    """First UTF-8 byte modulo the number of shards; the empty key belongs to shard 0."""
    first = F.conv(F.hex(F.substring(F.encode(key, "UTF-8"), 1, 1)), 16, 10).cast("int")
    return F.when(key == "", F.lit(0)).otherwise(F.pmod(first, F.lit(shards))).cast("int")


def shard_of(key: str, shards: int = N_SHARDS) -> int:
    raw = key.encode()
    return raw[0] % shards if raw else 0


def shards_of_range(start: str, end: str, shards: int = N_SHARDS) -> list[int]:
    """The shards that can hold keys of [start, end); an empty end is open. For partition pruning."""
    low = start.encode()[0] if start else 0
    high = end.encode()[0] if end else 255
    found = {b % shards for b in range(low, high + 1)} if high - low < shards else set(range(shards))
    return sorted(found | ({0} if not start else set()))


def in_range(key: Column, start: str = "", end: str = "") -> Column:
    low = key >= F.lit(start)
    return low & (key < F.lit(end)) if end else low


def prefix_successor(prefix: str) -> str:
    """The least string above every string with this prefix; '' if there is none."""
    for k in range(len(prefix) - 1, -1, -1):
        code = ord(prefix[k]) + 1
        if code == 0xD800:
            code = 0xE000
        if code <= 0x10FFFF:
            return prefix[:k] + chr(code)
    return ""


def decode_stored(value: Column) -> Column:
    """Strip the one-byte tag that raw exports put before live values."""
    return F.when(value.startswith("\x01"), F.substring(value, 2, 2**31 - 1)).otherwise(value)


def encode_stored(value: Column) -> Column:
    return F.concat(F.lit("\x01"), value)


def checksum(value: Column) -> Column:
    return F.crc32(F.encode(value, "UTF-8"))


def entry_bytes(key: Column, value: Column) -> Column:
    return F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))


def fits_store(key: Column, value: Column, limit: int = 65_535) -> Column:
    """Whether lengths stay within the two-byte length fields of raw exports."""
    return (F.octet_length(key) <= limit) & (F.coalesce(F.octet_length(value), F.lit(0)) <= limit)


class Bloom:
    """A Bloom filter built by Spark: bits are set by seeded hashes and kept as 64-bit words.

    ``n`` and ``p`` fix the number of bits, so the words that reach the driver are bounded.
    """

    MOST = 1_000_000  # keys a filter is sized for; more keys only make more false positives

    def __init__(self, n: int = 65_536, p: float = 0.1):
        self.bits = max(64, math.ceil(-n * math.log(p) / math.log(2) ** 2))
        self.hashes = max(1, math.ceil(self.bits / n * math.log(2)))
        self.words: dict[int, int] = {}

    @classmethod
    def of(cls, df: DataFrame, key: str, p: float = 0.1) -> Bloom:
        """A filter of a table's keys, sized by their number up to MOST."""
        n = df.agg(F.approx_count_distinct(key)).first()[0]
        return cls(min(cls.MOST, max(1000, n)), p).build(df, key)

    def _places(self, key: Column) -> Column:
        return F.array(*[F.pmod(F.xxhash64(key, F.lit(k)), F.lit(self.bits)) for k in range(self.hashes)])

    def build(self, df: DataFrame, key: str) -> Bloom:
        places = df.select(F.explode(self._places(F.col(key))).alias("b"))
        rows = places.groupBy(F.floor(F.col("b") / 64).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(b, 64) as int)))").alias("x"))
        self.words = {r.w: r.x for r in rows.collect()}
        return self

    def to_bytes(self) -> bytes:
        return struct.pack("<qi", self.bits, self.hashes) + b"".join(struct.pack("<q", self.words.get(w, 0)) for w in range(self.bits // 64 + 1))

    @classmethod
    def from_bytes(cls, raw: bytes) -> Bloom:
        out = cls()
        out.bits, out.hashes = struct.unpack_from("<qi", raw)
        out.words = {w: x for w, (x,) in enumerate(struct.iter_unpack("<q", raw[12:])) if x}
        return out

    def may_contain(self, key: Column) -> Column:
        table = F.lit([self.words.get(w, 0) for w in range(self.bits // 64 + 1)])

        def bit(b: Column) -> Column:
            return F.getbit(F.element_at(table, F.floor(b / 64).cast("int") + 1), F.pmod(b, F.lit(64)).cast("int")) == 1

        return F.forall(self._places(key), bit)
