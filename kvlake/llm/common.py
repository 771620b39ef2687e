"""What several corpus operators share: words, hashes, storage, id buckets."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.shipping import ship_package
from kvlake.sources.shared import remove_folder, shared_folder

__all__ = ["Rolling", "WordHashes", "batches", "crc_mod", "held_by", "let_go", "map_batches", "mix", "remove_folder", "shared_folder", "split_words", "stored", "table", "trim", "word_hashes"]

MIX_A = np.uint64(0xFF51AFD7ED558CCD)
MIX_B = np.uint64(0xC4CEB9FE1A85EC53)
SHIFT = np.uint64(33)
SLICE = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trim() -> None:
    """Give freed memory back to the system: workers live on and run other stages."""
    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if free is not None:
        free(0)


_HELD: dict[str, dict] = {}


def held_by(operator: str) -> dict:
    """What a worker keeps from task to task of one operator (its module's name)."""
    return _HELD.setdefault(operator, {})


def let_go(operator: str) -> None:
    """Drop what the worker keeps for other operators."""
    for name, held in _HELD.items():
        if name != operator:
            held.clear()


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with this package made available to the workers; batches come in slices of SLICE rows at most."""
    ship_package(df.sparkSession)
    operator = fn.__module__

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(operator)
        try:
            yield from fn(part.slice(k, SLICE) for part in parts for k in range(0, part.num_rows, SLICE))
        finally:
            trim()

    return df.mapInArrow(run, schema)


def split_words(text: str | None) -> list[bytes]:
    """Maximal runs outside U+0020 and U+0009..U+000D, as UTF-8 bytes.

    ``bytes.split`` splits on exactly those six ASCII characters, and UTF-8
    never uses their bytes inside another character.
    """
    return text.encode("utf-8", "surrogatepass").split() if text else []


class WordHashes(dict):
    """word -> 64-bit hash; forgets everything when it holds ``most`` words, and never holds words above LONG bytes."""

    LONG = 64

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= self.LONG:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> SHIFT)
    x = x * MIX_A
    x = x ^ (x >> SHIFT)
    x = x * MIX_B
    return x ^ (x >> SHIFT)


_STEP = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word of a UTF-8 text (words as in ``split_words``).

    A word's hash is a sum over its 8-byte blocks, each mixed together with its number. No
    sum of powers is involved, so words cannot be built that collide whatever the constants.
    """
    data, n = np.frombuffer(raw + bytes(8), np.uint8), len(raw)
    inside = np.empty(n, bool)
    np.not_equal(data[:n], 32, out=inside)
    inside &= (data[:n] - np.uint8(9)) > 4
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    blocks = np.ndarray((n + 1,), "<u8", data.data, strides=(1,))
    length = end - start
    x = blocks[start]
    short = np.flatnonzero(length < 8)
    x[short] &= (np.uint64(1) << (np.uint64(8) * length[short].astype(np.uint64))) - np.uint64(1)
    h = mix(x + _STEP)
    long = np.flatnonzero(length > 8)
    if len(long):
        more = (length[long] - 1) >> 3
        first = np.cumsum(more) - more
        j = np.arange(int(more.sum())) - np.repeat(first, more) + 1
        at = np.repeat(start[long], more) + 8 * j
        left = np.repeat(end[long], more) - at
        x = blocks[at]
        short = np.flatnonzero(left < 8)
        x[short] &= (np.uint64(1) << (np.uint64(8) * left[short].astype(np.uint64))) - np.uint64(1)
        h[long] += np.add.reduceat(mix(x + (j + 1).astype(np.uint64) * _STEP), first)
    return mix(h ^ mix(length.astype(np.uint64))), start, end


class Rolling:
    """Polynomial window hashes mod 2**64 of whole arrays at once.

    For short windows of values that are hashes themselves, and for finding cuts. Windows of
    hundreds of plain bytes can collide by construction, so strings are never told apart by it.

    With an odd base B the prefix sums S[k] = sum(h[i] * B**-i) give the hash
    of the window [i, i+n) as (S[i+n] - S[i]) * B**i.
    """

    def __init__(self, base: int = 0x9E3779B97F4A7C15 | 1):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            step = np.full(size, self.base, np.uint64)
            step[0] = 1
            self.up = np.multiply.accumulate(step)
            step[1:] = self.inverse
            self.down = np.multiply.accumulate(step)

    def prefix(self, h: np.ndarray) -> np.ndarray:
        self._grow(len(h) + 1)
        s = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * self.down[: len(h)], out=s[1:])
        return s

    def windows(self, prefix: np.ndarray, n: int) -> np.ndarray:
        """The mixed hash of every window of n items (none if there are fewer)."""
        count = len(prefix) - n
        if count <= 0:
            return np.zeros(0, np.uint64)
        return mix((prefix[n:] - prefix[:count]) * self.up[:count])


def stored(df: DataFrame, purpose: str, path: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = path or shared_folder(df.sparkSession, purpose)
    schema = df.schema
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def crc_mod(column: str, n: int):
    """crc32 of the decimal text of an id, modulo n; null ids count as remainder 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(0)).cast("int")


def batches(rows: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)
