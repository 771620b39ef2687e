"""Packed arrays as shuffle rows, and buckets that meet shuffle partitions one to one.

Millions of small facts (a hash with a document and a place) travel as one row
for each writer and bucket, holding numpy arrays. A row's ``bucket`` is the key
of ``repartition(n, "bucket")``; keys are chosen so that each of the n partitions
gets exactly one bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("docs", pa.binary()), ("at", pa.binary()), ("hash", pa.binary()), ("more", pa.binary())])
DDL = "bucket int, kind int, docs binary, at binary, hash binary, more binary"
NO_ID = np.iinfo(np.int64).max


BUCKET_BYTES = 128 << 20


def bucket_count(rows: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    """As many buckets as shuffle partitions, and more where one would hold over about ``bucket_bytes`` of text."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket_bytes))


def bucket_keys(spark: SparkSession, n: int) -> np.ndarray:
    """For every partition number the least int key that ``repartition(n, key)`` sends there."""
    size = 16
    while True:
        rows = spark.range(size * n).select(F.col("id").cast("int").alias("k")).select("k", F.pmod(F.hash("k"), F.lit(n)).alias("p")).groupBy("p").agg(F.min("k").alias("k")).collect()
        if len(rows) == n:
            return np.array([r.k for r in sorted(rows, key=lambda r: r.p)], np.int32)
        size *= 2


def doc_bucket(ids: np.ndarray, n: int) -> np.ndarray:
    return np.mod(ids ^ (ids >> 7) ^ (ids >> 17), n)


def doc_bucket_column(doc_id: Column, keys: np.ndarray) -> Column:
    """The key of a document's bucket; the same arithmetic as ``doc_bucket``."""
    number = F.pmod(doc_id.bitwiseXOR(F.shiftright(doc_id, 7)).bitwiseXOR(F.shiftright(doc_id, 17)), F.lit(len(keys)))
    return F.element_at(F.lit([int(k) for k in keys]), number.cast("int") + 1)


def _places(at: np.ndarray) -> bytes:
    return at.astype("<u2").tobytes() if not len(at) or at.max() < 1 << 16 else at.astype("<u4").tobytes()


def rows_by(which: np.ndarray, keys: np.ndarray, kind: int, docs: np.ndarray, at: np.ndarray, hashes: np.ndarray | None = None, more: np.ndarray | None = None) -> Iterator[tuple]:
    """A row for each bucket number that occurs in ``which``; items stay in their order."""
    order = np.argsort(which, kind="stable")
    ordered = which[order]
    for part in np.split(order, np.flatnonzero(np.diff(ordered)) + 1) if len(order) else []:
        packed = b"" if hashes is None else hashes[part].astype("<u8").view(np.uint8).reshape(len(part), 8)[:, :6].tobytes()
        yield (int(keys[which[part[0]]]), kind, np.diff(docs[part], prepend=0).astype("<i8").tobytes(), _places(at[part]), packed, b"" if more is None else more[part].tobytes())


def hash_bucket(h: np.ndarray, n: int) -> np.ndarray:
    """Taken from the leading half, of which the packed hash leaves out two bytes."""
    return ((h >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(SCHEMA), SCHEMA, strict=True)], schema=SCHEMA)


def unpack(docs: bytes, at: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.cumsum(np.frombuffer(docs, "<i8"))
    return ids, np.frombuffer(at, "<u2" if len(at) == 2 * len(ids) else "<u4").astype(np.int64)


def unpack_hash(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel()


def dealt(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n, "bucket")
