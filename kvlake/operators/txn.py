"""Optimistic transactions: snapshot reads, write overlay, read-set validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlake.functions.keys import in_range, shard_of
from kvlake.operators import read
from kvlake.schema import TXN_READS, TXN_WRITES, Isolation, Status


def overlay(live: DataFrame, writes: DataFrame) -> DataFrame:
    """Live rows (key, value, version) with pending writes (key, value, is_delete) laid over: writes win, deletes remove."""
    own = writes.select("key", F.col("value").alias("own"), "is_delete")
    joined = live.join(own, "key", "full_outer").where("coalesce(is_delete, false) = false")
    return joined.select("key", F.when(F.col("is_delete").isNotNull(), F.col("own")).otherwise(F.col("value")).alias("value"), "version")


def overlay_range(log: DataFrame, writes: DataFrame, start: str, end: str, snapshot: int | None, limit: int = 0) -> DataFrame:
    """A range at a snapshot under the transaction's own writes; the limit counts what is left after them."""
    pending = writes.where(in_range(F.col("key"), start, end))
    out = overlay(read.range_scan(log, start, end, snapshot), pending).select("key", "value").orderBy("key")
    return out.limit(limit) if limit > 0 else out


def conflicts(log: DataFrame, reads: DataFrame) -> DataFrame:
    """Reads (key, version; 0: no row) whose key has another newest version by now."""
    now = read.newest(log.join(reads.select("key").distinct(), "key", "left_semi")).select("key", F.col("version").alias("current"))
    joined = reads.select("key", F.col("version").alias("seen")).join(now, "key", "left")
    return joined.select("key", "seen", F.coalesce("current", F.lit(0)).cast("bigint").alias("current")).where("seen <> current")


def write_conflicts(log: DataFrame, writes: DataFrame, snapshot: int) -> DataFrame:
    """Written keys that somebody else wrote after the snapshot."""
    return log.where(F.col("version") > snapshot).join(writes.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.max("version").alias("current"))


class TransactionError(Exception):
    def __init__(self, status: Status | str):
        super().__init__(str(getattr(status, "value", status)))
        self.status = status


class Transaction:
    """A transaction of a store.

    By default it is one of the service: it belongs to one shard, that of its first
    key, and reads its begin snapshot at every level. RepeatableRead and Serializable
    validate every key read; Serializable also reads its ranges again, so rows that
    appeared in them are conflicts; the other levels validate nothing. ``write_checks``
    adds write-write conflicts.

    An ``embedded`` one spans all shards. ReadCommitted reads the newest committed rows
    at each read. ReadUncommitted writes at once, so others see its writes before it
    ends, and takes them back by compensating writes if it is aborted. RepeatableRead
    and Serializable read their snapshot and always check written keys as well.

    A transaction that is idle for longer than the store's limit is gone: its
    snapshot may be compacted, so it reads and commits no more.
    """

    def __init__(self, store, level: Isolation = Isolation.REPEATABLE_READ, write_checks: bool = False, embedded: bool = False):
        self.store, self.level, self.embedded = store, level, embedded
        self.write_checks = write_checks or (embedded and level in (Isolation.REPEATABLE_READ, Isolation.SERIALIZABLE))
        self.shard: int | None = None
        self.snapshot: int | None = None
        self.valid, self.closed = True, False
        self.reads: dict[str, int] = {}
        self.values: dict[str, str | None] = {}
        self.writes: dict[str, str | None] = {}
        self.undo: dict[str, str | None] = {}
        self.ranges: list[tuple[str, str]] = []

    def _begin(self, key: str) -> bool:
        shard = shard_of(key)
        if self.closed or (self.shard not in (None, shard) and not self.embedded):
            self.valid = False
            return False
        if self.snapshot is None:
            self.shard = None if self.embedded else shard
            self.snapshot = self.store.begin(self)
        return self.valid

    def _seen(self) -> None:
        if not self.store.touch(self):
            self.closed = True
            raise TransactionError(Status.CONFLICT)

    def _log(self) -> DataFrame:
        return self.store.log() if self.shard is None else self.store.shard(self.shard)

    @property
    def _latest(self) -> bool:
        return self.embedded and self.level in (Isolation.READ_COMMITTED, Isolation.READ_UNCOMMITTED)

    def get(self, key: str) -> str | None:
        if not self._begin(key):
            raise TransactionError(Status.WRONG_GROUP)
        self._seen()
        if key in self.writes:
            return self.writes[key]
        if self._latest:
            return read.get(self._log(), key).first().value
        if key not in self.values:
            row = read.get(self._log(), key, self.snapshot).first()
            self.reads.setdefault(key, row.version)
            self.values[key] = row.value
        return self.values[key]

    def _set(self, key: str, value: str | None) -> bool:
        if not self._begin(key):
            return False
        if self.embedded and self.level is Isolation.READ_UNCOMMITTED:
            if key not in self.undo:
                self.undo[key] = read.get(self._log(), key).first().value
            return self.store.commit(self._frame({key: value})) is Status.OK
        self.writes[key] = value
        return True

    def put(self, key: str, value: str) -> bool:
        return self._set(key, value)

    def remove(self, key: str) -> bool:
        return self._set(key, None)

    def _frame(self, rows: dict[str, str | None]) -> DataFrame:
        return self.store.spark.createDataFrame(list(rows.items()), "key string, value string")

    def scan(self, start: str, end: str, limit: int = 0) -> DataFrame:
        """(key, value) of a range under the transaction's own writes. Nothing of it comes to the driver.

        In the service both ends must start with the same byte, so that one shard holds the range.
        """
        same = self.embedded or (start and end and start.encode()[0] == end.encode()[0])
        if not same or not self._begin(start):
            self.valid = False
            raise TransactionError(Status.WRONG_GROUP)
        self._seen()
        pending = self.store.spark.createDataFrame([(k, v, v is None) for k, v in self.writes.items()], TXN_WRITES)
        if not self._latest:
            self.ranges.append((start, end))
        return overlay_range(self._log(), pending, start, end, None if self._latest else self.snapshot, limit)

    def range(self, start: str, end: str, limit: int = 0) -> list[tuple[str, str]]:
        """The rows of ``scan`` as a list, for ranges that fit the driver."""
        return [(r.key, r.value) for r in self.scan(start, end, limit).collect()]

    def _conflict(self) -> bool:
        if self.level not in (Isolation.REPEATABLE_READ, Isolation.SERIALIZABLE):
            return False
        spark, log = self.store.spark, self._log()
        if self.reads and not conflicts(log, spark.createDataFrame(list(self.reads.items()), TXN_READS)).isEmpty():
            return True
        if self.write_checks and self.writes and not write_conflicts(log, spark.createDataFrame([(k,) for k in self.writes], "key string"), self.snapshot).isEmpty():
            return True
        for start, end in self.ranges:
            rows = log.where(in_range(F.col("key"), start, end))
            newer = rows.where(F.col("version") > self.snapshot)
            if self.level is not Isolation.SERIALIZABLE:  # only rows that were read, not ones that appeared
                newer = newer.join(read.snapshot_scan(rows, self.snapshot), "key", "left_semi")
            if not newer.isEmpty():
                return True
        return False

    def commit(self) -> Status:
        if not self.valid or self.closed:
            self.abort()
            return Status.WRONG_GROUP
        self.closed = True
        try:
            if self.snapshot is None:
                return Status.OK
            if not self.store.touch(self):
                return Status.CONFLICT
            return self.store.commit(self._frame(self.writes) if self.writes else None, check=lambda: not self._conflict())
        finally:
            self.store.end(self)

    def abort(self) -> None:
        if self.undo and not self.closed:
            self.store.commit(self._frame(self.undo))
        self.closed = True
        self.store.end(self)
