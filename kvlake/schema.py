"""The constant schemas, status words and isolation levels of the engine."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in fields])


S, L, I, B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()

KV_LOG = _struct(("key", S, False), ("value", S, True), ("is_tombstone", B, False), ("version", L, False), ("seq", L, False), ("shard", I, False))
OP_LOG = _struct(("idx", L, False), ("client_id", L, False), ("rpc_id", L, False), ("op", S, False), ("key", S, True), ("value", S, True))
TXN_READS = _struct(("key", S, False), ("version", L, False))
TXN_WRITES = _struct(("key", S, False), ("value", S, True), ("is_delete", B, False))
CONFIG = _struct(("num", I, False), ("shards", T.ArrayType(I), False), ("groups", T.MapType(I, T.ArrayType(S)), False))
HISTORY = _struct(("client_id", I, True), ("op", I, False), ("key", S, False), ("arg", S, True), ("ret", S, True), ("call_ts", L, False), ("return_ts", L, False))

N_SHARDS = 10


class Status(str, Enum):
    OK = "OK"
    NO_KEY = "ErrNoKey"
    WRONG_GROUP = "ErrWrongGroup"
    REPEATED = "ErrRepeated"
    NOT_READY = "ErrNotReady"
    CONFLICT = "ErrConflict"


def parse_status(text: str) -> Status | str:
    """The status word of a text; unknown words pass through."""
    return next((s for s in Status if s.value == text), text)


class Isolation(str, Enum):
    READ_UNCOMMITTED = "ReadUncommitted"
    READ_COMMITTED = "ReadCommitted"
    REPEATABLE_READ = "RepeatableRead"
    SERIALIZABLE = "Serializable"

    @classmethod
    def of(cls, name: str | None) -> Isolation:
        """By name; anything unknown reads committed rows."""
        return next((x for x in cls if x.value == name), cls.READ_COMMITTED)


def check_frame(df, schema: T.StructType) -> None:
    """Refuse a table that lacks a column of ``schema`` or holds it in another type."""
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f.name for f in schema if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"columns missing or of another type: {', '.join(wrong)}")
