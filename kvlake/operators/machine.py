"""The state machine of a group: an op log applied strictly in order, with answered requests remembered.

An op of a shard that is not served is refused. An op whose rpc_id does not exceed
what its client has had answered gets the client's last answer again. All others
are applied: Put, Append and Delete change the state, Get reads it.

Refusals and repeats are windows over a client's ops. The state is one pass over
each key's ops in order, in which a worker holds one key's value at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvlake.functions.keys import key2shard
from kvlake.schema import Status
from kvlake.shipping import ship_package

ANSWERED = "client_id bigint, rpc_id bigint, status string, value string"
_FOLDED = "idx bigint, key string, status string, value string"


def _fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, idx, op, value) sorted by key and idx -> a row for each op, and one without idx for each changed key's state."""
    schema = pa.schema([("idx", pa.int64()), ("key", pa.string()), ("status", pa.string()), ("value", pa.string())])
    now, state, changed, rows = None, None, False, []

    def batch() -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    for part in parts:
        for key, idx, op, value in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if key != now:
                if changed:
                    rows.append((None, now, Status.OK.value, state))
                now, state, changed = key, None, False
            status, shown = Status.OK.value, None
            if op == "Get":
                status, shown = (Status.NO_KEY.value, None) if state is None else (status, state)
            else:
                state = None if op == "Delete" else (value or "") if op == "Put" else (state or "") + (value or "")
                changed |= idx >= 0
            if idx >= 0:
                rows.append((idx, key, status, shown))
        yield batch()
    if changed:
        rows.append((None, now, Status.OK.value, state))
    yield batch()


def apply_ops(ops: DataFrame, current: DataFrame, answered: DataFrame | None = None, served: list[int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """ops (OP_LOG), live rows (key, value), answered requests (ANSWERED), served shards (None: all).

    Gives the answers (idx, client_id, rpc_id, status, value, applied), the changed keys
    (key, value; null: deleted) and the requests answered after them.
    """
    spark = ops.sparkSession
    ship_package(spark)
    stored = (spark.createDataFrame([], ANSWERED) if answered is None else answered).selectExpr("client_id", "rpc_id had", "status had_status", "value had_value")
    open_ = F.lit(True) if served is None else key2shard(F.col("key")).isin(served)
    before = Window.partitionBy("client_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    seen = ops.select("idx", "client_id", "rpc_id", "op", "key", "value").withColumn("open", open_).withColumn("prior", F.max(F.when(F.col("open"), F.col("rpc_id"))).over(before)).join(stored, "client_id", "left")
    floor = F.greatest("prior", "had")
    judged = seen.withColumn("applied", F.col("open") & (floor.isNull() | (F.col("rpc_id") > floor)))

    passed = judged.where("applied").select("key", "idx", "op", "value")
    held = current.join(passed.select("key").distinct(), "key", "left_semi").select("key", F.lit(-1).cast("bigint").alias("idx"), F.lit("Put").alias("op"), "value")
    folded = passed.unionByName(held).repartition("key").sortWithinPartitions("key", "idx").mapInArrow(_fold, _FOLDED)

    given = F.when(F.col("applied"), F.struct("status", "value"))
    last = F.last(given, ignorenulls=True).over(before)
    had = F.when(F.col("had").isNotNull(), F.struct(F.col("had_status").alias("status"), F.col("had_value").alias("value")))
    out = judged.drop("value").join(folded.where("idx is not null").select("idx", "status", "value"), "idx", "left")
    refused = F.struct(F.lit(Status.WRONG_GROUP.value).alias("status"), F.lit(None).cast("string").alias("value"))
    answer = F.when(~F.col("open"), refused).otherwise(F.coalesce(given, last, had))
    answers = out.withColumn("answer", answer).select("idx", "client_id", "rpc_id", "answer.status", "answer.value", "applied")

    both = answers.where("applied").select("client_id", "rpc_id", "status", "value").unionByName(stored.selectExpr("client_id", "had rpc_id", "had_status status", "had_value value"))
    after = both.groupBy("client_id").agg(F.max_by(F.struct("rpc_id", "status", "value"), "rpc_id").alias("r")).select("client_id", "r.*")
    return answers, folded.where("idx is null").select("key", "value"), after


def contiguous_end(idx: DataFrame, applied: int) -> int:
    """The last index of the run of indexes that begins right after ``applied``."""
    ahead = idx.where(F.col("idx") > applied).select("idx").distinct()
    ends = ahead.join(ahead.select((F.col("idx") - 1).alias("idx")), "idx", "left_anti").agg(F.min("idx")).first()[0]
    first = ahead.agg(F.min("idx")).first()[0]
    return ends if first == applied + 1 else applied
