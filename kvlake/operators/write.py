"""Mutations as rows, ordered append folds, and request deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvlake.functions.keys import key2shard


def as_log(rows: DataFrame, version: int, seq: int | None = None) -> DataFrame:
    """(key, value) as one batch of puts; a null value is a tombstone. All rows share one version."""
    return rows.select(
        "key", "value", F.col("value").isNull().alias("is_tombstone"), F.lit(version).cast("bigint").alias("version"),
        F.lit(version if seq is None else seq).cast("bigint").alias("seq"), key2shard(F.col("key")).alias("shard"),
    )


def tombstones(keys: DataFrame, version: int) -> DataFrame:
    return as_log(keys.select("key", F.lit(None).cast("string").alias("value")), version)


def as_imported(rows: DataFrame) -> DataFrame:
    """Rows as a migration without history brings them: version 0."""
    return as_log(rows, 0)


def append_fold(log: DataFrame) -> DataFrame:
    """For each key its live values joined in order of version."""
    parts = F.array_sort(F.collect_list(F.struct("version", "seq", "value")))
    return log.where("value is not null").groupBy("key").agg(F.array_join(F.transform(parts, lambda x: x["value"]), "").alias("folded"))


def append_since_put(ops: DataFrame) -> DataFrame:
    """(key, op, value, version): the state after puts, appends and deletes; the fold starts at the last put or delete."""
    whole = Window.partitionBy("key")
    reset = F.max(F.when(F.col("op") != "Append", F.col("version"))).over(whole)
    tail = ops.withColumn("reset", reset).where(F.col("reset").isNull() | (F.col("version") >= F.col("reset"))).where("op <> 'Delete'")
    parts = F.array_sort(F.collect_list(F.struct("version", "value")))
    return tail.groupBy("key").agg(F.array_join(F.transform(parts, lambda x: x["value"]), "").alias("folded"))


def dedup_high_water(ops: DataFrame) -> DataFrame:
    """At most once for each client: an op passes if its rpc_id exceeds all that its client logged before."""
    before = Window.partitionBy("client_id").orderBy("version").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.max("rpc_id").over(before)
    return ops.withColumn("seen", seen).where(F.col("seen").isNull() | (F.col("rpc_id") > F.col("seen"))).drop("seen")


def dedup_exact(ops: DataFrame) -> DataFrame:
    """The first op of each (client, rpc): nothing is lost when a client's ids arrive out of order."""
    return ops.groupBy("client_id", "rpc_id").agg(F.min("version").alias("version"))


def dedup_last(ops: DataFrame) -> DataFrame:
    """Drop an op that repeats its client's previous rpc_id; ids need no order."""
    order = Window.partitionBy("client_id").orderBy("version")
    last = F.lag("rpc_id").over(order)
    return ops.withColumn("last", last).where(F.col("last").isNull() | (F.col("last") != F.col("rpc_id"))).drop("last")


def merge_dedup_tables(*tables: DataFrame) -> DataFrame:
    """Tables (client_id, rpc_id, ...) of several groups joined: the largest rpc_id of a client stays."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("client_id").agg(F.max_by(F.struct(*out.columns), "rpc_id").alias("r")).select("r.*")
