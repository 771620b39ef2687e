"""Readers of op logs and of tables that serve as versioned logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.functions.keys import key2shard
from kvlake.schema import KV_LOG, OP_LOG


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(KV_LOG).parquet(path)


def read_ops(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OP_LOG).parquet(path)


def _log(df: DataFrame, key, value, version, *extra) -> DataFrame:
    rows = df.select(key.cast("string").alias("key"), value.alias("value"), version.cast("bigint").alias("version"), *extra)
    return rows.withColumn("is_tombstone", F.col("value").isNull()).withColumn("seq", F.col("version")).withColumn("shard", key2shard(F.col("key")))


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a log: users are keys, events are versions, errors are tombstones."""
    return event_rows(spark.read.parquet(f"{sf_dir}/events.parquet"))


def event_rows(e: DataFrame) -> DataFrame:
    """Rows of an events table, or stream, as log rows."""
    value = F.when(F.col("event_type") != "error", F.concat_ws(":", "event_type", F.col("event_id").cast("string")))
    return _log(e, F.col("user_id"), value, F.col("event_id") + 1, (F.col("user_id") % 7).alias("client_id"), ((F.col("event_id") * 7919) % 101).alias("rpc_id"), "event_type")


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return _log(o, F.col("o_custkey"), F.col("o_orderstatus"), F.col("o_orderkey") + 1)


def customers_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All names begin with the same byte, so one shard holds every row."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return _log(c, F.col("c_name"), F.col("c_mktsegment"), F.col("c_custkey") + 1)


def middle_of(log: DataFrame) -> Column:
    """``middle_version`` as a subquery of the query that uses it."""
    return log.agg(F.floor(F.coalesce(F.max("version"), F.lit(0)) / 2).cast("bigint")).scalar()


def middle_version(log: DataFrame) -> int:
    """Half of the greatest version: a snapshot that grows with the data."""
    return (log.agg(F.max("version")).first()[0] or 0) // 2
