"""The op log as a stream: newest state, request deduplication, ingest, the state machine, windows.

A file source delivers files in no log order, so nothing here relies on arrival:
newest rows are chosen by version, deduplication gives the same set of ops in any
order, and the state machine waits for the unbroken run of indexes.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType

from kvlake.schema import KV_LOG, OP_LOG
from kvlake.shipping import ship_package
from kvlake.sources.registry import TxnRegistry
from kvlake.sources.service import ShardService
from kvlake.sources.shared import exists
from kvlake.sources.store import KVStore

__all__ = ["TxnRegistry", "apply_stream", "dedup_stream", "high_water", "ingest", "latest_by_key", "run_to_end", "stream_log", "stream_ops", "windowed_counts"]

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_ops(spark: SparkSession, path: str, files_per_batch: int | None = None, schema: StructType = OP_LOG) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def stream_log(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    return stream_ops(spark, path, files_per_batch, KV_LOG)


def high_water(late: int) -> StatefulProcessor:
    """The processor of ``dedup_stream``; made in here so that it travels by value, as the stream's first worker has no package."""

    class HighWater(StatefulProcessor):
        """An op passes if its rpc_id exceeds those of all ops of its client with smaller versions.

        The ops that pass are kept as a rising staircase of (version, rpc_id). An op that comes late
        is put in its place; later ops that it overtakes no longer pass, and a row with ``passes``
        false takes each of them back. So the result does not depend on arrival. Steps more than
        ``late`` versions behind the newest are settled: of them only the highest is kept.
        """

        def __init__(self, late: int):
            self.late = late

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.steps = handle.getListState("steps", "version bigint, rpc_id bigint")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            steps = [(int(v), int(r)) for v, r in self.steps.get()] if self.steps.exists() else []
            now = dict(steps)
            for part in rows:
                for version, rpc in sorted(zip(part["version"].tolist(), part["rpc_id"].tolist(), strict=True)):
                    at = bisect_left(steps, (version,))
                    if at and steps[at - 1][1] >= rpc or at < len(steps) and steps[at][0] == version:
                        continue
                    end = at
                    while end < len(steps) and steps[end][1] <= rpc:
                        end += 1
                    steps[at:end] = [(version, rpc)]
            after = dict(steps)
            changes = [(v, r, True) for v, r in after.items() if v not in now] + [(v, r, False) for v, r in now.items() if v not in after]
            settled = bisect_left(steps, (steps[-1][0] - self.late,)) if steps else 0
            self.steps.put(steps[max(0, settled - 1) :])
            if changes:
                yield pd.DataFrame({"client_id": key[0], "rpc_id": [r for _, r, _ in changes], "version": [v for v, _, _ in changes], "passes": [p for *_, p in changes]})

        def close(self) -> None:
            pass

    return HighWater(late)


def latest_by_key(log: DataFrame) -> DataFrame:
    """Stream of (key, value, version) updates; the row of greatest version of a key is its state."""
    best = F.max_by(F.struct("value", "version"), F.struct("version", "seq")).alias("r")
    return log.groupBy("key").agg(best).select("key", "r.value", "r.version")


def dedup_stream(ops: DataFrame, late: int = 1_000_000) -> DataFrame:
    """Stream of (client_id, rpc_id, version, passes): the last row of an op says whether it passes."""
    ship_package(ops.sparkSession)
    return ops.select("client_id", "rpc_id", "version").groupBy("client_id").transformWithStateInPandas(high_water(late), "client_id bigint, rpc_id bigint, version bigint, passes boolean", "Update", "None")


def ingest(log: DataFrame, store_path: str, checkpoint: str):
    """Write a log stream into a store; the manifest that adds a batch notes its number, so a batch delivered again adds nothing."""

    def put(rows: DataFrame, batch: int) -> None:
        KVStore(rows.sparkSession, store_path).add_log(rows.dropDuplicates(["key", "version", "value"]), checkpoint, batch)

    return log.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def apply_stream(ops: DataFrame, store_path: str, gid: int, checkpoint: str):
    """Feed a stream of ops to a group's state machine, which applies each index once and in order."""

    def feed(rows: DataFrame, batch: int) -> None:
        ShardService(KVStore(rows.sparkSession, store_path), gid).feed(rows)

    return ops.writeStream.foreachBatch(feed).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_end(updates: DataFrame, folder: str) -> DataFrame:
    """Run a stream of updates over all that its source holds now; its rows, with the number of their ``batch``. None for an empty source."""

    def put(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")

    updates.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    schema = StructType([*updates.schema.fields, StructField("batch", IntegerType())])
    spark = updates.sparkSession
    if not exists(spark, f"{folder}/rows"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{folder}/rows").parquet(f"{folder}/rows/*")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Event-time counts by type with a watermark for late rows; ``ts`` without zone is read as UTC."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
