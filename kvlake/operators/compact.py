"""Compaction: version retention, levels, sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvlake.functions.keys import entry_bytes

FILES_TO_COMPACT, BASE_BYTES, FAN_OUT, BLOCK_BYTES = 4, 4 << 20, 4, 32_768


def gc_rewrite(log: DataFrame, watermark: int, purge_tombstones: bool = False) -> DataFrame:
    """Every version from the watermark on, and the newest below it for each key; watermark 0 keeps all.

    With ``purge_tombstones`` a tombstone below the watermark goes as well: no row older than it remains.
    """
    plain = log.dropDuplicates(["key", "version", "value"])
    if watermark <= 0:
        return plain
    below = F.col("version") < F.lit(watermark)
    order = Window.partitionBy("key", below).orderBy(F.desc("version"), F.desc("seq"))
    kept = plain.withColumn("rn", F.row_number().over(order)).where(~below | (F.col("rn") == 1)).drop("rn")
    return kept.where(~(below & F.col("is_tombstone"))) if purge_tombstones else kept


def watermark(active: DataFrame, log: DataFrame) -> DataFrame:
    """Least active snapshot, or the last version if none is active."""
    low = active.agg(F.min("snapshot").alias("low"))
    last = log.agg(F.max("version").alias("last"))
    return low.join(last, how="cross").select(F.least("low", "last").alias("watermark"))


def target_bytes(level: int) -> int:
    return BASE_BYTES * FAN_OUT**level


def levels_to_compact(files: DataFrame) -> DataFrame:
    """(level, file) -> levels with enough files to be merged into the next."""
    return files.groupBy("level").agg(F.count("*").alias("files")).where(F.col("files") >= FILES_TO_COMPACT)


def _range_of(bounds: list[tuple[str, int]], key: Column, version: Column) -> Column:
    """How many bounds come before or at (key, version) in storage order, by halving: a row makes as many comparisons as the tree is deep."""

    def halve(low: int, high: int):
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        k, v = bounds[mid]
        before = (key < F.lit(k)) | ((key == F.lit(k)) & (version > F.lit(v)))
        return F.when(before, halve(low, mid)).otherwise(halve(mid + 1, high))

    return halve(0, len(bounds))


def block_stats(log: DataFrame, block_bytes: int = BLOCK_BYTES, most_ranges: int = 256, range_rows: int = 1_000_000) -> DataFrame:
    """Blocks of each shard by cumulative entry size in storage order: rows, first and last key, versions.

    Two passes, so that no task runs through a whole shard: sizes by ranges of (key, version) of
    about ``range_rows``, cut by a sample of about 32 rows each, are summed up; sums within a range
    start from there. A log of one range is summed up at once.
    """
    size = F.lit(12) + entry_bytes(F.col("key"), F.col("value"))
    sized = log.withColumn("size", size.cast("bigint"))
    total = log.count()
    ranges = min(most_ranges, max(1, total // range_rows))
    unit = F.pmod(F.xxhash64("key", "version"), F.lit(1 << 30))
    sample = sorted((r.key, -r.version) for r in log.where(unit < F.lit(int(min(1.0, 32 * ranges / max(1, total)) * (1 << 30)))).select("key", "version").collect()) if ranges > 1 else []
    bounds = sorted({sample[k * len(sample) // ranges] for k in range(1, ranges)}) if sample else []
    ranged = sized.withColumn("range", _range_of([(k, -v) for k, v in bounds], F.col("key"), F.col("version")))
    sums = ranged.groupBy("shard", "range").agg(F.sum("size").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("shard", "range", before.alias("start"))  # a row for each range of each shard
    order = Window.partitionBy("shard", "range").orderBy("key", F.desc("version"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("upto", F.sum("size").over(order)).join(F.broadcast(starts), ["shard", "range"])
    block = F.floor((F.col("start") + F.col("upto") - F.col("size")) / F.lit(block_bytes)).cast("bigint")
    return placed.withColumn("block", block).groupBy("shard", "block").agg(F.count("*").alias("entries"), F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.min("version").alias("min_version"), F.max("version").alias("max_version"))
