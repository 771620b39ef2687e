"""Reads of the versioned log: snapshots, lookups, scans, merges, time travel.

Visibility (``version <= snapshot``) is filtered below the choice of the newest
row of a key, tombstones above it: a deletion must win over older rows before it
is hidden. Equal versions are settled by ``seq``, the order of ingestion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvlake.functions.keys import in_range
from kvlake.schema import Status

_ROW = ("value", "is_tombstone", "version", "seq")


def visible(log: DataFrame, snapshot: int | Column | None = None) -> DataFrame:
    return log if snapshot is None else log.where(F.col("version") <= F.lit(snapshot))


def newest(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The newest visible row of each key, tombstones included: one shuffle, combined map-side."""
    best = F.max_by(F.struct(*_ROW), F.struct("version", "seq")).alias("r")
    return visible(log, snapshot).groupBy("key").agg(best).select("key", "r.*")


def snapshot_scan(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Live keys at a version."""
    return newest(log, snapshot).where(~F.col("is_tombstone")).select("key", "value", "version")


def get(log: DataFrame, key: str, snapshot: int | None = None) -> DataFrame:
    """One row: value, version and status of a key; version 0 if no row of it is visible."""
    asked = log.sparkSession.createDataFrame([(key,)], "key string")
    return multi_get(log.where(F.col("key") == key), asked, snapshot)


def multi_get(log: DataFrame, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Every requested key once, with version 0 where absent; a tombstone keeps its version."""
    found = newest(log.join(keys.select("key").distinct(), "key", "left_semi"), snapshot)
    joined = keys.select("key").distinct().join(found, "key", "left")
    gone = F.coalesce("is_tombstone", F.lit(True))
    return joined.select("key", "value", F.coalesce("version", F.lit(0)).cast("bigint").alias("version"), F.when(gone, Status.NO_KEY.value).otherwise(Status.OK.value).alias("status"))


def range_scan(log: DataFrame, start: str = "", end: str = "", snapshot: int | None = None, limit: int = 0) -> DataFrame:
    """Live keys of [start, end) in byte order; an empty end is open, a limit of 0 or less is none."""
    live = snapshot_scan(log.where(in_range(F.col("key"), start, end)), snapshot).orderBy("key")
    return live.limit(limit) if limit > 0 else live


def prefix_scan(log: DataFrame, prefix: str, snapshot: int | None = None) -> DataFrame:
    return snapshot_scan(log.where(F.col("key").startswith(prefix)), snapshot)


def predicate_scan(log: DataFrame, hit: Column, snapshot: int | None = None) -> DataFrame:
    """Live keys where a condition on ``key`` holds; intervals reach the file scan."""
    return snapshot_scan(log.where(hit), snapshot)


def monotone_scan(log: DataFrame, side, snapshot: int | None = None) -> DataFrame:
    """For a user's monotone function key -> int (0: hit), as an Arrow-batched UDF over distinct keys."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("int")
    def sides(keys):
        return keys.map(side).astype("int32")

    return snapshot_scan(log, snapshot).where(sides("key") == 0)


def limit_by_shard(live: DataFrame, n: int) -> DataFrame:
    """The first n live keys of every shard; a negative n is 0."""
    order = Window.partitionBy("shard").orderBy("key")
    return live.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= max(0, n)).drop("nth")


def merge_newest(*runs: DataFrame, snapshot: int | None = None, live_only: bool = True) -> DataFrame:
    """K-way merge, later runs first: of equal versions the row of the later run wins."""
    tagged = [r.withColumn("seq", F.struct(F.lit(k).alias("run"), F.col("seq").alias("seq"))) for k, r in enumerate(runs)]
    out = tagged[0]
    for r in tagged[1:]:
        out = out.unionByName(r)
    out = newest(out, snapshot).withColumn("seq", F.col("seq.seq"))
    return out.where(~F.col("is_tombstone")) if live_only else out


def merge_versions(*runs: DataFrame, snapshot: int | None = None) -> DataFrame:
    """All visible versions of all runs by key, newest first."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return visible(out, snapshot).orderBy("key", F.desc("version"), F.desc("seq"))


def version_history(log: DataFrame) -> DataFrame:
    """Every version with the version that ends it (null: still valid)."""
    order = Window.partitionBy("key").orderBy("version", "seq")
    return log.select("key", "value", "version", F.lead("version").over(order).alias("valid_to"))


def as_of(log: DataFrame, requests: DataFrame) -> DataFrame:
    """For each request (key, snapshot, and any id columns) the version and value valid then.

    Rows and requests of a key are put on one time line, and the last row is carried
    forward by a running window, so no pairs of versions and requests are made. A
    request's own column named value or version is returned with the prefix ``request_``.
    """
    clash = {c: f"request_{c}" for c in requests.columns if c in ("value", "version")}
    requests = requests.withColumnsRenamed(clash)
    extra = [c for c in requests.columns if c not in ("key", "snapshot")]
    line = log.select("key", F.col("version").alias("__at"), F.lit(0).alias("__kind"), F.col("seq").alias("__seq"), F.struct("version", "value", "is_tombstone").alias("__row"), *[F.lit(None).cast(requests.schema[c].dataType).alias(c) for c in extra]).unionByName(
        requests.select("key", F.col("snapshot").cast("bigint").alias("__at"), F.lit(1).alias("__kind"), F.lit(0).cast("bigint").alias("__seq"), F.lit(None).cast("struct<version:bigint,value:string,is_tombstone:boolean>").alias("__row"), *extra)
    )
    order = Window.partitionBy("key").orderBy("__at", "__kind", "__seq").rowsBetween(Window.unboundedPreceding, 0)
    filled = line.withColumn("__row", F.last("__row", ignorenulls=True).over(order)).where("__kind = 1")
    return filled.select("key", F.col("__at").alias("snapshot"), *extra, F.col("__row.value").alias("value"), F.coalesce("__row.version", F.lit(0)).cast("bigint").alias("version"))
