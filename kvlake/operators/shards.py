"""Shards: routing, statistics, balanced assignment, configuration history, migration."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.functions.keys import entry_bytes
from kvlake.schema import CONFIG, N_SHARDS


@dataclass(frozen=True)
class Config:
    num: int = 0
    shards: tuple[int, ...] = (0,) * N_SHARDS
    groups: dict[int, tuple[str, ...]] = field(default_factory=dict)


def rebalance(shards: Iterable[int], gids: Iterable[int]) -> tuple[int, ...]:
    """Balance shards over groups with least movement, the same way every time.

    Groups in order of gid hold quotas that differ by one at most, larger ones
    first. Each keeps its lowest shards up to its quota; all others are dealt, in
    order, to the groups with room. Without groups every shard is 0.
    """
    old, order = list(shards), sorted(gids)
    if not order:
        return (0,) * len(old)
    base, more = divmod(len(old), len(order))
    room = {g: base + (k < more) for k, g in enumerate(order)}
    out: list[int | None] = []
    for g in old:
        keep = room.get(g, 0) > 0
        out.append(g if keep else None)
        if keep:
            room[g] -= 1
    free = iter([g for g in order for _ in range(room[g])])
    return tuple(next(free) if g is None else g for g in out)


class ConfigHistory:
    """Numbered configurations; every change adds one."""

    def __init__(self):
        self.all = [Config()]

    def _add(self, config: Config) -> Config:
        self.all.append(replace(config, num=self.all[-1].num + 1))
        return self.all[-1]

    def join(self, groups: dict[int, Iterable[str]]) -> Config:
        last = self.all[-1]
        merged = {**last.groups, **{g: tuple(s) for g, s in groups.items()}}
        return self._add(Config(0, rebalance(last.shards, merged), merged))

    def leave(self, gids: Iterable[int]) -> Config:
        last, gone = self.all[-1], set(gids)
        left = {g: s for g, s in last.groups.items() if g not in gone}
        return self._add(Config(0, rebalance(last.shards, left), left))

    def move(self, shard: int, gid: int) -> Config:
        """Assign one shard without balancing; an unknown gid changes nothing but the number."""
        last = self.all[-1]
        shards = tuple(gid if k == shard else g for k, g in enumerate(last.shards)) if gid in last.groups else last.shards
        return self._add(Config(0, shards, last.groups))

    def query(self, num: int = -1) -> Config:
        return self.all[num] if 0 <= num < len(self.all) else self.all[-1]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(c.num, list(c.shards), {g: list(s) for g, s in c.groups.items()}) for c in self.all], CONFIG)


def config_at(history: DataFrame, num: int) -> DataFrame:
    """The configuration of a number; the latest for -1 and for numbers not reached yet."""
    latest = history.agg(F.max("num").alias("last"))
    wanted = F.when((F.lit(num) >= 0) & (F.lit(num) <= F.col("last")), F.lit(num)).otherwise(F.col("last"))
    return history.join(F.broadcast(latest.select(wanted.alias("num"))), "num", "left_semi")  # one row


def owners(config: DataFrame) -> DataFrame:
    """(shard, gid) of configurations."""
    return config.select("num", F.posexplode("shards").alias("shard", "gid"))


def shards_per_group(config: DataFrame) -> DataFrame:
    return owners(config).groupBy("num", "gid").agg(F.count("*").alias("shards"))


def route(rows: DataFrame, config: DataFrame) -> DataFrame:
    """Rows with the gid and servers of their shard; the config side has one row for each shard."""
    table = config.select(F.posexplode("shards").alias("shard", "gid"), "groups").select("shard", "gid", F.element_at("groups", F.col("gid")).alias("servers"))
    return rows.join(F.broadcast(table), "shard")


def served(rows: DataFrame, status: DataFrame, gid: int) -> DataFrame:
    """Rows of the shards that a group owns and serves; status: (shard, gid, state), a row for each shard."""
    return rows.join(F.broadcast(status.where((F.col("gid") == gid) & F.col("state").isin("Serving", "GCing"))), "shard", "left_semi")


def rejected(rows: DataFrame, status: DataFrame, gid: int) -> DataFrame:
    return rows.join(F.broadcast(status.where((F.col("gid") == gid) & F.col("state").isin("Serving", "GCing"))), "shard", "left_anti")


def migration_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Shards whose group differs between two configurations."""
    a, b = owners(before).selectExpr("shard", "gid as from_gid"), owners(after).selectExpr("shard", "gid as to_gid")
    return a.join(b, "shard").where("from_gid <> to_gid")


def reconfigure(before: DataFrame, after: DataFrame, gid: int) -> DataFrame:
    """State of each shard at a group on the step from one configuration to the next; no rows for any other step."""
    first = F.col("from_gid") == 0
    state = F.when((F.col("to_gid") == gid) & (F.col("from_gid") == gid), "Serving").when((F.col("to_gid") == gid) & first, "Serving").when(F.col("to_gid") == gid, "Pulling").when(F.col("from_gid") == gid, "BePulling").otherwise("Absent")
    a, b = owners(before).selectExpr("shard", "gid as from_gid", "num as was"), owners(after).selectExpr("shard", "gid as to_gid", "num")
    return a.join(b, "shard").where("num = was + 1").select("num", "shard", F.col("to_gid").alias("gid"), state.alias("state"))


def insert_shard(log: DataFrame, pulled: DataFrame, status: DataFrame, config_num: int) -> DataFrame:
    """Accept pulled rows (with ``config_num``) of shards that wait for them in the current configuration; versions are kept."""
    waiting = status.where((F.col("state") == "Pulling") & (F.col("num") == config_num)).select("shard")
    fresh = pulled.where(F.col("config_num") == config_num).join(F.broadcast(waiting), "shard", "left_semi")  # a row for each shard
    return log.unionByName(fresh.select(*log.columns))


def drop_shard(log: DataFrame, shard: int) -> DataFrame:
    return log.where(F.col("shard") != shard)


def shard_stats(log: DataFrame) -> DataFrame:
    size = entry_bytes(F.col("key"), F.col("value"))
    return log.groupBy("shard").agg(F.count("*").alias("entries"), F.sum(size).alias("bytes"), F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.min("version").alias("min_version"), F.max("version").alias("max_version"), F.count_distinct("key").alias("keys"))


def hit_rate(requests: DataFrame) -> DataFrame:
    """(hit boolean) -> share of hits, 0 without requests."""
    return requests.agg(F.coalesce(F.avg(F.col("hit").cast("double")), F.lit(0.0)).alias("hit_rate"))


def traffic(calls: DataFrame) -> DataFrame:
    """(op, sent, received) -> number of calls of each op and their bytes."""
    size = lambda c: F.sum(F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint"))
    return calls.groupBy("op").agg(F.count("*").alias("calls"), size("sent").alias("bytes_sent"), size("received").alias("bytes_received"))


def commit_index(match: DataFrame) -> DataFrame:
    """(grp, server, match_index) -> the greatest index that a majority of each group holds."""
    ordered = F.reverse(F.array_sort(F.collect_list("match_index")))
    return match.groupBy("grp").agg(F.element_at(ordered, (F.floor(F.count("*") / 2) + 1).cast("int")).alias("commit_index"))
