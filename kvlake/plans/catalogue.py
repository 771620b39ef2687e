"""Named queries over the versioned log, each with its DuckDB equivalent.

The log of a query is the events table: users are keys, events are versions and
errors are tombstones. Snapshots are half of the last version, so they grow with
the data. ``orders`` and ``customer`` give logs of other sizes and skews.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.functions import keys as K
from kvlake.operators import check, compact, machine, read, shards, txn, write
from kvlake.sources.shared import shared_folder
from kvlake.sources.tables import customers_log, event_rows, events_log, middle_of, middle_version, orders_log

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LOG = """l as (
  select cast(user_id as varchar) as key,
         case when event_type = 'error' then null else event_type || ':' || cast(event_id as varchar) end as value,
         event_id + 1 as version, user_id % 7 as client_id, (event_id * 7919) % 101 as rpc_id, event_type
  from events),
s as (select max(version) // 2 as s from l),
v as (select * from (select l.*, row_number() over (partition by key order by version desc) as rn from l, s where version <= s.s) where rn = 1),
cur as (select * from (select l.*, row_number() over (partition by key order by version desc) as rn from l) where rn = 1),
live as (select key, value, version from v where value is not null)"""
SHARD = "coalesce(cast(nullif('0x' || substr(hex(encode(key)), 1, 2), '0x') as integer), 0) % 10"
#: Configurations of the shard controller: none; groups 1 and 2; group 3 joins; group 1 leaves; shard 4 is moved to group 3.
_HISTORY = shards.ConfigHistory()
_HISTORY.join({1: ["a", "b"], 2: ["c"]})
_HISTORY.join({3: ["d"]})
_HISTORY.leave([1])
_HISTORY.move(4, 3)
#: The same, worked out by hand: fixed values of the oracles, which do not run the code that is tested.
_OWNERS = (
    (0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
    (1, 1, 1, 1, 1, 2, 2, 2, 2, 2),
    (1, 1, 1, 1, 3, 2, 2, 2, 3, 3),
    (2, 2, 3, 3, 3, 2, 2, 2, 3, 3),
    (2, 2, 3, 3, 3, 2, 2, 2, 3, 3),
)
_ROWS = ", ".join(f"({num}, {s}, {g})" for num, owners in enumerate(_OWNERS) for s, g in enumerate(owners))
CONF = f"conf(num, shard, gid) as (values {_ROWS})"


def query(oracle: str | None = None, log: str = LOG):
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = f"with {log}, {CONF} {oracle}"
        return fn

    return add


def _log(spark: SparkSession, d: str) -> DataFrame:
    return events_log(spark, d)


@query("select * from live")
def snapshot_scan(spark, d):
    log = _log(spark, d)
    return read.snapshot_scan(log, middle_of(log))


@query("select key, value, version from cur where value is not null")
def latest_scan(spark, d):
    return read.snapshot_scan(_log(spark, d))


@query("select * from live where key >= '10' and key < '14' order by key limit 25")
def range_scan_limit(spark, d):
    log = _log(spark, d)
    return read.range_scan(log, "10", "14", middle_of(log), 25)


@query("select * from live where key >= '5'")
def range_scan_open(spark, d):
    log = _log(spark, d)
    return read.range_scan(log, "5", "", middle_of(log))


@query("select * from live where starts_with(key, '11')")
def prefix_scan(spark, d):
    log = _log(spark, d)
    return read.prefix_scan(log, "11", middle_of(log))


@query("select * from live where key between '2' and '3'")
def predicate_scan(spark, d):
    log = _log(spark, d)
    return read.predicate_scan(log, F.col("key").between("2", "3"), middle_of(log))


@query("select * from live where length(key) = 2")
def monotone_scan(spark, d):
    log = _log(spark, d)
    return read.monotone_scan(log, lambda k: 2 - len(k), middle_of(log))


@query("select '17' as key, v.value, coalesce(v.version, 0)::bigint as version, case when v.value is null then 'ErrNoKey' else 'OK' end as status from (select 1) left join v on key = '17'")
def point_get(spark, d):
    log = _log(spark, d)
    return read.get(log, "17", middle_of(log))


@query("select k.key, v.value, coalesce(v.version, 0)::bigint as version, case when v.value is null then 'ErrNoKey' else 'OK' end as status from (select distinct cast(c_custkey % 400 as varchar) as key from customer) k left join v on v.key = k.key")
def multi_get(spark, d):
    log = _log(spark, d)
    wanted = spark.read.parquet(f"{d}/customer.parquet").select((F.col("c_custkey") % 400).cast("string").alias("key"))
    return read.multi_get(log, wanted, middle_of(log))


@query("select key, value, version, lead(version) over (partition by key order by version) as valid_to from l")
def version_history(spark, d):
    return read.version_history(_log(spark, d))


@query("select key, value, version from l, s where version <= s.s")
def versions_merge(spark, d):
    log = _log(spark, d)
    odd, even = log.where("version % 2 = 1"), log.where("version % 2 = 0")
    return read.merge_versions(odd, even, snapshot=middle_of(log)).select("key", "value", "version")


@query("select key, value, version from live")
def merge_newest(spark, d):
    log = _log(spark, d)
    runs = [log.where(F.col("version") % 3 == k) for k in range(3)]
    return read.merge_newest(*runs, snapshot=middle_of(log)).select("key", "value", "version")


@query(
    """, q as (select event_id, cast(user_id as varchar) as key, (event_id + 1) - (event_id * 31) % 500 as snapshot from events)
select q.event_id, q.key, q.snapshot, l.value, coalesce(l.version, 0)::bigint as version from q asof left join l on q.key = l.key and q.snapshot >= l.version""".lstrip()
)
def as_of_reads(spark, d):
    asked = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("user_id").cast("string").alias("key"), ((F.col("event_id") + 1) - (F.col("event_id") * 31) % 500).alias("snapshot"))
    return read.as_of(_log(spark, d), asked)


_GC = "gc as (select key, value, version from (select l.*, s.s, row_number() over (partition by key, version < s.s order by version desc) as rn from l, s) where version >= s or rn = 1)"


@query(f", {_GC} select * from gc")
def gc_rewrite(spark, d):
    log = _log(spark, d)
    return compact.gc_rewrite(log, middle_version(log)).select("key", "value", "version")


@query(f", {_GC}, g as (select key, value, version from (select gc.*, row_number() over (partition by key order by version desc) as rn from gc, s where version <= s.s + 10) where rn = 1) select count(*)::bigint as same from g join (select * from (select l.*, row_number() over (partition by key order by version desc) as rn from l, s where version <= s.s + 10) where rn = 1) b on g.key = b.key and g.version = b.version and g.value is not distinct from b.value")
def gc_then_snapshot_equal(spark, d):
    log = _log(spark, d)
    w = middle_version(log)
    a = read.newest(compact.gc_rewrite(log, w), w + 10).select("key", F.col("version").alias("va"), F.col("value").alias("xa"))
    b = read.newest(log, w + 10).select("key", F.col("version").alias("vb"), F.col("value").alias("xb"))
    return a.join(b, "key").where("va = vb and xa <=> xb").agg(F.count("*").alias("same"))


@query("select key, string_agg(value, '' order by version) as folded from l where value is not null group by key")
def append_fold(spark, d):
    return write.append_fold(_log(spark, d))


_OPS = "o as (select key, version, coalesce(value, '') as value, case event_type when 'error' then 'Delete' when 'signup' then 'Put' else 'Append' end as op from l)"


@query(f", {_OPS}, r as (select key, max(version) as reset from o where op <> 'Append' group by key) select o.key, string_agg(value, '' order by version) as folded from o left join r using (key) where op <> 'Delete' and version >= coalesce(reset, 0) group by o.key")
def append_since_put(spark, d):
    op = F.when(F.col("event_type") == "error", "Delete").when(F.col("event_type") == "signup", "Put").otherwise("Append")
    return write.append_since_put(_log(spark, d).select("key", "version", F.coalesce("value", F.lit("")).alias("value"), op.alias("op")))


@query("select client_id, rpc_id, version from (select *, max(rpc_id) over (partition by client_id order by version rows between unbounded preceding and 1 preceding) as seen from l) where seen is null or rpc_id > seen")
def dedup_high_water(spark, d):
    return write.dedup_high_water(_log(spark, d)).select("client_id", "rpc_id", "version")


@query("select client_id, rpc_id, min(version) as version from l group by client_id, rpc_id")
def dedup_exact(spark, d):
    return write.dedup_exact(_log(spark, d))


@query("select client_id, r as rpc_id, version from (select *, rpc_id // 20 as r, lag(rpc_id // 20) over (partition by client_id order by version) as last from l) where last is null or last <> r")
def dedup_last(spark, d):
    log = _log(spark, d).withColumn("rpc_id", F.floor(F.col("rpc_id") / 20))
    return write.dedup_last(log).select("client_id", "rpc_id", "version")


@query("select client_id, max(rpc_id) as rpc_id from l group by client_id")
def dedup_tables_merge(spark, d):
    ops = _log(spark, d).select("client_id", "rpc_id")
    return write.merge_dedup_tables(ops.where("rpc_id % 2 = 0"), ops.where("rpc_id % 2 = 1"))


_WRITES = "w as (select distinct cast(c_custkey % 300 as varchar) as key, 'txn' || cast(c_custkey % 300 as varchar) as own, (c_custkey % 300) % 3 = 0 as is_delete from customer)"


def _pending(spark, d):
    k = (F.col("c_custkey") % 300).alias("k")
    return spark.read.parquet(f"{d}/customer.parquet").select(k).distinct().select(F.col("k").cast("string").alias("key"), F.concat(F.lit("txn"), F.col("k").cast("string")).alias("value"), (F.col("k") % 3 == 0).alias("is_delete"))


@query(f", {_WRITES} select coalesce(live.key, w.key) as key, case when w.key is not null then own else value end as value from (select * from live where key >= '1' and key < '2') live full join (select * from w where key >= '1' and key < '2') w on live.key = w.key where not coalesce(is_delete, false)")
def txn_overlay_range(spark, d):
    log = _log(spark, d)
    return txn.overlay_range(log, _pending(spark, d), "1", "2", middle_of(log))


@query("select v.key, v.version as seen, cur.version as current from v join cur using (key) where v.version <> cur.version")
def txn_validate(spark, d):
    log = _log(spark, d)
    return txn.conflicts(log, read.newest(log, middle_of(log)).select("key", "version"))


@query(f", {_WRITES} select key, max(version) as current from l, s where version > s.s and key in (select key from w) group by key")
def write_write_conflicts(spark, d):
    log = _log(spark, d)
    return txn.write_conflicts(log, _pending(spark, d), middle_version(log))


@query(f"select key, {SHARD} as shard from (select distinct c_name as key from customer union select '' union select 'é' union select distinct key from l)")
def shard_map(spark, d):
    names = customers_log(spark, d).select("key").union(spark.createDataFrame([("",), ("é",)], "key string")).union(_log(spark, d).select("key")).distinct()
    return names.select("key", K.key2shard(F.col("key")).alias("shard"))


@query(f"select {SHARD} as shard, count(*) as entries, sum(strlen(key) + coalesce(strlen(value), 0))::bigint as bytes, min(key) as first_key, max(key) as last_key, min(version) as min_version, max(version) as max_version, count(distinct key) as keys from l group by 1")
def shard_stats(spark, d):
    return shards.shard_stats(_log(spark, d))


@query(f"select shard, key, value, version from (select *, row_number() over (partition by shard order by key) as rn from (select *, {SHARD} as shard from live)) where rn <= 3")
def shard_limit(spark, d):
    log = _log(spark, d)
    live = read.snapshot_scan(log, middle_of(log)).withColumn("shard", K.key2shard(F.col("key")))
    return read.limit_by_shard(live, 3)


def _config(spark, num):
    return shards.config_at(_HISTORY.frame(spark), num)


@query("select num, shard, gid from conf where num = 2")
def config_query(spark, d):
    return shards.owners(_config(spark, 2))


@query("select num, shard, gid from conf where num = (select max(num) from conf)")
def config_query_latest(spark, d):
    return shards.owners(_config(spark, 99))


@query("select num, gid, count(*) as shards from conf group by num, gid")
def shards_per_group(spark, d):
    return shards.shards_per_group(_HISTORY.frame(spark))


@query("select a.shard, a.gid as from_gid, b.gid as to_gid from conf a join conf b using (shard) where a.num = 1 and b.num = 2 and a.gid <> b.gid")
def migration_diff(spark, d):
    return shards.migration_diff(_config(spark, 1), _config(spark, 2))


@query("select b.num, b.shard, b.gid, case when b.gid = 3 and a.gid = 3 then 'Serving' when b.gid = 3 and a.gid = 0 then 'Serving' when b.gid = 3 then 'Pulling' when a.gid = 3 then 'BePulling' else 'Absent' end as state from conf a join conf b using (shard) where a.num = 1 and b.num = 2")
def reconfigure_status(spark, d):
    return shards.reconfigure(_config(spark, 1), _config(spark, 2), 3)


@query(f"select live.key, live.version, c.shard, c.gid, case c.gid when 1 then 'a,b' when 2 then 'c' when 3 then 'd' end as servers from (select *, {SHARD} as shard from live) live join conf c on c.shard = live.shard and c.num = 2")
def route(spark, d):
    log = _log(spark, d)
    live = read.snapshot_scan(log, middle_of(log)).select("key", "version", K.key2shard(F.col("key")).alias("shard"))
    return shards.route(live, _config(spark, 2)).withColumn("servers", F.array_join("servers", ","))


@query(f"select key, version from live where exists (select 1 from conf where num = 2 and gid = 2 and shard = {SHARD})")
def owned_semi(spark, d):
    log = _log(spark, d)
    live = read.snapshot_scan(log, middle_of(log)).withColumn("shard", K.key2shard(F.col("key")))
    return shards.served(live, shards.owners(_config(spark, 2)).withColumn("state", F.lit("Serving")), 2).select("key", "version")


@query(f"select key, version from live where not exists (select 1 from conf where num = 2 and gid = 2 and shard = {SHARD})")
def rejected_anti(spark, d):
    log = _log(spark, d)
    live = read.snapshot_scan(log, middle_of(log)).withColumn("shard", K.key2shard(F.col("key")))
    return shards.rejected(live, shards.owners(_config(spark, 2)).withColumn("state", F.lit("Serving")), 2).select("key", "version")


@query("select key, value, version from l")
def insert_shard(spark, d):
    log = _log(spark, d)
    status = shards.reconfigure(_config(spark, 1), _config(spark, 2), 3)
    pulling = status.where("state = 'Pulling'").select("shard")
    mine = log.join(F.broadcast(pulling), "shard", "left_anti")
    pulled = log.join(F.broadcast(pulling), "shard", "left_semi").withColumn("config_num", F.lit(2))
    return shards.insert_shard(mine, pulled, status, 2).select("key", "value", "version")


@query(f"select key, value, version from cur where value is not null and ({SHARD}) = 9")
def export_shard(spark, d):
    return read.snapshot_scan(_log(spark, d).where("shard = 9"))


@query("select key, count(*) as versions, sum((value is null)::int)::bigint as tombstones from l group by key having sum((value is null)::int) > 0")
def tombstone_stats(spark, d):
    return _log(spark, d).groupBy("key").agg(F.count("*").alias("versions"), F.sum(F.col("is_tombstone").cast("bigint")).alias("tombstones")).where("tombstones > 0")


@query("select least((select min(o_orderkey) + 100 from orders), (select max(version) from l)) as watermark")
def watermark(spark, d):
    active = spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_orderkey") + 100).alias("snapshot"))
    return compact.watermark(active, _log(spark, d))


@query(f"select shard, block, count(*) as entries, min(key) as first_key, max(key) as last_key, min(version) as min_version, max(version) as max_version from (select *, ((sum(size) over (partition by shard order by key, version desc rows between unbounded preceding and current row) - size) // 4096)::bigint as block from (select *, {SHARD} as shard, 12 + strlen(key) + coalesce(strlen(value), 0) as size from l)) group by shard, block")
def block_stats(spark, d):
    return compact.block_stats(_log(spark, d), 4096)


@query("select (event_id % 5)::integer as level, count(*) as files from (select distinct event_id % 23 as event_id from events) group by 1 having count(*) >= 4")
def compaction_levels(spark, d):
    files = spark.read.parquet(f"{d}/events.parquet").select((F.col("event_id") % 23).alias("file")).distinct()
    return compact.levels_to_compact(files.select((F.col("file") % 5).cast("int").alias("level"), "file"))


@query("select avg((event_type = 'view')::int)::double as hit_rate from events")
def hit_rate(spark, d):
    return shards.hit_rate(spark.read.parquet(f"{d}/events.parquet").select((F.col("event_type") == "view").alias("hit")))


@query("select grp, list_sort(list(m), 'desc')[len(list(m)) // 2 + 1] as commit_index from (select client_id as grp, rpc_id % 5 as server, max(version) as m from l group by all) group by grp")
def commit_index(spark, d):
    match = _log(spark, d).groupBy(F.col("client_id").alias("grp"), (F.col("rpc_id") % 5).alias("server")).agg(F.max("version").alias("match_index"))
    return shards.commit_index(match)


@query("select key, value from (select cast(o_custkey as varchar) as key, o_orderstatus as value, row_number() over (partition by o_custkey order by o_orderkey desc) as rn from orders) where rn = 1")
def orders_latest(spark, d):
    return read.snapshot_scan(orders_log(spark, d)).select("key", "value")


@query("select c_name as key, c_mktsegment as value from customer order by 1 limit 100")
def one_shard_range(spark, d):
    return read.range_scan(customers_log(spark, d), "C", "D", None, 100).select("key", "value")


#: One step of CRC-32 (reflected polynomial 0xEDB88320, a fixed value) over a list of registers; eight give the table of bytes.
_STEP = "list_transform({}, lambda c: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)"
_TABLE = "range(256)"
for _ in range(8):
    _TABLE = _STEP.format(_TABLE)
_BYTES = "list_transform(range(strlen(value)), lambda k: ('0x' || substr(hex(encode(value)), 2 * k + 1, 2))::bigint)"


@query(f", t as (select {_TABLE} as t) select key, version, xor(list_reduce(list_prepend(4294967295, {_BYTES}), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) as crc from l, t where value is not null")
def checksums(spark, d):
    return _log(spark, d).where("value is not null").select("key", "version", K.checksum(F.col("value")).alias("crc"))


@query("select c_custkey, cast(c_custkey % 400 as varchar) as key from customer where cast(c_custkey % 400 as varchar) in (select key from live)")
def bloom_semi_join(spark, d):
    """Customers whose key is live: a filter of the live keys drops most others before the exact semi join, which drops its false positives."""
    log = _log(spark, d)
    live = read.snapshot_scan(log, middle_of(log))
    asked = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", (F.col("c_custkey") % 400).cast("string").alias("key"))
    return asked.where(K.Bloom.of(live, "key", 0.05).may_contain(F.col("key"))).join(live.select("key"), "key", "left_semi")


@query("select event_type as op, count(*) as calls, sum(strlen(props))::bigint as bytes_sent, sum(coalesce(strlen(value), 0))::bigint as bytes_received from (select e.event_type, e.props, l.value from events e join l on l.version = e.event_id + 1) group by 1")
def traffic(spark, d):
    log = _log(spark, d).select("version", F.col("value").alias("received"))
    calls = spark.read.parquet(f"{d}/events.parquet").select((F.col("event_id") + 1).alias("version"), F.col("event_type").alias("op"), F.col("props").alias("sent"))
    return shards.traffic(calls.join(log, "version"))


def _events(spark, d):
    """The events table as a stream of files."""
    return spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(d)


@query("select key, value, version from cur")
def stream_latest(spark, d):
    """The newest row of every key by an update-mode stream, run to the end of its source."""
    from kvlake.streaming import stream

    updates = stream.run_to_end(stream.latest_by_key(event_rows(_events(spark, d))), shared_folder(spark, "stream"))
    return updates.groupBy("key").agg(F.max_by(F.struct("value", "version"), "version").alias("r")).select("key", "r.*")


@query("select client_id, rpc_id, version from (select *, max(rpc_id) over (partition by client_id order by version rows between unbounded preceding and 1 preceding) as seen from l) where seen is null or rpc_id > seen")
def stream_dedup(spark, d):
    """Deduplication by high-water mark as a stream whose result does not depend on arrival."""
    from kvlake.streaming import stream

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream.STATE_STORE)
    updates = stream.run_to_end(stream.dedup_stream(event_rows(_events(spark, d))), shared_folder(spark, "stream"))
    last = updates.groupBy("client_id", "version").agg(F.max_by(F.struct("rpc_id", "passes"), "batch").alias("r"))
    return last.where("r.passes").select("client_id", "r.rpc_id", "version")


_MACHINE = f"""m as (
  select version as idx, client_id, version // 20 as rpc_id, key, value, ({SHARD}) <> 3 as open,
         case event_type when 'view' then 'Get' when 'signup' then 'Put' when 'error' then 'Delete' else 'Append' end as op from l),
p as (select *, open and rpc_id > coalesce(max(case when open then rpc_id end) over (partition by client_id order by idx rows between unbounded preceding and 1 preceding), -1) as applied from m),
g as (select *, count(case when op in ('Put', 'Delete') then 1 end) over (partition by key order by idx) as grp from p where applied),
f as (select *, string_agg(case when op in ('Put', 'Append') then value end, '') over (partition by key, grp order by idx) as state from g),
a as (select idx, case when op = 'Get' and state is null then 'ErrNoKey' else 'OK' end as status, case when op = 'Get' then state end as value from f),
w as (select p.idx, p.client_id, p.rpc_id, p.open, p.applied, case when p.applied then {{'status': a.status, 'value': a.value}} end as given from p left join a using (idx)),
x as (select *, last_value(given ignore nulls) over (partition by client_id order by idx rows between unbounded preceding and current row) as answer from w)"""


@query(f", {_MACHINE} select idx, client_id, rpc_id, case when open then answer.status else 'ErrWrongGroup' end as status, case when open then answer.value end as value, applied from x")
def apply_ops(spark, d):
    """The op log through the state machine of a group that serves all shards but one."""
    kind = F.col("event_type")
    op = F.when(kind == "view", "Get").when(kind == "signup", "Put").when(kind == "error", "Delete").otherwise("Append")
    ops = _log(spark, d).select(F.col("version").alias("idx"), "client_id", F.floor(F.col("version") / 20).alias("rpc_id"), op.alias("op"), "key", "value")
    none = spark.createDataFrame([], "key string, value string")
    return machine.apply_ops(ops, none, served=[k for k in range(10) if k != 3])[0]


@query("select date_trunc('day', ts) as start, event_type, count(*) as n from events group by all")
def windowed_counts(spark, d):
    from kvlake.streaming.stream import windowed_counts as counts

    return counts(spark.read.parquet(f"{d}/events.parquet"), "1 day").withColumn("start", F.col("start").cast("timestamp_ntz"))


def _history(spark, d):
    """A history with overlapping calls whose results are right by construction, one key for each user."""
    log = _log(spark, d)
    op = F.when(F.col("event_type") == "view", check.GET).otherwise(check.PUT)
    before = "last(case when op = 1 then value end, true) over (partition by key order by version rows between unbounded preceding and 1 preceding)"
    ops = log.withColumn("value", F.coalesce("value", F.lit(""))).withColumn("op", op)
    return ops.selectExpr("cast(client_id as int) client_id", "op", "key", "case when op = 1 then value end as arg", f"case when op = 0 then coalesce({before}, '') else '' end as ret", "version * 10 - 15 as call_ts", "version * 10 as return_ts")


@query("select key, 'Ok' as result, count(*) as operations from l group by key")
def linearizability(spark, d):
    return check.check_by_key(_history(spark, d), timeout=0).select("key", "result", "operations")
