"""Golden cases of the log's reads, merges and compaction."""

import random

import pytest
from pyspark.sql import functions as F

from kvlake.functions import keys as K
from kvlake.operators import compact, read, write
from kvlake.schema import KV_LOG, Isolation, Status, check_frame, parse_status


def log_of(spark, rows):
    """(key, value or None, version)"""
    return spark.createDataFrame([(k, v, v is None, n, s, K.shard_of(k)) for s, (k, v, n) in enumerate(rows)], KV_LOG)


def got(df, *names):
    return sorted(tuple(r[n] for n in names or ("key", "value")) for r in df.collect())


def test_point_reads_see_the_newest_version_or_tombstone(spark):
    log = log_of(spark, [("k", "v1", 1), ("k", "v2", 2), ("k", None, 3)])
    assert [got(read.multi_get(log, log.select("key"), s), "value", "version") for s in (1, 2, 3, 4, 0)] == [[("v1", 1)], [("v2", 2)], [(None, 3)], [(None, 3)], [(None, 0)]]
    assert read.get(log, "k", 3).first().status == Status.NO_KEY
    assert read.get(log, "other").first().asDict() == {"key": "other", "value": None, "version": 0, "status": "ErrNoKey"}


def test_batches_share_a_version(spark):
    rows = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    log = write.as_log(rows, 10).union(write.tombstones(rows, 11))
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    assert got(read.multi_get(log, wanted, 10), "key", "value", "version") == [("a", "1", 10), ("b", "2", 10), ("c", None, 0)]
    assert read.get(log, "a", 12).first().version == 11


def test_ranges_at_snapshots(spark):
    log = log_of(spark, [("a", "v10", 10), ("a", "v20", 20), ("b", "v15", 15), ("c", "v05", 5), ("c", None, 25)])
    assert got(read.range_scan(log, "a", "z", 18)) == [("a", "v10"), ("b", "v15"), ("c", "v05")]
    assert got(read.range_scan(log, "a", "z", 30)) == [("a", "v20"), ("b", "v15")]
    assert got(read.range_scan(log, "a", "", 18, limit=2)) == [("a", "v10"), ("b", "v15")]


def test_gc_keeps_the_newest_below_the_watermark(spark):
    log = log_of(spark, [("k", f"v{n}", n) for n in range(1, 6)] + [("k", "v5", 5), ("t", None, 2), ("t", "x", 1)])
    kept = got(compact.gc_rewrite(log, 4), "key", "version")
    assert kept == [("k", 3), ("k", 4), ("k", 5), ("t", 2)]
    assert got(compact.gc_rewrite(log, 4, purge_tombstones=True), "key", "version") == kept[:-1]
    assert compact.gc_rewrite(log, 0).count() == 7
    assert compact.target_bytes(2) == 64 << 20


def test_merge_prefers_later_runs_on_ties(spark):
    old, new = log_of(spark, [("a", "oldA", 0), ("b", "oldB", 0)]), log_of(spark, [("a", "newA", 0), ("c", "newC", 0)])
    assert got(read.merge_newest(old, new)) == [("a", "newA"), ("b", "oldB"), ("c", "newC")]
    assert got(read.merge_newest(new, old)) == [("a", "oldA"), ("b", "oldB"), ("c", "newC")]
    assert read.merge_versions(old, new).count() == 4


def test_prefix_and_predicate(spark):
    log = log_of(spark, [(k, k, 1) for k in ("ab", "abc", "abd", "b", "c", "ÿ", "ÿa", "Ā")])
    assert [k for k, _ in got(read.prefix_scan(log, "ab"))] == ["ab", "abc", "abd"]
    assert [k for k, _ in got(read.prefix_scan(log, "ÿ"))] == ["ÿ", "ÿa"]
    assert [k for k, _ in got(read.predicate_scan(log, F.col("key").between("b", "c")))] == ["b", "c"]
    assert [k for k, _ in got(read.monotone_scan(log, lambda k: 0 if "b" <= k <= "c" else 1))] == ["b", "c"]
    assert K.prefix_successor("az") == "a{" and K.prefix_successor("\U0010ffff") == ""


def test_deleted_keys_stay_deleted_across_files(spark):
    log = log_of(spark, [("b", "x", 1)]).union(log_of(spark, [("b", None, 2)]))
    assert read.range_scan(log).count() == 0
    assert got(read.merge_newest(log_of(spark, [("b", "x", 1)]), log_of(spark, [("b", None, 2)]))) == []


def test_empty_value_is_no_tombstone(spark):
    log = log_of(spark, [("k", "", 1)])
    assert read.get(log, "k").first().status == "OK" and read.get(log, "k").first().value == ""
    raw = spark.createDataFrame([("a", "\x01"), ("b", "\x01v"), ("c", "v")], "key string, value string")
    assert got(raw.select("key", K.decode_stored(F.col("value")).alias("value"))) == [("a", ""), ("b", "v"), ("c", "v")]


@pytest.mark.parametrize(("key", "shard"), [("é", 5), ("", 0), ("1", 9), ("a", 7)])
def test_shard_is_the_first_byte(spark, key, shard):
    assert spark.range(1).select(K.key2shard(F.lit(key)).alias("s")).first().s == K.shard_of(key) == shard
    assert shard in K.shards_of_range(key, key)


def test_random_logs_against_a_dictionary(spark):
    rng = random.Random(1)
    rows = [(f"k{rng.randrange(30)}", rng.choice([None, "x", "y", ""]), n + 1) for n in range(400)]
    log = log_of(spark, rows)
    for snapshot in (0, 57, 200, 400):
        state = {}
        for k, v, n in rows:
            if n <= snapshot:
                state[k] = (v, n)
        live = sorted((k, v, n) for k, (v, n) in state.items() if v is not None)
        assert got(read.snapshot_scan(log, snapshot), "key", "value", "version") == live
        kept = compact.gc_rewrite(log, 200)
        if snapshot >= 199:
            assert got(read.snapshot_scan(kept, snapshot), "key", "value", "version") == live
        asked = spark.createDataFrame([(f"k{i}", snapshot, i) for i in range(31)], "key string, snapshot bigint, id int")
        assert got(read.as_of(log, asked), "id", "version") == sorted((i, state.get(f"k{i}", (None, 0))[1]) for i in range(31))


def test_folds_and_dedup(spark):
    ops = spark.createDataFrame([("a", "Put", "x", 1), ("a", "Append", "y", 2), ("a", "Put", "z", 3), ("a", "Append", "w", 4), ("b", "Append", "q", 5), ("c", "Append", "q", 6), ("c", "Delete", "", 7), ("c", "Append", "r", 8)], "key string, op string, value string, version bigint")
    assert got(write.append_since_put(ops), "key", "folded") == [("a", "zw"), ("b", "q"), ("c", "r")]
    late = spark.createDataFrame([(1, 2, 1), (1, 1, 2)], "client_id bigint, rpc_id bigint, version bigint")
    assert got(write.dedup_high_water(late), "rpc_id") == [(2,)] and got(write.dedup_exact(late), "rpc_id") == [(1,), (2,)]
    again = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (1, 4, 3), (1, 5, 4)], "client_id bigint, rpc_id bigint, version bigint")
    assert got(write.dedup_last(again), "version") == [(1,), (3,), (4,)]


def test_words_and_levels(spark):
    assert parse_status("ErrConflict") is Status.CONFLICT and parse_status("odd") == "odd"
    assert Isolation.of("Serializable") is Isolation.SERIALIZABLE and Isolation.of("?") is Isolation.READ_COMMITTED
    check_frame(log_of(spark, [("k", "v", 1)]), KV_LOG)
    with pytest.raises(ValueError):
        check_frame(spark.range(1), KV_LOG)


def test_plans_push_filters_and_combine_before_the_shuffle(spark, tmp_path):
    log_of(spark, [("k", "v", 1), ("l", "v", 2)]).write.parquet(str(tmp_path / "log"))
    plan = read.get(spark.read.parquet(str(tmp_path / "log")), "k", 5)._jdf.queryExecution().toString()
    assert "EqualTo(key,k)" in plan and "LessThanOrEqual(version,5)" in plan and "partial_max_by" in plan


def test_bloom_has_no_false_negatives(spark):
    inside, outside = spark.range(0, 2000).selectExpr("cast(id as string) key"), spark.range(5000, 9000).selectExpr("cast(id as string) key")
    bloom = K.Bloom(2000, 0.05).build(inside, "key")
    assert inside.where(bloom.may_contain(F.col("key"))).count() == 2000
    assert outside.where(bloom.may_contain(F.col("key"))).count() < 600
