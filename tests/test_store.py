"""The durable store, transactions, shard control, the checker and streams."""

import random

import pytest

from kvlake.operators import check, read, shards
from kvlake.operators.txn import Transaction, TransactionError
from kvlake.schema import HISTORY, KV_LOG, Isolation, Status
from kvlake.sources.store import KVStore
from kvlake.streaming import stream

KV = "key string, value string"


@pytest.fixture
def store(spark, tmp_path):
    return KVStore(spark, str(tmp_path / "store"))


def put(store, **rows):
    return store.commit(store.spark.createDataFrame(list(rows.items()), KV))


def live(store, *bounds, **options):
    return [(r.key, r.value) for r in store.range(*bounds, **options).collect()]


def test_versions_survive_reopening_and_compaction(spark, store):
    for value in ("v1", "v2", None):
        put(store, k=value)
    again = KVStore(spark, store.path)
    assert [again.get("k", s).first().value for s in (1, 2, 3)] == ["v1", "v2", None]
    pinned = KVStore(spark, store.path, pin=again.latest() - 1)
    assert live(pinned) == [("k", "v2")] and live(again) == []
    put(again, b="1", d="2")
    assert again.needs_compaction() and again.compact(watermark=3)
    assert len(again.manifest()["folders"]) == 1 and again.get("k", 3).first().version == 3
    assert live(again, "a", "e") == [("b", "1"), ("d", "2")] and again.vacuum(older_than=0) == 4
    assert live(again, "b", "e", limit=1) == [("b", "1")] and [r.key for r in again.prefix("d").collect()] == ["d"]


def test_pinned_stores_refuse_writes(spark, store):
    put(store, a="1")
    put(store, a="2")
    pinned = KVStore(spark, store.path, pin=1)
    rows = spark.createDataFrame([("a", "3")], KV)
    for write in (lambda: pinned.put(rows), lambda: pinned.append(rows), lambda: pinned.remove(rows), pinned.compact, pinned.vacuum, lambda: pinned.compact_level(0), lambda: pinned.add_log(store.log()), lambda: pinned.restore(0)):
        with pytest.raises(PermissionError):
            write()
    assert live(pinned) == [("a", "1")] and live(store) == [("a", "2")]


def test_vacuum_leaves_young_folders(spark, store, monkeypatch):
    put(store, a="1")
    publish, gone = store._publish, []

    def late(n, content):
        gone.append(KVStore(spark, store.path).vacuum())  # another process, while this commit is under way
        return publish(n, content)

    monkeypatch.setattr(store, "_publish", late)
    put(store, b="2")
    assert gone == [0] and live(store) == [("a", "1"), ("b", "2")]


def test_a_batch_has_a_key_once_or_an_order(spark, store):
    twice = [("a", "first"), ("a", "second"), ("b", "x")]
    with pytest.raises(ValueError):
        store.put(spark.createDataFrame(twice, KV))
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame(twice, KV))
    assert store.latest() == 0 and live(store) == []
    ordered = spark.createDataFrame([("a", "second", 2), ("a", "first", 1), ("b", None, 5), ("b", "x", 4)], KV + ", order int")
    assert store.put(ordered.repartition(4)) is Status.OK and live(store) == [("a", "second")]
    letters = [("a", c, k) for k, c in enumerate("abcdefghij")]
    store.append(spark.createDataFrame(letters[::-1], KV + ", order int").repartition(5))
    assert live(store) == [("a", "secondabcdefghij")]


def test_manifests_are_created_by_one_writer_only(spark, store):
    assert store._publish(1, {"folders": [], "version": 7}) and not store._publish(1, {"folders": [], "version": 9})
    assert store.manifest(1)["version"] == 7
    aside = store._hadoop.Path(f"{store.path}/manifests/_x")
    for taken in (True, False):
        store._fs.create(aside, True).close()
        target = store._manifest(1 if taken else 2)
        assert store._rename(aside, target) is not taken
    assert store.manifest(1)["version"] == 7
    names = [s.getPath().getName() for s in store._fs.listStatus(store._hadoop.Path(f"{store.path}/manifests"))]
    assert sum(n.startswith("_") for n in names) <= 1


def test_levels_merge_and_keep_every_row(spark, store):
    for k in range(9):
        put(store, **{f"k{k}": str(k), "same": str(k)})
    assert store.needs_compaction() and store.maintain() >= 1 and not store.needs_compaction()
    assert set(store.level_folders()) <= {0, 1, 2} and any(k > 0 for k in store.level_folders())
    assert live(store) == [*[(f"k{k}", str(k)) for k in range(9)], ("same", "8")]
    for k in range(30):
        put(store, **{f"k{k % 9}": str(k)})
        if store.needs_compaction():
            store.maintain(watermark=10_000)
    assert live(store)[0] == ("k0", "27") and len(store.manifest()["folders"]) < 9
    assert store.export_all().count() == 10 and {r.shard for r in store.export_all().collect()} == {7, 5}


def test_files_follow_ranges_and_not_shards(spark, tmp_path):
    store = KVStore(spark, str(tmp_path / "wide"))
    rows = spark.range(20_000).selectExpr("concat('C', lpad(cast(id as string), 9, '0')) key", "cast(id as string) value")
    store._write(read_rows(rows), "batch=x", files=6)
    files = {r.f for r in store._rows(["batch=x"]).selectExpr("input_file_name() f").distinct().collect()}
    assert len(files) == 6


def read_rows(rows):
    from kvlake.operators import write

    return write.as_log(rows, 1)


def test_append_import_export(spark, store):
    put(store, a="x")
    store.append(spark.createDataFrame([("a", "y"), ("n", "z")], KV))
    assert live(store) == [("a", "xy"), ("n", "z")]
    store.import_raw(spark.createDataFrame([("m", "\x01v"), ("o", "")], KV))
    assert store.get("m").first().version == 0 and store.get("o").first().status == "ErrNoKey"
    assert {(r.key, r.value) for r in store.export_shard(7).collect()} == {("a", "xy")}
    assert store.export_all().count() == 3
    store.remove(spark.createDataFrame([("a",)], "key string"))
    assert "a" not in dict(live(store))


@pytest.mark.parametrize(("level", "status"), [(Isolation.REPEATABLE_READ, Status.CONFLICT), (Isolation.SERIALIZABLE, Status.CONFLICT), (Isolation.READ_COMMITTED, Status.OK)])
def test_conflicts_by_level(store, level, status):
    put(store, a1="v0")
    one, two = Transaction(store, level), Transaction(store, level)
    assert one.get("a1") == "v0"
    assert two.put("a1", "v2") and two.commit() is Status.OK
    one.put("a2", "x")
    assert one.commit() is status and store.active == {}


def test_transactions_read_their_snapshot_under_their_writes(store):
    put(store, a1="v1", a2="v2", a3="v3")
    txn = Transaction(store)
    assert txn.range("a", "a~") == [("a1", "v1"), ("a2", "v2"), ("a3", "v3")]
    put(store, a2="v2-new")
    assert txn.range("a", "a~")[1] == ("a2", "v2")
    txn.abort()
    mine = Transaction(store)
    mine.put("a2", "v2x")
    mine.remove("a1")
    assert mine.range("a", "a~", limit=2) == [("a2", "v2x"), ("a3", "v3")]
    assert mine.commit() is Status.OK and live(store) == [("a2", "v2x"), ("a3", "v3")]
    cross = Transaction(store)
    assert cross.put("a1", "x") and not cross.put("b1", "y") and cross.commit() is Status.WRONG_GROUP
    with pytest.raises(TransactionError):
        Transaction(store).range("a", "b")


def test_tombstones_and_phantoms(store):
    put(store, k="x")
    put(store, k=None)
    txn = Transaction(store)
    assert txn.get("k") is None and txn.put("k2", "y") and txn.commit() is Status.OK
    phantom = Transaction(store, Isolation.SERIALIZABLE)
    phantom.range("a", "a~")
    put(store, a5="new")
    assert phantom.commit() is Status.CONFLICT
    blind = Transaction(store, write_checks=True)
    blind.put("a5", "mine")
    put(store, a5="theirs")
    assert blind.commit() is Status.CONFLICT


def test_open_transactions_hold_the_watermark_of_every_process(spark, store):
    put(store, a="1")
    txn = Transaction(store)
    assert txn.get("a") == "1"
    put(store, a="2")
    other = KVStore(spark, store.path)
    assert other.active == {txn.token: 1} and other.watermark() == 1 and other.compact()
    assert Transaction.get(txn, "a") == "1" and read.get(other.log(), "a", 1).first().value == "1"
    txn.abort()
    assert other.active == {} and other.watermark() == 2


def test_an_idle_transaction_is_gone(spark, store):
    put(store, a="1")
    now = [1000.0]
    store.registry.clock = lambda: now[0]
    txn, held = Transaction(store), Transaction(store)
    txn.get("a")
    held.put("a2", "x")
    now[0] += 20
    txn.get("a")
    now[0] += 20
    assert held.commit() is Status.CONFLICT and list(store.active) == [txn.token]
    now[0] += 31
    with pytest.raises(TransactionError):
        txn.get("a")
    assert store.active == {}


def test_embedded_levels(spark, store):
    put(store, a="1", b="1")
    low = Transaction(store, Isolation.READ_UNCOMMITTED, embedded=True)
    committed, repeatable = Transaction(store, Isolation.READ_COMMITTED, embedded=True), Transaction(store, Isolation.REPEATABLE_READ, embedded=True)
    assert committed.get("a") == repeatable.get("a") == "1"
    low.put("a", "dirty")
    low.put("a", "dirtier")
    low.remove("b")
    low.put("c", "new")
    assert committed.get("a") == "dirtier" and repeatable.get("a") == "1"  # written at once, read as newest rows
    assert low.get("a") == "dirtier" and low.get("b") is None
    low.abort()
    assert live(store) == [("a", "1"), ("b", "1")]
    assert committed.get("c") is None and committed.range("", "") == [("a", "1"), ("b", "1")]
    committed.put("a", "2")
    assert committed.get("a") == "2" and committed.commit() is Status.OK
    assert repeatable.commit() is Status.CONFLICT
    blind = Transaction(store, Isolation.SERIALIZABLE, embedded=True)
    blind.put("b", "mine")
    put(store, b="theirs")
    assert blind.commit() is Status.CONFLICT
    kept = Transaction(store, Isolation.READ_UNCOMMITTED, embedded=True)
    kept.put("x", "1")
    assert kept.commit() is Status.OK and dict(live(store))["x"] == "1"


def test_ranges_are_frames_and_conflict_by_rows_read(store):
    put(store, a1="1", a2="2")
    txn = Transaction(store, Isolation.REPEATABLE_READ)
    assert txn.scan("a", "a~").count() == 2
    put(store, a3="new")  # appeared: no conflict below Serializable
    txn.put("a9", "x")
    assert txn.commit() is Status.OK
    other = Transaction(store, Isolation.REPEATABLE_READ)
    other.scan("a", "a~")
    put(store, a2="changed")
    other.put("a8", "x")
    assert other.commit() is Status.CONFLICT


def test_rebalance_moves_little_and_keeps_balance():
    rng = random.Random(2)
    for _ in range(300):
        gids = rng.sample(range(1, 40), rng.randrange(1, 15))
        before = shards.rebalance([0] * 10, gids)
        joined = sorted({*gids, rng.randrange(40, 50)})
        after = shards.rebalance(before, joined)
        for found, groups in ((before, gids), (after, joined)):
            counts = [found.count(g) for g in groups]
            assert max(counts) - min(counts) <= 1 and set(found) <= set(groups)
        moved = [s for s in range(10) if before[s] != after[s]]
        assert len(moved) <= 10 // len(joined) + 1
        assert shards.rebalance(after, joined) == after
    assert shards.rebalance([1] * 10, []) == (0,) * 10


def test_config_history(spark):
    h = shards.ConfigHistory()
    h.join({1: ["a"], 2: ["b"]})
    for s in range(10):
        h.move(s, 1 + (s > 4))
    h.move(0, 77)
    h.leave([2, 99])
    assert h.query(11).shards == (1,) * 5 + (2,) * 5 == h.query(12).shards[:10]
    assert h.query(-1) == h.query(500) and h.query(-1).shards == (1,) * 10 and h.query(13).num == 13
    frame = h.frame(spark)
    assert shards.config_at(frame, 11).first().shards == list(h.query(11).shards)
    assert shards.config_at(frame, -1).first().num == 13
    assert {r.state for r in shards.reconfigure(shards.config_at(frame, 12), shards.config_at(frame, 13), 1).collect()} == {"Serving", "Pulling"}


def test_checker(spark):
    good = [(1, check.PUT, "k", "a", "", 0, 10), (2, check.GET, "k", None, "", 1, 5), (3, check.GET, "k", None, "a", 2, 8), (1, check.APPEND, "k", "b", "", 11, 12), (2, check.APPEND_GET, "k", "c", "ab", 13, 14), (2, check.GET, "k", None, "abc", 15, 16)]
    bad = [(1, check.PUT, "x", "a", "", 0, 1), (2, check.GET, "x", None, "", 2, 3)]
    out = {r.key: r for r in check.check_by_key(spark.createDataFrame(good + bad, HISTORY)).collect()}
    assert out["k"].result == "Ok" and len(out["k"].longest) == 6 and out["x"].result == "Illegal" and out["x"].longest == [0]
    assert check.check(check.check_by_key(spark.createDataFrame(good + bad, HISTORY))).first().result == "Illegal"
    assert check.search([]) == ("Ok", []) and check.check(check.check_by_key(spark.createDataFrame([], HISTORY))).first().result == "Ok"
    many = [(check.APPEND, "x", "", 0, 100)] * 40 + [(check.GET, None, "nope", 0, 100)]
    assert check.search(many, 0.05)[0] in ("Unknown", "Illegal")
    events = [(k, kind, 1, check.PUT, "k", "v", "", t) for k in range(3) for kind, t in (("call", 2 * k), ("return", 2 * k + 1))]
    assert check.pair_events(spark.createDataFrame(events, "id int, kind string, client_id int, op int, key string, arg string, ret string, ts bigint")).count() == 3


def test_checker_is_linear_in_the_history():
    import time

    ops, state = [], ""
    for k in range(60_000):
        op = (check.PUT, str(k), "") if k % 2 else (check.GET, None, state)
        state = str(k) if k % 2 else state
        ops.append((*op, 10 * k, 10 * k + 14))
    began = time.monotonic()
    result, order = check.search(ops, 0)
    assert result == "Ok" and len(order) == len(ops) and time.monotonic() - began < 20
    assert check.search([*ops, (check.GET, None, "never", 10**9, 10**9 + 1)], 0)[0] == "Illegal"


def test_a_model_of_ones_own(spark):
    counter = check.Model(step=lambda n, op, arg, ret: (op == check.PUT or ret == str(n), n + (op == check.PUT)), initial=0, partition="client_id")
    rows = [(1, check.PUT, "x", "", "", 0, 1), (1, check.GET, "y", None, "1", 2, 3), (2, check.GET, "x", None, "1", 4, 5)]
    out = {r.key: r.result for r in check.check_by_key(spark.createDataFrame(rows, HISTORY), 0, counter).collect()}
    assert out == {"1": "Ok", "2": "Illegal"}


def test_checker_against_all_orders():
    import itertools

    rng = random.Random(4)
    for _ in range(300):
        ops = []
        for _ in range(rng.randrange(1, 6)):
            a = rng.randrange(10)
            ops.append((rng.randrange(3), rng.choice("ab"), rng.choice(["", "a", "b", "ab"]), a, a + rng.randrange(1, 6)))

        def legal(order, ops=ops):
            state = ""
            for n, k in enumerate(order):
                if any(ops[j][4] < ops[k][3] for j in order[n + 1 :]):
                    return False
                fits, state = check.kv_step(state, *ops[k][:3])
                if not fits:
                    return False
            return True

        want = any(legal(p) for p in itertools.permutations(range(len(ops))))
        assert check.search(ops)[0] == ("Ok" if want else "Illegal")


def test_streams(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream.STATE_STORE)
    rng = random.Random(3)
    rows = [(f"k{rng.randrange(9)}", rng.choice([None, "x", "y"]), False, n, n, 0) for n in range(200)]
    rows = [(k, v, v is None, n, s, sh) for k, v, _, n, s, sh in rows]
    mixed = rng.sample(rows, len(rows))
    for k in range(3):
        spark.createDataFrame(mixed[k::3], KV_LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    log = stream.stream_log(spark, str(tmp_path / "in"), files_per_batch=1)
    stream.latest_by_key(log).writeStream.format("memory").queryName("newest").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start().awaitTermination()
    final = {}
    for r in spark.table("newest").collect():
        if r.key not in final or r.version > final[r.key][1]:
            final[r.key] = (r.value, r.version)
    assert final == {r.key: (r.value, r.version) for r in read.newest(spark.createDataFrame(rows, KV_LOG)).collect()}
    stream.ingest(stream.stream_log(spark, str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "c2")).awaitTermination()
    assert KVStore(spark, str(tmp_path / "store")).log().count() == 200
    ops = spark.createDataFrame([(k % 3, (k * 7) % 20, k) for k in range(60)], "client_id bigint, rpc_id bigint, version bigint")
    mixed = rng.sample(ops.collect(), 60)
    for k in range(4):
        spark.createDataFrame(mixed[k::4], ops.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "ops"))
    updates = stream.run_to_end(stream.dedup_stream(stream.stream_ops(spark, str(tmp_path / "ops"), 1, ops.schema)), str(tmp_path / "dedup"))
    last = {(r.client_id, r.version): (r.rpc_id, r.passes) for r in sorted(updates.collect(), key=lambda r: r.batch)}
    from kvlake.operators.write import dedup_high_water

    assert updates.select("batch").distinct().count() == 4
    assert sorted((c, r, v) for (c, v), (r, passes) in last.items() if passes) == sorted(tuple(r) for r in dedup_high_water(ops).collect())


def test_a_stream_without_rows(spark, tmp_path):
    spark.createDataFrame([], KV_LOG).write.parquet(str(tmp_path / "none"))
    updates = stream.run_to_end(stream.latest_by_key(stream.stream_log(spark, str(tmp_path / "none"))), str(tmp_path / "out"))
    assert updates.count() == 0 and updates.columns == ["key", "value", "version", "batch"]


def test_ingest_adds_a_batch_once(spark, store):
    rows = spark.createDataFrame([("k", "x", False, 3, 3, 7)], KV_LOG)
    assert store.add_log(rows, "source", 4) is Status.OK and store.add_log(rows, "source", 4) is Status.REPEATED
    assert store.add_log(rows, "other", 0) is Status.OK and store.log().count() == 2


def test_registry_forgets_idle_transactions():
    now = [0.0]
    r = stream.TxnRegistry(30, lambda: now[0])
    r.register(1, 5)
    r.register(2, 9)
    now[0] = 20
    assert r.touch(2) and r.watermark(100) == 5
    now[0] = 40
    assert r.watermark(100) == 9 and not r.touch(1)
    r.release(2)
    assert r.watermark(100) == 100
