"""The state machine of a group, its configurations and moves of shards, and the write buffer."""

import random

import pytest

from kvlake.client import Client
from kvlake.functions.keys import Bloom
from kvlake.operators import check, machine, read, shards
from kvlake.operators.txn import TransactionError
from kvlake.schema import HISTORY, OP_LOG, Status
from kvlake.sources.buffer import WriteBuffer
from kvlake.sources.service import ShardService
from kvlake.sources.store import KVStore
from kvlake.streaming import stream

KV = "key string, value string"


def brute(ops, state=None, answered=None, served=None):
    """The apply loop by plain dictionaries."""
    state, answered, out = dict(state or {}), dict(answered or {}), {}
    for idx, client, rpc, op, key, value in sorted(ops):
        if served is not None and (key.encode()[0] % 10 if key else 0) not in served:
            out[idx] = ("ErrWrongGroup", None, False)
            continue
        if client in answered and rpc <= answered[client][0]:
            out[idx] = (*answered[client][1:], False)
            continue
        status, shown = "OK", None
        if op == "Get":
            status, shown = ("OK", state[key]) if key in state else ("ErrNoKey", None)
        elif op == "Put":
            state[key] = value
        elif op == "Append":
            state[key] = state.get(key, "") + value
        else:
            state.pop(key, None)
        answered[client] = (rpc, status, shown)
        out[idx] = (status, shown, True)
    return out, state, answered


def random_ops(rng, n, start=1):
    return [(k, rng.randrange(4), k // 3 + rng.randrange(-3, 3), rng.choice(["Put", "Append", "Append", "Get", "Delete"]), rng.choice("abcxyz"), rng.choice("pqrs")) for k in range(start, start + n)]


def test_ops_are_applied_as_by_a_plain_loop(spark):
    rng = random.Random(7)
    for _ in range(4):
        ops = random_ops(rng, 120)
        state, answered, served = {"a": "old", "q": "other"}, {1: (5, "OK", "seen"), 9: (1, "OK", None)}, rng.sample(range(10), 7)
        want, state_after, answered_after = brute(ops, state, answered, served)
        frames = machine.apply_ops(spark.createDataFrame(rng.sample(ops, len(ops)), OP_LOG).repartition(3), spark.createDataFrame(list(state.items()), KV), spark.createDataFrame([(c, *x) for c, x in answered.items()], machine.ANSWERED), served)
        answers, changed, after = (f.collect() for f in frames)
        assert {r.idx: (r.status, r.value, r.applied) for r in answers} == want
        now = dict(state)
        for r in changed:
            now.pop(r.key, None)
            if r.value is not None:
                now[r.key] = r.value
        assert now == state_after
        assert {r.client_id: (r.rpc_id, r.status, r.value) for r in after} == answered_after
    empty = machine.apply_ops(spark.createDataFrame([], OP_LOG), spark.createDataFrame([], KV))
    assert [f.count() for f in empty] == [0, 0, 0]


def service(spark, tmp_path, gid=1):
    return ShardService(KVStore(spark, str(tmp_path / f"group{gid}")), gid)


def all_to(num, gid, moved=()):
    return shards.Config(num, tuple(2 if k in moved else gid for k in range(10)), {1: ("a",), 2: ("b",)})


def test_fed_ops_wait_for_their_turn(spark, tmp_path):
    rng = random.Random(3)
    group = service(spark, tmp_path)
    assert group.get("a") == ("ErrWrongGroup", None) and group.reconfigure(all_to(1, 1)) is Status.OK
    ops = random_ops(rng, 60)
    want, state, answered = brute(ops)
    for k in range(3):
        spark.createDataFrame(rng.sample(ops, 60)[k * 20 : k * 20 + 20] if k < 2 else ops, OP_LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "ops"))
    stream.apply_stream(stream.stream_ops(spark, str(tmp_path / "ops"), 1), group.store.path, 1, str(tmp_path / "c")).awaitTermination()
    assert group.state["applied"] == 60 and {r.key: r.value for r in group.store.range().collect()} == state
    assert {r.client_id: (r.rpc_id, r.status, r.value) for r in group.answered().collect()} == answered
    before = group.store.latest()
    group.feed(spark.createDataFrame(ops, OP_LOG))
    assert {r.key: r.value for r in group.store.range().collect()} == state and before < group.store.latest()


def test_shards_move_with_their_rows_and_answers(spark, tmp_path):
    one, two = service(spark, tmp_path, 1), service(spark, tmp_path, 2)
    groups = {1: one, 2: two}
    for g in groups.values():
        assert g.reconfigure(all_to(1, 1)) is Status.OK and g.reconfigure(all_to(3, 1)) is Status.NOT_READY
    assert one.serves() == list(range(10)) and two.serves() == []
    ops = [(1, 1, 1, "Put", "a", "va"), (2, 1, 2, "Put", "b", "vb"), (3, 2, 1, "Append", "a", "+"), (4, 2, 7, "Get", "b", None)]
    one.apply(spark.createDataFrame(ops, OP_LOG))
    moved = [ord("a") % 10, ord("c") % 10]
    assert one.reconfigure(all_to(2, 1, moved)) is Status.OK
    assert one.get("a") == ("ErrWrongGroup", None) and one.get("b") == ("OK", "vb")
    assert two.pull(1, 3)[0] is Status.NOT_READY and one.pull(2, moved[0])[0] is Status.NOT_READY
    assert two.reconfigure(all_to(2, 1, moved)) is Status.OK and two.state["shards"][moved[0]] == "Pulling"
    assert two.get("a") == ("ErrWrongGroup", None) and two.reconfigure(all_to(3, 1)) is Status.NOT_READY
    assert one.pull(1, 0)[0] is Status.NO_KEY
    one.store.vacuum(older_than=0)
    assert two.migrate(groups) == sorted(moved) and two.serves() == sorted(moved)
    assert two.get("a") == ("OK", "va+") and one.store.log([moved[0]]).isEmpty() and one.state["shadow"] == {}
    again = two.apply(spark.createDataFrame([(1, 2, 7, "Put", "a", "again"), (2, 2, 8, "Get", "a", None)], OP_LOG)).collect()
    assert {(r.idx, r.status, r.value) for r in again} == {(1, "OK", "vb"), (2, "OK", "va+")}  # request 7 was answered by the other group
    assert two.store.get("a").first().version > 0
    assert one.state["shards"][moved[0]] == "Absent" and one.reconfigure(all_to(3, 1)) is Status.OK and two.reconfigure(all_to(3, 1)) is Status.OK
    assert one.migrate(groups) == sorted(moved) and one.get("a") == ("OK", "va+")


def test_checkpoints_bring_everything_back(spark, tmp_path):
    group = service(spark, tmp_path)
    group.reconfigure(all_to(1, 1))
    group.apply(spark.createDataFrame([(1, 1, 1, "Put", "a", "1")], OP_LOG))
    at = group.checkpoint()
    group.apply(spark.createDataFrame([(2, 1, 2, "Put", "a", "2"), (3, 2, 1, "Put", "b", "2")], OP_LOG))
    group.reconfigure(all_to(2, 1, [7]))
    again = ShardService(KVStore(spark, group.store.path), 1)
    assert again.restore(at) is Status.OK
    assert [(r.key, r.value, r.version) for r in again.store.range().collect()] == [("a", "1", 1)]
    assert again.state["config"] == 1 and again.state["applied"] == 1 and [r.rpc_id for r in again.answered().collect()] == [1]
    again.apply(spark.createDataFrame([(2, 1, 2, "Append", "a", "+")], OP_LOG))
    assert again.get("a") == ("OK", "1+")


def test_a_client_follows_configurations(spark, tmp_path):
    history = shards.ConfigHistory()
    groups = {1: service(spark, tmp_path, 1), 2: service(spark, tmp_path, 2)}
    client = Client(history, groups, client_id=5, pause=0)
    with pytest.raises(TransactionError):
        client.get("a")
    history.join({1: ["x"]})
    assert groups[1].reconfigure(history.query()) is Status.OK and groups[2].reconfigure(history.query()) is Status.OK
    assert client.get("a") is None and client.put("a", "1") is Status.OK and client.append("a", "2") is Status.OK and client.get("a") == "12"
    assert groups[1].call(5, client.rpc_id, "Append", "a", "again") == ("OK", "12")  # the last request, sent again
    assert client.put("b", "x") is Status.OK and [tuple(r) for r in client.range("a", "c").collect()] == [("a", "12"), ("b", "x")]
    history.join({2: ["y"]})
    for g in groups.values():
        g.reconfigure(history.query())
    moved = groups[2].migrate(groups)
    assert len(moved) == 5 and client.get("a") == "12" and client.get("b") == "x"
    assert [tuple(r) for r in client.range("", "", 1).collect()] == [("a", "12")]
    txn = client.begin("a", "Serializable")
    assert txn.get("a") == "12" and txn.put("a", "t") and not txn.put("b", "t")
    assert txn.commit() is Status.WRONG_GROUP
    txn = client.begin("a")
    txn.put("a", "t")
    with pytest.raises(TransactionError):
        client.begin("a").range("", "b")
    assert txn.commit() is Status.OK and client.get("a") == "t"
    assert client.remove("a") is Status.OK and client.get("a") is None


def test_the_buffer_freezes_and_flushes_oldest_first(spark, tmp_path):
    store = KVStore(spark, str(tmp_path / "store"))
    buffer = WriteBuffer(store, limit=8)
    for k, v in (("a", "1234"), ("b", "1234"), ("a", "5678"), ("c", "12345678"), ("d", "1")):
        buffer.put(k, v)
    assert len(buffer.frozen) == 2 and buffer.get("a") == "5678" and store.latest() == 0
    assert buffer.flush_oldest() and store.get("a").first().value == "1234" and buffer.get("a") == "5678"
    buffer.remove("b")
    assert buffer.get("b") is None
    buffer.flush()
    assert {r.key: r.value for r in store.range().collect()} == {"a": "5678", "c": "12345678", "d": "1"} and not buffer.frozen and buffer.size == 0
    assert not buffer.flush_oldest()


def test_bloom_filters_drop_what_they_do_not_hold(spark):
    keys = spark.range(2000).selectExpr("cast(id as string) key")
    bloom = Bloom.of(keys, "key", 0.01)
    again = Bloom.from_bytes(bloom.to_bytes())
    assert (again.bits, again.hashes, again.words) == (bloom.bits, bloom.hashes, bloom.words)
    assert keys.where(again.may_contain(keys["key"])).count() == 2000
    others = spark.range(10_000, 30_000).selectExpr("cast(id as string) key")
    assert others.where(again.may_contain(others["key"])).count() < 1000


def test_as_of_with_clashing_columns(spark):
    log = spark.createDataFrame([("k", "x", False, 3, 3, 7)], "key string, value string, is_tombstone boolean, version bigint, seq bigint, shard int")
    asked = spark.createDataFrame([("k", 4, "mine", 9), ("k", 1, "other", 8)], "key string, snapshot bigint, value string, version int")
    got = read.as_of(log, asked).orderBy("snapshot").collect()
    assert [(r.request_value, r.request_version, r.value, r.version) for r in got] == [("other", 8, None, 0), ("mine", 9, "x", 3)]


@pytest.mark.parametrize("ranges", [1, 3, 64])
def test_blocks_do_not_depend_on_ranges(spark, ranges):
    from kvlake.operators import compact

    rng = random.Random(ranges)
    rows = [(rng.choice(["hot", *"abcdef"]) + str(rng.randrange(3)), "v" * rng.randrange(30), False, k, k, 0) for k in range(400)]
    rows = [(k, v, t, n, s, k.encode()[0] % 10) for k, v, t, n, s, _ in rows]
    want = {}
    held = {}
    for k, v, _, n, _, shard in sorted(rows, key=lambda r: (r[0], -r[3])):
        block = held.get(shard, 0) // 100
        held[shard] = held.get(shard, 0) + 12 + len(k) + len(v)
        want.setdefault((shard, block), []).append((k, n))
    log = spark.createDataFrame(rows, "key string, value string, is_tombstone boolean, version bigint, seq bigint, shard int").repartition(3)
    got = {(r.shard, r.block): (r.entries, r.first_key, r.last_key, r.min_version, r.max_version) for r in compact.block_stats(log, 100, ranges, 1).collect()}
    assert got == {b: (len(x), x[0][0], x[-1][0], min(n for _, n in x), max(n for _, n in x)) for b, x in want.items()}


def test_reconfigure_takes_one_step_only(spark):
    h = shards.ConfigHistory()
    h.join({1: ["a"]})
    h.join({2: ["b"]})
    frame = h.frame(spark)
    at = lambda n: shards.config_at(frame, n)
    assert shards.reconfigure(at(1), at(2), 1).count() == 10 and shards.reconfigure(at(0), at(2), 1).count() == 0
    assert check.check(check.check_by_key(spark.createDataFrame([], HISTORY))).first().result == "Ok"
