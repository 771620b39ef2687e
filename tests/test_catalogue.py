"""The query catalogue: oracles on the smallest tables, and independence of the corpus operators."""

import itertools
import os
import subprocess
import sys

import duckdb
import pytest

from kvlake import cli
from kvlake.operators.check import GET, PUT, check, kv_step
from kvlake.plans import catalogue
from kvlake.sources.store import KVStore

SF = "/root/testdata/sf0.001"


def test_catalogue_equals_duckdb(spark):
    con = duckdb.connect()
    for t in ("events", "orders", "customer"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    text = lambda rows: sorted(str([float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r]) for r in rows)
    for name, sql in catalogue.ORACLES.items():
        frame = catalogue.QUERIES[name](spark, SF)
        want = con.execute(sql)
        names = [c[0] for c in want.description]
        assert sorted(names) == sorted(frame.columns), name
        assert text(frame.select(*names).collect()) == text(want.fetchall()), name


def test_every_history_of_the_catalogue_is_legal(spark):
    assert check(catalogue.QUERIES["linearizability"](spark, SF)).first().result == "Ok"


def test_histories_hold_every_event_and_equal_all_orders(spark, tmp_path):
    events = [(39_995 + k, k % 2, ("view", "click", "error", "view", "signup")[k % 5]) for k in range(10)] + [(250_000, 0, "view"), (9_000_000, 2, "view")]
    spark.createDataFrame(events, "event_id bigint, user_id bigint, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    histories, state = {}, {}
    for n, user, kind in events:
        if kind == "view":
            op = (GET, None, state.get(user, ""))
        else:
            state[user] = "" if kind == "error" else f"{kind}:{n}"
            op = (PUT, state[user], "")
        histories.setdefault(str(user), []).append((*op, n * 10 - 5, n * 10 + 10))

    def legal(ops, order):
        now = ""
        for k, at in enumerate(order):
            fits, now = kv_step(now, *ops[at][:3])
            if not fits or any(ops[j][4] < ops[at][3] for j in order[k + 1 :]):
                return False
        return True

    want = {(key, "Ok" if any(legal(ops, order) for order in itertools.permutations(range(len(ops)))) else "Illegal", len(ops)) for key, ops in histories.items()}
    assert {tuple(r) for r in catalogue.QUERIES["linearizability"](spark, str(tmp_path)).select("key", "result", "operations").collect()} == want


def test_the_library_does_not_import_the_corpus_operators():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    files = [os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(os.path.join(root, "kvlake")) for f in names if f.endswith(".py")]
    modules = [f[:-3].replace(os.sep, ".").removesuffix(".__init__") for f in files if not f.startswith(os.path.join("kvlake", "llm"))]
    code = f"import sys, importlib\nfor m in {modules!r}: importlib.import_module(m)\nassert not any(m.startswith('kvlake.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root)


@pytest.mark.parametrize("line", ["put a 1", "append a 2", "get a", "txn-demo a x", "range a b 5", "history a", "compact", "remove a", "get a", "?", ""])
def test_prompt(spark, tmp_path_factory, line):
    store = KVStore(spark, str(tmp_path_factory.getbasetemp() / "prompt"))
    want = {"put a 1": "OK", "append a 2": "OK", "txn-demo a x": "12 -> x: OK", "range a b 5": "a=x", "history a": "1: 1\n2: 12\n3: x", "compact": "True", "remove a": "OK", "?": "unknown command", "": ""}
    got = cli.answer(store, line)
    assert got == want[line] if line in want else got in ("12", "ErrNoKey")
