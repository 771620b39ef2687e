"""A small prompt over a store: get, put, append, remove, range, history, txn-demo, compact, quit."""

from __future__ import annotations

import shlex
import sys

from pyspark.sql import SparkSession

from kvlake.operators import read
from kvlake.operators.txn import Transaction
from kvlake.sources.store import KVStore


def answer(store: KVStore, line: str) -> str:
    """The reply to one command line."""
    words = shlex.split(line)
    if not words:
        return ""
    kv = lambda *rows: store.spark.createDataFrame(list(rows), "key string, value string")
    match words:
        case ["get", key]:
            row = store.get(key).first()
            return row.value if row.status == "OK" else row.status
        case ["put", key, value]:
            return store.put(kv((key, value))).value
        case ["append", key, value]:
            return store.append(kv((key, value))).value
        case ["remove", key]:
            return store.remove(kv((key, None))).value
        case ["range", start, end, *limit]:
            return "\n".join(f"{r.key}={r.value}" for r in store.range(start, end, limit=int(limit[0]) if limit else 0).collect())
        case ["history", key]:
            return "\n".join(f"{r.version}: {r.value}" for r in read.version_history(store.log()).where(f"key = '{key}'").orderBy("version").collect())
        case ["txn-demo", key, value]:
            txn = Transaction(store)
            before = txn.get(key)
            txn.put(key, value)
            return f"{before} -> {value}: {txn.commit().value}"
        case ["compact"]:
            return str(store.compact())
    return "unknown command"


def main() -> None:
    store = KVStore(SparkSession.builder.getOrCreate(), sys.argv[1])
    for line in sys.stdin:
        if line.strip() == "quit":
            break
        print(answer(store, line), flush=True)


if __name__ == "__main__":
    main()
