"""Linearizability of operation histories: a legal order is searched for each key, keys in parallel.

An operation may come first if no other operation returned before it was called.
The search takes such operations one by one as long as their results agree with
the state, remembers every (operations done, state) it has been in, and backs up
when stuck. Keys are independent, so a history is legal if each key's is. What is
done is kept as the first pending operation and the few done beyond it, so a
history costs its length times the operations that overlap, not its square.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvlake.shipping import ship_package

GET, PUT, APPEND, APPEND_GET = 0, 1, 2, 3


def kv_step(state: str, op: int, arg: str | None, ret: str | None) -> tuple[bool, str]:
    """Whether the result is right in this state, and the state after it."""
    if op == GET:
        return (ret or "") == state, state
    if op == PUT:
        return True, arg or ""
    if op == APPEND:
        return True, state + (arg or "")
    return (ret or "") == state, state + (arg or "")


@dataclass(frozen=True)
class Model:
    """What a history is checked against: states must be hashable; ``partition`` tells independent histories apart."""

    step: Callable = kv_step
    initial: object = ""
    partition: Column | str = "key"


def search(ops: list[tuple], timeout: float = 1.0, initial: object = "", step: Callable = kv_step) -> tuple[str, list[int]]:
    """ops: (op, arg, ret, call, return). Gives Ok, Illegal or Unknown and the longest legal order found.

    Unknown comes only from a timeout; 0 is none.
    """
    n, deadline = len(ops), time.monotonic() + timeout if timeout else None
    by_call = sorted(range(n), key=lambda k: ops[k][3])
    calls, returns = [ops[k][3] for k in by_call], [ops[k][4] for k in by_call]
    order: list[int] = []
    best: list[int] = []
    seen = {(0, 0, initial)}

    def choices(first: int, done: int) -> list[int]:
        """Pending operations called no later than the first return among the pending ones, latest first for the stack.

        ``first`` is the first pending place in order of call; bit j of ``done`` says that place first + j is done.
        """
        out, least, j = [], None, 0
        while first + j < n and (least is None or calls[first + j] <= least):
            if not done >> j & 1:
                out.append(first + j)
                least = returns[first + j] if least is None else min(least, returns[first + j])
            j += 1
        return out[::-1]

    stack = [(0, 0, initial, choices(0, 0))] if n else []
    while stack:
        if deadline and time.monotonic() > deadline:
            return "Unknown", max(best, order, key=len)
        first, done, state, open_ops = stack[-1]
        if not open_ops:
            if len(order) > len(best):
                best = list(order)  # copied only where the search backs up
            stack.pop()
            if order:
                order.pop()
            continue
        place = open_ops.pop()
        fits, after = step(state, *ops[by_call[place]][:3])
        at, now = first, done | 1 << (place - first)
        while now & 1:
            at, now = at + 1, now >> 1
        if not fits or (at, now, after) in seen:
            continue
        seen.add((at, now, after))
        order.append(by_call[place])
        if len(order) == n:
            return "Ok", order
        stack.append((at, now, after, choices(at, now)))
    return ("Ok" if not n else "Illegal"), best


def check_by_key(history: DataFrame, timeout: float = 1.0, model: Model = Model()) -> DataFrame:
    """key, result, operations, longest legal order (places in order of call) of a HISTORY table.

    ``key`` is the model's partition. The operations of one partition are one worker's.
    """
    ship_package(history.sparkSession)
    rows = history.withColumn("__part", (F.col(model.partition) if isinstance(model.partition, str) else model.partition).cast("string"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["call_ts", "return_ts"], kind="stable")
        text = lambda v: None if v is None or v != v else v
        ops = [(int(o), text(a), text(r), int(c), int(e)) for o, a, r, c, e in zip(rows.op, rows.arg, rows.ret, rows.call_ts, rows.return_ts, strict=True)]
        result, best = search(ops, timeout, model.initial, model.step)
        return pd.DataFrame({"key": [key[0]], "result": [result], "operations": [len(ops)], "longest": [best]})

    return rows.groupBy("__part").applyInPandas(run, "key string, result string, operations bigint, longest array<bigint>")


def check(by_key: DataFrame) -> DataFrame:
    """One row: Illegal if any key is, else Unknown if any is, else Ok."""
    worst = F.max(F.when(F.col("result") == "Illegal", 2).when(F.col("result") == "Unknown", 1).otherwise(0))
    return by_key.agg(F.element_at(F.array(F.lit("Ok"), F.lit("Unknown"), F.lit("Illegal")), F.coalesce(worst, F.lit(0)) + 1).alias("result"))


def pair_events(events: DataFrame) -> DataFrame:
    """(id, kind call|return, client_id, op, key, arg, ret, ts) -> HISTORY rows."""
    calls = events.where("kind = 'call'").select("id", "client_id", "op", "key", "arg", F.col("ts").alias("call_ts"))
    returns = events.where("kind = 'return'").select("id", "ret", F.col("ts").alias("return_ts"))
    return calls.join(returns, "id").select("client_id", "op", "key", "arg", "ret", "call_ts", "return_ts")
