"""The registered corpus queries and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kvlake.llm import contracts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: getattr(contracts, name) for name in dir(contracts) if name.startswith("op") and name[2].isdigit()
}
ORACLES: dict[str, str] = dict(contracts.ORACLES)
