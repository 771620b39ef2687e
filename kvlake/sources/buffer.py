"""Small writes gathered in memory and committed in batches."""

from __future__ import annotations

from kvlake.schema import Status
from kvlake.sources.store import KVStore

LIMIT = 64 << 20


class WriteBuffer:
    """A table of single writes. A full one is frozen before the next write; frozen ones are committed oldest first, a batch each.

    Reads see the newest of all tables, then the store. What is not flushed is lost with the process.
    """

    def __init__(self, store: KVStore, limit: int = LIMIT):
        self.store, self.limit, self.size = store, limit, 0
        self.table: dict[str, str | None] = {}
        self.frozen: list[dict[str, str | None]] = []  # oldest first

    def _set(self, key: str, value: str | None) -> None:
        if self.size > self.limit:
            self.freeze()
        self.table[key] = value
        self.size += len(key.encode()) + len((value or "").encode())

    def put(self, key: str, value: str) -> None:
        self._set(key, value)

    def remove(self, key: str) -> None:
        self._set(key, None)

    def get(self, key: str) -> str | None:
        for table in (self.table, *reversed(self.frozen)):
            if key in table:
                return table[key]
        return self.store.get(key).first().value

    def freeze(self) -> None:
        if self.table:
            self.frozen.append(self.table)
        self.table, self.size = {}, 0

    def flush_oldest(self) -> bool:
        """Commit the oldest frozen table; False if there is none."""
        if not self.frozen:
            return False
        rows = self.store.spark.createDataFrame(list(self.frozen[0].items()), "key string, value string")
        if self.store.put(rows) is Status.OK:
            self.frozen.pop(0)
        return True

    def flush(self) -> None:
        self.freeze()
        while self.flush_oldest():
            pass
