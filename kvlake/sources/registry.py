"""Open transactions and their snapshots, with an idle limit; the least snapshot is the compaction watermark."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, MutableMapping

from py4j.protocol import Py4JJavaError


class FolderMap(MutableMapping):
    """transaction -> (snapshot, last seen), one empty file each, so that all processes over a store see them."""

    def __init__(self, fs, folder):
        self.fs, self.folder = fs, folder

    def _files(self) -> dict[str, tuple[tuple[int, float], object]]:
        found: dict[str, tuple[tuple[int, float], object]] = {}
        for s in self.fs.listStatus(self.folder) if self.fs.exists(self.folder) else []:
            txn, snapshot, seen = s.getPath().getName().split(".")
            value = (int(snapshot), int(seen) / 1000)
            if txn not in found or value[1] > found[txn][0][1]:
                found[txn] = (value, s.getPath())
        return found

    def __getitem__(self, txn: str) -> tuple[int, float]:
        return self._files()[txn][0]

    def __setitem__(self, txn: str, value: tuple[int, float]) -> None:
        before = self._files().get(txn)
        path = self.folder.suffix(f"/{txn}.{value[0]}.{int(value[1] * 1000)}")
        self.fs.create(path, True).close()
        if before and before[1].getName() != path.getName():
            self.fs.delete(before[1], False)

    def __delitem__(self, txn: str) -> None:
        found = self._files().get(txn)
        if found:
            try:
                self.fs.delete(found[1], False)
            except Py4JJavaError:  # another process has swept it
                pass

    def __iter__(self) -> Iterator[str]:
        return iter(self._files())

    def __len__(self) -> int:
        return len(self._files())

    def items(self):
        return [(txn, value) for txn, (value, _) in self._files().items()]


class TxnRegistry:
    def __init__(self, ttl: float = 30.0, clock: Callable[[], float] | None = None, open: MutableMapping | None = None):
        self.ttl, self.clock = ttl, clock or time.monotonic
        self.open = {} if open is None else open

    def register(self, txn, snapshot: int) -> None:
        self.open[txn] = (snapshot, self.clock())

    def touch(self, txn) -> bool:
        """Whether the transaction is still open; it counts as seen now."""
        self.sweep()
        seen = dict(self.open.items()).get(txn)
        if seen is None:
            return False
        self.open[txn] = (seen[0], self.clock())
        return True

    def release(self, txn) -> None:
        self.open.pop(txn, None)

    def sweep(self) -> None:
        now = self.clock()
        for txn, (_, seen) in list(self.open.items()):
            if now - seen > self.ttl:
                self.open.pop(txn, None)

    def watermark(self, last: int) -> int:
        self.sweep()
        return min([last, *(s for _, (s, _) in self.open.items())])
