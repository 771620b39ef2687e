"""A durable store: immutable Parquet files by shard, and numbered manifests.

A batch is written to a folder of its own and becomes visible when manifest N+1,
created exclusively, names it; a reader pins one manifest and sees exactly its
folders. There is one writer at a time for each number: who finds N+1 taken
validates again on the newer state and tries the next. Nothing is rewritten in
place, so a lost executor or driver leaves at most unnamed folders, which
``vacuum`` removes once they are old. On a file system whose rename may replace an
existing file, as on some object stores, only one process may write.

A batch has a key once: later rows of a key win by an ``order`` column, and
without one a batch that repeats a key is refused. Rows are dealt over files by
ranges of (shard, key, version), so neither a shard nor a key is bound to one task.

Compaction is by level, as a level's folders are merged with those of the next and
files grow by level, or of all folders at once. Service tables (requests already
answered, shard states, configurations) can be put into a manifest beside the rows
and come back with it.
"""

from __future__ import annotations

import json
import os
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.functions.keys import decode_stored, key2shard, shards_of_range
from kvlake.operators import compact, read, write
from kvlake.schema import KV_LOG, Status
from kvlake.sources.registry import FolderMap, TxnRegistry


class KVStore:
    def __init__(self, spark: SparkSession, path: str, pin: int | None = None, ttl: float = 30.0):
        self.spark, self.path, self.pin = spark, path.rstrip("/"), pin
        jvm = spark.sparkContext._jvm
        self._hadoop, self._conf = jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._hadoop.Path(self.path).getFileSystem(self._conf)
        self.registry = TxnRegistry(ttl, time.time, FolderMap(self._fs, self._hadoop.Path(f"{self.path}/active")))
        if self.latest() < 0:
            self._publish(0, {"folders": [], "version": 0})

    def _writable(self) -> None:
        if self.pin is not None:
            raise PermissionError("a store that is pinned to a manifest is read only")

    # --- manifests ------------------------------------------------------------

    def _manifest(self, n: int):
        return self._hadoop.Path(f"{self.path}/manifests/{n:012d}.json")

    def latest(self) -> int:
        folder = self._hadoop.Path(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return -1
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(x[:-5]) for x in names if x.endswith(".json") and not x.startswith(("_", "."))), default=-1)

    def _publish(self, n: int, content: dict) -> bool:
        """Create manifest n unless it exists. The content is written aside first, so it appears whole."""
        aside, target = self._hadoop.Path(f"{self.path}/manifests/_{uuid.uuid4().hex}"), self._manifest(n)
        out = self._fs.create(aside, False)
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()
        try:
            return self._put_in_place(aside, target)
        finally:
            if self._fs.exists(aside):
                self._fs.delete(aside, False)

    def _put_in_place(self, aside, target) -> bool:
        if self._fs.getScheme() == "file":
            try:
                os.link(aside.toUri().getPath(), target.toUri().getPath())  # fails where the name is taken
                return True
            except FileExistsError:
                return False
        return self._rename(aside, target)

    def _rename(self, aside, target) -> bool:
        """A rename that never replaces."""
        none = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)
        try:
            self._hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(self._fs.makeQualified(aside), self._fs.makeQualified(target), none)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise

    def manifest(self, n: int | None = None) -> dict:
        n = self.latest() if n is None else n
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils
        stream = self._fs.open(self._manifest(n))
        try:
            return json.loads(bytes(text.toByteArray(stream)).decode())
        finally:
            stream.close()

    # --- reading ----------------------------------------------------------------

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], KV_LOG)
        rows = self.spark.read.schema(KV_LOG).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/{f}" for f in folders])
        return rows.select(*KV_LOG.fieldNames())

    def log(self, shards: list[int] | None = None) -> DataFrame:
        """All versions of the pinned, or latest, manifest; ``shards`` prunes partitions."""
        rows = self._rows(self.manifest(self.pin)["folders"])
        return rows if shards is None or len(shards) >= 10 else rows.where(F.col("shard").isin(shards))

    def shard(self, shard: int) -> DataFrame:
        return self.log([shard])

    def range(self, start: str = "", end: str = "", snapshot: int | None = None, limit: int = 0) -> DataFrame:
        return read.range_scan(self.log(shards_of_range(start, end)), start, end, snapshot, limit)

    def get(self, key: str, snapshot: int | None = None) -> DataFrame:
        return read.get(self.log(shards_of_range(key, key) if key else [0]), key, snapshot)

    def prefix(self, prefix: str, snapshot: int | None = None) -> DataFrame:
        return read.prefix_scan(self.log(shards_of_range(prefix, prefix) if prefix else None), prefix, snapshot)

    def version(self) -> int:
        return self.manifest()["version"]

    # --- writing ------------------------------------------------------------------

    def _write(self, rows: DataFrame, name: str, files: int | None = None) -> None:
        """Files of ranges of (shard, key, version), sorted, newest first, so files and row groups carry tight key ranges."""
        by = ("shard", "key", "version")
        out = rows.select(*KV_LOG.fieldNames())
        out = (out.repartitionByRange(files, *by) if files else out.repartitionByRange(*by)).sortWithinPartitions("shard", "key", F.desc("version"), F.desc("seq"))
        out.write.partitionBy("shard").option("parquet.page.write-checksum.enabled", "true").option("parquet.bloom.filter.enabled#key", "true").mode("error").parquet(f"{self.path}/data/{name}")

    def _drop(self, name: str) -> None:
        self._fs.delete(self._hadoop.Path(f"{self.path}/data/{name}"), True)

    def commit(self, rows: DataFrame | None, check=lambda: True, also: dict | None = None) -> Status:
        """Append (key, value) rows as one version, null values as tombstones, if ``check`` holds on the state before.

        Of rows of one key, that of the greatest ``order`` counts; without that column a repeated key is an error.
        ``also`` goes into the manifest.
        """
        self._writable()
        ordered = rows is not None and "order" in rows.columns
        if ordered:
            rows = rows.groupBy("key").agg(F.max_by(F.struct("value"), "order").alias("r")).select("key", "r.value")
        while True:
            n = self.latest()
            if not check():
                return Status.CONFLICT
            if rows is None and also is None:
                return Status.OK
            before = self.manifest(n)
            version, name = before["version"] + 1, f"batch={uuid.uuid4().hex}"
            after = before | (also or {})
            if rows is not None:
                self._write(write.as_log(rows, version), name)
                if not ordered and not self._rows([name]).groupBy("key").count().where("count > 1").isEmpty():
                    self._drop(name)
                    raise ValueError("a batch holds a key twice; an order column says which row comes last")
                after |= {"folders": [*before["folders"], name], "version": version}
            if self._publish(n + 1, after):
                return Status.OK
            if rows is not None:
                self._drop(name)

    def put(self, rows: DataFrame) -> Status:
        return self.commit(rows.select("key", "value", *(["order"] if "order" in rows.columns else [])))

    def remove(self, keys: DataFrame) -> Status:
        return self.commit(keys.select("key", F.lit(None).cast("string").alias("value")).distinct())

    def append(self, rows: DataFrame) -> Status:
        """Append text to values, in the order of an ``order`` column where a key is repeated; an absent key counts as the empty text."""
        self._writable()
        if "order" not in rows.columns:
            if not rows.groupBy("key").count().where("count > 1").isEmpty():
                raise ValueError("a batch appends to a key twice; an order column says in which order")
            rows = rows.withColumn("order", F.lit(0))
        parts = F.array_sort(F.collect_list(F.struct("order", "value")))
        tails = rows.groupBy("key").agg(F.array_join(F.transform(parts, lambda x: x["value"]), "").alias("tail"))
        while True:
            n = self.latest()
            now = read.newest(self.log().join(rows.select("key").distinct(), "key", "left_semi")).select("key", F.col("value").alias("old"))
            new = tails.join(now, "key", "left").select("key", F.concat(F.coalesce("old", F.lit("")), "tail").alias("value"))
            if self.commit(new, check=lambda n=n: self.latest() == n) is Status.OK:
                return Status.OK

    def add_log(self, rows: DataFrame, source: str | None = None, batch: int | None = None) -> Status:
        """Append rows that carry their versions, as a migration or a stream brings them.

        With ``source`` and ``batch`` the manifest notes the batch, and one that it has noted is not added again.
        """
        self._writable()
        if source is not None and self._noted(self.manifest(), source) >= batch:
            return Status.REPEATED
        name = f"batch={uuid.uuid4().hex}"
        self._write(rows, name)
        top = self._rows([name]).agg(F.max("version")).first()[0]
        while True:
            n = self.latest()
            before = self.manifest(n)
            if source is not None and self._noted(before, source) >= batch:
                self._drop(name)
                return Status.REPEATED
            after = before | {"folders": [*before["folders"], *([name] if top is not None else [])], "version": max(before["version"], top or 0)}
            if source is not None:
                after["sources"] = before.get("sources", {}) | {source: batch}
            if self._publish(n + 1, after):
                return Status.OK

    @staticmethod
    def _noted(manifest: dict, source: str) -> int:
        return manifest.get("sources", {}).get(source, -1)

    def import_raw(self, rows: DataFrame) -> Status:
        """(key, value) of a raw export: tagged values are live, empty ones tombstones, all of version 0."""
        value = F.when(F.col("value") == "", F.lit(None)).otherwise(decode_stored(F.col("value")))
        return self.add_log(write.as_imported(rows.select("key", value.alias("value"))))

    # --- transactions' registry, compaction ------------------------------------------

    @property
    def active(self) -> dict:
        """Open transactions of all processes and their snapshots."""
        self.registry.sweep()
        return {txn: snapshot for txn, (snapshot, _) in self.registry.open.items()}

    def begin(self, txn) -> int:
        """Register a transaction at the newest version."""
        txn.token = uuid.uuid4().hex
        snapshot = -1
        while snapshot != (now := self.version()):  # a commit may come before the registration is seen
            snapshot = now
            self.registry.register(txn.token, snapshot)
        return snapshot

    def touch(self, txn) -> bool:
        return self.registry.touch(txn.token)

    def end(self, txn) -> None:
        if getattr(txn, "token", None):
            self.registry.release(txn.token)

    def watermark(self) -> int:
        return self.registry.watermark(self.version())

    def _replace(self, n: int, before: dict, old: list[str], level: int, purge_tombstones: bool, watermark: int | None, files: int | None) -> bool:
        name = f"batch={uuid.uuid4().hex}"
        self._write(compact.gc_rewrite(self._rows(old), self.watermark() if watermark is None else watermark, purge_tombstones), name, files)
        levels = {f: k for f, k in before.get("levels", {}).items() if f not in old} | {name: level}
        done = self._publish(n + 1, before | {"folders": [name, *[f for f in before["folders"] if f not in old]], "levels": levels})
        if not done:
            self._drop(name)
        return done

    def compact(self, watermark: int | None = None, purge_tombstones: bool = False) -> bool:
        """Rewrite all folders as one with old versions dropped; False if somebody committed meanwhile."""
        self._writable()
        n = self.latest()
        before = self.manifest(n)
        if len(before["folders"]) < 2:
            return True
        return self._replace(n, before, before["folders"], 1, purge_tombstones, watermark, None)

    def drop_shards(self, shards: list[int]) -> Status:
        """Rewrite the store without the rows of some shards; older manifests still have them."""
        self._writable()
        while True:
            n = self.latest()
            before = self.manifest(n)
            if self.log(shards).isEmpty():
                return Status.OK
            name = f"batch={uuid.uuid4().hex}"
            self._write(self._rows(before["folders"]).where(~F.col("shard").isin(shards)), name)
            if self._publish(n + 1, before | {"folders": [name], "levels": {name: 1}}):
                return Status.OK
            self._drop(name)

    def level_folders(self, before: dict | None = None) -> dict[int, list[str]]:
        """Folders by level; new batches are of level 0."""
        before = before or self.manifest(self.pin)
        out: dict[int, list[str]] = {}
        for f in before["folders"]:
            out.setdefault(before.get("levels", {}).get(f, 0), []).append(f)
        return out

    def compact_level(self, level: int, watermark: int | None = None) -> bool:
        """Merge the folders of a level with those of the next, which is merged first if it is full; files get the next level's size."""
        self._writable()
        if len(self.level_folders().get(level + 1, [])) >= compact.FILES_TO_COMPACT and not self.compact_level(level + 1, watermark):
            return False
        n = self.latest()
        before = self.manifest(n)
        by_level = self.level_folders(before)
        old = [*by_level.get(level, []), *by_level.get(level + 1, [])]
        if not by_level.get(level):
            return True
        size = sum(self._fs.getContentSummary(self._hadoop.Path(f"{self.path}/data/{f}")).getLength() for f in old)
        files = max(1, -(-size // compact.target_bytes(level + 1)))
        return self._replace(n, before, old, level + 1, False, watermark, files)

    def maintain(self, watermark: int | None = None) -> int:
        """Compact the lowest full level until none is full; the number of merges."""
        done = 0
        while full := [k for k, f in self.level_folders().items() if len(f) >= compact.FILES_TO_COMPACT]:
            if self.compact_level(min(full), watermark):
                done += 1
        return done

    def needs_compaction(self) -> bool:
        return any(len(f) >= compact.FILES_TO_COMPACT for f in self.level_folders().values())

    def vacuum(self, keep: int = 1, older_than: float = 86_400.0) -> int:
        """Delete folders that none of the last ``keep`` manifests, nor one that a lost shard is read from, names and that have not changed for ``older_than`` seconds.

        The age must exceed the time that any write takes: folders of a commit under way are not named yet.
        """
        self._writable()
        last = self.latest()
        kept = {*range(max(0, last - keep + 1), last + 1), *self.state().get("shadow", {}).values()}
        named = {f for k in kept for f in self._named(self.manifest(k))}
        gone, before = 0, (time.time() - older_than) * 1000
        for folder in ("data", "service"):
            root = self._hadoop.Path(f"{self.path}/{folder}")
            for s in self._fs.listStatus(root) if self._fs.exists(root) else []:
                if s.getPath().getName() not in named and s.getModificationTime() <= before:
                    self._fs.delete(s.getPath(), True)
                    gone += 1
        return gone

    @staticmethod
    def _named(manifest: dict) -> set[str]:
        return {*manifest["folders"], *manifest.get("tables", {}).values()}

    # --- service tables -------------------------------------------------------------------

    def save_tables(self, tables: dict[str, DataFrame], state: dict | None = None, check=lambda: True, rows: DataFrame | None = None) -> Status:
        """Put service tables, and small state, into the next manifest, with ``rows`` as a batch of the same manifest."""
        self._writable()
        named = {}
        for name, table in tables.items():
            named[name] = f"{name}-{uuid.uuid4().hex}"
            table.write.mode("error").parquet(f"{self.path}/service/{named[name]}")
        before = self.manifest()
        also = {"tables": before.get("tables", {}) | named}
        if state is not None:
            also["state"] = before.get("state", {}) | state
        return self.commit(rows, check, also)

    def table(self, name: str) -> DataFrame | None:
        """A service table as of the pinned, or latest, manifest."""
        found = self.manifest(self.pin).get("tables", {}).get(name)
        return self.spark.read.parquet(f"{self.path}/service/{found}") if found else None

    def state(self) -> dict:
        return self.manifest(self.pin).get("state", {})

    def restore(self, n: int) -> Status:
        """Make the rows and service tables of manifest n the newest state; its folders must not have been vacuumed."""
        self._writable()
        while True:
            last = self.latest()
            old = self.manifest(n)
            if self._publish(last + 1, old | {"version": max(old["version"], self.manifest(last)["version"])}):
                return Status.OK

    # --- exports ----------------------------------------------------------------------------

    def export_shard(self, shard: int) -> DataFrame:
        return read.snapshot_scan(self.shard(shard)).select("key", "value")

    def export_all(self) -> DataFrame:
        """(shard, key, value) of all live rows."""
        return read.snapshot_scan(self.log()).select(key2shard(F.col("key")).alias("shard"), "key", "value")
