"""Deterministic sharded WARC archives: writing, committing, reading back.

Writing range-sorts the records by page_id, and records of one page_id by a hash
of their contents, into shards of about equal size. The shard bounds are quantiles
of a sample chosen by a hash of each record, SAMPLES_A_SHARD records for a shard
and all records of a small table, so they depend on the rows alone; ids of any
spread and ids that many records share are cut alike. A task writes each of its
shards as gzip members, one for a record, and rolls to the next file when a file's
compressed size passes ``roll_bytes``. Record ids, dates, headers and digests are
regenerated from the rows, so the same rows give the same bytes. Files are written
under names that belong to one task attempt; Spark's own commit of the task results
decides which attempt counts; those files are renamed to their final names and the
manifest is published last. A reader follows the manifest and never sees anything
else. A lost executor costs its tasks only.

Of rows with equal payloads (of ``least_bytes`` at least) those of the largest
page_id become responses and the others revisit it; smaller ones are responses.
Payloads that very many rows share meet their rows by a broadcast of HOT_PAYLOADS
rows at most, so no task gets all of them.

Defined cases: null html is an empty payload; a null url gets a name made from
the page_id; null page_ids are written before all others and revisit like
others (a group of null ids alone is all responses); rows repeated with the same
page_id are separate records of the same kind; an empty table gives an empty
manifest; a payload of any length is one record; other columns, whatever their
names, are not read and not written.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from kvlake.llm.common import map_batches, shared_folder

DATE = "2024-01-01T00:00:00Z"
SAMPLES_A_SHARD, HOT_PAYLOADS = 64, 1000
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


class Store:
    """The few file operations needed, for local paths and for what pyarrow can reach."""

    def __init__(self, folder: str):
        scheme, _, rest = folder.partition(":") if ":" in folder else ("file", "", folder)
        self.local = scheme == "file"
        if self.local:
            self.root = "/" + rest.lstrip("/")
        else:
            from pyarrow import fs

            self.fs, self.root = fs.FileSystem.from_uri(folder)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def create(self, name: str):
        if self.local:
            os.makedirs(os.path.dirname(self.path(name)), exist_ok=True)
            return open(self.path(name), "wb")
        self.fs.create_dir(self.path(name).rpartition("/")[0], recursive=True)
        return self.fs.open_output_stream(self.path(name))

    def open(self, name: str):
        return open(self.path(name), "rb") if self.local else self.fs.open_input_stream(self.path(name))

    def size(self, name: str) -> int:
        if self.local:
            return os.path.getsize(self.path(name)) if os.path.exists(self.path(name)) else -1
        info = self.fs.get_file_info(self.path(name))
        return info.size if info.is_file else -1

    def rename(self, old: str, new: str, size: int) -> None:
        """May be repeated: a task that runs again finds the file in place."""
        if self.size(old) < 0 and self.size(new) == size:
            return
        if self.local:
            os.makedirs(os.path.dirname(self.path(new)), exist_ok=True)
            os.replace(self.path(old), self.path(new))
        else:
            self.fs.create_dir(self.path(new).rpartition("/")[0], recursive=True)
            self.fs.move(self.path(old), self.path(new))


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}:{digest}')}>"


def _lines(pairs: list[tuple[str, str]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in pairs).encode("utf-8")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP header of the response but not its payload."""
    digest = digest32(payload)
    http = b"HTTP/1.1 200 OK\r\n" + _lines([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]) + b"\r\n"
    block = http if revisit else http + payload
    target = quote(url, safe="%:/?#[]@!$&'()*+,;=~-._") if url else f"urn:page:{page_id}"
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{digest32(block)}"),
    ]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + _lines(head) + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """A gzip member without time or name, so that equal data give equal bytes."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def records(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    d, parts, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or stream.read(chunk)
        rest = b""
        if not data:
            if parts:
                raise ValueError("the archive ends inside a record")
            return
        parts.append(d.decompress(data))
        if d.eof:
            yield b"".join(parts)
            rest, d, parts = d.unused_data, zlib.decompressobj(31), []


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields and block of one record; digests are checked."""
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"not a WARC record: {first[:40]}")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != f"sha1:{digest32(block)}":
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return fields, block


NO_PAGE = -(1 << 63)


def shard_bounds(sample: pa.Table, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each shard but the first begins: (page_id, tie) that cut a sample (page_id, tie, size) into parts of equal size."""
    page, tie, size = (sample.column(c).to_numpy() for c in ("page_id", "tie", "size"))
    order = np.lexsort((tie, page))
    page, tie, upto = page[order], tie[order], np.cumsum(size[order])
    at = np.searchsorted(upto, np.arange(1, count) * (upto[-1] / count)) if len(upto) else np.zeros(0, np.int64)
    at = np.unique(np.minimum(at, max(0, len(upto) - 1)))
    return page[at], tie[at]


def shard_numbers(bounds: tuple[np.ndarray, np.ndarray], page: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """How many bounds are at or below each (page_id, tie)."""
    low, high = np.searchsorted(bounds[0], page, "left"), np.searchsorted(bounds[0], page, "right")
    out = low.copy()
    inside = np.flatnonzero(high > low)
    for first in np.unique(low[inside]):
        some = inside[low[inside] == first]
        out[some] += np.searchsorted(bounds[1][first : high[some[0]]], tie[some], "right")
    return out.astype(np.int32)


def _shard_column(bounds: tuple[np.ndarray, np.ndarray]) -> Column:
    @pandas_udf("int")
    def shard(page: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series(shard_numbers(bounds, page.to_numpy(), tie.to_numpy()))

    return shard(F.coalesce("page_id", F.lit(NO_PAGE)), F.col("tie"))


MANIFEST = "shard int, file string, temporary string, records bigint, bytes bigint, sha1 string"


def write_warc(pages: DataFrame, folder: str, shard_bytes: int = 8 << 20, roll_bytes: int = 2 << 20, least_bytes: int = 0, most_shards: int = 20_000, hot_rows: int = 100_000) -> DataFrame:
    """Write all rows of ``pages`` (page_id, url, html) under ``folder``; returns the committed manifest."""
    spark = pages.sparkSession
    rows = pages.selectExpr("cast(page_id as bigint) page_id", "url", "coalesce(html, '') html").withColumn("tie", F.xxhash64("url", "html"))
    meta = rows.select("page_id", "tie", F.octet_length("html").cast("bigint").alias("size"), F.unhex(F.sha1(F.encode("html", "UTF-8"))).alias("digest"))
    records_bytes = F.octet_length("html").cast("bigint") + 512
    total, size = rows.agg(F.count("*"), F.sum(records_bytes)).first()
    count = int(min(most_shards, -(-(size or 1) // shard_bytes)))
    unit = F.xxhash64("page_id", "tie", F.lit(1)).bitwiseAND(F.lit((1 << 30) - 1))
    share = min(1.0, SAMPLES_A_SHARD * count / max(1, total))
    sample = rows.where(unit < F.lit(int(share * (1 << 30)))).select(F.coalesce("page_id", F.lit(NO_PAGE)).alias("page_id"), "tie", records_bytes.alias("size")).toArrow()
    bounds = shard_bounds(sample, count)  # SAMPLES_A_SHARD * most_shards rows or so
    count = len(bounds[0]) + 1

    # one row for each distinct payload; only those found more than once go on
    groups = meta.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    limit = max(hot_rows, total // HOT_PAYLOADS)
    hot = F.broadcast(groups.where(F.col("n") > limit).selectExpr("digest", "size", "refers_to hot"))  # fewer than HOT_PAYLOADS rows
    cold = groups.where(F.col("n") <= limit).drop("n")
    # a row that has met its hot payload gets a key of its own, of another length than a digest
    own = F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.encode(F.col("tie").cast("string"), "UTF-8"))
    met = meta.join(hot, ["digest", "size"], "left").withColumn("own", own)
    refers = met.join(cold.withColumnRenamed("digest", "own"), ["own", "size"], "left").withColumn("refers_to", F.coalesce("hot", "refers_to"))
    flags = refers.where("refers_to is not null and (page_id is null or page_id <> refers_to)").select("page_id", "tie", "digest", "refers_to").distinct()
    # a flag travels to its record's shard and sorts just before the record
    both = flags.select("page_id", "tie", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), F.lit(0).alias("kind"), "digest", "refers_to").unionByName(
        rows.select("page_id", "tie", "url", "html", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("bigint").alias("refers_to"))
    )
    dealt = both.withColumn("shard", _shard_column(bounds)).repartitionById(count, "shard").sortWithinPartitions("shard", "page_id", "tie", "kind", "url", "html")
    schema = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("temporary", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())])

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, attempt = Store(folder), uuid.uuid4().hex
        done: list[tuple] = []
        out, shard_now, number, n, size, check, flags = None, None, 0, 0, 0, None, {}
        names = ("", "")

        def end() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((shard_now, *names, n, size, check.hexdigest()))
                out = None

        at = None
        for part in parts:
            cols = [c.to_pylist() for c in part.select(["shard", "page_id", "tie", "url", "html", "kind", "digest", "refers_to"]).columns]
            for s, page_id, tie, url, html, kind, digest, refers_to in zip(*cols, strict=True):
                if s != shard_now:
                    end()
                    shard_now, number = s, 0
                if (page_id, tie) != at:
                    flags, at = {}, (page_id, tie)
                if not kind:
                    flags[bytes(digest)] = refers_to
                    continue
                payload = html.encode("utf-8")
                target = flags.get(hashlib.sha1(payload).digest()) if flags else None
                if out is None:
                    names = (f"records-{s:05d}-{number:05d}.warc.gz", f"_temporary/{attempt}/records-{s:05d}-{number:05d}.warc.gz")
                    out, n, size, check = store.create(names[1]), 0, 0, hashlib.sha1()
                    number += 1
                member = gzip_member(record_bytes(page_id, url, payload, target, target is not None))
                out.write(member)
                check.update(member)
                n, size = n + 1, size + len(member)
                if size >= roll_bytes:
                    end()
        end()
        cols = list(zip(*done, strict=True)) if done else [[]] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    written = map_batches(dealt, write, MANIFEST)
    written.write.mode("error").parquet(f"{folder}/_written")  # one attempt of each task counts
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/_written")

    def commit(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(folder)
        for part in parts:
            for file, temporary, size in zip(*[part.column(k).to_pylist() for k in ("file", "temporary", "bytes")], strict=True):
                store.rename(temporary, file, size)
            yield part

    map_batches(manifest, commit, MANIFEST).select("shard", "file", "records", "bytes", "sha1").write.mode("error").parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("shard int, file string, records bigint, bytes bigint, sha1 string").parquet(f"{folder}/manifest")


def read_warc(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """One row for each record of the files that the manifest names; ``payload`` is null for revisits."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), *([("payload", pa.string())] if with_payload else [])])
    names = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload string" * with_payload

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(folder)
        for part in parts:
            for file, expected in zip(part.column("file").to_pylist(), part.column("records").to_pylist(), strict=True):
                rows, found, held = [], 0, 0
                with store.open(file) as stream:
                    for record in records(stream):
                        fields, block = parse(record)
                        head, _, payload = block.partition(b"\r\n\r\n")
                        length = int(dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])["Content-Length"])
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        revisit = fields["WARC-Type"] == "revisit"
                        if not revisit and (length != len(payload) or digest32(payload) != digest):
                            raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
                        number = lambda k, f=fields: int(f[k]) if k in f else None
                        rows.append((number("X-Page-ID"), fields["WARC-Target-URI"], length, digest, fields["WARC-Type"], number("X-Refers-To-Page-ID"), *([None if revisit else payload.decode("utf-8")] if with_payload else [])))
                        found, held = found + 1, held + len(payload)
                        if len(rows) >= 5000 or held > 16 << 20:
                            yield _batch(rows, schema)
                            rows, held = [], 0
                if found != expected:
                    raise ValueError(f"{file} holds {found} records, the manifest says {expected}")
                if rows:
                    yield _batch(rows, schema)

    files = read_manifest(spark, folder)
    return map_batches(files.repartition(max(1, min(4096, files.count())), "file"), read, names)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def warc_round_trip(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write the archives, then read page_id, payload_bytes, payload_digest, record_type and refers_to back."""
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    write_warc(pages, folder, **options)
    return read_warc(spark, folder).drop("url")


ORACLE = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, strlen(h) as n, sha1(h) as x, max(page_id) over (partition by h) as last from p)
select page_id, n::bigint as payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(x, (k // 4) * 5 + 1, 5))::integer >> (15 - 5 * (k % 4))::integer) & 31)::integer, 1)), '') as payload_digest,
       case when page_id < last then 'revisit' else 'response' end as record_type,
       case when page_id < last then last end as refers_to
from d
"""
