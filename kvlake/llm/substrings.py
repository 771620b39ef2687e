"""Removal of repeated word windows, by difference-cover anchors.

A window is WINDOW consecutive words of one document. Every window whose words
also start at a smaller (doc_id, place) is found, and the words it covers go.

COVER is a difference cover modulo PERIOD: for any two places i and j some shift
below PERIOD takes both onto cover residues. So two equal windows share an equal
anchor (ANCHOR = WINDOW - PERIOD + 1 words) that starts at a cover residue in
both. Only anchors at cover residues are hashed and shuffled, 4 of 13 places.

1. Anchors. Each task hashes the anchors of its documents and sends every
   distinct hash once, however many copies it holds. A bucket of hashes finds
   those seen more than once and answers the places that sent them.
2. Extension. Documents meet the answers. Every window that holds a shared
   anchor is extended to its full words, hashed with 96 bits and, again once for
   each bucket of documents, compared by hash. Later occurrences inside a bucket
   of documents are settled on the spot.
3. Removal. Documents meet the places of their later windows.

A passage in a third of all documents costs each task one entry for each of its
anchors. No pairs of places are made, so groups of any size cost their length.

Buckets of documents hold about blobs.BUCKET_BYTES of text, however large the table.

Defined cases: null texts have no words; documents of fewer than WINDOW words
lose nothing; texts of any length are read whole; rows that share a doc_id are at
equal places, so none of them is earlier than the other and identical rows stay
alike; null ids come after all others, equal texts as one id and different ones in
an order of their hashes, so they are spread over all buckets; an empty table gives
an empty one; other columns, whatever their names, are not read and not returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlake.llm import blobs
from kvlake.llm.common import Rolling, WordHashes, map_batches, split_words
from kvlake.shipping import ship_package

WINDOW, PERIOD, COVER = 20, 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
NO_IDS = blobs.NO_ID - (1 << 40) + 1  # ids from here on stand for null
SHARED, LATER, SEEN = 0, 1, 2  # kinds of rows: places of shared anchors, places of later windows, hashes to compare
_ROLL, _CHECK = Rolling(), Rolling(0xD6E8FEB86659FD93 | 1)


def _hashes(words: WordHashes, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts one after another, and the number of words of each text."""
    parts = [words.of(split_words(x)) for x in texts]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.fromiter(map(len, parts), np.int64, len(parts))


def _places(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word its document and its place there."""
    first = np.cumsum(counts) - counts
    return np.repeat(ids, counts), np.arange(int(counts.sum())) - np.repeat(first, counts)


def _runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by hash and the first item of every run of equals."""
    order = np.argsort(h, kind="stable")
    ordered = h[order]
    new = np.ones(len(h), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return order, new


def _anchors(keys: np.ndarray, unit: int):
    """Pass 1: rows of SEEN for buckets of hashes, rows of SHARED for buckets of documents."""
    n = len(keys)
    residue = np.zeros(PERIOD, bool)
    residue[list(COVER)] = True

    def work(words: WordHashes, ids: list, texts: list) -> list[tuple]:
        h, counts = _hashes(words, texts)
        doc, at = _places(np.array(ids, np.int64), counts)
        left = np.repeat(counts, counts) - at  # words from here to the text's end
        long = np.repeat(counts >= WINDOW, counts)
        chosen = np.flatnonzero(residue[at % PERIOD] & (left >= ANCHOR) & long)
        if not len(chosen):
            return []
        g = _ROLL.windows(_ROLL.prefix(h), ANCHOR)[chosen]
        order, new = _runs(g)
        head = np.flatnonzero(new)
        many = np.diff(np.append(head, len(order))) > 1
        sent = order[head]
        again = np.ones(len(order), bool)
        again[head[~many]] = False
        by_place = np.argsort(sent, kind="stable")
        sent, many = sent[by_place], many[by_place]
        out = list(blobs.rows_by(blobs.hash_bucket(g[sent], n), keys, SEEN, doc[chosen[sent]], at[chosen[sent]], g[sent], many.astype(np.uint8)))
        known = np.sort(chosen[order[again]])
        out += blobs.rows_by(blobs.doc_bucket(doc[known], n), keys, SHARED, doc[known], at[known])
        return out

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids, texts, held = WordHashes(), [], [], 0
        for part in parts:
            for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(text)
                held += len(text or "")
                if held >= unit:
                    yield blobs.batch(work(words, ids, texts))
                    ids, texts, held = [], [], 0
        if ids:
            yield blobs.batch(work(words, ids, texts))

    return run


def _shared(keys: np.ndarray):
    """A bucket of anchor hashes: answers the places whose hash came more than once."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, docs, at, many = [], [], [], []
        for part in parts:
            seen = np.array(part.column(1).to_pylist()) == SEEN
            if not seen.all():
                yield part.filter(pa.array(~seen))
            for _, _, d, a, h, m in zip(*(c.to_pylist() for c in part.filter(pa.array(seen)).columns), strict=True):
                ids, places = blobs.unpack(d, a)
                hashes.append(blobs.unpack_hash(h))
                docs.append(ids)
                at.append(places.astype(np.uint32))
                many.append(np.frombuffer(m, np.uint8))
        if not hashes:
            return
        h, d, a, m = np.concatenate(hashes), np.concatenate(docs), np.concatenate(at), np.concatenate(many).astype(bool)
        order, new = _runs(h)
        group = np.cumsum(new) - 1
        size = np.bincount(group)
        # those that were found many times within their task have answered themselves
        chosen = order[(size[group] > 1) & ~m[order]]
        chosen = chosen[np.lexsort((a[chosen], d[chosen]))]
        yield blobs.batch(list(blobs.rows_by(blobs.doc_bucket(d[chosen], len(keys)), keys, SHARED, d[chosen], a[chosen].astype(np.int64))))

    return run


def _marks(table: pa.Table, ids: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Which words, by their number in the bucket, the rows of places name. Rows of one id are all named."""
    marks = np.zeros(size, bool)
    order = np.argsort(ids, kind="stable")
    ordered = ids[order]
    for d, a in zip(table.column("docs").to_pylist(), table.column("at").to_pylist(), strict=True):
        docs, at = blobs.unpack(d, a)
        low, high = np.searchsorted(ordered, docs, "left"), np.searchsorted(ordered, docs, "right")
        while len(docs):
            here = low < high
            docs, at, low, high = docs[here], at[here], low[here], high[here]
            if len(docs):
                places = first[order[low]] + at
                marks[places[places < size]] = True
                low = low + 1
    return marks


def _sorted_bucket(docs: pa.Table) -> tuple[np.ndarray, list]:
    ids = docs.column("doc_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    texts = docs.column("text").to_pylist()
    return ids[order], [texts[k] for k in order.tolist()]


def _extend(keys: np.ndarray):
    """Pass 2, a bucket of documents: full hashes of the windows around shared anchors."""
    n = len(keys)

    def run(key, docs: pa.Table, shared: pa.Table) -> pa.Table:
        ids, texts = _sorted_bucket(docs)
        if not len(ids) or not shared.num_rows:
            return blobs.SCHEMA.empty_table()
        touched = np.unique(np.concatenate([np.unique(blobs.unpack(d, a)[0]) for d, a in zip(shared.column("docs").to_pylist(), shared.column("at").to_pylist(), strict=True)]))
        use = np.flatnonzero(np.isin(ids, touched))
        ids, texts = ids[use], [texts[k] for k in use.tolist()]
        h, counts = _hashes(WordHashes(), texts)
        first = np.cumsum(counts) - counts
        marks = np.concatenate([[0], np.cumsum(_marks(shared, ids, first, len(h)))])
        doc, at = _places(ids, counts)
        left = np.repeat(counts, counts) - at
        start = np.flatnonzero(left >= WINDOW)
        start = start[marks[start + PERIOD] > marks[start]]
        if not len(start):
            return blobs.SCHEMA.empty_table()
        g = _ROLL.windows(_ROLL.prefix(h), WINDOW)[start]
        check = (_CHECK.windows(_CHECK.prefix(h), WINDOW)[start] >> np.uint64(16)).astype(np.uint64)
        order, new = _runs(g ^ (check << np.uint64(1)))
        least = order[np.flatnonzero(new)][np.cumsum(new) - 1]  # the first of each run, as places are in order
        later = (doc[start[order]] != doc[start[least]]) | (at[start[order]] != at[start[least]])
        settled = np.sort(start[order[later]])
        rows = list(blobs.rows_by(blobs.doc_bucket(doc[settled], n), keys, LATER, doc[settled], at[settled]))
        sent = np.sort(order[np.flatnonzero(new)])
        more = check[sent].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        rows += blobs.rows_by(blobs.hash_bucket(g[sent], n), keys, SEEN, doc[start[sent]], at[start[sent]], g[sent], np.ascontiguousarray(more))
        return pa.Table.from_batches([blobs.batch(rows)])

    return run


def _later(keys: np.ndarray):
    """A bucket of window hashes: answers every place but the first of each window."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, checks, docs, at = [], [], [], []
        for part in parts:
            seen = np.array(part.column(1).to_pylist()) == SEEN
            if not seen.all():
                yield part.filter(pa.array(~seen))
            for _, _, d, a, h, m in zip(*(c.to_pylist() for c in part.filter(pa.array(seen)).columns), strict=True):
                ids, places = blobs.unpack(d, a)
                hashes.append(blobs.unpack_hash(h))
                checks.append(blobs.unpack_hash(m))
                docs.append(ids)
                at.append(places.astype(np.uint32))
        if not hashes:
            return
        h, c, d, a = (np.concatenate(x) for x in (hashes, checks, docs, at))
        order = np.lexsort((a, d, c, h))
        h, c, d, a = h[order], c[order], d[order], a[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        least = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = np.flatnonzero((d != d[least]) | (a != a[least]))
        later = later[np.lexsort((a[later], d[later]))]
        yield blobs.batch(list(blobs.rows_by(blobs.doc_bucket(d[later], len(keys)), keys, LATER, d[later], a[later].astype(np.int64))))

    return run


RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def _remove(with_text: bool):
    schema = pa.schema([*RESULT, ("kept", pa.string())]) if with_text else RESULT

    def run(key, docs: pa.Table, later: pa.Table) -> pa.Table:
        ids, texts = _sorted_bucket(docs)
        words = [split_words(x) for x in texts]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        first, total = np.cumsum(counts) - counts, int(counts.sum())
        edges = np.zeros(total + WINDOW + 1, np.int64)
        starts = np.flatnonzero(_marks(later, ids, first, total)) if later.num_rows else np.zeros(0, np.int64)
        edges[starts] += 1
        np.subtract.at(edges, starts + WINDOW, 1)
        gone = np.cumsum(edges)[:total] > 0
        rows = []
        for i, some, a, n in zip(ids.tolist(), words, first.tolist(), counts.tolist(), strict=True):
            lost = gone[a : a + n]
            removed = int(lost.sum())
            kept = b" ".join(compress(some, (~lost).tolist()) if removed else some)
            rows.append((None if i >= NO_IDS else i, n, removed, hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8")] if with_text else [])))
        return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)

    return run


def remove_repeats(docs: DataFrame, with_text: bool = False, unit_chars: int = 8_000_000) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and the kept text) of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    ship_package(spark)
    without = F.lit(NO_IDS) + F.xxhash64("text").bitwiseAND(F.lit(blobs.NO_ID - NO_IDS))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), without).alias("doc_id"), "text")
    n = blobs.bucket_count(rows)
    keys = blobs.bucket_keys(spark, n)
    by_doc = rows.withColumn("bucket", blobs.doc_bucket_column(F.col("doc_id"), keys)).repartition(n, "bucket")
    anchors = blobs.dealt(map_batches(rows, _anchors(keys, unit_chars), blobs.DDL), n)
    shared = blobs.dealt(map_batches(anchors, _shared(keys), blobs.DDL), n)
    windows = by_doc.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(_extend(keys), blobs.DDL)
    later = blobs.dealt(map_batches(blobs.dealt(windows, n), _later(keys), blobs.DDL), n)
    ddl = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * with_text
    return by_doc.groupBy("bucket").cogroup(later.groupBy("bucket")).applyInArrow(_remove(with_text), ddl)


ORACLE = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
w as (select doc_id, i, array_to_string(list_slice(ws, i + 1, i + 20), ' ') as g
      from d, unnest(range(greatest(len(ws) - 19, 0))) as r(i)),
n as (select doc_id, i, row_number() over (partition by g order by doc_id, i) as nth from w),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as i from n where nth > 1),
words as (select doc_id, unnest(ws) as word, unnest(range(len(ws))) as i from d),
kept as (
  select words.doc_id, string_agg(word, ' ' order by words.i) as text from words
  left join gone on gone.doc_id = words.doc_id and gone.i = words.i where gone.i is null group by words.doc_id),
lost as (select doc_id, count(*)::bigint as n from gone group by doc_id)
select d.doc_id, len(ws)::bigint as n_words, coalesce(lost.n, 0)::bigint as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from d left join kept using (doc_id) left join lost using (doc_id)
"""
