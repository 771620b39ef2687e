"""Exact Jaccard join of shingle sets with set-relation skipping; one component id for each document.

Two documents link when their sets of K-word shingles have a Jaccard similarity
of PERCENT in a hundred or more. Only the components of these links are asked
for, so relations between sets let most pairs be skipped without loss:

1. Equal sets are one class; its least doc_id stands for all.
2. Highly similar sets. Sets with an equal minimum under one of MINS
   permutations are compared with one leader of their group, then, HUB_ROUNDS
   times, those of other components with the member that has most links; the
   verified links are joined to components. A set takes over its leader's component, so no
   pair inside a component is looked at again: that part of its answers is
   derived, not computed.
3. The rest, exactly. Each class puts the prefix of its set (in one global token
   order, frequent tokens last) into an index. Lists are cut into blocks; a block
   is skipped for a set when its sizes or its least position rule out the overlap
   needed, or when all of it lies in the set's own component. A token whose list
   would be longer than ``split`` has a list for every two parts of its documents
   instead, so no task gets a hot token whole and every pair still meets. Pairs
   that remain are verified on whole sets and joined.

Candidates first meet by parity sketches of about two bits a shingle, whose
distance never exceeds the sets' difference, so what they rule out is no link.
Verification sends the text of one side once to each bucket that holds partners.
There the overlaps of a set with similar partners are derived one from the next,
from the few shingles in which the partners differ.

Buckets of documents hold about blobs.BUCKET_BYTES of text, however large the table.

Defined cases: a text without words, or null, has no shingles and is alone; a
text of 1 to K-1 words has one; texts of any length count whole; similarities equal
to the limit link; rows that share a doc_id are one document with the links of each
of its texts; a null doc_id has a null component; an empty table gives an empty one;
other columns, whatever their names, are not read by ``similar_components`` and
handed on by ``keep_representatives``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlake.llm import blobs
from kvlake.llm.common import Rolling, map_batches, mix, remove_folder, shared_folder, word_hashes
from kvlake.llm.graph import components
from kvlake.shipping import ship_package

K, PERCENT, MINS, BLOCK, SHORT_LIST = 5, 80, 4, 64, 24
HUB_ROUNDS = 2
MOST_FREQUENT = 500_000
_ROLL = Rolling(0xA0761D6478BD642F | 1)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SEEDS = np.random.default_rng(31).integers(1, 1 << 63, MINS, np.uint64)


GROUP_CHARS, GROUP_TEXTS = 600_000, 60_000


def groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about GROUP_CHARS characters."""
    start = 0
    while start < len(texts):
        end, chars = start, 0
        while end < len(texts) and end - start < GROUP_TEXTS and (chars < GROUP_CHARS or end == start):
            chars += len(texts[end] or "")
            end += 1
        yield start, end
        start = end


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text, one after another, and how many each has.

    A shingle's hash is a polynomial of the hashes of its K words.
    """
    raws = [(x or "").encode("utf-8", "surrogatepass").translate(_LOWER) for x in texts]
    ends = np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)) + 1) - 1
    words, start, _ = word_hashes(b"\n".join(raws) + b"\n")
    owner = np.searchsorted(ends, start, "left")
    counts = np.bincount(owner, minlength=len(texts))
    if not len(words):
        return np.zeros(0, np.uint64), counts
    last = np.cumsum(counts)[owner]  # where the text of each word ends
    prefix = _ROLL.prefix(words)
    at = np.arange(len(words))
    whole = at + K <= last
    short = (counts[owner] < K) & (at == last - counts[owner])
    width = np.where(whole, K, np.where(short, last - at, 0))
    use = np.flatnonzero(width)
    h = mix((prefix[use + width[use]] - prefix[use]) * _ROLL.up[use]) ^ (width[use].astype(np.uint64) * np.uint64(0x9E3779B9))
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(owner[use][order].astype(np.uint16), kind="stable")]
    h, of = h[order], owner[use][order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[new], np.bincount(of[new], minlength=len(texts))


def shingles(text: str | None) -> np.ndarray:
    return shingle_sets([text])[0]


SKETCH_SHARE = 2  # bits of a parity sketch for each shingle, in steps that both sides of a pair can fold to


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of a power of two of slots: sets that differ in d shingles differ in d slots at most."""
    bits = max(64, 1 << int(SKETCH_SHARE * len(s) - 1).bit_length())
    odd = np.bincount((mix(s) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def sketch_distance(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the number of shingles in which two sets differ; the longer sketch is folded to the shorter."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) > len(b):
        a = np.bitwise_xor.reduce(a.reshape(-1, len(b)), axis=0)
    return int(np.bitwise_count(a ^ b).sum())


def linked(common: int, a: int, b: int) -> bool:
    return 100 * common >= PERCENT * (a + b - common)


def least_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ceil(PERCENT / (100 + PERCENT) * (a + b))"""
    return -(-(PERCENT * (a + b)) // (100 + PERCENT))


SIGNS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), *[(f"m{k}", pa.int64()) for k in range(MINS)], ("sketch", pa.binary())])
SIGNS_DDL = "doc_id bigint, n bigint, s1 bigint, s2 bigint, " + ", ".join(f"m{k} bigint" for k in range(MINS)) + ", sketch binary"
COUNTS_ROW, LEAST_SEEN = -1, 8


def _signs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes, identities, minima and sketches of sets; and rows (n = COUNTS_ROW) with tokens seen in LEAST_SEEN texts or more."""
    held: list[np.ndarray] = []
    size = 0

    def counted() -> pa.RecordBatch:
        token, n = np.unique(np.concatenate(held), return_counts=True)
        some = n >= LEAST_SEEN
        blob = token[some].astype("<u8").tobytes() + n[some].astype("<i8").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([COUNTS_ROW], pa.int64()), *[pa.array([0], pa.int64())] * (2 + MINS), pa.array([blob], pa.binary())], schema=SIGNS)

    for part in parts:
        texts = part.column(1).to_pylist()
        for a, b in groups(texts):
            h, counts = shingle_sets(texts[a:b])
            held.append(h)
            size += len(h)
            some = np.flatnonzero(counts)
            cols = [np.zeros(b - a, np.uint64) for _ in range(2 + MINS)]
            ends = np.cumsum(counts)
            if len(some):
                first = (ends - counts)[some]
                cols[0][some] = np.bitwise_xor.reduceat(mix(h), first)
                cols[1][some] = np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), first)
                for k, seed in enumerate(_SEEDS):
                    cols[2 + k][some] = np.minimum.reduceat(mix(h ^ seed), first)
            sketches = [sketch(h[e - n : e]).tobytes() if n else b"" for n, e in zip(counts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0).slice(a, b - a), pa.array(counts, pa.int64()), *[pa.array(c.view(np.int64)) for c in cols], pa.array(sketches, pa.binary())], schema=SIGNS)
            if size > 2_000_000:
                yield counted()
                held, size = [], 0
    if held:
        yield counted()


def _token_counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("token", pa.int64()), ("n", pa.int64())])
    for part in parts:
        for blob in part.column(0).to_pylist():
            half = len(blob) // 2
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(blob[:half], "<i8")), pa.array(np.frombuffer(blob[half:], "<i8"))], schema=schema)


def _group_leaders(keys: np.ndarray):
    """A bucket of minima: (leader, member) for the members of each group, led by size bands."""
    n = len(keys)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = [[], [], []]
        for part in parts:
            for k, name in enumerate(("m", "doc_id", "n")):
                cols[k].append(part.column(part.schema.get_field_index(name)).to_numpy(zero_copy_only=False))
        if not cols[0]:
            return
        m, doc, size = map(np.concatenate, cols)
        order = np.lexsort((doc, size, m))
        m, doc, size = m[order], doc[order], size[order]
        same = np.zeros(len(m), bool)
        same[1:] = m[1:] == m[:-1]
        near = same | np.append(same[1:], False)
        lead, member = [], []
        before = None
        for k in np.flatnonzero(near).tolist():
            if not same[k] or PERCENT * size[k] > 100 * size[before]:
                before = k
            elif doc[k] != doc[before]:
                lead.append(doc[before])
                member.append(doc[k])
        if lead:
            pairs = np.unique(np.stack([np.array(lead, np.int64), np.array(member, np.int64)]), axis=1)
            yield blobs.batch(list(_pair_rows(pairs, keys, n)))

    return run


def _pair_rows(pairs: np.ndarray, keys: np.ndarray, n: int) -> Iterator[tuple]:
    """Rows for the bucket of the first side; ``hash`` holds the second side's ids."""
    lead, member = pairs
    which = blobs.doc_bucket(lead, n)
    order = np.lexsort((member, lead, which))
    ordered = which[order]
    for part in np.split(order, np.flatnonzero(np.diff(ordered)) + 1) if len(order) else []:
        yield (int(keys[which[part[0]]]), 0, np.diff(lead[part], prepend=0).astype("<i8").tobytes(), b"", member[part].astype("<i8").tobytes(), b"")


def _packed_pairs(keys: np.ndarray):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            pairs = np.stack([part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2)])
            yield blobs.batch(list(_pair_rows(pairs, keys, len(keys))))

    return run


TEXTS = pa.schema([("bucket", pa.int32()), ("lead", pa.int64()), ("text", pa.string()), ("members", pa.binary())])
TEXTS_DDL = "bucket int, lead bigint, text string, members binary"
SENT = pa.schema([("bucket", pa.int32()), ("lead", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("members", pa.binary())])
SENT_DDL = "bucket int, lead bigint, n bigint, sketch binary, members binary"


def _pairs_of(pairs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    lead = np.concatenate([np.cumsum(np.frombuffer(x, "<i8")) for x in pairs.column("docs").to_pylist()])
    return lead, np.concatenate([np.frombuffer(x, "<i8") for x in pairs.column("hash").to_pylist()])


def _send(keys: np.ndarray, columns: list[str], schema: pa.Schema):
    """Rows of one bucket meet the pairs they lead: what ``columns`` holds goes once to each bucket with partners."""
    n = len(keys)

    def run(key, docs: pa.Table, pairs: pa.Table) -> pa.Table:
        if not pairs.num_rows or not docs.num_rows:
            return schema.empty_table()
        lead, member = _pairs_of(pairs)
        both = np.unique(np.stack([lead, blobs.doc_bucket(member, n), member]), axis=1)
        own: dict[int, list] = {}
        for i, *row in zip(*(docs.column(c).to_pylist() for c in ("doc_id", *columns)), strict=True):
            own.setdefault(i, []).append(row)
        edge = np.flatnonzero((both[:2, 1:] != both[:2, :-1]).any(axis=0)) + 1
        rows = []
        for part in np.split(both, edge, axis=1):
            for row in own.get(int(part[0, 0]), ()):
                rows.append((int(keys[part[1, 0]]), int(part[0, 0]), *row, part[2].astype("<i8").tobytes()))
        return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)

    return run


def _sift(keys: np.ndarray):
    """Pairs whose sketches rule out the similarity go; the others are returned to the bucket of the first side."""
    n = len(keys)

    def run(key, docs: pa.Table, sent: pa.Table) -> pa.Table:
        if not sent.num_rows or not docs.num_rows:
            return blobs.SCHEMA.empty_table()
        own: dict[int, list] = {}
        for i, size, raw in zip(docs.column("doc_id").to_pylist(), docs.column("n").to_pylist(), docs.column("sketch").to_pylist(), strict=True):
            own.setdefault(i, []).append((size, np.frombuffer(raw, np.uint8)))
        out = []
        for lead, size, raw, xs in zip(*(sent.column(c).to_pylist() for c in ("lead", "n", "sketch", "members")), strict=True):
            a = np.frombuffer(raw, np.uint8)
            for x in np.frombuffer(xs, "<i8").tolist():
                # similarity needs |A ^ B| <= (100 - PERCENT) / (100 + PERCENT) * (|A| + |B|)
                if any((100 + PERCENT) * sketch_distance(a, b) <= (100 - PERCENT) * (size + m) for m, b in own.get(x, ())):
                    out.append((lead, x))
        if not out:
            return blobs.SCHEMA.empty_table()
        return pa.Table.from_batches([blobs.batch(list(_pair_rows(np.unique(np.array(out, np.int64).T, axis=1), keys, n)))])

    return run


LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _within(small: np.ndarray, large: np.ndarray) -> int:
    """How many of ``small`` are in the sorted ``large``."""
    if not len(small) or not len(large):
        return 0
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    return int((large[at] == small).sum())


def _verify(key, docs: pa.Table, sent: pa.Table) -> pa.Table:
    """Overlaps of the texts sent here with their partners in this bucket; those that link remain."""
    if not sent.num_rows or not docs.num_rows:
        return LINKS.empty_table()
    where: dict[int, list[int]] = {}
    for k, i in enumerate(docs.column("doc_id").to_pylist()):
        where.setdefault(i, []).append(k)
    texts = docs.column("text")
    sets: dict[int, np.ndarray] = {}
    changes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def set_of(k: int) -> np.ndarray:
        if k not in sets:
            sets[k] = shingles(texts[k].as_py())
        return sets[k]

    uses: dict[int, int] = {}
    members = [np.frombuffer(x, "<i8") for x in sent.column("members").to_pylist()]
    for m in members:
        for x in m.tolist():
            uses[x] = uses.get(x, 0) + 1
    out = []
    for lead, text, xs in zip(sent.column("lead").to_pylist(), sent.column("text").to_pylist(), members, strict=True):
        own = shingles(text)
        known, before, common = -1, None, 0
        for x in xs.tolist():
            for k in where.get(x, ()):
                s = set_of(k)
                if known >= 0 and uses[x] > 1 and abs(len(s) - len(before)) * 10 < len(s):
                    # a partner like the one before: its overlap differs by the shingles they do not share
                    if (known, k) not in changes:
                        changes[known, k] = np.setdiff1d(before, s, True), np.setdiff1d(s, before, True)
                    lost, won = changes[known, k]
                    common += _within(won, own) - _within(lost, own)
                else:
                    common = _within(s, own) if len(s) < len(own) else _within(own, s)
                known, before = k, s
                if linked(common, len(own), len(s)):
                    out.append((lead, x))
                    break
    return pa.Table.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], schema=LINKS)


def _parted(token: np.ndarray, doc: np.ndarray, count: np.ndarray, split: int) -> tuple[np.ndarray, np.ndarray]:
    """Which postings go where: those of a token of more than ``split`` documents to a list for its own part with each part."""
    parts = np.maximum(1, -(-count // split))
    at = np.repeat(np.arange(len(token)), parts)
    ends = np.cumsum(parts)
    other = np.arange(len(at)) - np.repeat(ends - parts, parts)
    own = (mix(doc.astype(np.uint64))[at] % parts[at].astype(np.uint64)).astype(np.int64)
    low, high = np.minimum(own, other), np.maximum(own, other)
    pair = (low * parts[at] + high + 1).astype(np.uint64)
    return at, np.where(parts[at] > 1, mix(token[at] ^ mix(pair)), token[at])


def _postings(keys: np.ndarray, frequent, split: int):
    """Documents of one bucket meet their components: prefixes for the buckets of tokens."""
    n = len(keys)

    def run(key, docs: pa.Table, labels: pa.Table) -> pa.Table:
        tokens, counts_of = frequent.value
        comp = dict(zip(labels.column("id").to_pylist(), labels.column("component").to_pylist(), strict=True))
        ids, texts = docs.column("doc_id").to_pylist(), docs.column("text").to_pylist()
        use = [k for k, i in enumerate(ids) if i in comp]  # another document of its class stands for the others
        ids, texts = [ids[k] for k in use], [texts[k] for k in use]
        cols: list[list[np.ndarray]] = [[] for _ in range(5)]
        for a, b in groups(texts):
            h, counts = shingle_sets(texts[a:b])
            owner, seen = np.repeat(np.arange(b - a), counts), np.zeros(len(h), np.int64)
            if len(tokens) and len(h):
                at = np.minimum(np.searchsorted(tokens, h), len(tokens) - 1)
                rank = np.where(tokens[at] == h, counts_of[at], 0)
                if rank.any():
                    level = np.ceil(np.log2(rank + 1.0)).astype(np.int64)  # the same order on every worker
                    order = np.argsort(owner * 64 + level, kind="stable")
                    h, seen = h[order], rank[order]
            place = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
            size = np.repeat(counts, counts)
            head = place < size - -(-PERCENT * size // 100) + 1
            who = np.array(ids[a:b], np.int64)[owner[head]] if b > a else np.zeros(0, np.int64)
            label = np.array([comp[i] for i in ids[a:b]], np.int64)[owner[head]] if b > a else who
            token, size, place = h[head], size[head], place[head]
            if (seen[head] > split).any():
                at, token = _parted(token, who, seen[head], split)
                who, label, size, place = who[at], label[at], size[at], place[at]
            for c, v in zip(cols, (token, who, label, size, place), strict=True):
                c.append(v)
        if not cols[0]:
            return blobs.SCHEMA.empty_table()
        token, doc, label, size, at = (np.concatenate(c) for c in cols)
        which = blobs.hash_bucket(token, n)
        rows = []
        order = np.argsort(which, kind="stable")
        ordered = which[order]
        for part in np.split(order, np.flatnonzero(np.diff(ordered)) + 1):
            more = np.diff(label[part], prepend=0).astype("<i8").tobytes() + size[part].astype("<i4").tobytes()
            packed = token[part].astype("<u8").view(np.uint8).reshape(len(part), 8)[:, :6].tobytes()
            rows.append((int(keys[which[part[0]]]), 0, np.diff(doc[part], prepend=0).astype("<i8").tobytes(), blobs._places(at[part]), packed, more))
        return pa.Table.from_batches([blobs.batch(rows)])

    return run


def _candidates(keys: np.ndarray):
    """A bucket of index lists: pairs of different components that no block skip rules out."""
    n = len(keys)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list[np.ndarray]] = [[] for _ in range(5)]
        for part in parts:
            for _, _, d, a, h, m in zip(*(c.to_pylist() for c in part.columns), strict=True):
                ids, at = blobs.unpack(d, a)
                k = len(ids)
                for c, v in zip(cols, (blobs.unpack_hash(h), ids, np.cumsum(np.frombuffer(m[: 8 * k], "<i8")), np.frombuffer(m[8 * k :], "<i4").astype(np.int64), at), strict=True):
                    c.append(v)
        if not cols[0]:
            return
        token, doc, label, size, at = (np.concatenate(c) for c in cols)
        order = np.lexsort((doc, at, size, token))
        token, doc, label, size, at = token[order], doc[order], label[order], size[order], at[order]
        head = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        width = np.diff(np.append(head, len(token)))
        low, high = np.minimum.reduceat(label, head), np.maximum.reduceat(label, head)
        wanted = (width > 1) & (low != high)
        found: list[np.ndarray] = []
        # short lists: all of them at once, places one apart, two apart, ...
        short = np.repeat(wanted & (width <= SHORT_LIST), width)
        end = np.repeat(head + width, width)
        for apart in range(1, SHORT_LIST):
            x = np.flatnonzero(short[: len(token) - apart])
            x = x[x + apart < end[x]]
            if not len(x):
                break
            y = x + apart
            fits = (label[x] != label[y]) & (doc[x] != doc[y]) & (PERCENT * size[y] <= 100 * size[x])
            fits &= np.minimum(size[x] - at[x], size[y] - at[y]) >= least_overlap(size[x], size[y])
            x, y = x[fits], y[fits]
            found.append(np.stack([np.minimum(doc[x], doc[y]), np.maximum(doc[x], doc[y])]))
        held = 0
        for k in np.flatnonzero(wanted & (width > SHORT_LIST)).tolist():
            a, b = int(head[k]), int(head[k] + width[k])
            for pairs in _list_pairs(doc[a:b], label[a:b], size[a:b], at[a:b]):
                found.append(pairs)
                held += pairs.shape[1]
            if held > 500_000:
                found = [np.unique(np.concatenate(found, axis=1), axis=1)]
                held = 0
                if found[0].shape[1] > 400_000:
                    yield blobs.batch(list(_pair_rows(found[0], keys, n)))
                    found = []
        if found:
            pairs = np.concatenate(found, axis=1)
            order = np.lexsort(pairs)
            pairs = pairs[:, order]
            yield blobs.batch(list(_pair_rows(pairs[:, np.append(True, (pairs[:, 1:] != pairs[:, :-1]).any(axis=0))] if pairs.shape[1] else pairs, keys, n)))

    return run


def _list_pairs(doc: np.ndarray, label: np.ndarray, size: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs of one list, sorted by size; blocks are skipped by size, position and component."""
    m = len(doc)
    starts = np.arange(0, m, BLOCK)
    first, last = size[starts], size[np.minimum(starts + BLOCK, m) - 1]
    # the most that can still match after a place; the largest of a block bounds the whole block
    rest = size - at
    most = np.maximum.reduceat(rest, starts)
    low, high = np.minimum.reduceat(label, starts), np.maximum.reduceat(label, starts)
    for b in range(len(starts)):
        xs = slice(int(starts[b]), min(int(starts[b]) + BLOCK, m))
        for c in range(b, len(starts)):
            if PERCENT * first[c] > 100 * last[b]:
                break
            if min(most[b], most[c]) < least_overlap(first[b], first[c]) or (low[b] == high[b] == low[c] == high[c]):
                continue
            ys = slice(int(starts[c]), min(int(starts[c]) + BLOCK, m))
            x, y = size[xs][:, None], size[ys][None, :]
            fits = (PERCENT * np.maximum(x, y) <= 100 * np.minimum(x, y)) & (label[xs][:, None] != label[ys][None, :])
            fits &= np.minimum(rest[xs][:, None], rest[ys][None, :]) >= least_overlap(x, y)
            if b == c:
                fits = np.triu(fits, 1)
            i, j = np.nonzero(fits)
            if len(i):
                p, q = doc[xs][i], doc[ys][j]
                some = p != q
                yield np.stack([np.minimum(p, q)[some], np.maximum(p, q)[some]])


def similar_components(docs: DataFrame, split: int = 20_000) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    n = blobs.bucket_count(rows)
    keys = blobs.bucket_keys(spark, n)
    work, names = shared_folder(spark, "jaccard"), []

    def kept(df: DataFrame, name: str, files: int = max(8, n // 8)) -> DataFrame:
        # rows of a few numbers: a bucket's are too little for a file (0: as they come)
        (df.repartition(files) if files else df).write.parquet(f"{work}/{name}")
        names.append(name)
        return spark.read.schema(df.schema).parquet(f"{work}/{name}")

    written = kept(map_batches(rows, _signs, SIGNS_DDL), "signs", 0)
    signs = written.where(F.col("n") >= 0)
    some = signs.where("n > 0 and doc_id is not null")
    classes = some.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("doc_id"), *[F.first(f"m{k}").alias(f"m{k}") for k in range(MINS)])
    leads = kept(classes.select("doc_id", "n", "s1", "s2", *[f"m{k}" for k in range(MINS)]), "classes")

    by_doc = rows.where("doc_id is not null").withColumn("bucket", blobs.doc_bucket_column(F.col("doc_id"), keys)).repartition(n, "bucket")

    sketches = some.select("doc_id", "n", "sketch").withColumn("bucket", blobs.doc_bucket_column(F.col("doc_id"), keys)).repartition(n, "bucket")

    def verified(pairs: DataFrame) -> DataFrame:
        sent = sketches.groupBy("bucket").cogroup(blobs.dealt(pairs, n).groupBy("bucket")).applyInArrow(_send(keys, ["n", "sketch"], SENT), SENT_DDL)
        likely = sketches.groupBy("bucket").cogroup(sent.repartition(n, "bucket").groupBy("bucket")).applyInArrow(_sift(keys), blobs.DDL)
        texts = by_doc.groupBy("bucket").cogroup(blobs.dealt(likely, n).groupBy("bucket")).applyInArrow(_send(keys, ["text"], TEXTS), TEXTS_DDL)
        return by_doc.groupBy("bucket").cogroup(texts.repartition(n, "bucket").groupBy("bucket")).applyInArrow(_verify, "u bigint, v bigint")

    # similar sets: each group of an equal minimum is compared with its leaders
    minima = leads.select("doc_id", "n", F.posexplode(F.array(*[f"m{k}" for k in range(MINS)])).alias("k", "m"))
    groups = minima.select(F.xxhash64("k", "m").alias("m"), "doc_id", "n")
    # a minimum shared by very many sets is cut by the sets' own least ids first, so that no task gets it whole
    spread = groups.repartition(n, "m", F.pmod("doc_id", F.lit(16)))
    firsts = map_batches(spread, _group_leaders(keys), blobs.DDL)
    heads = groups.groupBy("m", F.pmod("doc_id", F.lit(16)).alias("salt"), (F.log2("n") * 6).cast("int").alias("band")).agg(F.min(F.struct("n", "doc_id")).alias("x")).select("m", "x.doc_id", "x.n")
    seconds = map_batches(heads.repartition(n, "m"), _group_leaders(keys), blobs.DDL)
    near = kept(verified(firsts.unionByName(seconds)), "near")
    nodes = leads.select("doc_id").distinct()

    def labels_of(links: DataFrame, name: str) -> DataFrame:
        found = nodes.join(components(links), F.col("doc_id") == F.col("id"), "left")
        return kept(found.select(F.col("doc_id").alias("id"), F.coalesce("component", "doc_id").alias("component")), name)

    labelled = labels_of(near, "labels")
    for round_ in range(HUB_ROUNDS):
        # each group meets its hub, the member with most links so far; only other components are compared
        degree = near.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
        members = groups.join(degree, F.col("doc_id") == F.col("id"), "left").drop("id").join(labelled.withColumnRenamed("id", "doc_id"), "doc_id")
        hubs = members.groupBy("m").agg(F.count("*").alias("size"), F.max(F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), (-F.col("doc_id")).alias("minus"), F.col("n").alias("hub_n"), F.col("component").alias("hub_component"))).alias("h")).where("size > 1").select("m", "h.*")
        pairs = members.join(hubs, "m").where("component <> hub_component").where(F.lit(PERCENT) * F.greatest("n", "hub_n") <= 100 * F.least("n", "hub_n")).select((-F.col("minus")).alias("lead"), F.col("doc_id").alias("member")).distinct()
        by_lead = pairs.withColumn("bucket", blobs.doc_bucket_column(F.col("lead"), keys)).repartition(n, "bucket")
        near = kept(near.union(verified(map_batches(by_lead.select("lead", "member"), _packed_pairs(keys), blobs.DDL))), f"near{round_}")
        labelled = labels_of(near, f"labels{round_}")

    # the rest, through the prefix index
    counted = map_batches(written.where(F.col("n") == COUNTS_ROW).select("sketch"), _token_counts, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    top = counted.where("n >= 16").orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).toPandas()
    tokens = top["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    frequent = spark.sparkContext.broadcast((tokens[order], top["n"].to_numpy(np.int64)[order]))  # MOST_FREQUENT entries at most
    dealt_labels = labelled.withColumn("bucket", blobs.doc_bucket_column(F.col("id"), keys)).repartition(n, "bucket")
    postings = by_doc.groupBy("bucket").cogroup(dealt_labels.groupBy("bucket")).applyInArrow(_postings(keys, frequent, split), blobs.DDL)
    far = kept(verified(map_batches(blobs.dealt(postings, n), _candidates(keys), blobs.DDL)), "far")
    joined = far.join(labelled.selectExpr("id u", "component cu"), "u").join(labelled.selectExpr("id v", "component cv"), "v").select(F.col("cu").alias("u"), F.col("cv").alias("v"))
    merged = components(joined)
    final = labelled.join(merged.selectExpr("id component", "component top"), "component", "left").select(F.col("id").alias("lead"), F.coalesce("top", "component").alias("component_id"))

    # a document's component is that of its class; rows that share a doc_id join their classes
    member = some.select("doc_id", "n", "s1", "s2").join(leads.select("n", "s1", "s2", F.col("doc_id").alias("lead")), ["n", "s1", "s2"]).join(final, "lead").select("doc_id", "component_id")
    both = kept(member.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.max("component_id").alias("other")), "members")
    twice = components(both.where("component_id <> other").select(F.col("component_id").alias("u"), F.col("other").alias("v")))
    for name in names:
        if name not in ("signs", "members"):  # what the result is read from
            remove_folder(spark, f"{work}/{name}")
    settled = both.join(twice.selectExpr("id component_id", "component top"), "component_id", "left").select(F.col("doc_id").alias("id"), F.coalesce("top", "component_id").alias("component_id"))
    return signs.select("doc_id", F.col("n").alias("n_shingles")).join(settled, F.col("doc_id") == F.col("id"), "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_representatives(docs: DataFrame) -> DataFrame:
    """The documents that bear their component's id, with all their columns; rows with a null id stay."""
    found = similar_components(docs).where("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    named = docs.join(found, docs["doc_id"].cast("bigint") == F.col("__kept"), "left_semi")
    return named.select(*docs.columns).unionByName(docs.where("doc_id is null"))


ORACLE = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws
  from documents),
s as (
  select distinct doc_id, array_to_string(list_slice(ws, i + 1, i + least(5, len(ws))), ' ') as g
  from d, unnest(range(len(ws) - least(5, len(ws)) + 1)) as r(i) where len(ws) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (
  select x, y from pairs join n nx on nx.doc_id = x join n ny on ny.doc_id = y
  where 100 * c >= 80 * (nx.n + ny.n - c)),
linked as (select x, y from links union all select y, x from links),
reach(doc_id, other) as (
  select doc_id, doc_id from d union select r.doc_id, b.y from reach r join linked b on b.x = r.other)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.component_id
from d left join n using (doc_id) join (select doc_id, min(other) as component_id from reach group by doc_id) m using (doc_id)
"""
