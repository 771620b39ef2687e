"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts are compared as words in lower case without ASCII punctuation. A document
leaks an item if some stretch of it is within ``rate`` times the item's length
in word edits (insertions, deletions, replacements).

The CGK embedding walks over a string and repeats or advances at every step by a
random bit of the step and the symbol read; strings at a small edit distance get
embeddings at a small Hamming distance. For each length class of items, windows
of that many words are embedded, a few of the embedding's places form a key, and
equal keys make a candidate. This is repeated with new walks until simulated
items with the most edits allowed are met with the target recall, and until fresh
ones, on which the number of repeats was not chosen, are as well. Fewer places are
sampled where the target is not reached within MOST_REPEATS; a class that no sample
brings there is searched without loss, by the word pairs its items share with a
stretch. Every candidate is then checked by the exact edit distance (free ends in
the document), so hits are exact and only recall is probabilistic.

A window is embedded only if it holds enough of the benchmark's word pairs: each
edit breaks two pairs at most, so a window with fewer cannot begin a leak. Items
longer than the longest window are embedded in segments of that length. Items of
fewer than MIN_WORDS words allow no edit; they are found as equal word sequences.

Items go to the workers in blocks of about BLOCK_ITEMS and BLOCK_CHARS; each block
is one pass over the documents, so neither driver nor workers hold more than a block.

Defined cases: null or empty texts leak nothing; items that are null or have no
word are no evidence; texts and items of any length are compared whole; repeated
documents are judged row by row; repeated items are each reported; of stretches at
an equal distance the first is reported; null ids are kept as null; empty tables
give no hit and drop nothing; other columns, whatever their names, are not read by
``find_leaks`` and handed on by ``drop_leaks``.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlake.llm.common import map_batches, mix

MIN_WORDS, LONGEST_WINDOW, SAMPLES, MOST_REPEATS = 5, 120, (4, 3, 2), 96
BLOCK_ITEMS, BLOCK_CHARS, ITEMS_AT_ONCE = 20_000, 8_000_000, 256
COIN_ROWS = 4096  # symbols of one row flip the same coins
_PUNCT = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(None, _PUNCT).split() if text else []


def allowed(n: int, rate: float) -> int:
    return int(rate * n + 1e-9)


def distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance of the item to any stretch of the text, and the end of the first such stretch."""
    place = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for k, word in enumerate(item.tolist(), 1):
        new = np.empty_like(row)
        new[0] = k
        new[1:] = np.minimum(row[:-1] + (text != word), row[1:] + 1)
        row = np.minimum.accumulate(new - place) + place
    end = int(row.argmin())
    return int(row[end]), end


def classes_of_length() -> list[int]:
    """The window, in words, of each length class."""
    out = [MIN_WORDS]
    while out[-1] < LONGEST_WINDOW:
        out.append(min(LONGEST_WINDOW, out[-1] + max(1, out[-1] // 8)))
    return out


class Index:
    """Hash tables of one block of items."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float, target: float, seed: int = 17):
        self.rate = rate
        split = [(i, words_of(t)) for i, t in items]
        split = [(i, w) for i, w in split if w]
        self.numbers: dict[bytes, int] = {}
        for _, words in split:
            for w in words:
                self.numbers.setdefault(w, len(self.numbers))
        size = len(self.numbers)
        self.unknown = size
        self.ids = [i for i, _ in split]
        self.items = [np.array([self.numbers[w] for w in words], np.int64) for _, words in split]
        pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *[self.pair_keys(a) for a in self.items if len(a) >= MIN_WORDS]]))
        self.pair_bits = max(16, int(len(pairs)).bit_length() + 6)
        self.pairs = np.zeros(1 << self.pair_bits, bool)
        self.pairs[self._slot(pairs)] = True
        rng = np.random.default_rng(seed)
        self.coins = rng.integers(0, 1 << 64, (MOST_REPEATS, COIN_ROWS + 1, 3), np.uint64, endpoint=False)
        self.coins[:, COIN_ROWS] = 0  # the end of a text repeats itself
        # members of a class: item and offset of the segment that is embedded; items longer
        # than the longest window have several segments, one of which holds its share of edits or less
        windows = classes_of_length()
        self.classes: dict[int, list[tuple[int, int]]] = {}
        for k, item in enumerate(self.items):
            if len(item) >= MIN_WORDS:
                window = max(w for w in windows if w <= len(item))
                for offset in range(0, len(item) - window + 1, window):
                    self.classes.setdefault(window, []).append((k, offset))
        # the most edits that an embedded segment of a class can hold
        self.edits = {w: max(allowed(len(self.items[k]), rate) // max(1, len(self.items[k]) // w) for k, _ in members) for w, members in self.classes.items()}
        self.chosen: dict[int, np.ndarray] = {}
        self.repeats: dict[int, int] = {}  # 0: searched by pairs
        self.recall: dict[int, float] = {}  # on fresh trials
        for w in self.classes:
            self._calibrate(w, target, seed)
        self.tables = {w: self._tables(w) for w in self.classes if self.repeats[w]}
        self.by_pairs = [self._pair_lists(group) for w in self.classes if not self.repeats[w] for group in self._groups(w)]
        self.short = {n: self._short(n) for n in {len(a) for a in self.items if len(a) < MIN_WORDS}}

    def pair_keys(self, symbols: np.ndarray) -> np.ndarray:
        return symbols[:-1] * (self.unknown + 2) + symbols[1:]

    def _groups(self, window: int) -> list[list[int]]:
        members = sorted({k for k, _ in self.classes[window]})
        return [members[k : k + ITEMS_AT_ONCE] for k in range(0, len(members), ITEMS_AT_ONCE)]

    def _pair_lists(self, members: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word pairs of some items in order, where the list of items with each begins, and all lists."""
        key = np.concatenate([np.unique(self.pair_keys(self.items[k])) for k in members])
        item = np.concatenate([np.full(len(np.unique(self.pair_keys(self.items[k]))), k) for k in members])
        order = np.lexsort((item, key))
        keys, first = np.unique(key[order], return_index=True)
        return keys, np.append(first, len(order)), item[order]

    def _sequence_keys(self, symbols: np.ndarray, n: int) -> np.ndarray:
        """A hash of the n words from each place on."""
        key = np.full(max(0, len(symbols) - n + 1), np.uint64(n))
        for k in range(n):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + symbols[k : k + len(key)].astype(np.uint64))
        return key

    def _short(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        members = np.array([k for k, a in enumerate(self.items) if len(a) == n], np.int64)
        key = np.concatenate([self._sequence_keys(self.items[k], n) for k in members])
        order = np.argsort(key, kind="stable")
        return key[order], members[order]

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return (mix(pairs.astype(np.uint64)) >> np.uint64(64 - self.pair_bits)).astype(np.int64)

    def rows(self, symbols: np.ndarray) -> np.ndarray:
        """The coin row of each symbol."""
        return np.where(symbols == self.unknown + 1, COIN_ROWS, symbols % COIN_ROWS)

    def keys(self, symbols: np.ndarray, rows: np.ndarray, at: np.ndarray, chosen: np.ndarray, r: int, stages: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """The embedding, sampled at ``chosen``, of the windows that begin at ``at``: which windows, their keys, and the keys after each sample.

        With ``stages``, the keys that the items have after each sample, windows drop out as soon as no item agrees.
        """
        coins = self.coins[r]
        left = np.arange(len(at))
        key, seen, step = np.full(len(at), np.uint64(r + 1)), [], 0
        for nth, sample in enumerate(chosen.tolist()):
            while True:
                if step == sample:
                    here = symbols[at]
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + here.astype(np.uint64))
                    seen.append(key)
                    if stages is not None:
                        known = stages[nth]
                        some = np.flatnonzero(known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key)
                        at, key, left = at[some], key[some], left[some]
                at = at + ((coins[rows[at], step >> 6] >> np.uint64(step & 63)) & np.uint64(1)).astype(np.int64)
                step += 1
                if step > sample:
                    break
            if not len(at):
                break
        return left, key, seen

    def _padded(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """All texts, each followed by an end mark, where every walk stays; and where each begins."""
        mark = np.full(1, self.unknown + 1, np.int64)
        starts = np.cumsum([0, *[len(t) + 1 for t in texts]])[:-1]
        return np.concatenate([*[x for t in texts for x in (t, mark)], np.full(LONGEST_WINDOW + 8, self.unknown + 1, np.int64)]), starts

    def _tables(self, window: int) -> list[tuple]:
        members = np.array([k for k, _ in self.classes[window]], np.int64)
        symbols, starts = self._padded([self.items[k][offset:] for k, offset in self.classes[window]])
        rows, out = self.rows(symbols), []
        for r in range(self.repeats[window]):
            _, key, seen = self.keys(symbols, rows, starts, self.chosen[window][r], r)
            order = np.argsort(key, kind="stable")
            out.append((key[order], members[order], [np.unique(x) for x in seen]))
        return out

    def _hits(self, symbols: np.ndarray) -> np.ndarray:
        """How many word pairs of the benchmark begin before each place."""
        known = self.pairs[self._slot(self.pair_keys(symbols))] & (symbols[:-1] < self.unknown) & (symbols[1:] < self.unknown)
        return np.concatenate([[0], np.cumsum(known)])

    def _need(self, window: int) -> int:
        """Pairs a window holds at least: from the first word kept on, each edit breaks, or pushes out of the window, two at most."""
        return max(1, window - 1 - 2 * self.edits[window])

    def _trials(self, window: int, count: int, rng: random.Random) -> list[tuple[list[int], list[int]]]:
        """Segments of a class, each with the same words after the most edits allowed."""
        out = []
        for _ in range(count):
            k, offset = rng.choice(self.classes[window])
            item = self.items[k][offset : offset + max(window, len(self.items[k]) % LONGEST_WINDOW)].tolist()
            text = list(item)
            for _ in range(min(self.edits[window], allowed(len(self.items[k]), self.rate))):
                at, kind = rng.randrange(len(text)), rng.randrange(3)
                if kind == 0:
                    text[at] = self.unknown
                elif kind == 1:
                    text.insert(at, self.unknown)
                elif len(text) > 1:
                    del text[at]
            out.append((item, text))
        return out

    def _met(self, window: int, trials: list[tuple[list[int], list[int]]], chosen: np.ndarray) -> Iterator[float]:
        """The recall on some trials after each repeat; windows are embedded as in a search."""
        symbols, starts = self._padded([np.array(t, np.int64) for _, t in trials])
        own, own_starts = self._padded([np.array(i, np.int64) for i, _ in trials])
        rows, own_rows, hits = self.rows(symbols), self.rows(own), self._hits(symbols)
        met = np.zeros(len(trials), bool)
        for r in range(MOST_REPEATS):
            want = self.keys(own, own_rows, own_starts, chosen[r], r)[1]
            for shift in range(4):  # neighbouring windows are embedded as well
                at = starts + shift
                seen = (symbols[at] < self.unknown) & (hits[at + window - 1] - hits[at] >= self._need(window))
                met |= seen & (self.keys(symbols, rows, at, chosen[r], r)[1] == want)
            yield float(met.mean())

    def _calibrate(self, window: int, target: float, seed: int) -> None:
        """Sample size and repeats that reach the target on trials and on fresh ones; none: the class is searched by pairs."""
        rng, places = random.Random(seed), np.random.default_rng(seed)
        trials, fresh = self._trials(window, 100, rng), self._trials(window, 200, rng)
        self.repeats[window], self.recall[window] = 0, 1.0
        for sample in SAMPLES:
            chosen = np.sort(np.stack([places.choice(max(sample, window * 3 // 2), sample, replace=False) for _ in range(MOST_REPEATS)]), axis=1)
            least = next((r + 1 + (r + 1) // 4 for r, found in enumerate(self._met(window, trials, chosen)) if found >= target), MOST_REPEATS + 1)
            for r, found in enumerate(self._met(window, fresh, chosen) if least <= MOST_REPEATS else ()):
                if r + 1 >= least and found >= target:
                    self.chosen[window], self.repeats[window], self.recall[window] = chosen, min(MOST_REPEATS, r + 1 + (r + 1) // 4), found
                    return

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, distance, first word, end word) of every item that a text leaks."""
        if not self.items:
            return []
        numbered = [np.fromiter(map(self.numbers.get, words_of(t), repeat(self.unknown)), np.int64) for t in texts]
        symbols, starts = self._padded(numbered)
        rows, hits = self.rows(symbols), self._hits(symbols)
        found: list[np.ndarray] = []
        for n, (keys, members) in self.short.items():
            self._equal(self._sequence_keys(symbols, n), np.arange(len(symbols) - n + 1), keys, members, found)
        for window, tables in self.tables.items():
            at = np.flatnonzero((hits[window - 1 :] - hits[: len(hits) - window + 1] >= self._need(window)) & (symbols[: len(hits) - window + 1] < self.unknown))
            if not len(at):
                continue
            for r, (keys, members, stages) in enumerate(tables):
                left, key, _ = self.keys(symbols, rows, at, self.chosen[window][r], r, stages)
                self._equal(key, at[left], keys, members, found)
                if len(found) > 64:
                    found = [np.unique(np.concatenate(found, axis=1), axis=1)]
        place = np.flatnonzero(np.diff(hits)) if self.by_pairs else np.zeros(0, np.int64)
        for lists in self.by_pairs:
            self._by_pairs(symbols, place, lists, found)
        if not found:
            return []
        item, at = np.unique(np.concatenate(found, axis=1), axis=1)
        text = np.searchsorted(starts, at, "right") - 1
        return self._checked(numbered, starts, item, text, at)

    @staticmethod
    def _equal(key: np.ndarray, at: np.ndarray, keys: np.ndarray, members: np.ndarray, found: list[np.ndarray]) -> None:
        """Every (item, place) of equal keys."""
        low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
        some = np.flatnonzero(high > low)
        while len(some):
            found.append(np.stack([members[low[some]], at[some]]))
            low[some] += 1
            some = some[high[some] > low[some]]

    def _by_pairs(self, symbols: np.ndarray, place: np.ndarray, lists: tuple, found: list[np.ndarray]) -> None:
        """Every (item, place) from which on a stretch holds as many of the item's word pairs as a leak must."""
        keys, first, items = lists
        pair = symbols[place] * (self.unknown + 2) + symbols[place + 1]
        where = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        known = keys[where] == pair
        where, place = where[known], place[known]
        count = first[where + 1] - first[where]
        ends = np.cumsum(count)
        at = np.repeat(place, count)
        item = items[np.arange(len(at)) + np.repeat(first[where] - (ends - count), count)]
        order = np.lexsort((at, item))
        at, item = at[order], item[order]
        size = np.fromiter(map(len, self.items), np.int64, len(self.items))[item]
        edits = (self.rate * size + 1e-9).astype(np.int64)
        last = np.arange(len(at)) + np.maximum(1, size - 1 - 2 * edits) - 1
        inside = last < len(at)
        last = np.minimum(last, len(at) - 1)
        some = np.flatnonzero(inside & (item[last] == item) & (at[last] - at <= size + edits - 2))
        if len(some):
            found.append(np.stack([item[some], at[some]]))

    def _checked(self, numbered: list[np.ndarray], starts: np.ndarray, item: np.ndarray, text: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        out = []
        edge = np.flatnonzero((item[1:] != item[:-1]) | (text[1:] != text[:-1])) + 1
        for part in np.split(np.arange(len(item)), edge):
            k, t = int(item[part[0]]), int(text[part[0]])
            own, words = self.items[k], numbered[t]
            limit = allowed(len(own), self.rate)
            places = at[part] - starts[t]
            best = None
            for group in np.split(places, np.flatnonzero(np.diff(places) > len(own)) + 1):
                back = 3 * limit + 4 + (len(own) if len(own) > LONGEST_WINDOW else 0)
                first = max(0, int(group[0]) - back)
                stretch = words[first : int(group[-1]) + len(own) + 2 * limit + 3]
                d, end = distance(own, stretch)
                if d <= limit and (best is None or d < best[0]):
                    _, length = distance(own[::-1], stretch[:end][::-1])
                    best = (d, first + end - length, first + end)
            if best:
                out.append((t, k, *best))
        return out


HITS = "doc_id bigint, item_id bigint, distance int, item_words int, first_word int, end_word int"


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("text is not null")
    total, chars = rows.agg(F.count("*"), F.sum(F.length("text"))).first()
    parts = max(math.ceil(total / BLOCK_ITEMS), math.ceil((chars or 0) / BLOCK_CHARS))
    for k in range(parts):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        yield sorted(((r.item_id, r.text) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.2, target: float = 0.99, at_once: int = 8_000_000) -> DataFrame:
    """One row of HITS for each document (doc_id, text) and item (item_id, text) that it leaks."""
    spark = docs.sparkSession
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), *[(c, pa.int32()) for c in ("distance", "item_words", "first_word", "end_word")]])
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = None
    for items in _blocks(benchmark):
        index = spark.sparkContext.broadcast(Index(items, rate, target))  # a block of items

        def run(parts: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for part in parts:
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                start, found = 0, []
                while start < len(texts):
                    end, chars = start, 0
                    while end < len(texts) and (chars < at_once or end == start):
                        chars += len(texts[end] or "")
                        end += 1
                    found += [(ids[start + t], index.value.ids[k], d, len(index.value.items[k]), a, b) for t, k, d, a, b in index.value.search(texts[start:end])]
                    start = end
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*found, strict=True) if found else [[]] * len(schema), schema, strict=True)], schema=schema)

        hits = map_batches(rows, run, HITS)
        out = hits if out is None else out.unionByName(hits)
    return spark.createDataFrame([], HITS) if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.2, target: float = 0.99) -> DataFrame:
    """The documents that leak no item, with all their columns."""
    spark, where = docs.sparkSession, docs.columns.index("text")
    for items in _blocks(benchmark):
        index = spark.sparkContext.broadcast(Index(items, rate, target))

        def run(parts: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for part in parts:
                for start in range(0, part.num_rows, 2500):
                    some = part.slice(start, 2500)
                    clean = np.ones(some.num_rows, bool)
                    clean[[hit[0] for hit in index.value.search(some.column(where).to_pylist())]] = False
                    yield some.filter(pa.array(clean))

        docs = map_batches(docs, run, docs.schema)
    return docs
