"""Language identification by interpolated Kneser-Ney character models.

Every language has its own model of orders 1 to ``ORDER`` over the letters of
words, with the ends of a word as symbols. The models are fitted on a bounded
sample of labelled rows. An n-gram is a 64-bit hash; for each order the hashes of
all languages stand in one sorted array, each with the list of the languages that
hold it and their values: discounted continuation probability, or back-off weight.
So the models grow with the n-grams of each language, not with n-grams times
languages. A word's cross-entropies under all languages come from one walk through the arrays, and
each distinct word of a batch is walked once. A text gets the language of lowest
cross-entropy per character; the score is the calibrated probability of that
language, and ``accepted`` tells whether the text passes the rejection limit of
its language: the cross-entropy that all but 1 in 200 held-back training texts
stay below.

Fitting takes whole rows whose hash is smallest (about ``train_chars``
characters a language and TOTAL_CHARS in all, rows up to ``LONGEST`` characters, the
MOST_LANGS most frequent languages) and never looks at held-out rows, at source or
at doc_id other than for this choice.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
without any labelled row everything is ``und``; ties go to the first language by
name; null and repeated ids are predicted row by row (a null id is not held out);
texts and words of any length are scored whole; an empty table gives an empty one;
other columns, whatever their names, are not read and not returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlake.llm.common import crc_mod, map_batches, mix

ORDER = 5
LONGEST = 40_000
MOST_LANGS, TOTAL_CHARS = 200, 4_000_000
PIECE = 10_000
_WORD = re.compile(r"[^\W\d_]+")
_MULT = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all words, each between two end marks (1); and the first place of every word."""
    flat = np.frombuffer(("\x01" + "\x01".join(words) + "\x01").encode("utf-32-le", "surrogatepass"), "<u4")
    starts = np.flatnonzero(flat == 1)[:-1]
    return flat.astype(np.uint64), starts


def _grams(words: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order n: the hash of the n symbols that end at each place that is predicted (0: the word has fewer).

    Predicted are a word's letters and its closing mark; the opening mark is context.
    """
    flat, starts = _codes(words)
    ends = np.append(starts[1:], len(flat) - 1)
    place = np.ones(len(flat), bool)
    place[0] = False
    at = np.flatnonzero(place)
    owner = np.searchsorted(ends, at, "left")
    depth = at - starts[owner] + 1  # symbols of this word up to here, the opening mark included
    out, h = [], np.zeros(len(at), np.uint64)
    for n in range(1, ORDER + 1):
        # the n-th symbol back joins the hash, so a longer gram extends a shorter one to the left
        sym = np.where(depth >= n, flat[np.maximum(at - n + 1, 0)], np.uint64(0))
        h = mix(h * _MULT + sym + np.uint64(n))
        out.append(np.where(depth >= n, h, np.uint64(0)))
    return out, owner, depth


def _left_hash(words: list[str]) -> list[np.ndarray]:
    """For each order n: the hash of the n-1 symbols before each predicted place (its context)."""
    flat, starts = _codes(words)
    at = np.arange(1, len(flat))
    ends = np.append(starts[1:], len(flat) - 1)
    depth = at - starts[np.searchsorted(ends, at, "left")] + 1
    out, h = [np.full(len(at), np.uint64(7))], np.full(len(at), np.uint64(7))
    for n in range(2, ORDER + 1):
        h = mix(h * _MULT + np.where(depth >= n, flat[np.maximum(at - n + 1, 0)], np.uint64(0)) + np.uint64(n + 100))
        out.append(np.where(depth >= n, h, np.uint64(0)))
    return out


class Values:
    """Values of several languages by hash: sorted hashes, each with a list of languages and their values."""

    BITS = 18

    def __init__(self, store: dict[int, tuple[np.ndarray, np.ndarray]], langs: int, absent: float):
        """store: language -> its hashes and their values; languages that lack a hash have the value ``absent``."""
        key = np.concatenate([np.zeros(0, np.uint64), *[v[0] for v in store.values()]])
        lang = np.concatenate([np.zeros(0, np.int16), *[np.full(len(v[0]), k, np.int16) for k, v in store.items()]])
        value = np.concatenate([np.zeros(0, np.float32), *[v[1] for v in store.values()]])
        order = np.lexsort((lang, key))
        self.keys, first = np.unique(key[order], return_index=True)
        self.first = np.append(first, len(order)).astype(np.int64)
        self.lang, self.value = lang[order], value[order].astype(np.float32)
        self.langs, self.absent = langs, absent
        # where each range of leading bits begins; hashes are uniform, so ranges are short
        heads = np.arange(1 << self.BITS, dtype=np.uint64) << np.uint64(64 - self.BITS)
        self.edges = np.searchsorted(self.keys, heads).astype(np.int32)
        self.widest = int(np.diff(np.append(self.edges, len(self.keys))).max())

    def of(self, wanted: np.ndarray) -> np.ndarray:
        """Hash, language -> value."""
        out = np.full((len(wanted), self.langs), self.absent, np.float32)
        if not len(self.keys):
            return out
        begin = self.edges[(wanted >> np.uint64(64 - self.BITS)).astype(np.int64)].astype(np.int64)
        at = np.full(len(wanted), -1, np.int64)
        for step in range(self.widest):
            here = np.minimum(begin + step, len(self.keys) - 1)
            at = np.where(self.keys[here] == wanted, here, at)
        row = np.flatnonzero(at >= 0)
        at = at[row]
        count = self.first[at + 1] - self.first[at]
        ends = np.cumsum(count)
        item = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.first[at] - (ends - count), count)
        out[np.repeat(row, count), self.lang[item]] = self.value[item]
        return out


class KneserNey:
    """Models of several languages in shared sorted hash arrays."""

    def __init__(self, samples: dict[str, dict[str, int]]):
        """samples: language -> word -> how often it was seen."""
        self.langs = sorted(samples)
        grams, contexts = [{} for _ in range(ORDER)], [{} for _ in range(ORDER)]
        for k, lang in enumerate(self.langs):
            words = list(samples[lang])
            if words:
                self._count(k, words, np.fromiter(samples[lang].values(), np.float64, len(words)), grams, contexts)
        self.grams = [Values(store, len(self.langs), 0.0) for store in grams]
        self.contexts = [Values(store, len(self.langs), 1.0) for store in contexts]
        self.symbols = np.float32(1.0 / 400)  # the uniform model below order 1

    def _count(self, k: int, words: list[str], times: np.ndarray, grams: list, contexts: list) -> None:
        hashes, owner, _ = _grams(words)
        left = _left_hash(words)
        weight = times[owner]
        for n in range(1, ORDER + 1):
            here = hashes[n - 1] != 0
            key, first, back = np.unique(hashes[n - 1][here], return_index=True, return_inverse=True)
            if n == ORDER:
                count = np.bincount(back, weights=weight[here])
            else:
                # continuation count: distinct longer grams that end in this one, and its own
                # occurrences at the word's start, where nothing longer exists
                longer = hashes[n] != 0
                distinct = np.unique(hashes[n][longer], return_index=True)[1]
                count = np.bincount(np.searchsorted(key, hashes[n - 1][longer][distinct]), minlength=len(key)).astype(np.float64)
                start = here & (hashes[n] == 0)
                count += np.bincount(np.searchsorted(key, hashes[n - 1][start]), weights=weight[start], minlength=len(key))
            n1, n2 = max(1, (count == 1).sum()), (count == 2).sum()
            discount = n1 / (n1 + 2 * n2) if n2 else 0.5
            ctx = left[n - 1][here][first]
            ctx_key, ctx_back = np.unique(ctx, return_inverse=True)
            total = np.bincount(ctx_back, weights=count)
            kinds = np.bincount(ctx_back)
            grams[n - 1][k] = (key, ((count - np.minimum(discount, count)) / total[ctx_back]).astype(np.float32))
            contexts[n - 1][k] = (ctx_key, np.minimum(1.0, discount * kinds / total).astype(np.float32))

    def entropies(self, words: list[str], at_once: int = 200_000) -> np.ndarray:
        """Nats of each word under every language: word, language.

        Words above PIECE letters are scored whole, in pieces that begin with the letters their first place looks back to.
        """
        if any(len(w) > PIECE for w in words):
            pieces, first, cut = [], [], {}
            for w in words:
                first.append(len(pieces))
                for k in range(0, len(w), PIECE):
                    if len(w) > PIECE:
                        cut[len(pieces)] = (min(k, ORDER - 1), k + PIECE >= len(w))
                    pieces.append(w[max(0, k - ORDER + 1) : k + PIECE])
            return np.add.reduceat(self._nats(pieces, cut, at_once), first, axis=0, dtype=np.float64).astype(np.float32)
        return self._nats(words, {}, at_once)

    def _nats(self, words: list[str], cut: dict[int, tuple[int, bool]], at_once: int) -> np.ndarray:
        """cut: piece -> how many places at its start belong to the piece before, and whether the word ends with it."""
        parts = []
        start, at_once = 0, min(at_once, max(2000, 4_000_000 // max(1, len(self.langs))))
        while start < len(words):
            end, chars = start, 0
            while end < len(words) and chars < at_once:
                chars += len(words[end]) + 1
                end += 1
            some = words[start:end]
            hashes, owner, _ = _grams(some)
            left = _left_hash(some)
            p = np.full((len(owner), len(self.langs)), self.symbols, np.float32)
            for n in range(ORDER):
                here = np.flatnonzero(hashes[n])
                if len(here):
                    p[here] = self.grams[n].of(hashes[n][here]) + self.contexts[n].of(left[n][here]) * p[here]
            logs = -np.log(p)
            first = np.searchsorted(owner, np.arange(len(some)), "left")
            for k in range(start, end) if cut else ():
                if k in cut:
                    at = first[k - start]
                    logs[at : at + cut[k][0]] = 0
                    logs[at + len(words[k])] *= cut[k][1]
            parts.append(np.add.reduceat(logs, first, axis=0))
            start = end
        return np.concatenate(parts) if parts else np.zeros((0, len(self.langs)), np.float32)

    def score_texts(self, texts: list[str | None], cache: WordRows) -> tuple[np.ndarray, np.ndarray]:
        """Mean nats per character of each text under every language, and its number of characters (0: no words)."""
        cache.make_room()
        ids, counts = [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            words = words_of(text) if text else []
            counts[k] = len(words)
            ids.append(np.fromiter(map(cache.__getitem__, words), np.int64, len(words)))
        got = cache.rows(self)[np.concatenate(ids)] if ids else np.zeros((0, len(self.langs) + 1), np.float32)
        sums = np.zeros((len(texts), len(self.langs) + 1))
        some = np.flatnonzero(counts)
        if len(some):
            first = (np.cumsum(counts) - counts)[some]
            sums[some] = np.add.reduceat(got, first, axis=0, dtype=np.float64)
        return sums[:, :-1] / np.maximum(1.0, sums[:, -1:]), sums[:, -1]


class WordRows(dict):
    """Word -> number of its row of nats; new words wait in a list and are scored together."""

    def __init__(self, langs: int = 4, most: int = 800_000):
        super().__init__()
        self.most = min(most, 8_000_000 // (langs + 1))
        self.waiting, self.table, self.used, self.letters = [], np.zeros((0, 0), np.float32), 0, 0

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.waiting.append(word)
        self.letters += len(word)
        return n

    def make_room(self) -> None:
        if len(self) > self.most or self.letters > 20 * self.most:
            self.clear()
            self.used = self.letters = 0

    def rows(self, model: KneserNey) -> np.ndarray:
        if self.waiting:
            nats = model.entropies(self.waiting)
            need = self.used + len(self.waiting)
            if need > len(self.table):
                grown = np.zeros((2 * need, nats.shape[1] + 1), np.float32)
                if self.used:
                    grown[: self.used] = self.table[: self.used]
                self.table = grown
            self.table[self.used : need, :-1] = nats
            self.table[self.used : need, -1] = np.fromiter(map(len, self.waiting), np.float32, len(self.waiting)) + 1
            self.used = need
            self.waiting.clear()
        return self.table


class Identifier:
    """Models with calibration: temperature of the score and a limit for each language."""

    def __init__(self, rows: list[tuple[str, str]]):
        """rows: (language, text). Every fifth row is held back to calibrate."""
        fit, back = [r for k, r in enumerate(rows) if k % 5], [r for k, r in enumerate(rows) if not k % 5]
        samples: dict[str, dict[str, int]] = {}
        for lang, text in fit or back:
            seen = samples.setdefault(lang, {})
            for w in words_of(text):
                seen[w] = seen.get(w, 0) + 1
        for lang, _ in rows:
            samples.setdefault(lang, {})
        self.model = KneserNey(samples)
        self.temperature, self.limits = 20.0, np.full(len(samples), np.inf)
        if samples:
            self._calibrate(back)

    def _calibrate(self, rows: list[tuple[str, str]]) -> None:
        nats, size = self.model.score_texts([t for _, t in rows], WordRows())
        truth = np.array([self.model.langs.index(lang) for lang, _ in rows])
        some = size > 0
        nats, truth = nats[some], truth[some]
        if not len(nats):
            return
        best = np.inf
        for temperature in (1, 2, 5, 10, 20, 50, 100):
            z = -temperature * (nats - nats.min(axis=1, keepdims=True))
            loss = -(z[np.arange(len(z)), truth] - np.log(np.exp(z).sum(axis=1))).mean()
            if loss < best:
                best, self.temperature = loss, float(temperature)
        for k in range(len(self.limits)):
            own = nats[truth == k, k]
            if len(own) >= 20:
                self.limits[k] = np.quantile(own, 0.995) * 1.1

    def predict(self, texts: list[str | None], cache: WordRows) -> tuple[list[str], list[float], list[bool]]:
        langs = self.model.langs
        if not langs:
            return ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
        nats, size = self.model.score_texts(texts, cache)
        names, scores, accepted = [], [], []
        best = nats.argmin(axis=1)
        z = np.exp(-self.temperature * (nats - nats.min(axis=1, keepdims=True)))
        for k, text in enumerate(texts):
            if not text or not any(c.isalpha() for c in text):
                names.append("und")
                scores.append(0.0)
                accepted.append(False)
                continue
            b = int(best[k]) if size[k] else 0
            names.append(langs[b])
            scores.append(float(1.0 / z[k].sum()) if size[k] else 1.0 / len(langs))
            accepted.append(bool(size[k] > 0 and nats[k, b] <= self.limits[b]))
        return names, scores, accepted


def training_rows(docs: DataFrame, train_chars: int) -> list[tuple[str, str]]:
    """A bounded sample of labelled rows: those of smallest hash, about ``train_chars`` characters a language."""
    labelled = docs.where("lang is not null and text is not null").where(crc_mod("doc_id", 4) != 2)
    size = F.length("text")
    usable = labelled.where(size.between(1, LONGEST))
    totals = usable.groupBy("lang").agg(F.sum(size).alias("total")).orderBy(F.desc("total"), "lang").limit(MOST_LANGS).collect()
    if not totals:
        return []
    train_chars = min(train_chars, TOTAL_CHARS // len(totals))
    share = F.lit(0.0)
    for r in totals:
        share = F.when(F.col("lang") == r.lang, train_chars / r.total).otherwise(share)
    unit = F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))
    chosen = usable.where(unit < share).select("lang", "text", unit.alias("unit")).collect()
    return [(r.lang, r.text) for r in sorted(chosen, key=lambda r: (r.unit, r.lang, r.text))]


def identify_languages(docs: DataFrame, train_chars: int = 500_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted of every row of ``docs`` (doc_id, text, lang)."""
    rows = training_rows(docs.select("doc_id", "text", "lang"), train_chars)
    identifier = docs.sparkSession.sparkContext.broadcast(Identifier(rows))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = identifier.value
        cache = model.__dict__.setdefault("cache", WordRows(len(model.model.langs)))  # lives as long as the worker holds the broadcast
        for part in parts:
            for start in range(0, part.num_rows, 1000):
                some = part.slice(start, 1000)
                names, scores, accepted = model.predict(some.column(2).to_pylist(), cache)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(names), pa.array(scores), pa.array(accepted)], schema=schema)

    return map_batches(docs.select(F.col("doc_id").cast("bigint"), (crc_mod("doc_id", 4) == 2).alias("held_out"), "text"), run, "doc_id bigint, held_out boolean, lang_pred string, score double, accepted boolean")
