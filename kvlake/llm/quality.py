"""Document quality by a linear-chain conditional random field over lines.

Every line with a word is labelled good or bad. A line is described by binned
measures of its own characters and words and of the lines before and after it;
the chain's transitions tie neighbours together. Forward-backward gives each
line's probability of being good; their mean, weighted by line length, is
calibrated to the probability of label 1 and moved so that the decision limit
``LIMIT`` splits the classes best.

Labels belong to documents. The chain is first fitted with every line bearing
its document's label; then the lines of bad documents that it finds clearly good
are labelled good and it is fitted again.

Fitting uses about ``per_class`` labelled rows of each class (those of smallest
hash, texts up to LONGEST characters), never held-out rows (crc32 of the id,
modulo 5, is 0). Labels, lang, source and doc_id are no inputs of a score.

Defined cases: a text that is null or has no word scores 0; without labels of
both classes every other text scores 0.5; a score equal to the limit is good; a
doc_id labelled twice counts with its least label; null ids are never training rows;
repeated ids are scored row by row; texts of any length are scored whole, line by
line; an empty table gives an empty one; other columns, whatever their names, are not
read by ``score_quality`` and handed on by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlake.llm.common import Rolling, crc_mod, map_batches, mix

LIMIT = 0.3
LONGEST = 60_000

_KIND = np.zeros(256, np.uint8)  # 0 others, 1 upper, 2 lower, 3 digit, 4 blank, 5 stop, 6 exclamation, 7 bar, 8 symbol
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("a") : ord("z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[[32, 9, 10, 11, 12, 13]] = 4
for _c in ".,;:?'\"()-":
    _KIND[ord(_c)] = 5
_KIND[ord("!")] = 6
_KIND[ord("|")] = 7
for _c in "#$%&*<>=@^~\\/_{}[]+`":
    _KIND[ord(_c)] = 8

EDGES = [
    [0.001, 0.02, 0.05, 0.1, 0.25, 0.6],  # upper-case share of ASCII letters
    [0.001, 0.01, 0.03, 0.1, 0.3],  # digits
    [0.001, 0.01, 0.03, 0.08, 0.2],  # exclamation marks
    [0.001, 0.01, 0.03, 0.08, 0.2],  # bars
    [0.001, 0.01, 0.03, 0.08, 0.2],  # other symbols
    [0.02, 0.08, 0.15, 0.3, 0.6],  # stops for each word
    [3.0, 4.0, 5.0, 6.0, 7.5, 10.0],  # characters for each word
    [2.5, 4.5, 6.5, 8.5, 11.5, 20.5, 50.5, 150.5],  # words
    [0.15, 0.3, 0.5, 0.7, 0.85, 0.95],  # distinct words
    [0.5],  # equal to an earlier line
]
WIDTH = max(map(len, EDGES)) + 2  # bins, and one for "no such line"
NONE = WIDTH - 1
_ROLL = Rolling()
_BYTES = np.random.default_rng(23).integers(1, 1 << 63, 256, np.uint64)


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins (line, measure), number of characters of each line, and lines of each text; lines without a word are left out."""
    raws = [x.encode("utf-8", "surrogatepass") for x in texts]
    data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    kind = _KIND[data]
    newline = np.flatnonzero(data == 10)
    start, end = np.concatenate([[0], newline[:-1] + 1]), newline
    ends_of_texts = np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)) + 1) - 1
    owner = np.searchsorted(ends_of_texts, end, "left")
    inside = kind != 4
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    ws, we = edge[::2], edge[1::2]
    line_of = np.searchsorted(end, ws, "left")
    words = np.bincount(line_of, minlength=len(end))
    at = np.flatnonzero(inside)
    of = np.searchsorted(end, at, "left")
    counts = np.bincount(of * 9 + kind[at], minlength=9 * len(end)).reshape(len(end), 9).astype(np.float64)
    counts[:, 0] -= np.bincount(of[(data[at] & 0xC0) == 0x80], minlength=len(end))  # code points, not bytes
    prefix = _ROLL.prefix(_BYTES[data])
    word_hash = mix(((prefix[we] - prefix[ws]) * _ROLL.up[ws]) ^ (we - ws).astype(np.uint64))
    distinct = np.bincount(line_of[np.unique(mix(word_hash + line_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]], minlength=len(end))
    line_hash = mix(((prefix[end] - prefix[start]) * _ROLL.up[start]) ^ mix((end - start).astype(np.uint64) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    again = np.ones(len(end), bool)
    again[np.unique(line_hash, return_index=True)[1]] = False
    chars = np.maximum(counts.sum(axis=1), 1)
    n = np.maximum(words, 1)
    measures = [counts[:, 1] / np.maximum(1, counts[:, 1] + counts[:, 2]), counts[:, 3] / chars, counts[:, 6] / chars, counts[:, 7] / chars, counts[:, 8] / chars, counts[:, 5] / n, chars / n, words, distinct / n, again]
    real = words > 0
    bins = np.stack([np.searchsorted(e, m[real].astype(np.float64), "right") for e, m in zip(EDGES, measures, strict=True)], axis=1).astype(np.uint8) if real.any() else np.zeros((0, len(EDGES)), np.uint8)
    return bins, chars[real], np.bincount(owner[real], minlength=len(texts))


class Chains:
    """Lines of many documents laid out for steps over all documents at once, longest first."""

    def __init__(self, lines: np.ndarray):
        self.order = np.argsort(-lines, kind="stable")
        first = (np.cumsum(lines) - lines)[self.order]
        self.lines = lines[self.order]
        longest = int(self.lines[0]) if len(lines) else 0
        self.steps = [first[: np.searchsorted(-self.lines, -t, "left")] + t for t in range(longest)]

    def marginals(self, e: np.ndarray, a: np.ndarray, pairs: bool = False):
        """P(label) of each line; with ``pairs`` also the expected transitions and the sum of log partition sums."""
        alpha, beta = e.copy(), np.zeros_like(e)
        for t in range(1, len(self.steps)):
            now, before = self.steps[t], self.steps[t] - 1
            alpha[now] += np.logaddexp(alpha[before][:, :1] + a[0], alpha[before][:, 1:] + a[1])
        for t in range(len(self.steps) - 2, -1, -1):
            after = self.steps[t + 1]
            x = e[after] + beta[after]
            beta[after - 1] = np.logaddexp(x[:, :1] + a[:, 0], x[:, 1:] + a[:, 1])
        joint = alpha + beta
        z = np.logaddexp(joint[:, 0], joint[:, 1])
        p = np.exp(joint - z[:, None])
        if not pairs:
            return p
        expected = np.zeros((2, 2))
        for t in range(1, len(self.steps)):
            now = self.steps[t]
            x = alpha[now - 1][:, :, None] + a[None] + (e[now] + beta[now])[:, None, :] - z[now][:, None, None]
            expected += np.exp(x).sum(axis=0)
        return p, expected, float(z[self.steps[0]].sum()) if self.steps else 0.0


class LineCRF:
    def __init__(self):
        self.w = np.zeros((3, len(EDGES), WIDTH))
        self.bias, self.a = 0.0, np.zeros((2, 2))

    @staticmethod
    def around(bins: np.ndarray, lines: np.ndarray) -> list[np.ndarray]:
        """Bins of the line before, the line, and the line after, within one document."""
        before, after = np.roll(bins, 1, axis=0), np.roll(bins, -1, axis=0)
        some = lines[lines > 0]
        last = np.cumsum(some) - 1
        before[last - some + 1], after[last] = NONE, NONE
        return [before, bins, after]

    def emissions(self, around: list[np.ndarray]) -> np.ndarray:
        s = np.full(len(around[0]), self.bias)
        for w, bins in zip(self.w, around, strict=True):
            for k in range(bins.shape[1]):
                s += w[k][bins[:, k]]
        return np.stack([-s / 2, s / 2], axis=1)

    def fit(self, bins: np.ndarray, lines: np.ndarray, labels: np.ndarray, weights: np.ndarray, rounds: int = 80, rate: float = 0.15, ridge: float = 1e-3) -> None:
        """labels: of lines. Maximises the likelihood of the labels by Adam over all lines."""
        around, chains, n = self.around(bins, lines), Chains(lines), max(1, len(lines))
        flat = [a.astype(np.int64) + WIDTH * np.arange(a.shape[1]) for a in around]
        linked = np.ones(len(labels), bool)
        some = lines[lines > 0]
        linked[np.cumsum(some) - some] = False
        seen = np.zeros((2, 2))
        at = np.flatnonzero(linked)
        np.add.at(seen, (labels[at - 1], labels[at]), 1.0)
        theta = np.concatenate([self.w.ravel(), [self.bias], self.a.ravel()])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, rounds + 1):
            p, pairs, _ = chains.marginals(self.emissions(around), self.a, pairs=True)
            miss = (labels - p[:, 1]) * weights
            gw = np.stack([np.bincount(f.ravel(), weights=np.repeat(miss, f.shape[1]), minlength=WIDTH * len(EDGES)).reshape(len(EDGES), WIDTH) for f in flat])
            g = np.concatenate([gw.ravel(), [miss.sum()], (seen - pairs).ravel()]) / n - ridge * theta
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            k = self.w.size
            self.w, self.bias, self.a = theta[:k].reshape(self.w.shape), float(theta[k]), np.clip(theta[k + 1 :].reshape(2, 2), -3, 3)

    def good(self, bins: np.ndarray, lines: np.ndarray) -> np.ndarray:
        return Chains(lines).marginals(self.emissions(self.around(bins, lines)), self.a)[:, 1] if len(bins) else np.zeros(0)


class QualityModel:
    """The chain and its calibration."""

    def __init__(self, bins: np.ndarray, chars: np.ndarray, lines: np.ndarray, labels: np.ndarray):
        self.crf, self.slope, self.shift = LineCRF(), 4.0, 0.0
        self.known = len(set(labels.tolist())) == 2
        if not self.known:
            return
        line_label = np.repeat(labels, lines)
        ones = np.ones(len(line_label))
        self.crf.fit(bins, lines, line_label, ones)
        p = self.crf.good(bins, lines)
        self.crf.fit(bins, lines, np.where((line_label == 0) & (p > 0.8), 1, line_label), ones)
        x = self._mean(bins, chars, lines)
        some = lines > 0
        self._calibrate(x[some], labels[some])

    def _mean(self, bins: np.ndarray, chars: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the lines' marginals for each document, as log odds."""
        p, owner = self.crf.good(bins, lines), np.repeat(np.arange(len(lines)), lines)
        total = np.bincount(owner, weights=chars, minlength=len(lines))
        mean = np.bincount(owner, weights=p * chars, minlength=len(lines)) / np.maximum(total, 1e-9)
        return np.log((mean + 1e-4) / (1 - mean + 1e-4))

    def _calibrate(self, x: np.ndarray, labels: np.ndarray) -> None:
        """Logistic slope by Newton steps; the shift puts the best split of the two classes at LIMIT."""
        a, b = 1.0, 0.0
        w = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            g = np.array([(w * (labels - p) * x).sum(), (w * (labels - p)).sum()]) - 1e-3 * np.array([a, b])
            h = w * p * (1 - p)
            hess = np.array([[(h * x * x).sum(), (h * x).sum()], [(h * x).sum(), h.sum()]]) + 1e-3 * np.eye(2)
            a, b = np.array([a, b]) + np.linalg.solve(hess, g)
        order = np.argsort(x)
        missed_good = np.cumsum(w[order] * labels[order])  # good ones at or below the split
        missed_bad = (w * (labels == 0)).sum() - np.cumsum(w[order] * (labels[order] == 0))
        # a good document lost weighs twice a bad one kept
        cost = 2 * missed_good + missed_bad
        best = int(np.argmin(cost))
        low, high = x[order[best]], x[order[best + 1]] if best + 1 < len(x) else x[order[best]] + 1
        split = (low + high) / 2
        self.slope = float(np.clip(a, 0.1, 20))
        self.shift = float(np.log(LIMIT / (1 - LIMIT)) - self.slope * split)

    def scores(self, texts: list[str | None], at_once: int = 600_000) -> np.ndarray:
        parts, start = [], 0
        while start < len(texts):
            end, chars = start, 0
            while end < len(texts) and (chars < at_once or end == start):
                chars += len(texts[end] or "")
                end += 1
            bins, size, lines = line_features([x or "" for x in texts[start:end]])
            if self.known:
                s = 1 / (1 + np.exp(-np.clip(self.slope * self._mean(bins, size, lines) + self.shift, -30, 30)))
            else:
                s = np.full(len(lines), 0.5)
            parts.append(np.where(lines > 0, s, 0.0))
            start = end
        return np.concatenate(parts) if parts else np.zeros(0)


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = 2500) -> QualityModel:
    """Fit on a bounded sample of the labelled rows of ``docs`` (doc_id, text) and ``labels`` (doc_id, quality)."""
    spark = docs.sparkSession
    usable = labels.select(F.col("doc_id").cast("bigint"), "quality").where("doc_id is not null and quality in (0, 1)").where(crc_mod("doc_id", 5) != 0)
    each = usable.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    counts = {r.quality: r.n for r in each.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    unit = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))
    share = F.lit(0.0)
    for q, n in counts.items():
        share = F.when(F.col("quality") == q, per_class / n).otherwise(share)
    chosen = spark.createDataFrame([(r.doc_id, r.quality) for r in each.where(unit < share).collect()], "doc_id bigint, quality int")
    texts = docs.select(F.col("doc_id").cast("bigint"), "text").where(F.length("text").between(1, LONGEST)).join(F.broadcast(chosen), "doc_id")  # about 2 * per_class rows
    schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("bins", pa.binary()), ("chars", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            bins, chars, lines = line_features(part.column(1).to_pylist())
            ends = np.cumsum(lines)
            rows = [(bins[e - n : e].tobytes(), chars[e - n : e].astype(np.int32).tobytes()) for n, e in zip(lines.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], schema=schema)

    rows = sorted(map_batches(texts.select("doc_id", "text", "quality"), run, "doc_id bigint, quality int, bins binary, chars binary").collect(), key=lambda r: (r.doc_id, bytes(r.bins)))
    bins = np.frombuffer(b"".join(bytes(r.bins) for r in rows), np.uint8).reshape(-1, len(EDGES))
    chars = np.frombuffer(b"".join(bytes(r.chars) for r in rows), np.int32).astype(np.float64)
    lines = np.array([len(r.chars) // 4 for r in rows], np.int64)
    return QualityModel(bins, chars, lines, np.array([r.quality for r in rows], np.int64))


def score_quality(docs: DataFrame, labels: DataFrame, per_class: int = 2500) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, per_class))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            s = model.value.scores(part.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s, pa.float64()), pa.array((s >= LIMIT).astype(np.int32))], schema=schema)

    return map_batches(docs.select(F.col("doc_id").cast("bigint"), (crc_mod("doc_id", 5) == 0).alias("held_out"), "text"), run, "doc_id bigint, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, per_class: int = 2500) -> DataFrame:
    """The rows of ``docs`` that are predicted good, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, per_class))
    where = docs.columns.index("text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield part.filter(pa.array(model.value.scores(part.column(where).to_pylist()) >= LIMIT))

    return map_batches(docs, run, docs.schema)
