"""Personal data: base patterns, and a character BiLSTM-CRF that adds spans.

The tagger is a bidirectional LSTM over character symbols with CRF transitions,
trained in numpy on labelled spans that this module writes itself from formats
of e-mail addresses, IP addresses, card and phone numbers amid words, dates,
prices, keys and versions. It reads windows of WINDOW characters, every STRIDE
characters, wherever a digit or '@' lies within REACH, and further to the ends of
the address around an '@' and through the gaps of a phone number: a span of any of
the four kinds holds a digit or '@', so no text outside can hold one. The emissions of
overlapping windows are averaged per character, each weighted by its distance
from the window's ends, and one Viterbi pass over the whole region, across all
its windows, gives the global labelling. A long region is read in stretches of
STRETCH characters with the scores carried over, and labels are settled as soon as
all paths agree on them, so memory does not grow with it. A decoded span is added if its kind's
shape holds (Luhn, number of digits, parts up to 255, dotted domain) and it
touches no base span; base spans always stay.

Defined cases: null counts as the empty text; rows with null or repeated ids are
read like others; texts of any length are read whole; of labellings that score the
same, the one of lesser tags is taken; an empty table gives an empty one; other
columns, whatever their names, are not read by ``find_pii`` and handed on by
``mask_pii``.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlake.llm.common import map_batches

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE, REACH, STRETCH = 64, 32, 20, 16_384

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT_RUNS = re.compile("[0-9]+")
_TRIGGER = re.compile("[0-9@]+")
_AFTER_AT = re.compile(r" ?(?:[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+)?")
_IN_PHONE = re.compile("[ ().-]*")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """In one pass over the '@'s: the run of local characters before each, then a dotted domain."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, floor := found.end()))
        else:
            floor = at + 1
        at = text.find("@", floor)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind and start; leftmost, not overlapping within a kind."""
    spans = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if _TRIGGER.search(text):
        for m in _IP.finditer(text):
            if all(len(x) < 4 and int(x) < 256 or int(x.lstrip("0")[:4] or 0) < 256 for x in m[0].split(".")):
                spans.append((1, m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                spans.append((2, m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum(map(len, _DIGIT_RUNS.findall(m[0]))) <= 15:
                    spans.append((3, m.start(), m.end()))
    return spans


# --- the tagger -----------------------------------------------------------------

_PUNCT = " \n\t.,:;!?@+-_()[]{}<>/\\|\"'=%#$&*~"
N_SYMBOLS = len(_PUNCT) + 6
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
_TABLE = np.full(128, len(_PUNCT) + 4, np.int64)
_TABLE[ord("0") : ord("9") + 1] = len(_PUNCT)
_TABLE[ord("a") : ord("z") + 1] = len(_PUNCT) + 1
_TABLE[ord("A") : ord("Z") + 1] = len(_PUNCT) + 2
for _k, _c in enumerate(_PUNCT):
    _TABLE[ord(_c)] = _k
PAD = len(_PUNCT) + 5


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.where(codes < 128, _TABLE[np.minimum(codes, 127)], len(_PUNCT) + 3)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tagger:
    """Embedding, LSTM in both directions, linear emissions, CRF transitions."""

    def __init__(self, embed: int = 10, hidden: int = 20, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.h = hidden
        scale = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"E": scale(N_SYMBOLS, embed), "V": scale(2 * hidden, TAGS), "c": np.zeros(TAGS, np.float32), "A": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            self.p[f"W{d}"] = scale(embed + hidden, 4 * hidden)
            self.p[f"b{d}"] = np.zeros(4 * hidden, np.float32)
            self.p[f"b{d}"][hidden : 2 * hidden] = 1.0
        self.allowed = np.zeros((TAGS, TAGS), np.float32)  # inside follows only begin or inside of its kind
        for k in range(len(KINDS)):
            for before in range(TAGS):
                if before not in (1 + 2 * k, 2 + 2 * k):
                    self.allowed[before, 2 + 2 * k] = -1e4

    def _lstm(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """x: time, window, embedding; the backward direction runs from the end."""
        n, h = x.shape[1], self.h
        w, b = self.p[f"W{d}"], self.p[f"b{d}"]
        out = np.zeros((len(x), n, h), np.float32)
        state, cell, saved = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            joined = np.concatenate([x[t], state], axis=1)
            z = joined @ w + b
            gates = _sigmoid(z[:, : 3 * h])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            g = np.tanh(z[:, 3 * h :])
            before = cell
            cell = f * cell + i * g
            tc = np.tanh(cell)
            state = o * tc
            out[t] = state
            if keep:
                saved.append((t, joined, i, f, o, g, before, tc))
        return out, saved

    def emissions(self, ids: np.ndarray, keep: bool = False):
        """ids: window, time -> time, window, tag."""
        x = self.p["E"][ids.T]
        forward, sf = self._lstm(x, "f", keep)
        backward, sb = self._lstm(x, "b", keep)
        both = np.concatenate([forward, backward], axis=2)
        e = both @ self.p["V"] + self.p["c"]
        return (e, x, both, sf, sb) if keep else e

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        e, _, both, sf, sb = self.emissions(ids, True)
        steps, n, _ = e.shape
        a = self.p["A"] + self.allowed
        y = tags.T
        alpha = np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, steps):
            s = alpha[t - 1][:, :, None] + a[None]
            top = s.max(axis=1)
            alpha[t] = e[t] + top + np.log(np.exp(s - top[:, None]).sum(axis=1))
        beta = np.zeros_like(e)
        for t in range(steps - 2, -1, -1):
            s = a[None] + (e[t + 1] + beta[t + 1])[:, None, :]
            top = s.max(axis=2)
            beta[t] = top + np.log(np.exp(s - top[:, :, None]).sum(axis=2))
        last = alpha[-1]
        top = last.max(axis=1)
        z = top + np.log(np.exp(last - top[:, None]).sum(axis=1))
        de = np.exp(alpha + beta - z[None, :, None])
        da = np.zeros_like(a)
        row = np.arange(n)
        loss = z.sum()
        for t in range(steps):
            loss -= e[t, row, y[t]].sum()
            de[t, row, y[t]] -= 1
            if t:
                loss -= a[y[t - 1], y[t]].sum()
                da += np.exp(alpha[t - 1][:, :, None] + a[None] + (e[t] + beta[t])[:, None, :] - z[:, None, None]).sum(axis=0)
                np.add.at(da, (y[t - 1], y[t]), -1.0)
        flat = de.reshape(-1, TAGS)
        g = {"V": both.reshape(-1, 2 * self.h).T @ flat, "c": flat.sum(axis=0), "A": np.where(self.allowed < 0, 0, da)}
        dboth = de @ self.p["V"].T
        dx = np.zeros((steps, n, self.p["E"].shape[1]), np.float32)
        for d, saved, part in (("f", sf, dboth[:, :, : self.h]), ("b", sb, dboth[:, :, self.h :])):
            g[f"W{d}"], g[f"b{d}"] = self._back(saved, part, d, dx)
        g["E"] = np.zeros_like(self.p["E"])
        np.add.at(g["E"], ids.T, dx)
        return float(loss) / n, {k: v / n for k, v in g.items()}

    def _back(self, saved: list, dout: np.ndarray, d: str, dx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = self.p[f"W{d}"]
        gw, gb = np.zeros_like(w), np.zeros_like(self.p[f"b{d}"])
        n = dout.shape[1]
        dh, dc = np.zeros((n, self.h), np.float32), np.zeros((n, self.h), np.float32)
        width = dx.shape[2]
        for t, joined, i, f, o, g, before, tc in reversed(saved):
            dh = dh + dout[t]
            do = dh * tc
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), do * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            gw += joined.T @ dz
            gb += dz.sum(axis=0)
            back = dz @ w.T
            dx[t] += back[:, :width]
            dh, dc = back[:, width:], dc * f
        return gw, gb

    def fit(self, ids: np.ndarray, tags: np.ndarray, epochs: int, batch: int = 128, rate: float = 0.01, seed: int = 5) -> float:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, loss = 0, 0.0
        total = epochs * -(-len(ids) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(ids))
            for k in range(0, len(ids), batch):
                loss, g = self.gradients(ids[order[k : k + batch]], tags[order[k : k + batch]])
                step += 1
                lr = rate * (1 - 0.95 * step / total)
                for name, grad in g.items():
                    grad = np.clip(grad, -1, 1)
                    m[name] = 0.9 * m[name] + 0.1 * grad
                    v2[name] = 0.99 * v2[name] + 0.01 * grad * grad
                    self.p[name] = (self.p[name] - lr * (m[name] / (1 - 0.9**step)) / (np.sqrt(v2[name] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return loss

    def viterbi(self, parts: Iterable[np.ndarray]) -> np.ndarray:
        """Best tags of one region, whose emissions (time, tag) come in parts."""
        a = (self.p["A"] + self.allowed).astype(np.float64)
        first = np.where((np.arange(TAGS) % 2 == 0) & (np.arange(TAGS) > 0), -1e4, 0.0)
        score, back, out = None, [], []
        for e in parts:
            for row in e:
                if score is None:
                    score = row + first
                else:
                    s = score[:, None] + a
                    back.append(s.argmax(axis=0).astype(np.uint8))
                    score = s.max(axis=0) + row
            if score is not None:
                score = score - score.max()
            # where the best paths to all tags meet, what lies before is settled
            ends, at = np.arange(TAGS), len(back)
            while at and (ends != ends[0]).any():
                at -= 1
                ends = back[at][ends]
            if at:
                out.append(self._follow(back[:at], int(ends[0]))[:-1])
                back = back[at:]
        if score is not None:
            out.append(self._follow(back, int(score.argmax())))
        return np.concatenate(out) if out else np.zeros(0, np.uint8)

    @staticmethod
    def _follow(back: list[np.ndarray], tag: int) -> np.ndarray:
        path = [tag]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return np.array(path[::-1], np.uint8)


def _with_luhn(rng: random.Random, n: int) -> str:
    head = "".join(rng.choices("0123456789", k=n - 1))
    return next(head + str(d) for d in range(10) if luhn(head + str(d)))


def labelled_windows(count: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Training windows: symbol ids and tags, written from formats of each kind and of look-alikes."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    letters = lambda a, b, extra="": "".join(rng.choices("abcdefghijklmnopqrstuvwxyz" + extra, k=rng.randrange(a, b)))
    pick = lambda *x: rng.choice(x)

    def word() -> str:
        w = letters(1, 10, "éü")
        return pick(w, w, w, w, w.capitalize(), w.upper()) + pick("", "", "", ",", ".", "?", ":", "!!", "###", "%%%")

    def grouped(s: str, size: int, by: str) -> str:
        return by.join(s[i : i + size] for i in range(0, len(s), size))

    def email() -> str:
        return letters(2, 9) + pick("", ".", "_", "-", "+") + pick(digits(2), letters(1, 6)) + pick("@", "@", "@", " @ ", "@ ") + letters(2, 9, "0123456789") + pick(".", ".", "-x.") + pick("example.com", "com", "org", "co.uk", "net")

    def ip() -> str:
        return ".".join(str(rng.randrange(256)) for _ in range(4))

    def card() -> str:
        return pick(_with_luhn(rng, 16), grouped(_with_luhn(rng, 16), 4, pick(" ", "-", ".", "/")), _with_luhn(rng, 15), _with_luhn(rng, 19))

    def phone() -> str:
        cc, a, b, c = str(rng.randrange(1, 99)), digits(3), digits(3), digits(4)
        return pick(f"+{cc} ({a}) {b}-{c}", f"+{cc}{a}{b}{c}", f"+{cc} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"00{cc} {a} {b}{c}", f"+{cc}-{a}-{b}-{c}")

    def other() -> str:
        return pick(
            digits(rng.randrange(1, 6)), f"{digits(1)}.{digits(rng.randrange(1, 3))}", f"{digits(1)}.{digits(1)}.{digits(2)}", f"20{digits(2)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}", f"${digits(3)},{digits(3)}.{digits(2)}",
            "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=16)), "password=" + "".join(rng.choices("0123456789abcdef", k=rng.randrange(8, 20))), 'token = "' + "".join(rng.choices("0123456789abcdef", k=40)) + '"', "@" + letters(3, 9), letters(2, 6) + "@" + letters(3, 9), f"{digits(2)}%", f"#{digits(4)}", letters(3, 6) + digits(2), f"https://{letters(3, 8)}.com/{digits(3)}?x={digits(2)}",
        )

    makers = (email, ip, card, phone)
    ids, tags = np.full((count, WINDOW), PAD, np.int64), np.zeros((count, WINDOW), np.int64)
    for k in range(count):
        text, labels = "", []
        while len(text) < 2 * WINDOW:
            r = rng.random()
            kind = rng.randrange(4) if r < 0.3 else -1
            piece = makers[kind]() if kind >= 0 else other() if r < 0.5 else word()
            text += piece + (gap := pick(" ", " ", " ", "\n", ", ", ". "))
            labels += ([1 + 2 * kind] + [2 + 2 * kind] * (len(piece) - 1) if kind >= 0 else [0] * len(piece)) + [0] * len(gap)
        start = rng.randrange(WINDOW)
        n = WINDOW if rng.random() < 0.9 else rng.randrange(8, WINDOW)
        part, got = text[start : start + n], np.array(labels[start : start + n])
        inside = (got > 0) & (got % 2 == 0)
        if inside[0]:
            cut = int(np.argmin(inside)) if not inside.all() else n
            got[:cut] = got[0]
            got[0] -= 1  # a span that the window's edge cuts begins there
        ids[k, : len(part)], tags[k, : len(part)] = symbols(part), got
    return ids, tags


@lru_cache(maxsize=2)
def trained(windows: int = 8000, epochs: int = 8) -> Tagger:
    tagger = Tagger()
    tagger.fit(*labelled_windows(windows), epochs=epochs)
    return tagger


def _before_at(text: str, at: int) -> int:
    """Where the run of local characters before an '@' starts, one space between them let through."""
    if at and text[at - 1] == " ":
        at -= 1
    while at and text[at - 1] in _LOCAL:
        at -= 1
    return at


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches that hold every span of a kind's shape; those that meet are one.

    Each reaches REACH characters around a digit or '@' and goes on from an '@' to
    the ends of the runs beside it, and between digits through the marks of a phone number.
    """
    out: list[list[int]] = []
    last = -1
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if "@" in m[0]:
            a = min(a, _before_at(text, text.index("@", m.start())))
            b = max(b, _AFTER_AT.match(text, text.rindex("@", m.start(), m.end()) + 1).end())
        if out and (a <= out[-1][1] or _IN_PHONE.fullmatch(text, last, m.start())):
            while len(out) > 1 and a <= out[-2][1]:
                b = max(b, out.pop()[1])
            out[-1] = [min(a, out[-1][0]), max(b, out[-1][1])]
        else:
            out.append([a, b])
        last = m.end()
    return [(a, b) for a, b in out]


def _shaped(kind: int, span: str) -> bool:
    digits = "".join(_DIGIT_RUNS.findall(span))
    if kind == 0:
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+ ?@ ?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", span))
    if kind == 1:
        return bool(re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", span)) and all(int(x) < 256 for x in span.split("."))
    if kind == 2:
        return bool(re.fullmatch(r"[0-9](?:[ ./-]?[0-9])+", span)) and len(digits) in (15, 16, 19) and luhn(digits)
    return bool(re.fullmatch(r"(?:\+|00|\()?[0-9][ ().0-9-]+[0-9]", span)) and 10 <= len(digits) <= 15


def _spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    out = []
    for k in np.flatnonzero(tags % 2 == 1).tolist():
        end = k + 1
        while end < len(tags) and tags[end] == tags[k] + 1:
            end += 1
        out.append((int(tags[k] - 1) // 2, k, end))
    return out


class Taken:
    """Spans of one text: whether one of them covers, or meets, a stretch."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        ordered = sorted((a, b) for _, a, b in spans)
        self.starts = [a for a, _ in ordered]
        self.reach = np.maximum.accumulate([b for _, b in ordered]).tolist() if ordered else []

    def covers(self, a: int, b: int) -> bool:
        k = bisect_right(self.starts, a)
        return k > 0 and self.reach[k - 1] >= b

    def meets(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b)
        return k > 0 and self.reach[k - 1] > a


_WEIGHT = 1.0 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]).astype(np.float32)


def _window_starts(length: int, first: int = 0, end: int | None = None) -> range:
    """Where windows begin that reach into [first, end) of a region."""
    last = max(1, length - WINDOW + STRIDE)
    return range(max(0, (first - WINDOW) // STRIDE * STRIDE + STRIDE), last if end is None else min(last, end), STRIDE)


def region_emissions(tagger: Tagger, text: str, a: int, b: int) -> Iterator[np.ndarray]:
    """Averaged emissions (time, tag) of one region, stretch by stretch."""
    n = b - a
    for first in range(0, n, STRETCH):
        end = min(n, first + STRETCH)
        starts = _window_starts(n, first, end)
        ids = symbols(text[a + starts[0] : a + min(n, starts[-1] + WINDOW)])
        ids = np.concatenate([ids, np.full(max(0, starts[-1] + WINDOW - n), PAD, np.int64)])
        e = tagger.emissions(np.stack([ids[s - starts[0] : s - starts[0] + WINDOW] for s in starts]))
        total, w = np.zeros((starts[-1] + WINDOW - starts[0], TAGS), np.float32), np.zeros(starts[-1] + WINDOW - starts[0], np.float32)
        for j, s in enumerate(starts):
            at = s - starts[0]
            total[at : at + WINDOW] += e[:, j] * _WEIGHT[:, None]
            w[at : at + WINDOW] += _WEIGHT
        some = slice(first - starts[0], end - starts[0])
        yield total[some] / w[some, None]


def tagger_spans(tagger: Tagger, texts: list[str], taken: list[list[tuple[int, int, int]]], at_once: int = 4096) -> list[list[tuple[int, int, int]]]:
    """What the tagger adds to the ``taken`` spans of each text."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    known = [Taken(x) for x in taken]
    pending: list[tuple[int, int, np.ndarray]] = []
    held = 0

    def add(doc: int, a: int, tags: np.ndarray) -> None:
        for kind, s, t in _spans_of(tags):
            span = texts[doc][a + s : a + t]
            lead = len(span) - len(span.lstrip())
            s, span = s + lead, span.strip()
            t = s + len(span)
            if _shaped(kind, span) and not known[doc].meets(a + s, a + t):
                out[doc].append((kind, a + s, a + t))

    def work() -> None:
        """Many short regions at once."""
        windows, owner = [], []
        for k, (_, _, ids) in enumerate(pending):
            for s in _window_starts(len(ids)):
                row = np.full(WINDOW, PAD, np.int64)
                row[: len(ids[s : s + WINDOW])] = ids[s : s + WINDOW]
                windows.append(row)
                owner.append((k, s))
        sums = [np.zeros((len(x[2]), TAGS), np.float32) for x in pending]
        weights = [np.zeros(len(x[2]), np.float32) for x in pending]
        for first in range(0, len(windows), at_once):
            e = tagger.emissions(np.stack(windows[first : first + at_once]))
            for j in range(e.shape[1]):
                k, s = owner[first + j]
                n = min(WINDOW, len(sums[k]) - s)
                sums[k][s : s + n] += e[:n, j] * _WEIGHT[:n, None]
                weights[k][s : s + n] += _WEIGHT[:n]
        for (doc, a, _), total, w in zip(pending, sums, weights, strict=True):
            add(doc, a, tagger.viterbi([total / w[:, None]]))
        pending.clear()

    for doc, text in enumerate(texts):
        for a, b in regions(text):
            # what base spans cover, with what they touch, needs no second opinion
            if all(known[doc].covers(m.start(), m.end()) for m in _TRIGGER.finditer(text, a, b)):
                continue
            if b - a > STRETCH:
                add(doc, a, tagger.viterbi(region_emissions(tagger, text, a, b)))
                continue
            pending.append((doc, a, symbols(text[a:b])))
            held += b - a
            if held > 200_000:
                work()
                held = 0
    if pending:
        work()
    for spans in out:
        spans.sort(key=lambda s: s[1])
    return out


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all)."""
    tagger = trained()
    schema = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [x or "" for x in part.column(1).to_pylist()]
            base = [base_spans(x) for x in texts]
            added = tagger_spans(tagger, texts, base)
            rows = [[sum(s[0] == k for s in b) for k in range(4)] + [hashlib.sha256(_listed(b).encode()).hexdigest(), _listed(sorted(b + more))] for b, more in zip(base, added, strict=True)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(list(c), f.type) for c, f in zip(cols, list(schema)[1:], strict=True)]], schema=schema)

    return map_batches(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span, or group of overlapping spans, replaced by its kind's placeholder."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a < at:
            if b > at:
                at = b
            continue
        out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = b
    return "".join(out) + text[at:]


def mask_pii(docs: DataFrame) -> DataFrame:
    """The same columns; personal data in ``text`` replaced by placeholders, ``n_chars`` brought up to date if present."""
    tagger = trained()
    names = docs.columns
    where = names.index("text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column(where).to_pylist()
            plain = [x or "" for x in texts]
            base = [base_spans(x) for x in plain]
            added = tagger_spans(tagger, plain, base)
            new = [None if x is None else mask(x, b + more) for x, b, more in zip(texts, base, added, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, part.schema.field(k).type) if k == where else part.column(k) for k in range(part.num_columns)], schema=part.schema)

    masked = map_batches(docs, run, docs.schema)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else masked
