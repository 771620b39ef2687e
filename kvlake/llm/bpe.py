"""BPE encoding and decoding by content-defined chunk reuse.

A text is cut where a rolling hash of its last bytes hits a pattern, so that
equal passages of different documents give equal chunks. A chunk's inside, from
its first to its last white space, is encoded once and reused wherever the same
bytes come again; chunks are told apart by their bytes, not by a hash. Encoding
an inside asks the tokenizers library for each word that has not been met lately
and joins the words' ids.

What lies around a cut, from the last white space before it to the first one
behind it, is a joint. It is encoded anew together with the last whole word of
the chunk before and the first whole word of the chunk behind. Where the ids of
these words are the ids that the two chunks end and begin with, the encodings
agree and are put together; where they are not, the joint takes in twice as many
words on each side, up to all of them, and is encoded again. Agreement at white
space is exact: the tokenizer's pattern drops white space, its merges, NFC,
lower-casing and special strings never act across it. A chunk without white space
becomes part of the joint; a text without any is one joint. Joints are reused by
their bytes as well.

Every character takes this way; there is no other one.

Defined cases: null is encoded as the empty text (no ids, decoded ''); an empty
table gives an empty one; rows with null, repeated or tied ids are encoded like
any other; texts of any length are encoded whole, in chunks of MOST_CHUNK bytes
or less; other columns, whatever their names, are not read and not returned.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kvlake.llm.common import Rolling, held_by, map_batches

WINDOW, MASK = 16, np.uint64(0x3FF)
LEAST_CHUNK, MOST_CHUNK = 128, 16_384
_BLANKS = b" \t\n\v\f\r"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... (count[0] of them), first[1], ..."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(first - (ends - count), count)


class Joint:
    """A stretch to encode: its bytes, and how many of them at either end repeat words of the chunks beside it."""

    __slots__ = ("left", "right", "words", "start", "end", "head", "tail")

    def __init__(self, left: int, right: int, start: int, end: int):
        self.left, self.right = left, right  # chunk numbers on both sides; -1 at the text's ends
        self.words, self.start, self.end = 1, start, end
        self.head = self.tail = 0


class ChunkCodec:
    """Encoder and decoder of one worker; what it keeps is bounded by ``most_bytes`` of chunks and joints and ``most_words``."""

    def __init__(self, path: str, most_bytes: int = 48 << 20, most_words: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        names = [self.library.id_to_token(i).encode("utf-8") + b" " for i in range(self.library.get_vocab_size())]
        self.name_bytes = np.frombuffer(b"".join(names), np.uint8)
        self.name_count = np.fromiter(map(len, names), np.int64, len(names))
        self.name_first = np.cumsum(self.name_count) - self.name_count
        self.rolling = Rolling()
        self.byte_hash = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64)
        self.most_bytes, self.held, self.most_words = most_bytes, 0, most_words
        self.words: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.chunks: dict[bytes, np.ndarray] = {}
        self.joints: dict[tuple[bytes, int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.encoded_chunks = self.reused_chunks = self.repaired_joints = self.grown_joints = 0

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokenizer file has no decoder: tokens are joined by one space. UTF-8."""
        return self.name_bytes[_spread(self.name_first[ids], self.name_count[ids])].tobytes()[:-1]

    def encode_many(self, texts: list[str], at_once: int = 1_000_000) -> Iterator[np.ndarray]:
        """Ids of each whole text; texts are worked off in groups of about ``at_once`` characters."""
        start = 0
        while start < len(texts):
            end, chars = start, 0
            while end < len(texts) and (chars < at_once or end == start):
                chars += len(texts[end])
                end += 1
            yield from self._group(texts[start:end])
            start = end

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_many([text]))

    def cuts(self, raw: bytes) -> list[int]:
        """Where the chunks of a text end: behind whole characters, LEAST_CHUNK to MOST_CHUNK bytes apart."""
        n = len(raw)
        if n <= LEAST_CHUNK:
            return [n] if n else []
        data = np.frombuffer(raw, np.uint8)
        hits = np.flatnonzero((self.rolling.windows(self.rolling.prefix(self.byte_hash[data]), WINDOW) & MASK) == 0) + WINDOW
        out, at = [], 0
        while n - at > LEAST_CHUNK:
            k = int(np.searchsorted(hits, at + LEAST_CHUNK))
            cut = min(int(hits[k]) if k < len(hits) else n, at + MOST_CHUNK, n)
            while cut < n and raw[cut] & 0xC0 == 0x80:
                cut += 1
            out.append(cut)
            at = cut
        if at < n:
            out.append(n)
        return out

    def _insides(self, raws: list[bytes]) -> Iterator[np.ndarray]:
        """The ids of stretches that begin and end with white space."""
        split = [x.split() for x in raws]
        if len(self.words) > self.most_words:
            self.words, self.before = {}, self.words
        new = set()
        for some in split:
            new.update(some)
        new.difference_update(self.words)
        kept = new.intersection(self.before)
        self.words.update(zip(kept, map(self.before.__getitem__, kept)))
        self.words.update(self._each(list(new - kept)))
        for some in split:
            yield np.frombuffer(b"".join(map(self.words.__getitem__, some)), np.uint32)
        for w in new:
            if len(w) > 64:
                del self.words[w]

    def _each(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Words with their ids."""
        found = self.library.encode_batch_fast([w.decode("utf-8") for w in words], add_special_tokens=False)
        return zip(words, [array("I", x.ids).tobytes() for x in found], strict=True)

    def _encode(self, raws: list[bytes]) -> list:
        return self.library.encode_batch([x.decode("utf-8") for x in raws], add_special_tokens=False)

    def _group(self, texts: list[str]) -> list[np.ndarray]:
        if self.held > self.most_bytes:
            self.chunks.clear()
            self.joints.clear()
            self.held = 0
        plans = [self._plan(x.encode("utf-8")) for x in texts]
        fresh = list(dict.fromkeys(x for _, insides, _ in plans for x in insides if x is not None and x not in self.chunks))
        for x, ids in zip(fresh, self._insides(fresh), strict=True):
            self.chunks[x] = ids
            self.held += len(x) + 4 * len(ids) + 200
        self.encoded_chunks += len(fresh)
        self.reused_chunks += sum(x is not None for _, insides, _ in plans for x in insides) - len(fresh)
        parts: list[list] = [[None] * (2 * len(insides) + 1) for _, insides, _ in plans]
        for own, (_, insides, _) in zip(parts, plans, strict=True):
            for k, x in enumerate(insides):
                own[2 * k + 1] = self.chunks[x] if x is not None else None
        todo = [(t, j) for t, (_, _, joints) in enumerate(plans) for j in joints]
        while todo:
            todo = self._repair(plans, parts, todo)
        return [np.concatenate([x for x in own if x is not None]) if any(x is not None for x in own) else np.zeros(0, np.uint32) for own in parts]

    def _plan(self, raw: bytes) -> tuple[bytes, list[bytes | None], list[Joint]]:
        """A text's bytes, the inside of each chunk (None: no white space), and its joints."""
        insides: list[bytes | None] = []
        joints: list[Joint] = []
        begin, left, start = 0, -1, 0
        for cut in self.cuts(raw):
            chunk = raw[begin:cut]
            rest = chunk.lstrip(_BLANKS)
            head = 0 if len(rest) < len(chunk) else len(chunk.split(None, 1)[0])  # bytes before the first white space
            if head == len(chunk):
                insides.append(None)
            else:
                tail = 0 if chunk[-1] in _BLANKS else len(chunk.rsplit(None, 1)[-1])
                insides.append(chunk[head : len(chunk) - tail])
                joints.append(Joint(left, len(insides) - 1, start, begin + head))
                left, start = len(insides) - 1, cut - tail
            begin = cut
        joints.append(Joint(left, -1, start, len(raw)))
        return raw, insides, [j for j in joints if j.end > j.start]

    @staticmethod
    def _reach(inside: bytes, words: int, from_end: bool) -> int:
        """Bytes of the last, or first, so many words of a chunk's inside, with the white space between them and the joint."""
        if from_end:
            some = inside.rsplit(None, words)
            rest = len(some[0].rstrip(_BLANKS)) if len(some) > words else 0
            return len(inside) - (rest + (len(inside[rest:]) - len(inside[rest:].lstrip(_BLANKS))))
        some = inside.split(None, words)
        return len(inside) - len(some[-1]) if len(some) > words else len(inside)

    def _repair(self, plans: list, parts: list, todo: list[tuple[int, Joint]]) -> list[tuple[int, Joint]]:
        """Encode joints with the words beside them; those that do not agree yet come back with more words."""
        keys = []
        for t, j in todo:
            raw, insides, _ = plans[t]
            j.head = self._reach(insides[j.left], j.words, True) if j.left >= 0 else 0
            j.tail = self._reach(insides[j.right], j.words, False) if j.right >= 0 else 0
            keys.append((raw[j.start - j.head : j.end + j.tail], j.head, j.tail))
        fresh = list(dict.fromkeys(k for k in keys if k not in self.joints))
        for (x, head, tail), got in zip(fresh, self._encode([k[0] for k in fresh]), strict=True):
            ids = np.array(got.ids, np.uint32)
            first = last = 0
            if head or tail:
                text_head, text_end = len(x[:head].decode("utf-8")), len(x[: len(x) - tail].decode("utf-8"))
                offsets = np.array(got.offsets, np.int64).reshape(-1, 2)
                first, last = int((offsets[:, 1] <= text_head).sum()) if head else 0, int((offsets[:, 0] >= text_end).sum()) if tail else 0
            self.joints[x, head, tail] = ids[:first], ids[first : len(ids) - last], ids[len(ids) - last :]
            self.held += len(x) + 4 * len(ids) + 400
        again = []
        for (t, j), key in zip(todo, keys, strict=True):
            before, middle, behind = self.joints[key]
            insides = plans[t][1]
            left = self.chunks[insides[j.left]] if j.left >= 0 else before
            right = self.chunks[insides[j.right]] if j.right >= 0 else behind
            if np.array_equal(left[len(left) - len(before) :], before) and np.array_equal(right[: len(behind)], behind):
                self.repaired_joints += 1
                parts[t][2 * (j.right if j.right >= 0 else len(insides))] = middle
            elif j.words <= len(plans[t][0]):
                self.grown_joints += 1
                j.words *= 2
                again.append((t, j))
            else:
                raise ValueError("a chunk's ids are not those of its text")
        return again


_CODECS: dict[str, ChunkCodec] = held_by(__name__)


def _codec(path: str) -> ChunkCodec:
    if path not in _CODECS:
        _CODECS[path] = ChunkCodec(path)
    return _CODECS[path]


def bpe_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text (null: empty)."""
    file = path or tokenizer_path()
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(file)
        for part in parts:
            counts, ids, decoded = [], [], []
            for packed in codec.encode_many([x or "" for x in part.column(1).to_pylist()]):
                counts.append(len(packed))
                ids.append(hashlib.sha256(packed.astype("<u4").tobytes()).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(packed)).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], schema=schema)

    return map_batches(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def bpe_encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int), decoded text."""
    file = path or tokenizer_path()
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(file)
        for part in parts:
            ids, decoded = [], []
            for packed in codec.encode_many([x or "" for x in part.column(1).to_pylist()]):
                ids.append(packed.astype(np.int32))
                decoded.append(codec.decode(packed).decode("utf-8"))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], schema=schema)

    return map_batches(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), run, "doc_id bigint, ids array<int>, decoded string")
