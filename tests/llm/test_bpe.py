import hashlib
import random

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from kvlake.llm import bpe
from kvlake.llm.common import let_go, map_batches

DOCS = "doc_id bigint, text string, ids_sha256 string, n_tokens int"


def expected(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_random_texts_equal_the_library():
    codec, library = bpe.ChunkCodec(bpe.tokenizer_path()), Tokenizer.from_file(bpe.tokenizer_path())
    rng = random.Random(3)
    letters = "aB é'sSΣİǅ̈́ªº²½\t\n ​\x85\x1c_-日ß"
    texts = []
    for k in range(400):
        text = "".join(rng.choice(letters if k % 2 else "aBt é'\x00¡#$") for _ in range(rng.randrange(300)))
        texts.append(text + "<|endoftext|>it's they'LL" if k % 5 == 0 else text)
    for text, ids in zip(texts, codec.encode_many(texts), strict=True):
        want, shown = expected(library, text)
        assert ids.tolist() == want
        assert codec.decode(ids).decode() == shown


def test_capitals_whose_lower_case_lies_beyond_the_pattern():
    codec, library = bpe.ChunkCodec(bpe.tokenizer_path()), Tokenizer.from_file(bpe.tokenizer_path())
    capitals = [chr(c) for c in range(0x250) if max(map(ord, chr(c).lower())) >= 0x250]
    assert len(capitals) >= 23
    texts = [text for c in capitals for text in (c, f"{c}li", f"a{c}b x{c} {c}", f"plain words, then B{c}{c}C")]
    for text, ids in zip(texts, codec.encode_many(texts), strict=True):
        assert ids.tolist() == expected(library, text)[0], text


def test_scripts_quotes_and_emoji_take_the_same_way():
    rng = random.Random(9)
    codec, library = bpe.ChunkCodec(bpe.tokenizer_path()), Tokenizer.from_file(bpe.tokenizer_path())
    words = ["“curly”", "it’s", "naïve—dash", "日本語のテキスト。", "Привет", "👩\u200d👩\u200d👧 🎉", "ﬁx", "e\u0301a", "क्षि", "\u2000x\u3000y", "가나", "ΣΑΣ", "plain", "O'Neil's", "x" * 40, "<|endoftext|>", "a<|startoftext|>b", "\u0301"]
    passage = " ".join(rng.choice(words) for _ in range(3000))
    texts = [f"{k} {passage}" for k in range(4)] + ["".join(rng.choice(words) for _ in range(4000)), "日" * 30_000, " " * 5000 + "é" * 700]
    for text, ids in zip(texts, codec.encode_many(texts, at_once=40_000), strict=True):
        assert ids.tolist() == expected(library, text)[0]
    assert codec.reused_chunks > 30


def test_chunks_are_reused_and_joints_repaired():
    rng = random.Random(5)
    passage = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 12))) for _ in range(4000))
    texts = [f"{rng.random()} head{k} {passage}{k} tail" for k in range(6)] + ["x" * 50_000, ""]
    codec, library = bpe.ChunkCodec(bpe.tokenizer_path()), Tokenizer.from_file(bpe.tokenizer_path())
    for text, ids in zip(texts, codec.encode_many(texts, at_once=25_000), strict=True):
        assert ids.tolist() == expected(library, text)[0]
    assert codec.reused_chunks > 2 * codec.encoded_chunks and codec.repaired_joints > 100


def test_cuts_follow_the_content():
    rng = random.Random(6)
    passage = " ".join("".join(rng.choice("abcdé") for _ in range(rng.randrange(2, 12))) for _ in range(5000)).encode()
    codec = bpe.ChunkCodec(bpe.tokenizer_path())
    for raw in (passage, b"some words before " + passage, "é".encode() * 100_000, b"x", b""):
        ends = codec.cuts(raw)
        assert ends == sorted(set(ends)) and (ends[-1:] == [len(raw)] or not raw)
        assert all(b - a <= bpe.MOST_CHUNK + 3 for a, b in zip([0, *ends], ends, strict=False))
        assert "".join(raw[a:b].decode() for a, b in zip([0, *ends], ends, strict=False)) == raw.decode()
    chunks = lambda raw: {raw[a:b] for a, b in zip([0, *codec.cuts(raw)], codec.cuts(raw), strict=False)}
    assert len(chunks(passage) & chunks(b"other beginning, " + passage)) > 0.9 * len(chunks(passage))


def test_a_wrong_join_is_seen_and_grown():
    codec, library = bpe.ChunkCodec(bpe.tokenizer_path()), Tokenizer.from_file(bpe.tokenizer_path())
    text = " ".join(f"word{k} number{k * k}" for k in range(400))
    codec.encode(text)
    real = dict(codec.joints)
    for x, head, tail in list(codec.joints):
        before, middle, behind = codec.joints[x, head, tail]
        codec.joints[x, head, tail] = before + 1, middle, behind
    assert codec.encode(text).tolist() == expected(library, text)[0] and codec.grown_joints > 0 and len(codec.joints) > len(real)


def thue_morse(n, swap=False):
    return "".join("ab"[(k.bit_count() + swap) % 2] for k in range(n))


def test_strings_made_to_collide_are_told_apart():
    codec, library = bpe.ChunkCodec(bpe.tokenizer_path()), Tokenizer.from_file(bpe.tokenizer_path())
    for n in (1024, 2048, 4096):
        texts = [f"x {thue_morse(n)} y", f"x {thue_morse(n, True)} y"]
        for text, ids in zip(texts, codec.encode_many(texts), strict=True):
            assert ids.tolist() == expected(library, text)[0]


def test_caches_are_bounded():
    codec, library = bpe.ChunkCodec(bpe.tokenizer_path(), most_bytes=3000), Tokenizer.from_file(bpe.tokenizer_path())
    for k in range(20):
        text = " ".join(f"word{k}x{i}" for i in range(400))
        assert codec.encode(text).tolist() == expected(library, text)[0]
        assert codec.held < 60_000


def test_query_with_nulls_repeats_and_extra_columns(spark):
    rows = [(1, None, "en", 7), (2, "", "en", 7), (3, "Hello, the world's end", None, 7), (3, "Hello, the world's end", None, 7), (None, "x y", None, None)]
    out = {(r.doc_id, r.ids_sha256): r for r in bpe.bpe_digests(spark.createDataFrame(rows, DOCS)).collect()}
    library = Tokenizer.from_file(bpe.tokenizer_path())
    assert len(out) == 4
    for doc_id, text, *_ in rows:
        ids, shown = expected(library, text or "")
        got = out[doc_id, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()]
        assert got.n_tokens == len(ids)
        assert got.decoded_sha256 == hashlib.sha256(shown.encode()).hexdigest()
    assert bpe.bpe_digests(spark.createDataFrame([], DOCS)).count() == 0
    assert bpe.bpe_encode(spark.createDataFrame(rows, DOCS)).count() == 5


def test_workers_let_go_of_the_codec_for_other_operators(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(64)], "doc_id bigint, text string").repartition(8)

    def held(parts):
        for part in parts:
            yield pa.RecordBatch.from_arrays([pa.array([len(bpe._CODECS)] * part.num_rows, pa.int32())], names=["n"])

    assert bpe.bpe_digests(docs).count() == 64
    assert {r.n for r in map_batches(docs, held, "n int").collect()} == {0}
    bpe._codec(bpe.tokenizer_path())
    let_go("kvlake.llm.bpe")
    assert bpe._CODECS
    let_go("kvlake.llm.jaccard")
    assert not bpe._CODECS
