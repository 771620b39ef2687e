import random

from kvlake.llm import common


def test_word_hashes_tell_words_apart_and_find_them_as_split_does():
    rng = random.Random(1)
    seen = {}
    texts = [b"", b" ", b"a", b" a\x0b", "é\x1cx\xa0y".encode()]
    texts += [bytes(rng.choice(b"ab \n\t\r\x0b\x0c\x1c\x80") for _ in range(rng.randrange(60))) for _ in range(2000)]
    texts += [b" ".join(bytes(rng.choice(b"abc\x00") for _ in range(rng.randrange(1, 40))) for _ in range(50)) for _ in range(50)]
    for raw in texts:
        hashes, start, end = common.word_hashes(raw)
        words = raw.split()
        assert [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)] == words
        for word, h in zip(words, hashes.tolist(), strict=True):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen) > 2000


def test_long_and_built_words():
    words = ["".join("ab"[(k.bit_count() + swap) % 2] for k in range(n)) for n in (1024, 2048, 4096) for swap in (0, 1)]
    words += ["x" * 3_000_000, "x" * 2_999_999 + "y", "y" + "x" * 2_999_999]
    hashes = common.word_hashes(" ".join(words).encode())[0]
    assert len(set(hashes.tolist())) == len(words)
