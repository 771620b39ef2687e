import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from kvlake.llm import langid


def brute_nats(samples, word):
    """Interpolated Kneser-Ney by plain dictionaries, for one language."""
    times, follow, distinct = [Counter() for _ in range(6)], [Counter() for _ in range(6)], {}
    for w, k in samples.items():
        s = "\x01" + w + "\x01"
        for at in range(1, len(s)):
            for n in range(1, langid.ORDER + 1):
                if at - n + 1 >= 0:
                    times[n][s[at - n + 1 : at + 1]] += k
    counts = {langid.ORDER: dict(times[langid.ORDER])}
    for n in range(1, langid.ORDER):
        c = defaultdict(float)
        for g in times[n + 1]:
            c[g[1:]] += 1
        for g, k in times[n].items():
            if g[0] == "\x01" and len(g) == n and n > 1:
                c[g] += k
        counts[n] = dict(c)
    out = 0.0
    s = "\x01" + word + "\x01"
    for at in range(1, len(s)):
        p = 1 / 400
        for n in range(1, min(langid.ORDER, at + 1) + 1):
            g, ctx = s[at - n + 1 : at + 1], s[at - n + 1 : at]
            same = {x: c for x, c in counts[n].items() if x[:-1] == ctx}
            n1, n2 = max(1, sum(c == 1 for c in counts[n].values())), sum(c == 2 for c in counts[n].values())
            d = n1 / (n1 + 2 * n2) if n2 else 0.5
            if same:
                total = sum(same.values())
                p = max(0.0, counts[n].get(g, 0) - min(d, counts[n].get(g, 0))) / total + min(1.0, d * len(same) / total) * p
        out -= math.log(p)
    return out


def test_entropies_equal_plain_dictionaries():
    rng = random.Random(1)
    samples = {lang: Counter("".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(60)) for lang, letters in (("aa", "abc"), ("bb", "bcdé"))}
    model = langid.KneserNey({k: dict(v) for k, v in samples.items()})
    words = ["a", "abc", "bcd", "éé", "zz", "abcabcabc", *list(samples["aa"])[:10]]
    got = model.entropies(words)
    for k, lang in enumerate(model.langs):
        np.testing.assert_allclose(got[:, k], [brute_nats(samples[lang], w) for w in words], rtol=2e-4)
    np.testing.assert_allclose(got, model.entropies(words, at_once=3), rtol=1e-6)


def test_long_words_are_scored_whole(monkeypatch):
    rng = random.Random(2)
    samples = {lang: Counter("".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(60)) for lang, letters in (("aa", "abc"), ("bb", "bcdé"))}
    model = langid.KneserNey({k: dict(v) for k, v in samples.items()})
    words = ["".join(rng.choice("abcdé") for _ in range(n)) for n in (1, 6, 7, 8, 11, 14, 15, 60, 260)]
    want = np.array([[brute_nats(samples[lang], w) for lang in model.langs] for w in words])
    text = "abc" * 67 + "bcdé" * 400
    sums, sizes = model.score_texts([text, " ".join(words)], langid.WordRows())
    assert sizes.tolist() == [len(text) + 1, sum(len(w) + 1 for w in words)]
    assert sums[0].argmin() == model.langs.index("bb")
    np.testing.assert_allclose(sums[1] * sizes[1], want.sum(axis=0), rtol=2e-4)
    whole = model.entropies([text])
    monkeypatch.setattr(langid, "PIECE", 7)
    np.testing.assert_allclose(model.entropies([text]), whole, rtol=1e-4)
    np.testing.assert_allclose(model.entropies(words), want, rtol=2e-4)
    np.testing.assert_allclose(model.entropies(words, at_once=3), want, rtol=2e-4)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = {r.doc_id: r for r in langid.identify_languages(docs).collect()}
    rows = docs.collect()
    assert len(out) == len(rows)
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(out[r.doc_id].held_out for r in held) and sum(o.held_out for o in out.values()) == len(held)
    assert np.mean([out[r.doc_id].lang_pred == r.lang for r in held]) > 0.97
    assert np.mean([out[r.doc_id].accepted for r in held]) > 0.95
    assert all(0 <= o.score <= 1 for o in out.values())


def test_defined_cases(spark):
    names = "doc_id bigint, text string, lang string, score double, unit string"
    rows = [(k, ["the cat and the hat", "der hund und die katze"][k % 2], ["en", "de"][k % 2], 0.0, "u") for k in range(100, 160)]
    rows += [(1, None, "en", None, None), (2, "", "en", None, None), (3, "12 ²½ !", None, None, None), (None, "the hat", None, None, None), (4, "the cat", None, None, None), (4, "the cat", None, None, None), (5, "日本", None, None, None)]
    got = sorted((str(r.doc_id), r.lang_pred) for r in langid.identify_languages(spark.createDataFrame(rows, names)).collect() if r.doc_id is None or r.doc_id < 10)
    assert got[:5] == [("1", "und"), ("2", "und"), ("3", "und"), ("4", "en"), ("4", "en")]
    assert got[6] == ("None", "en") and got[5][1] in ("en", "de")
    assert {r.lang_pred for r in langid.identify_languages(spark.createDataFrame(rows[60:65], names).selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}
    assert langid.identify_languages(spark.createDataFrame([], names)).count() == 0


def test_many_languages_are_told_apart():
    rng = random.Random(5)
    letters = [chr(c) for c in [*range(97, 123), *range(0xE0, 0xF6), *range(0x3B1, 0x3C9), *range(0x430, 0x450)]]
    rows, tests = [], []
    for k in range(60):
        own = rng.sample(letters, 9)
        text = lambda own=own: " ".join("".join(rng.choice(own) for _ in range(rng.randrange(2, 8))) for _ in range(80))
        rows += [(f"l{k:02d}", text()) for _ in range(10)]
        tests.append((f"l{k:02d}", text()))
    model = langid.Identifier(rows)
    names, scores, _ = model.predict([t for _, t in tests], langid.WordRows(60))
    assert np.mean([a == b for (a, _), b in zip(tests, names, strict=True)]) > 0.97 and all(0 <= x <= 1 for x in scores)


def test_values_by_language_equal_a_dictionary():
    rng = np.random.default_rng(6)
    store = {k: (np.unique(rng.integers(1, 300, 80).astype(np.uint64) << np.uint64(54)), None) for k in range(7)}
    store = {k: (keys, rng.random(len(keys)).astype(np.float32)) for k, (keys, _) in store.items()}
    values = langid.Values(store, 7, 1.0)
    plain = {(int(h), k): float(v) for k, (keys, vs) in store.items() for h, v in zip(keys, vs, strict=True)}
    wanted = rng.integers(1, 300, 500).astype(np.uint64) << np.uint64(54)
    np.testing.assert_array_equal(values.of(wanted), np.array([[plain.get((int(h), k), 1.0) for k in range(7)] for h in wanted], np.float32))
    assert langid.Values({}, 3, 0.0).of(wanted).shape == (500, 3)


def test_very_long_text(spark):
    docs = [(k, ["the cat and the hat", "der hund und die katze"][k % 2], ["en", "de"][k % 2]) for k in range(100, 160)]
    docs.append((1, "die katze und der hund " * 200_000 + "the", None))
    out = langid.identify_languages(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"))
    assert {r.lang_pred for r in out.where("doc_id = 1").collect()} == {"de"}


@pytest.mark.parametrize("text", ["\x01", "a\ud800b", "İ" * 300])
def test_odd_letters(text):
    langid.Identifier([("en", "the cat"), ("de", "der hund")]).predict([text], langid.WordRows())
