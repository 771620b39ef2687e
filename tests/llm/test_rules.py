import random
import re
from collections import Counter

from kvlake.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    total = sum(map(len, words))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dups = [x for i, x in enumerate(lines) if x in lines[:i]]
    grams = {n: [tuple(words[i : i + n]) for i in range(len(words) - n + 1)] for n in range(2, 11)}
    counts = {n: Counter(g) for n, g in grams.items()}
    repeat = len({j for i, g in enumerate(grams[3]) if counts[3][g] > 1 for j in range(i, i + 3)})
    over = (100 * len(dups) > 30 * len(lines) or 100 * sum(len("".join(WORD.findall(x))) for x in dups) > 20 * total)
    for n in range(2, 5):
        over |= any(100 * c * len("".join(g)) > rules.TOP_LIMITS[n] * total for g, c in counts[n].items() if c > 1)
    for n in range(5, 11):
        seen, covered = set(), set()
        for i, g in enumerate(grams[n]):
            if g in seen:
                covered.update(range(i, i + n))
            seen.add(g)
        over |= 100 * sum(len(words[j]) for j in covered) > rules.COVER_LIMITS[n] * total
    failed = len(words) < 50 or 100 * repeat > 50 * len(words)
    return len(words), total, sum(c in rules.SYMBOLS for c in text), len(dups), repeat, failed, not failed and not over


def texts():
    rng = random.Random(2)
    yield from [None, "", " \n\t", "a", "é#|<\x1c\xa0x y", "w " * 500]
    for k in range(300):
        vocabulary = [chr(97 + rng.randrange(26)) * rng.randrange(1, 4) + ("ü" if k % 3 else "") for _ in range(rng.choice([2, 8, 400]))]
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(200))]
        if k % 4 == 0:
            words += words[: rng.randrange(1, 60)]
        yield "".join(w + rng.choice([" ", " ", "\n", " \n", "\t"]) for w in words)


def thue_morse(n, swap=False):
    return "".join("ab"[(k.bit_count() + swap) % 2] for k in range(n))


def test_words_made_to_collide_are_told_apart():
    for n in (1024, 2048, 4096):
        text = f"{thue_morse(n)} p q {thue_morse(n, True)} p q"
        assert rules.measure(text)[:7] == brute(text) and rules.measure(text)[4] == 0


def test_very_long_text():
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**9)}" for _ in range(400_000)]
    text = " ".join(words) + "\n" + "z" * 3_000_000
    assert rules.measure(text)[:6] == (400_001, sum(map(len, words)) + 3_000_000, 0, 0, 0, False)


def test_measure_equals_brute_force():
    for text in texts():
        assert rules.measure(text)[:7] == brute(text), text


def test_rows_with_nulls_repeats_and_extra_columns(spark):
    rows = [(1, None, 3, "x"), (2, "", 3, None), (None, "a b", 1, "x"), (2, "", 3, None)]
    out = rules.quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, n_words int, kept string")).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.base_failed, r.kept) for r in out) == [(0, 2, True, False), (1, 0, True, False), (2, 0, True, False), (2, 0, True, False)]
    assert rules.quality_rules(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
