import random

import numpy as np

from kvlake.llm import decontam

rng = random.Random(6)
VOCABULARY = [f"w{k}" for k in range(400)]
ITEMS = [(k, " ".join(rng.choice(VOCABULARY) for _ in range(rng.choice([5, 7, 12, 20, 33, 60, 150, 300])))) for k in range(60)]


def brute_distance(item, text):
    row = [0] * (len(text) + 1)
    for k, a in enumerate(item, 1):
        new = [k]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def edited(words, edits):
    words = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(words)), rng.randrange(3)
        if kind == 0:
            words[at] = "other"
        elif kind == 1:
            words.insert(at, rng.choice(VOCABULARY))
        elif len(words) > 1:
            del words[at]
    return words


def test_distance_equals_brute_force():
    for _ in range(200):
        a, b = (np.array([rng.randrange(4) for _ in range(rng.randrange(1, 12))]) for _ in range(2))
        assert decontam.distance(a, b)[0] == brute_distance(a.tolist(), b.tolist())


def cases():
    texts, want = [], set()
    for k, item in ITEMS:
        words = item.split()
        for share in (0, 0.1, 0.2):
            leak = edited(words, int(share * len(words)))
            around = [rng.choice(VOCABULARY) for _ in range(rng.randrange(60))]
            texts.append(" ".join(around[:20] + [w.upper() + rng.choice(["", ",", "!"]) for w in leak] + around[20:]))
    split = [[w.decode() for w in decontam.words_of(t)] for t in texts]
    for t, words in enumerate(split):
        for k, item in ITEMS:
            own = item.split()
            if len(set(own) & set(words)) * 2 >= len(set(own)) and brute_distance(own, words) <= int(0.2 * len(own) + 1e-9):
                want.add((t, k))
    return texts, split, want


def test_hits_are_exact_and_recall_is_met():
    index = decontam.Index(ITEMS, 0.2, 0.99)
    texts, split, want = cases()
    hits = index.search(texts)
    got = {(t, k) for t, k, *_ in hits}
    assert got <= want and len(got) >= 0.98 * len(want)
    for t, k, d, a, b in hits:
        assert d == brute_distance(ITEMS[k][1].split(), split[t]) == brute_distance(ITEMS[k][1].split(), split[t][a:b])
    assert all(r > 0.985 for r in index.recall.values()) and any(index.repeats.values())


def test_classes_below_the_target_are_searched_without_loss(monkeypatch):
    monkeypatch.setattr(decontam, "SAMPLES", ())
    monkeypatch.setattr(decontam, "ITEMS_AT_ONCE", 7)
    index = decontam.Index(ITEMS, 0.2, 0.99)
    assert not index.tables and len(index.by_pairs) >= 8
    texts, _, want = cases()
    assert {(t, k) for t, k, *_ in index.search(texts)} == want


def test_short_items_are_found_as_word_sequences():
    items = [(1, "Alpha"), (2, "beta gamma"), (3, "one two, three"), (4, "one two three four"), (5, "!?"), (6, "日本語のテキスト")]
    texts = ["say: ALPHA.", "alphabet beta", "gamma beta gamma", "beta delta gamma", "one two three", "x one two three four", "日本語のテキスト", "", None, "one two four three"]
    index = decontam.Index(items, 0.2, 0.99)
    got = {(t, index.ids[k]) for t, k, *_ in index.search(texts)}
    assert got == {(0, 1), (2, 2), (4, 3), (5, 3), (5, 4), (6, 6)}


def test_very_long_text():
    words = " ".join(rng.choice(VOCABULARY) for _ in range(300_000))
    index = decontam.Index(ITEMS, 0.2, 0.99)
    assert (0, 11, 0) in {(t, k, d) for t, k, d, *_ in index.search([f"{words} {ITEMS[11][1]} {words}"])}


def test_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "said: " + ITEMS[5][1] + " and so on", None), (3, "said: " + ITEMS[5][1] + " and so on", None), (None, ITEMS[7][1], ""), (4, "clean words only", ""), (5, "way Too, short!", "")], "doc_id bigint, text string, item_id string")
    bench = spark.createDataFrame([(*i, 0) for i in ITEMS] + [(900, None, 0), (901, "too short", 0), (None, ITEMS[7][1], 1), (902, "", 1)], "item_id bigint, text string, distance int")
    got = sorted((str(r.doc_id), str(r.item_id), r.distance) for r in decontam.find_leaks(docs, bench).collect())
    assert got == [("3", "5", 0), ("3", "5", 0), ("5", "901", 0), ("None", "7", 0), ("None", "None", 0)]
    kept = decontam.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]
    assert decontam.find_leaks(docs, bench.limit(0)).count() == 0 and decontam.find_leaks(docs.limit(0), bench).count() == 0
    assert decontam.drop_leaks(docs, bench.limit(0)).count() == 7
