import glob
import random

import numpy as np

from kvlake.llm import jaccard
from kvlake.llm.graph import components

DOCS = "doc_id bigint, text string, n bigint, component string"


def brute(rows):
    sets = []
    for i, text, *_ in rows:
        w = (text or "").encode().translate(jaccard._LOWER).split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - min(5, len(w)) + 1)} if w else set())
    up = {r[0]: r[0] for r in rows if r[0] is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            c = len(sets[a] & sets[b])
            if None not in (rows[a][0], rows[b][0]) and c and 100 * c >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(rows[a][0]), find(rows[b][0])))
                up[y] = x
    return sorted(((r[0], len(s), None if r[0] is None else find(r[0])) for r, s in zip(rows, sets, strict=True)), key=str)


def test_equals_brute_force(spark):
    rng = random.Random(12)
    vocabulary = [f"Wö{k}" for k in range(500)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    rows, bases = [], []
    for k in range(220):
        kind = rng.random()
        if kind < 0.45 or not bases:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 4, 5, 8, 30, 120]))]
            if kind < 0.15:
                words += passage.split()
            bases.append(words)
        else:
            words = list(rng.choice(bases))
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                words = words[: max(1, int(len(words) * rng.uniform(0.75, 1)))]
            if rng.random() < 0.3:
                bases.append(words)  # chains
        rows.append((rng.randrange(10**6), (" \n".join(words)).upper() if rng.random() < 0.2 else " ".join(words), k, "x"))
    rows += [(1, None, 0, None), (2, "", 0, None), (3, " \n", 0, None), (None, rows[0][1], 0, None), rows[0], rows[1], (rows[0][0], rows[2][1], 0, "")]
    got = jaccard.similar_components(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    kept = jaccard.keep_representatives(spark.createDataFrame(rows, DOCS))
    assert kept.columns == ["doc_id", "text", "n", "component"]
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in brute(rows)}
    assert jaccard.similar_components(spark.createDataFrame([], DOCS)).count() == 0


def test_hot_tokens_are_parted_without_loss(spark):
    rng = random.Random(21)
    common = " ".join(f"c{k}" for k in range(40))
    rows = [(k, common + " " + " ".join(f"x{rng.randrange(60)}" for _ in range(rng.randrange(4, 14))), k, "x") for k in range(150)]
    got = jaccard.similar_components(spark.createDataFrame(rows, DOCS).repartition(2), split=7).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    token, doc = np.array([5, 5, 5, 5, 9], np.uint64), np.arange(5)
    at, parted = jaccard._parted(token, doc, np.array([40, 40, 40, 40, 3]), 10)
    lists = [set(parted[at == k].tolist()) for k in range(5)]
    assert all(len(x) == 4 for x in lists[:4]) and lists[4] == {9}
    assert all(lists[a] & lists[b] for a in range(4) for b in range(4))


def thue_morse(n, swap=False):
    return "".join("ab"[(k.bit_count() + swap) % 2] for k in range(n))


def test_words_made_to_collide_are_told_apart():
    for n in (1024, 2048, 4096):
        a, b = (set(jaccard.shingles(f"{thue_morse(n, x)} one two three four five").tolist()) for x in (False, True))
        assert len(a) == len(b) == 2 and len(a & b) == 1


def test_very_long_texts_and_similarities_at_the_limit(spark):
    words = [f"w{k}" for k in range(300_000)]
    near = [*words[:200_000], "other", *words[200_000:]]
    at_limit = [f"q{k}" for k in range(36)]  # 32 shingles; 4 more words on both sides of an equal stretch make 80 in a hundred
    rows = [(1, " ".join(words), 0, ""), (2, " ".join(near), 0, ""), (3, " ".join(at_limit), 0, ""), (4, " ".join([*at_limit, *[f"r{k}" for k in range(8)]]), 0, ""), (5, " ".join([*at_limit, *[f"s{k}" for k in range(9)]]), 0, "")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_components(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: (299_996, 1), 2: (299_997, 1), 3: (32, 3), 4: (40, 3), 5: (41, 5)}


def test_list_pairs_lose_nothing():
    rng = np.random.default_rng(5)
    for _ in range(30):
        m = int(rng.integers(2, 300))
        size = np.sort(rng.integers(5, 60, m))
        at, label, doc = rng.integers(0, 5, m), rng.integers(0, 4, m), np.arange(m)
        got = {tuple(p) for pairs in jaccard._list_pairs(doc, label, size, at) for p in pairs.T.tolist()}
        want = {(x, y) for x in range(m) for y in range(x + 1, m) if label[x] != label[y] and 80 * size[y] <= 100 * size[x] and min(size[x] - at[x], size[y] - at[y]) >= -(-80 * int(size[x] + size[y]) // 180)}
        assert got == want


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 300)] + [(5, 7), (9, 9), (300, 299)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert all(got[k] == 100 for k in range(100, 161)) and all(got[k] == 5 for k in [5, 7, *range(200, 301)]) and 9 not in got
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_few_links_and_many_give_the_same_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(k + 1, k) for k in range(1000, 1040)] + [(None, 3), (2**62, 1)]
    table = spark.createDataFrame(links, "u bigint, v bigint")
    one = sorted(map(tuple, components(table).collect()))
    assert one == sorted(map(tuple, components(table, few=0).collect())) and one


def test_small_tables_are_not_written_bucket_by_bucket(spark):
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    folders = lambda kind: set(glob.glob(f"{base}/kvlake-{kind}-*"))
    words = [f"w{k}" for k in range(40)]
    rows = [(k, " ".join([*words[: k % 3], f"x{k % 200}", *words]), 0, "") for k in range(3000)]
    jaccard_before, links_before = folders("jaccard"), folders("links")
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = jaccard.similar_components(spark.createDataFrame(rows, DOCS)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert len(got) == 3000 and {r.component_id for r in got} == {0}
    assert not folders("links") - links_before
    (work,) = folders("jaccard") - jaccard_before
    assert 1 <= len(glob.glob(f"{work}/members/part-*")) <= 8
