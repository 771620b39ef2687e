import hashlib
import random

from kvlake.llm import substrings

DOCS = "doc_id bigint, text string, bucket string, kept string"


def brute(rows):
    last = max((r[0] for r in rows if r[0] is not None), default=0) + 1
    docs = [(last if r[0] is None else r[0], (r[1] or "").encode().split()) for r in rows]  # null ids: at most one has windows of its own
    first = {}
    for i, words in docs:
        for a in range(len(words) - 19):
            g = tuple(words[a : a + 20])
            first[g] = min(first.get(g, (i, a)), (i, a))
    out = []
    for (i, words), row in zip(docs, rows, strict=True):
        gone = {k for a in range(len(words) - 19) if first[tuple(words[a : a + 20])] < (i, a) for k in range(a, a + 20)}
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((row[0], len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, "b", None) for r in rows], DOCS).repartition(3)
    got = substrings.remove_repeats(df, **options).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=str) == brute(rows)


def test_equals_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{k}é" for k in range(3000)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.choice([19, 20, 21, 33, 60, 200]))] for _ in range(12)]
    rows = []
    for k in range(160):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            p = rng.choice(passages)
            cut = rng.randrange(len(p) // 3 + 1)
            words[at:at] = p[cut:]
        rows.append((k * 37 - 500, "".join(w + rng.choice([" ", "\n", "\t\x0b "]) for w in words)))
    rows += [(10_000 + k, rows[5][1]) for k in range(60)]  # copies
    rows += [(20_000 + k, "a b " * 40) for k in range(30)]  # windows that overlap their own copies
    rows += [(7, None), (8, ""), (9, " \n"), (None, rows[5][1]), (None, "x y z"), (20_000, "a b " * 40), (20_000, "c d " * 30)]
    check(spark, rows)
    check(spark, rows[:60], unit_chars=400)


def test_one_long_text_and_empty_table(spark):
    rng = random.Random(9)
    words = [f"q{rng.randrange(50_000)}" for _ in range(80_000)]
    check(spark, [(1, " ".join(words + words[1000:70_500])), (2, " ".join(words[500:600]))])
    assert substrings.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_cover_meets_every_difference():
    pairs = {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER}
    assert pairs == set(range(substrings.PERIOD))


def test_kept_text(spark):
    text = " ".join(f"t{k}" for k in range(30))
    got = {r.doc_id: r.kept for r in substrings.remove_repeats(spark.createDataFrame([(1, text, "", ""), (2, f"x  {text}\ny", "", "")], DOCS), with_text=True).collect()}
    assert got == {1: text, 2: "x y"}
