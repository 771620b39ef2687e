import itertools
import zlib

import numpy as np

from kvlake.llm import quality


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    lines = np.array([3, 0, 1, 4])
    e, a = rng.standard_normal((8, 2)), rng.standard_normal((2, 2))
    p, pairs, z = quality.Chains(lines).marginals(e, a, pairs=True)
    want, want_pairs, want_z, at = np.zeros((8, 2)), np.zeros((2, 2)), 0.0, 0
    for n in lines:
        if not n:
            continue
        weights = {}
        for y in itertools.product((0, 1), repeat=int(n)):
            weights[y] = np.exp(sum(e[at + k, y[k]] for k in range(n)) + sum(a[y[k - 1], y[k]] for k in range(1, n)))
        total = sum(weights.values())
        want_z += np.log(total)
        for y, w in weights.items():
            for k in range(n):
                want[at + k, y[k]] += w / total
                if k:
                    want_pairs[y[k - 1], y[k]] += w / total
        at += n
    np.testing.assert_allclose(p, want)
    np.testing.assert_allclose(pairs, want_pairs)
    np.testing.assert_allclose(z, want_z)


def test_features_do_not_depend_on_the_batch():
    texts = ["AB cd!\nAB cd!\n\n x | y 12", "", "é ü\n \nonly", "AB cd!", "\n", "$$$ %%"]
    bins, chars, lines = quality.line_features(texts)
    assert lines.tolist() == [3, 0, 2, 1, 0, 1]
    assert bins[1, -1] == 1 and bins[0, -1] == 0 and bins[5, -1] == 0
    assert chars.tolist() == [5, 5, 5, 2, 4, 5, 5]
    at = 0
    for text, n in zip(texts, lines, strict=True):
        alone = quality.line_features([text])
        np.testing.assert_array_equal(alone[0], bins[at : at + n])
        at += n


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    assert len(out) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [i for i in truth if i in out and zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i].held_out for i in held)
    assert np.mean([out[i].predicted == truth[i] for i in held]) > 0.95
    assert np.mean([out[i].predicted for i in held if truth[i] == 1]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out.values())
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in out.values())


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", None), (None, "some words here", None), (4, "fine text", "x"), (4, "fine text", "x"), (5, "\n \n", "")], "doc_id bigint, text string, score string")
    none = spark.createDataFrame([], "doc_id bigint, quality int, text string")
    got = sorted((str(r.doc_id), r.score, r.predicted) for r in quality.score_quality(docs, none).collect())
    assert got == [("1", 0.0, 0), ("2", 0.0, 0), ("4", 0.5, 1), ("4", 0.5, 1), ("5", 0.0, 0), ("None", 0.5, 1)]
    odd = spark.createDataFrame([(4, 1, ""), (4, 0, ""), (None, 1, ""), (6, None, ""), (7, 3, "")], "doc_id bigint, quality int, text string")
    assert quality.score_quality(docs, odd).count() == 6
    assert quality.score_quality(docs.limit(0), odd).count() == 0


def fitted(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    return quality.fit_quality(docs, labels)


def test_documents_are_length_weighted_means_of_their_lines(spark):
    model = fitted(spark)
    texts = ["A line of words.\n!!! BUY NOW !!! $$$\nAnother line, of more words than before.", "one line", "", "x\n" * 50]
    got = model.scores(texts)
    for text, score in zip(texts, got, strict=True):
        bins, chars, lines = quality.line_features([text])
        if not len(bins):
            assert score == 0
            continue
        p = model.crf.good(bins, lines)
        mean = sum(a * b for a, b in zip(p, chars, strict=True)) / sum(chars)
        odds = np.log((mean + 1e-4) / (1 - mean + 1e-4))
        assert abs(score - 1 / (1 + np.exp(-(model.slope * odds + model.shift)))) < 1e-9
    assert np.allclose(model.scores(texts, at_once=5), got)


def test_the_shift_puts_the_best_split_at_the_limit():
    rng = np.random.default_rng(2)
    model = quality.QualityModel(np.zeros((0, len(quality.EDGES)), np.uint8), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
    x = np.concatenate([rng.normal(-2, 1, 300), rng.normal(2, 1, 300)])
    labels = np.repeat([0, 1], 300)
    model._calibrate(x, labels)
    split = (np.log(quality.LIMIT / (1 - quality.LIMIT)) - model.shift) / model.slope
    cost = lambda at: 2 * (x[labels == 1] < at).mean() + (x[labels == 0] >= at).mean()
    assert model.slope > 0 and cost(split) <= min(cost(at) for at in x) + 1e-9


def test_very_long_text_and_ties(spark):
    model = fitted(spark)
    line = "A plain line of words that is neither long nor short."
    long = model.scores([(line + "\n") * 60_000, "word " * 400_000])
    assert len(long) == 2 and (0 <= long).all() and (long <= 1).all()
    assert len(set(model.scores([line] * 7).tolist())) == 1
