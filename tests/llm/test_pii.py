import itertools
import random
import re

import numpy as np
import pytest

from kvlake.llm import pii

# The contract's patterns as they stand.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0


def brute(text):
    only = lambda s: re.sub("[^0-9]", "", s)
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(only(m[0])) <= 19 and luhn(only(m[0]))]
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(only(m[0])) <= 15]


def test_base_spans_equal_the_patterns():
    rng = random.Random(4)
    pieces = ["a", "é", "@", ".", "-", " ", "+", "1", "25", "255", "256", "0007", "(", ")", "4111111111111111", "@x.com", "a.b@c.d", "\n", "\t", "1.2.3.4", "+1 (555) 123-4567", "٣"]
    for _ in range(6000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(25)))
        assert pii.base_spans(text) == brute(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 4000, "1." * 100_000, "+1" + " " * 200_000, "a@" * 100_000, "1 " * 100_000):
        pii.base_spans(text)


def test_gradients_equal_differences():
    tagger = pii.Tagger(3, 4)
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    ids, tags = pii.labelled_windows(2)
    _, grads = tagger.gradients(ids, tags)
    for name, g in grads.items():
        at = np.unravel_index(np.argmax(abs(g)), g.shape)
        kept = tagger.p[name][at]
        tagger.p[name][at] = kept + 1e-3
        up = tagger.gradients(ids, tags)[0]
        tagger.p[name][at] = kept - 1e-3
        down = tagger.gradients(ids, tags)[0]
        tagger.p[name][at] = kept
        assert abs((up - down) / 2e-3 - g[at]) < 1e-2 * abs(g[at]) + 1e-3, name


@pytest.fixture(scope="module")
def tagger():
    return pii.trained()


def test_method_finds_what_the_patterns_lose_and_leaves_clean_text_alone(tagger):
    found = lambda x: [(pii.KINDS[k], x[a:b]) for k, a, b in pii.tagger_spans(tagger, [x], [pii.base_spans(x)])[0]]
    text = "edathe stther +1 (269) 555-3296 4524132264652876 and onrend of"
    assert pii.base_spans(text) == []
    assert found(text) == [("phone", "+1 (269) 555-3296"), ("card", "4524132264652876")]
    for clean in ("no data here at all", "password=b7db7aa4a5fcc78305 then", "4785380592391131 fails the checksum", "in 1999 and 2024-01-05 at 10:30 for $12.50", "", "@"):
        assert pii.base_spans(clean) == [] and found(clean) == []


def test_regions_hold_whole_spans_of_every_shape():
    rng = random.Random(6)
    part = lambda chars, most: "".join(rng.choice(chars) for _ in range(rng.randrange(1, most)))
    local, label = "abcXYZ0189._%+-", "abcXYZ019-"
    for _ in range(3000):
        gap = lambda: " " * rng.choice((1, 1, 1, 60)) + rng.choice(("", "(", "-", ". "))
        email = part(local, 60) + rng.choice(("@", " @ ", "@ ", " @")) + ".".join(part(label, 30) for _ in range(rng.randrange(1, 5))) + "." + part("abcXYZ", 40) + "xy"
        phone = "+1" + "".join(gap() + part("0123456789", 3) for _ in range(20))[:90] + "5"
        digits = re.sub("[^0-9]", "", phone)
        span = email if rng.random() < 0.7 or not 10 <= len(digits) <= 15 else phone
        assert pii._shaped(0 if span is email else 3, span), span
        before, after = part("ab 1@.é\n", 60) + rng.choice(("\n", "é ", ", ")), rng.choice(("\n", " é", "", ", ")) + part("ab 1@.é\n", 60)
        text = before + span + after
        regions = pii.regions(text)
        assert any(a <= len(before) and len(before) + len(span) <= b for a, b in regions), text
        assert all(b < c for (_, b), (c, _) in zip(regions, regions[1:], strict=False)), text


def test_long_spaced_addresses_are_found_and_masked_whole(tagger):
    cases = {
        "see mary.smith @ students.university.edu or": "see <EMAIL> or",
        "please ask bartholomew.featherstone @ example.com about it": "please ask <EMAIL> about it",
        "mail mary.smith@ abcdefgh-x.example.com now": "mail <EMAIL> now",
    }
    for text, want in cases.items():
        base = pii.base_spans(text)
        more = pii.tagger_spans(tagger, [text], [base])[0]
        assert pii.mask(text, base + more) == want


def test_regions_take_linear_time():
    for text in ("a" * 300_000 + "@", "a@" * 100_000, "1 " * 100_000, "@ " + "a" * 300_000, "1" + " " * 300_000 + "1", "a.@ " * 100_000, "1" + "-" * 50 + "a" * 100_000 + "@"):
        pii.regions(text)


def test_overlapping_windows_are_one_labelling(tagger):
    text = "word " * 10 + " ".join("+1 (269) 555-3296 4524132264652876 thshe" for _ in range(40))
    got = pii.tagger_spans(tagger, [text], [pii.base_spans(text)])[0]
    assert sum(k == 3 for k, *_ in got) >= 36 and sum(k == 2 for k, *_ in got) >= 36
    assert all(a[2] <= b[1] for a, b in zip(sorted(got, key=lambda s: s[1]), sorted(got, key=lambda s: s[1])[1:], strict=False))


def test_viterbi_equals_enumeration_in_any_parts(tagger):
    rng = np.random.default_rng(3)
    a = (tagger.p["A"] + tagger.allowed).astype(np.float64)
    for _ in range(20):
        e = rng.normal(0, 3, (5, pii.TAGS)).astype(np.float32)
        score = lambda path, e=e: (-1e4 if path[0] % 2 == 0 and path[0] else 0) + sum(float(e[t, x]) for t, x in enumerate(path)) + sum(a[x, y] for x, y in itertools.pairwise(path))
        best = max(itertools.product(range(pii.TAGS), repeat=4), key=lambda p: score((*p, 0)) if e[4].argmax() == 0 else max(score((*p, x)) for x in range(pii.TAGS)))
        want = max(((*best, x) for x in range(pii.TAGS)), key=score)
        got = tagger.viterbi([e])
        assert score(tuple(got)) >= score(want) - 1e-6
        assert all(np.array_equal(got, tagger.viterbi([e[:k], e[k:]])) for k in range(6))
    e = rng.normal(0, 2, (4000, pii.TAGS)).astype(np.float32)
    assert np.array_equal(tagger.viterbi([e]), tagger.viterbi(np.array_split(e, 37)))


def test_emissions_are_weighted_means_of_the_windows(tagger, monkeypatch):
    text = "x " * 7 + " ".join("+1 (269) 555-3296 4524132264652876 thshe" for _ in range(9))
    n = len(text)
    total, weights = np.zeros((n, pii.TAGS)), np.zeros(n)
    ids = np.concatenate([pii.symbols(text), np.full(pii.WINDOW, pii.PAD)])
    for s in range(0, max(1, n - pii.WINDOW + pii.STRIDE), pii.STRIDE):
        e = tagger.emissions(ids[None, s : s + pii.WINDOW])
        for t in range(min(pii.WINDOW, n - s)):
            w = 1 + min(t, pii.WINDOW - 1 - t)
            total[s + t] += w * e[t, 0]
            weights[s + t] += w
    for stretch in (32, 64, 96, 16_384):
        monkeypatch.setattr(pii, "STRETCH", stretch)
        got = np.concatenate(list(pii.region_emissions(tagger, text, 0, n)))
        np.testing.assert_allclose(got, total / weights[:, None], rtol=1e-3, atol=1e-4)


def test_long_regions_are_read_in_stretches(tagger, monkeypatch):
    text = " ".join("+1 (269) 555-3296 4524132264652876 thshe" for _ in range(60))
    base = pii.base_spans(text)
    whole = pii.tagger_spans(tagger, [text], [base])[0]
    monkeypatch.setattr(pii, "STRETCH", 64)
    assert pii.tagger_spans(tagger, [text], [base])[0] == whole and len(whole) > 100


def test_very_long_text_through_the_tagger(tagger):
    text = "12 " * 200_000 + "mary.smith @ example.com" + " 7" * 50_000
    assert (0, 600_000, 600_024) in pii.tagger_spans(tagger, [text], [pii.base_spans(text)])[0]


def test_taken_spans_are_found_as_by_plain_search():
    rng = random.Random(8)
    for _ in range(500):
        spans = [(0, a, a + rng.randrange(1, 9)) for a in (rng.randrange(40) for _ in range(rng.randrange(6)))]
        a = rng.randrange(45)
        b = a + rng.randrange(1, 9)
        known = pii.Taken(spans)
        assert known.covers(a, b) == any(x <= a and b <= y for _, x, y in spans)
        assert known.meets(a, b) == any(x < b and a < y for _, x, y in spans)


def test_what_the_tagger_adds_on_labelled_text(tagger):
    """Of spans whose forms the base patterns lack, most are found, and little else."""
    rng = random.Random(11)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9)))
    want = found = right = 0
    for _ in range(150):
        text, spans = "", set()
        for _ in range(12):
            r = rng.random()
            if r < 0.1:
                kind, piece = 0, f"{word()}.{word()}{rng.choice([' @ ', '@ '])}{word()}.com"
            elif r < 0.2:
                kind, piece = 3, rng.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}"])
            elif r < 0.3:
                kind, piece = 2, pii._with_luhn(rng, 15)
            else:
                kind, piece = -1, rng.choice([word(), word(), digits(4), f"20{digits(2)}-0{digits(1)[-1]}-1{digits(1)}", f"${digits(3)}.{digits(2)}"])
            if kind >= 0:
                spans.add((kind, len(text), len(text) + len(piece)))
            text += piece + rng.choice([" ", ", ", " and "])
        assert not any(s in pii.base_spans(text) for s in spans)
        got = set(pii.tagger_spans(tagger, [text], [pii.base_spans(text)])[0])
        want, found, right = want + len(spans), found + len(got), right + len(got & spans)
    assert right >= 0.75 * want and right >= 0.75 * found


def test_rows_and_masking(spark, tagger):
    rows = [(1, "mail a.b@c.de now", 17, "x"), (1, None, None, None), (None, "", 0, "y"), (4, "1.2.3.4 +1 555 123 4567", 23, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint, spans string")
    out = {r.doc_id if r.base_sha256 != pii.hashlib.sha256(b"").hexdigest() else -1: r for r in pii.find_pii(docs).collect()}
    assert (out[1].n_email, out[1].spans) == (1, "email:5:13")
    assert out[4].spans == "ip:0:7,phone:8:23"
    masked = sorted(pii.mask_pii(docs).collect(), key=str)
    assert masked[0].asDict() == {"doc_id": 1, "text": "mail <EMAIL> now", "n_chars": 16, "spans": "x"}
    assert {r.text for r in masked} == {"mail <EMAIL> now", None, "", "<IP> <PHONE>"}
    assert pii.find_pii(docs.limit(0)).count() == 0
