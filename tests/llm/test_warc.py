import base64
import glob
import gzip
import hashlib
import random

import numpy as np
import pyarrow as pa

from kvlake.llm import warc

PAGES = "page_id bigint, url string, html string, shard int, size string"


def want(rows):
    out = []
    for page_id, _, html, *_ in rows:
        same = [r[0] for r in rows if (r[2] or "") == (html or "") and r[0] is not None]
        last = max(same, default=None)
        revisit = len([r for r in rows if (r[2] or "") == (html or "")]) > 1 and last is not None and page_id != last
        payload = (html or "").encode()
        out.append((page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=str)


def test_round_trip_equals_brute_force(spark, tmp_path):
    rows = [(k, f"http://x/{k} ü\n", ["<p>same</p>", f"page {k} é", None, "", "x" * 50_000][k % 5], 0, "s") for k in range(60)]
    rows += [(3, None, "page 3 é", 1, None), (None, "u", "<p>same</p>", None, None), (None, None, "alone", None, None), (7, "again", "other", 1, "z")]
    df = spark.createDataFrame(rows, PAGES)
    got = warc.warc_round_trip(df, str(tmp_path / "a"), shard_bytes=20_000, roll_bytes=500)
    assert sorted([tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()], key=str) == want(rows)
    # the same rows in another order give the same bytes
    warc.write_warc(df.repartition(7, "html"), str(tmp_path / "b"), shard_bytes=20_000, roll_bytes=500)
    files = {x: sorted(glob.glob(f"{tmp_path}/{x}/*.warc.gz")) for x in "ab"}
    assert len(files["a"]) > 5 and [open(f, "rb").read() for f in files["a"]] == [open(f, "rb").read() for f in files["b"]]
    assert not glob.glob(f"{tmp_path}/a/_temporary/*/*")
    payloads = {r.page_id: r.payload for r in warc.read_warc(spark, str(tmp_path / "a"), True).where("record_type = 'response' and page_id = 56").collect()}
    assert payloads == {56: "page 56 é"}
    assert gzip.open(files["a"][0]).read().startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_smallest_payloads_are_never_revisits(spark, tmp_path):
    rows = [(1, "a", "x", 0, ""), (2, "b", "x", 0, ""), (3, "c", "long enough", 0, ""), (4, "d", "long enough", 0, "")]
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.warc_round_trip(spark.createDataFrame(rows, PAGES), str(tmp_path / "c"), least_bytes=5).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}
    assert warc.warc_round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_ids_of_any_spread_are_cut_into_even_shards(spark, tmp_path):
    rng = random.Random(3)
    far = [-(2**62) - 5, 2**62 + 9, -(2**63), 2**63 - 1]
    rows = [(i, "u", f"page {i} " + "y" * 900, 0, "") for i in [*far, *range(300)]]
    rows += [(7, f"u{k}", f"copy {k} " + "z" * 900, 0, "") for k in range(150)] + [(None, f"n{k}", f"none {k}", 0, "") for k in range(150)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, PAGES)
    manifest = warc.write_warc(df, str(tmp_path / "a"), shard_bytes=40_000, hot_rows=3).collect()
    sizes = {}
    for r in manifest:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.records
    assert len(sizes) >= 10 and max(sizes.values()) < 120 and sum(sizes.values()) == len(rows)
    got = warc.read_warc(spark, str(tmp_path / "a")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == want(rows)


def test_bounds_and_numbers_against_plain_order():
    rng = np.random.default_rng(4)
    page, tie = rng.integers(-5, 5, 400) * (1 << 60), rng.integers(-9, 9, 400)
    size = rng.integers(1, 50, 400)
    bounds = warc.shard_bounds(pa.table({"page_id": page, "tie": tie, "size": size}), 9)
    pairs = list(zip(bounds[0].tolist(), bounds[1].tolist(), strict=True))
    assert pairs == sorted(pairs)
    assert warc.shard_numbers(bounds, page, tie).tolist() == [sum(b <= x for b in pairs) for x in zip(page.tolist(), tie.tolist(), strict=True)]


def test_payloads_that_many_rows_share(spark, tmp_path):
    rows = [(k, "u", ["", "same", f"own {k}", "rare" if k < 9 else f"x{k}"][k % 4], 0, "") for k in range(400)]
    got = warc.warc_round_trip(spark.createDataFrame(rows, PAGES), str(tmp_path / "a"), hot_rows=20).collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == want(rows)


def test_very_long_payload(spark, tmp_path):
    rows = [(1, "u", "x" * 20_000_000, 0, ""), (2, "u", "x" * 20_000_000, 0, "")]
    got = warc.warc_round_trip(spark.createDataFrame(rows, PAGES), str(tmp_path / "a")).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type) for r in got) == [(1, 20_000_000, "revisit"), (2, 20_000_000, "response")]
