import hashlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from kvlake.llm import bpe, decontam, pii, quality
from tests_llm_brute import components_brute, leaks_brute


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    scores = quality.fit_quality(docs, labels).scores([t for _, t in rows])
    rows = [r for r, s in zip(rows, scores, strict=True) if s >= 0.3]
    rows = [r for r, c in zip(rows, components_brute(rows), strict=True) if r[0] == c]
    rows = [r for r in rows if not leaks_brute(r[1], bench)]
    base = [pii.base_spans(t) for _, t in rows]
    more = pii.tagger_spans(pii.trained(), [t for _, t in rows], base)
    rows = [(i, pii.mask(t, b + m)) for (i, t), b, m in zip(rows, base, more, strict=True)]
    library = Tokenizer.from_file(bpe.tokenizer_path())
    want = {}
    for i, text in rows:
        ids = library.encode(text, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "PII", "BPE encoding and decoding"]


def test_stages_keep_the_columns_of_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a plain line of words", "en", "s", 21)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert decontam.MIN_WORDS == 5


def small(spark, folder, docs, labels=(), bench=()):
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(bench), "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_nulls_repeats_and_extra_columns_through_run(spark, tmp_path):
    text = "one plain line of words that is kept as it is by every stage of the pipeline"
    docs = [(1, None, "en", "s", None, 1.0), (2, "", "en", "s", 0, None), (3, text, None, None, 76, 0.5), (3, text, None, None, 76, 0.5), (4, text, "en", "s", 76, None), (5, "write to a.b@example.com or +1 555 123 4567 about the other matters of today", "en", "s", 70, 2.0), (None, "no id but words enough for a line of its own", "en", "s", 44, 0.0), (6, "an item of the benchmark stands in here, word for word", "en", "s", 54, 1.0)]
    sf = small(spark, tmp_path, docs, bench=[(1, "the benchmark stands in here, word for"), (2, None)])
    library = Tokenizer.from_file(bpe.tokenizer_path())
    masked = "write to <EMAIL> or <PHONE> about the other matters of today"
    want = sorted((i, len(library.encode(t, add_special_tokens=False).ids)) for i, t in ((3, text), (3, text), (5, masked)))
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got if r.doc_id is not None) == want
    assert [r.n_tokens for r in got if r.doc_id is None] == [len(library.encode(docs[6][1], add_special_tokens=False).ids)]


def test_empty_tables_through_run(spark, tmp_path):
    out = corpus_pipeline.run(spark, small(spark, tmp_path, []))
    assert out.count() == 0 and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_encode_takes_nulls(spark):
    docs = spark.createDataFrame([(1, None), (None, "x")], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.encode(spark, docs, "").collect()}
    none = hashlib.sha256(b"").hexdigest()
    assert got[1] == (0, none, none) and got[None][0] == 1
