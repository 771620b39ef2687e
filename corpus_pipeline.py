"""A corpus pipeline: quality, near duplicates, decontamination, personal data, tokens.

Every stage gets the documents that its predecessor kept, written as Parquet and
read again, so a lost executor or a restarted job never goes back further than
the last finished stage. What a stage has read is removed once its own output is
written.

Defined cases: documents whose text is null or has no word score 0 for quality and
go at the first stage; without labels of both classes all others stay; rows of a
null doc_id are kept as they are by the join; rows that share a doc_id stay or go
together there and are judged row by row elsewhere; of documents that are alike in
all respects the one of least doc_id stays; texts of any length are read whole;
empty tables give an empty result; other columns go through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kvlake.llm import bpe, decontam, jaccard, pii, quality
from kvlake.llm.common import remove_folder, shared_folder, stored, table


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF predicts good."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id in each component of similar documents."""
    return jaccard.keep_representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, exact or edited."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with placeholders for personal data."""
    return pii.mask_pii(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text."""
    return bpe.bpe_digests(docs)


STAGES = [
    ("quality classifier", keep_good_quality),
    ("n-gram Jaccard join", keep_one_of_similar),
    ("benchmark decontamination", drop_contaminated),
    ("PII", mask_personal_data),
    ("BPE encoding and decoding", encode),
]

#: SQL can express neither the trained models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = shared_folder(spark, "pipeline")
            docs = stored(docs, "pipeline", path)
            if before:
                remove_folder(spark, before)
            before = path
    return docs
