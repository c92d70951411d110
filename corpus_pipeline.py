"""Corpus pipeline: five stages over the table documents, each written as Parquet and read again by the next.

1. quality: documents that the co-trained classifier rejects (probably of low quality, or probably toxic) go.
2. line_dedup: later copies of repeated runs of lines go; no document does, one without lines left has an empty text.
3. simhash: of each group of near-duplicates (linked at 0.8 similarity of five-word shingles or more) the smallest doc_id stays.
4. decontaminate: documents that hold a test item, verbatim or edited, go.
5. tokens: token ids of what is left, with counts and digests.

Defined results: each row is judged for itself: texts that share a doc_id, or have none, are documents of their own, and of rows
equal in doc_id and text one stays in stage 3. Null and empty texts are documents; those with equal ids go but for one in stage 3, as
all texts without words do. Empty tables give empty results; further columns are kept by all stages but the last, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import bpe, decontaminate, line_dedup, near_copies, quality
from larder.llm.common import cut, drop_cut, fresh, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = tuple(fresh(n, docs.columns) for n in quality.RESULTS)
    return quality.scored(docs, table(spark, sf_dir, "labels"), names=names).where(F.col(names[-1])).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = tuple(fresh(n, docs.columns) for n in line_dedup.RESULTS)
    left = line_dedup.deduplicated(docs, names=names)
    return left.withColumn("n_chars", F.when(F.col(names[1]) > 0, F.length("text")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.tokenize(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", drop_low_quality),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("tokens", tokenize),
]

#: None: SQL can express neither the classifier nor the fingerprints, alignments and merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage keeps is written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        after = cut(stage(spark, docs, sf_dir))
        if k:
            drop_cut(docs)
        docs = after
    return docs
