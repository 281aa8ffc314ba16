"""A corpus pipeline of five stages, each applying one operator of the training-data subpackage to all that came before.

Every stage is written as Parquet in the shared folder and read again, so a lost executor costs a stage's tasks, not the run.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import bpe, mixing, pii, quality, simhash
from strandline.llm._common import doc_crc, materialise, table
from strandline.llm.queries import vocabulary


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from three quarters of the labelled rows of the whole table."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), doc_crc() % 4 != 2)
    return quality.keep_good(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more; operator 4's grid, then MinHash bands."""
    return simhash.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half of the way to equal weights of sources: each document once at least, and rarely more than twice."""
    return mixing.mix(docs, evenness=0.5, max_repeats=1.5)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and hashes of ids and decoded texts."""
    return bpe.encode_documents(docs, vocabulary())


STAGES = [
    ("quality classifier", drop_low_quality),
    ("near duplicates", drop_near_duplicates),
    ("personal data", redact_personal_data),
    ("source mixing", mix_sources),
    ("byte pairs", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned scores, XXH64 votes, components and merges have no SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None
