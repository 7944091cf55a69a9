"""A corpus from raw documents to token ids: the stages in order, each on all that the one before it kept.

toxicity              documents that the field predicts toxic go
exact dedup           one document of each group of equal texts stays
simhash near-dedup    one document of each group linked by fingerprints stays
decontamination       documents that hold a benchmark item go
bpe                   doc_id, ids, n_tokens and the decoded text
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import bpe, decontaminate, exact_dedup, simhash, toxicity
from tracewell.llm.common import written
from tracewell.llm.queries import table, tokenizer_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.dedup(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.tokenised(docs, tokenizer_path())


STAGES = [("toxicity", toxicity_stage), ("exact dedup", exact_stage), ("simhash near-dedup", near_stage), ("decontamination", benchmark_stage), ("bpe", token_stage)]

#: Learnt scores and fingerprints have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; each writes Parquet to the shared folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
