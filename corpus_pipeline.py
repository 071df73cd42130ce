"""A training-data pipeline over documents: quality rules, line dedup, near duplicates, benchmark passages, packing.

Each stage is a function of (spark, docs, sf_dir); its result is written as
Parquet and read again as the next one's docs.  All stages but the last return
the columns of documents, whatever further ones there are and whatever their
names.

Defined cases, by the operators' rules: a null or short text goes in the first
stage, which keeps no document of fewer than 50 words; repeated rows are judged
each by itself there, share their fate in line dedup, and are one class of the
Jaccard join, of which one row stays; of documents that tie, the one with the
least doc_id counts as first, one without doc_id as last there and as first in
line dedup; a doc_id with several texts stands for several documents; a very
long text is read whole by every stage and cut only into pieces by the last;
empty tables give no rows, and without labels or benchmark the base rules alone
reject, and nothing is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import decontamination, jaccard, line_dedup, packing, quality
from tracewright.storage import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the likelihood ratio keep, as they are."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of passages that an earlier document has; documents that lose all their lines go."""
    out = line_dedup.remove_repeats(docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the Jaccard join, the one with the least doc_id."""
    return jaccard.representatives(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), remove="documents")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 2048 tokens."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_removal),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("best-fit packing", packed),
]

#: SQL has neither the hash functions nor the tokenizer: tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{k}")
    return docs
