"""A training corpus from raw documents: quality, near-duplicates, personal data, source mixture, packing.

Each stage takes (spark, docs, sf_dir), works on everything that the stage
before it kept, and returns the columns of documents; the last returns pieces of
packed sequences. Nulls, empty texts and tables and repeated rows are handled as
the operators' docstrings say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytequarry.llm import mixture, nbsvm, neardup, pii, tokens
from bytequarry.llm.common import drop, scratch, shared_dir, table
from bytequarry.llm.queries import END_ID, LENGTH, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, doesn't reject."""
    judged = nbsvm.classify(docs, table(spark, sf_dir, "labels"))
    return judged.where("quality_predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return neardup.keep_one(docs, n=5, percent=80).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redact(docs).select(*COLUMNS)


def mixture_of_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them; copies of one have the same id."""
    return mixture.take(mixture.mix(docs)).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in sequences, concatenated and cut."""
    return tokens.concatenate_and_cut(docs, tokenizer_path(), END_ID, LENGTH).drop("ids")


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicates),
    ("personal data", personal_data),
    ("source mixture", mixture_of_sources),
    ("packing", packing),
]

#: SQL can express neither the fitted model nor the tokenizer; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole documents table.

    Each stage is written and read again; its intermediate tables go when it is
    written, and its input when the next stage is. What the last stage wrote stays for the caller.
    """
    docs = table(spark, sf_dir, "documents").select(*(F.col(c) for c in COLUMNS))
    where = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{where}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{where}/{k}")
        if k:
            drop(spark, f"{where}/{k - 1}")
    return docs
