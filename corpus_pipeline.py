"""The corpus pipeline: quality rules, near-duplicates, PII, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of documents.
Rows with null or empty texts fail the quality rules; empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hushframe.llm import bpe, mixing, pii, quality, simhash
from hushframe.llm.common import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or repeat themselves too much go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first by doc_id, of each group of near-duplicates stays."""
    return simhash.keep_first(docs)


def pii_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets in the texts become pseudonyms of the same format."""
    return pii.pseudonymise(docs, pii.session_key(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of domains below their target weight are repeated; none is dropped."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    _, report = mixing.mix(docs, mixing.labelled_domains(docs, labels), mixing.TARGETS, floor=1.0)
    return mixing.repeat_rows(docs, report)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, with digests of them and of the bytes they decode to."""
    found = bpe.token_digests(docs, *bpe.production_vocabulary(), extra=("lang", "source"), with_ids=True)
    return found.withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("pii_pseudonyms", pii_pseudonyms),
    ("mix_sources", mix_sources),
    ("token_ids", token_ids),
]

#: SQL cannot express suffix arrays, fingerprints, keyed permutations or token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
