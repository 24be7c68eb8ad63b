"""A corpus pipeline over `documents`: toxicity, exact dedup, n-gram Jaccard join, PII, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the shared folder and
reads again as the next stage's docs. All but the last return the columns of documents; each works on every row that its
predecessor kept. Rejected documents, all but one of equal texts (the largest doc_id stays) and all but one of each group
of near duplicates (the smallest doc_id stays) go; texts go on sanitised; the last stage returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import exact_dedup, ngram_join, packing, pii, toxicity
from sparkloom.llm.runtime import drop, scope, table, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows that the classifier rejects; it learns from the labels of the learning folds that docs has.

    Null and empty texts get the score of no words; repeated rows and null ids are rows of their own; without labels of both
    kinds, or on an empty table, every row stays.
    """
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that of the largest doc_id; null texts count as empty ones.

    A null id stays only in a group of null ids, and of repeated rows one; an empty table gives an empty one.
    """
    return exact_dedup.keep_first(docs)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates, that of the smallest doc_id (a null id comes last).

    Rows without words (null, empty or blank texts) all stay; of repeated rows one; an empty table gives an empty one.
    """
    return ngram_join.keep_one(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with base spans generalised to their kind and disclosing terms removed; n_chars is the new length.

    A null text stays null, an empty one empty; repeated rows are sanitised alike; an empty table gives an empty one.
    """
    return pii.sanitise(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their places in sequences of 4096 tokens, instead of documents.

    A null or empty text is its end token; texts of more tokens are cut; an empty table gives no piece.
    """
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_jaccard_join", ngram_join_stage),
    ("pii", pii_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL can't express training, tokens or packing; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in a row; what a stage wrote besides its result is dropped when that is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        with scope():
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}", outer=True)
        drop(before)
    return docs
