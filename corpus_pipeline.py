"""From raw documents to token shards: classifier, near duplicates, benchmark leaks, mixing, token output.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and returns their columns; the
last returns doc_id, start, n_tokens and ids_crc32 as read back from the shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnworks.llm.cnn import good_documents
from tarnworks.llm.common import Work, read
from tarnworks.llm.decontaminate import without_leaks
from tarnworks.llm.minhash import one_of_each
from tarnworks.llm.mixing import mixed
from tarnworks.llm.sstable import token_output
from tarnworks.llm.tokens import vocabulary_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more, by a network fitted to labels that aren't held out.

    Null and empty texts have a score of their own, like any text; repeated rows are kept or go together; texts of any
    length are read whole. Without usable labels the score is 0.5, so no document stays.
    """
    return good_documents(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least identifier; of repeated rows one.

    Documents without words, or without an identifier, are duplicates of nothing and stay.
    """
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; those without words, and all if the benchmark is empty, stay."""
    return without_leaks(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, 3 times at most, with all their columns.

    A null source is one of its own. Documents without words are taken never; of rows that repeat, each is taken by
    itself.
    """
    return mixed(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from its shards in ascending order.

    A null text is one end id; null identifiers come first; repeated rows are repeated; no documents give no rows.
    """
    return token_output(docs, vocabulary_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_shards", token_shards),
]

#: Trained models, hashing and tokenizing are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder; each is written before the next reads it. An empty table gives no rows."""
    work, docs = Work(spark, "pipeline"), read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
