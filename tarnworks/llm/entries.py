"""The queries of this subpackage, over the whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnworks.llm.audit import INTERACTIONS_SQL, interactions
from tarnworks.llm.cnn import quality_classifier
from tarnworks.llm.common import read
from tarnworks.llm.decontaminate import find_leaks
from tarnworks.llm.htmltext import extract_text
from tarnworks.llm.lengths import length_histogram, suffix_sums
from tarnworks.llm.lm import lm_scores
from tarnworks.llm.merkle import MANIFEST_SQL, manifest
from tarnworks.llm.minhash import near_duplicates
from tarnworks.llm.mixing import mix
from tarnworks.llm.pii import pii_digest
from tarnworks.llm.repeats import without_repeats
from tarnworks.llm.rules import quality_rules
from tarnworks.llm.sstable import token_output
from tarnworks.llm.tokens import vocabulary_path


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(read(spark, sf_dir, "documents"))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"))


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(read(spark, sf_dir, "documents"), vocabulary_path())


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), k=3, most=85, depth=3)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sums(length_histogram(read(spark, sf_dir, "documents"), vocabulary_path()))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(read(spark, sf_dir, "documents"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(read(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_lm_scores, op3_decontamination, op4_quality_rules, op5_token_shards, op6_minhash, op7_quality_classifier, op8_token_counts, op9_mixing, op10_html_text, op11_suffix_dedup, op12_manifest, op13_filter_audit)}
ORACLE_SQL: dict[str, str] = {"op12_manifest": MANIFEST_SQL, "op13_filter_audit": INTERACTIONS_SQL}
