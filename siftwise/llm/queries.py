"""The ten registered queries over the shared tables, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chunk_store, kd_shards, mixing, packing, phrase_dedup, prefix_forest, quality_model, rule_lists, simhash, url_templates
from .common import table

TOKENIZER_VARIABLE = "SIFTWISE_TOKENIZERS"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A public tokenizer's file, on the driver and on executors alike."""
    if folder := os.environ.get(TOKENIZER_VARIABLE):
        return os.path.join(folder, name)
    if importlib.util.find_spec("public_tokenizers"):
        import public_tokenizers

        return public_tokenizers.path(name)
    return os.path.join("/opt/tokenizers", name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_dedup.repeat_digests(table(spark, sf_dir, "documents"))


def op3_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_forest.nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op4_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.sharded(table(spark, sf_dir, "documents"))


def op6_budget_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    return url_templates.judge(pages, url_templates.labels_by_document(pages, labels))


def op8_chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_store.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_ids(table(spark, sf_dir, "documents"))


def op10_rule_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_lists.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_phrase_dedup": op2_phrase_dedup,
    "op3_prefix_forest": op3_prefix_forest,
    "op4_subword_quality": op4_subword_quality,
    "op5_kd_shards": op5_kd_shards,
    "op6_budget_mixing": op6_budget_mixing,
    "op7_url_templates": op7_url_templates,
    "op8_chunk_store": op8_chunk_store,
    "op9_simhash": op9_simhash,
    "op10_rule_lists": op10_rule_lists,
}

ORACLE_SQL: dict[str, str] = {}
