"""The corpus pipeline: quality rules, near duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read
back as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwise.llm import common, mixing, packing, phrase_dedup, rule_lists, shingle_sets
from siftwise.llm.queries import tokenizer_path

def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list reject."""
    return rule_lists.kept_documents(docs, common.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at a five-word Jaccard similarity of 0.8 or more, that of the smallest doc_id: SimHash candidates, checked and completed."""
    return shingle_sets.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without words of passages found earlier."""
    return phrase_dedup.without_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("packed", packed),
]

#: SQL cannot express learned rules, fingerprints or packing; tests compare with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages rows are written to the shared folder, and dropped when they have been read."""
    docs, last = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        at = common.new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        if last:
            common.drop_folder(spark, last)
        docs, last = spark.read.parquet(at), at
    out = common.checkpointed(STAGES[-1][1](spark, docs, sf_dir))
    if last:
        common.drop_folder(spark, last)
    return out
