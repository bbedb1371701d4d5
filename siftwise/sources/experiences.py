"""Pools of lessons, candidates and rollouts as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXPERIENCE = "experience_id string, source_query string, source_doc_id long, source_doc_excerpt string, experience_text string, applicability_signal string, score double"
CANDIDATE = "cand_id string, predicate string, doc_id long, expected_answer string, source string, meta map<string,string>"
ROLLOUT = (
    "cand_id string, predicate string, doc_id long, expected_answer string, features array<double>, small_prediction string, small_confidence double, "
    "s_entropy double, large_prediction string, z int, q double, round_idx int, acquisition string, meta map<string,string>"
)


def read_experiences(spark: SparkSession, path: str) -> DataFrame:
    """Missing texts are empty, a missing score is 0."""
    raw = spark.read.schema(EXPERIENCE).json(path)
    texts = ("source_doc_excerpt", "experience_text", "applicability_signal")
    return raw.withColumns({t: F.coalesce(t, F.lit("")) for t in texts} | {"score": F.coalesce("score", F.lit(0.0))})


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CANDIDATE).json(path).withColumn("meta", F.coalesce("meta", F.create_map().cast("map<string,string>")))


def read_rollouts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROLLOUT).json(path)


def rollout_matrix(rollouts: DataFrame, features: str = "features") -> DataFrame:
    """rollouts with vector, as learners take it; rows of another width than the first raise when read."""
    from pyspark.ml.functions import array_to_vector

    width = rollouts.select(F.size(features)).limit(1).collect()
    n = width[0][0] if width else 0
    checked = F.when(F.size(features) == n, F.col(features)).otherwise(F.raise_error(F.lit("rollouts have features of different widths")).cast("array<double>"))
    return rollouts.withColumn("vector", array_to_vector(checked))


def write(rows: DataFrame, path: str, mode: str = "append") -> None:
    rows.write.mode(mode).json(path)


def experience_id(query: str = "query_name", doc: str = "doc_id"):
    return F.concat(F.lit("online__"), F.col(query), F.lit("__doc_"), F.col(doc).cast("string"))


def synthetic_ids(predicate: str = "predicate"):
    """Digest ids of a predicate: (synthq_, md_ with the document, dc_ with the document)."""
    p = F.trim(F.col(predicate))
    both = F.concat_ws("|", p, F.col("doc_id").cast("string"))
    return (
        F.concat(F.lit("synthq_"), F.substring(F.sha1(p), 1, 12)),
        F.concat(F.lit("md_"), F.substring(F.sha1(both), 1, 16)),
        F.concat(F.lit("dc_"), F.substring(F.sha1(F.concat_ws("|", both, F.lit("pair"))), 1, 16)),
    )
