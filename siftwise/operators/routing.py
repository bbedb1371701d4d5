"""Routers: when the small model's verdict goes to the large one."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNDECIDED = ("UNKNOWN", "Unsure")


def all_small() -> Column:
    return F.lit(False)


def by_confidence(threshold: float = 0.8) -> Column:
    """Undecided, or less sure than the threshold."""
    return F.coalesce(F.col("small_prediction").isin(*UNDECIDED), F.lit(True)) | (F.col("confidence") < threshold)


def verify_score(votes: Column) -> Column:
    """Share of votes for correct among those that say anything; 0 if none does."""
    said = F.transform(votes, lambda v: F.lower(F.coalesce(v, F.lit(""))))
    wrong = F.size(F.filter(said, lambda v: v.contains("incorrect")))
    right = F.size(F.filter(said, lambda v: v.contains("correct") & ~v.contains("incorrect")))
    return F.when(right + wrong > 0, right / F.greatest(right + wrong, F.lit(1))).otherwise(0.0)


def by_verification(threshold: float = 0.5) -> Column:
    """Undecided (without a self-check), or verified no better than the threshold."""
    return ~F.coalesce(F.col("small_prediction").isin("Yes", "No"), F.lit(False)) | (F.col("verify_score") <= threshold)


def learned(threshold: float, bootstrap: float = 0.9, veto: float | None = None, trained: bool = True) -> Column:
    """Undecided, or unlikely to agree by the model (p_agree); without a model, or where it gives nothing, less sure than bootstrap.

    A veto spares points that the model would escalate and the small model is very sure of.
    """
    undecided = F.coalesce(F.col("small_prediction").isin(*UNDECIDED), F.lit(True))
    unsure = F.coalesce(F.col("confidence") < bootstrap, F.lit(True))
    if not trained:
        return undecided | unsure
    wish = F.col("p_agree") < threshold
    if veto is not None:
        wish = wish & ~F.coalesce(F.col("confidence") >= veto, F.lit(False))
    return undecided | F.when(F.col("p_agree").isNull(), unsure).otherwise(wish)


ROUTERS: dict[str, Callable[..., Column]] = {"all_small": all_small, "confidence_threshold": by_confidence, "automix": by_verification, "learned": learned}
#: These cannot run without a large model; all_big has no small call at all.
NEEDS_LARGE = ("all_big", "confidence_threshold", "automix", "learned")


def needs_large(name: str, generates: bool = False) -> bool:
    """Whether a large model must be reachable: some routers ask for it, and so does the making of lessons."""
    return generates or name in NEEDS_LARGE


def router(name: str, **settings) -> Column:
    if name not in ROUTERS:
        raise KeyError(f"unknown router {name!r}; known: {sorted(ROUTERS)}")
    return ROUTERS[name](**settings)


#: What a learned router sees of a point, in order.
POINT = (
    "p_yes", "p_no", "confidence", "margin", "entropy_2way", "logprob_yes", "logprob_no", "says_yes",
    "text_length", "description_length", "doc_seen", "doc_rate", "query_seen", "query_rate",
)


def point_features(columns: list[str], length: Column | None = None) -> Column:
    """The 14 numbers of POINT. columns: those at hand; what is missing or null has its neutral value.

    length: characters of the text, where the text itself is not at hand.
    """

    def value(name: str, neutral: Column | float) -> Column:
        neutral = neutral if isinstance(neutral, Column) else F.lit(float(neutral))
        return F.coalesce(F.col(name).cast("double"), neutral) if name in columns else neutral

    yes, no = value("p_yes", 0.5), value("p_no", 0.5)
    said = F.col("small_prediction")
    chars = length if length is not None else F.length("text") if "text" in columns else F.lit(0)
    described = F.length("query_description") if "query_description" in columns else F.lit(0)
    return F.array(
        yes, no, value("confidence", F.greatest(yes, no)), value("margin", F.abs(yes - no)), value("entropy_2way", math.log(2)),
        value("logprob_yes", -10), value("logprob_no", -10), F.when(said == "Yes", 1.0).when(said == "No", 0.0).otherwise(0.5),
        F.log(1 + F.coalesce(chars, F.lit(0)).cast("double")), F.coalesce(described, F.lit(0)).cast("double"),
        value("doc_seen", 0), value("doc_rate", 0.5), value("query_seen", 0), value("query_rate", 0.5),
    )


def with_verification(told: DataFrame, votes: Callable[[DataFrame], DataFrame], k: int = 8) -> DataFrame:
    """Rows with verify_score and what the self-check cost. votes adds votes (array<string>), verify_in, verify_out to rows that have a verdict.

    Undecided rows are not checked; a check that failed (null votes) scores 0 and is charged k calls.
    """
    sure = F.coalesce(F.col("small_prediction").isin("Yes", "No"), F.lit(False))
    checked = votes(told.where(sure)).withColumn("verify_score", verify_score(F.coalesce("votes", F.array().cast("array<string>")))).withColumn("verify_calls", F.lit(k).cast("long")).drop("votes")
    rest = told.where(~sure).withColumns({"verify_in": F.lit(0).cast("long"), "verify_out": F.lit(0).cast("long"), "verify_score": F.lit(None).cast("double"), "verify_calls": F.lit(0).cast("long")})
    return checked.unionByName(rest)


def decide(small: DataFrame, escalate: Column) -> DataFrame:
    """small with escalated (a wish that is null counts as yes) and routed_to, where the point went first."""
    return small.withColumn("escalated", F.coalesce(escalate, F.lit(True))).withColumn("routed_to", F.lit("small"))


def final(decided: DataFrame) -> DataFrame:
    """The large verdict where a point was escalated and it is known, else the small one."""
    use = F.col("escalated") & F.col("large_prediction").isNotNull()
    return decided.withColumn("prediction", F.when(use, F.col("large_prediction")).otherwise(F.col("small_prediction")))


def detector_rows(records: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """One row of each held-out point for a detector study: p_agree, the router's wish, and whether the models agree.

    truth: query_name, doc_id, oracle_label, for points whose large verdict is not in the records.
    """
    if truth is not None:
        records = records.join(truth.select("query_name", "doc_id", "oracle_label"), ["query_name", "doc_id"], "left")
        records = records.withColumn("oracle_label", F.coalesce("large_prediction", "oracle_label"))
    else:
        records = records.withColumn("oracle_label", F.col("large_prediction"))
    agree = F.when(F.col("small_prediction").isin("Yes", "No") & F.col("oracle_label").isin("Yes", "No"), (F.col("small_prediction") == F.col("oracle_label")).cast("int"))
    return records.select("query_name", "doc_id", "small_prediction", "oracle_label", "p_agree", "escalated", agree.alias("z"))


def detector_counts(records: DataFrame) -> DataFrame:
    return records.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("small_prediction").isin("Yes", "No")).alias("n_definitive"),
        F.count_if(F.col("small_prediction") == "Unsure").alias("n_unsure"), F.count_if(F.col("p_agree").isNull()).alias("n_null_p"),
    )
