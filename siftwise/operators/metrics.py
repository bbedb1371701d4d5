"""Quality, cost and usage reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.config import Price


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / F.greatest(b, F.lit(1))).otherwise(0.0)


def binary(df: DataFrame, keys: list[str], prediction: str = "prediction", gold: str = "ground_truth") -> DataFrame:
    """Counts and ratios; UNKNOWN counts as a parse failure, other undecided verdicts as n_other."""
    p, g = F.col(prediction), F.col(gold)
    counts = {
        "tp": (p == "Yes") & (g == "Yes"), "fp": (p == "Yes") & (g == "No"),
        "tn": (p == "No") & (g == "No"), "fn": (p == "No") & (g == "Yes"),
        "parse_fail": p == "UNKNOWN", "n_other": ~p.isin("Yes", "No", "UNKNOWN"),
    }
    agg = df.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return agg.select(
        *keys, "tp", "fp", "tn", "fn", "parse_fail", "n_other", n.alias("n"), F.round(_ratio(tp + tn, n), 6).alias("accuracy"),
        F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(_ratio(2 * tp, 2 * tp + fp + fn), 6).alias("f1"),
    )


def escalation(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points"), F.count_if("escalated").alias("n_escalated"), F.round(F.avg(F.col("escalated").cast("double")), 6).alias("escalation_rate"))


def tokens(records: DataFrame) -> DataFrame:
    """Calls and tokens; a self-check counts as calls of the small model."""
    return records.agg(
        (F.count("small_prediction") + F.sum("verify_calls")).alias("n_small_calls"),
        F.count_if(F.col("escalated") | (F.col("routed_to") == "large")).alias("n_large_calls"),
        F.sum(F.col("small_in") + F.col("verify_in")).alias("small_in"), F.sum(F.col("small_out") + F.col("verify_out")).alias("small_out"),
        F.sum("large_in").alias("large_in"), F.sum("large_out").alias("large_out"),
    )


def point_cost(price: Price = Price()) -> Column:
    """Dollars of a point: the small call, and the large one where it was escalated."""
    large = F.when(F.col("escalated"), F.col("large_in") * price.large_in + price.large_out).otherwise(0.0)
    return F.col("small_in") * price.small_in + F.col("small_out") * price.small_out + large


def cost(records: DataFrame, keys: list[str], price: Price = Price()) -> DataFrame:
    direct = F.when(F.col("routed_to") == "large", F.col("large_in") * price.large_in + price.large_out).otherwise(0.0)
    return records.groupBy(*keys).agg(F.round(F.sum(point_cost(price)), 9).alias("cost_usd"), F.round(F.sum(direct), 9).alias("direct_large_usd"))


def timings(records: DataFrame, stages: list[str]) -> DataFrame:
    """avg, n, total and max of each stage's non-null times."""
    long = records.select(F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("t")) for s in stages])).alias("x")).select("x.*")
    return long.where("t is not null").groupBy("stage").agg(F.round(F.avg("t"), 4).alias("avg_s"), F.count(F.lit(1)).alias("n"), F.round(F.sum("t"), 6).alias("total_s"), F.max("t").alias("max_s"))


def frontier_delta(run: DataFrame, frontier: DataFrame, value: str = "acc") -> DataFrame:
    """run (esc and a value: acc or f1) against values interpolated on the frontier's points, held at its ends; null if it has fewer than two."""
    if value != "acc":
        out = frontier_delta(run.drop("acc").withColumnRenamed(value, "acc"), frontier.drop("acc").withColumnRenamed(value, "acc"))
        return out.withColumnRenamed("acc", value).withColumnRenamed("frontier_acc", f"frontier_{value}")
    points = F.sort_array(F.collect_list(F.struct("esc", "acc")))
    line = frontier.groupBy().agg(points.alias("p"))
    low = F.array_max(F.filter("p", lambda x: x["esc"] <= F.col("esc")))
    high = F.array_min(F.filter("p", lambda x: x["esc"] >= F.col("esc")))
    mid = low["acc"] + (high["acc"] - low["acc"]) * (F.col("esc") - low["esc"]) / F.greatest(high["esc"] - low["esc"], F.lit(1e-12))
    at = F.when(low.isNull(), high["acc"]).when(high.isNull(), low["acc"]).when(high["esc"] == low["esc"], low["acc"]).otherwise(mid)
    joined = run.join(line)  # the frontier is one row
    expected = F.when(F.size("p") >= 2, at)
    return joined.select("name", "esc", "acc", F.round(expected, 6).alias("frontier_acc"), F.round(F.col("acc") - expected, 6).alias("delta"))


def calls(log: DataFrame) -> DataFrame:
    """A call log by phase, model and kind."""
    return log.groupBy("phase", "model", "kind").agg(F.count(F.lit(1)).alias("n_calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.sum("usd"), 9).alias("usd"))


def against_gold(df: DataFrame, keys: list[str], price: Price | None = None) -> DataFrame:
    """Ratios of a replayed cascade, with its agreement with the large model, its escalations and, with a price, its dollars."""
    base = binary(df, keys)
    own = [F.round(F.sum(point_cost(price)), 9).alias("cost_usd")] if price else []
    more = df.groupBy(*keys).agg(F.round(F.avg((F.col("prediction") == F.col("large_prediction")).cast("double")), 6).alias("agree_large"), F.round(F.avg(F.col("escalated").cast("double")), 6).alias("esc_rate"), *own)
    return base.join(more, keys) if keys else base.join(more)


def confusion(df: DataFrame, keys: list[str], served: str, gold: str, unknown: Column | None = None) -> DataFrame:
    """Counts over 0/1 columns; rows that the mask marks, or without an answer, are parse failures and count nowhere else."""
    bad = F.col(served).isNull() if unknown is None else F.coalesce(unknown, F.lit(False)) | F.col(served).isNull()
    p, g = F.col(served) == 1, F.col(gold) == 1
    counts = {"tp": p & g, "fp": p & ~g, "tn": ~p & ~g, "fn": ~p & g}
    agg = df.groupBy(*keys).agg(*[F.count_if(~bad & c).alias(n) for n, c in counts.items()], F.count_if(bad).alias("parse_fail"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return agg.withColumns({"accuracy": F.round(_ratio(tp + tn, tp + fp + tn + fn), 6), "f1": F.round(_ratio(2 * tp, 2 * tp + fp + fn), 6)})


def accuracies(df: DataFrame) -> DataFrame:
    """Share of right verdicts of each predicate, best first in place."""
    return df.groupBy("query_name").agg(F.round(F.avg(F.coalesce(F.col("prediction") == F.col("ground_truth"), F.lit(False)).cast("double")), 6).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def variants(df: DataFrame) -> DataFrame:
    """One row per variant, alpha and scope: all rows are in scope full, held-out ones in test too."""
    scoped = df.withColumn("scope", F.explode(F.when(F.col("is_test"), F.array(F.lit("full"), F.lit("test"))).otherwise(F.array(F.lit("full")))))
    right = (F.col("prediction") == F.col("ground_truth")).cast("double")
    return scoped.groupBy("variant", "alpha", "scope").agg(F.countDistinct("query_name").alias("n_queries"), F.count(F.lit(1)).alias("n"), F.round(F.avg(right), 6).alias("accuracy"))


def helpfulness(hits: DataFrame, keys: list[str], weighted: bool = False) -> DataFrame:
    """pos and neg of each lesson. hits: experience_id, small_prediction, final, and the keys; undecided finals count nothing.

    A small verdict that is missing was not right. weighted: observations count by small_confidence, held between 0 and 1.
    """
    told = hits.where(F.col("final").isNotNull() & (F.col("final") != "UNKNOWN"))
    good = F.coalesce(F.col("small_prediction") == F.col("final"), F.lit(False))
    if not weighted:
        return told.groupBy(*keys).agg(F.count_if(good).alias("pos"), F.count_if(~good).alias("neg"))
    step = F.least(F.greatest(F.coalesce("small_confidence", F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    return told.groupBy(*keys).agg(F.round(F.sum(F.when(good, step).otherwise(0.0)), 6).alias("pos"), F.round(F.sum(F.when(~good, step).otherwise(0.0)), 6).alias("neg"))


def rollup(counters: DataFrame) -> DataFrame:
    """Lessons observed and all their observations."""
    return counters.agg(F.count(F.lit(1)).alias("lessons_observed"), F.coalesce(F.sum("pos"), F.lit(0)).alias("total_pos"), F.coalesce(F.sum("neg"), F.lit(0)).alias("total_neg"))


def usage(hits: DataFrame) -> DataFrame:
    """Retrievals of each lesson. hits: experience_id, query_name, rank (from 0)."""
    per = hits.groupBy("experience_id", "query_name").agg(F.count(F.lit(1)).alias("n"), F.sum("rank").alias("r"))
    return per.groupBy("experience_id").agg(
        F.sum("n").alias("times_retrieved"), F.sum("r").alias("rank_sum"), F.round(F.sum("r") / F.sum("n"), 6).alias("avg_rank"), F.count(F.lit(1)).alias("n_queries"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("query_name", "n")))).alias("by_query"),  # one entry a predicate
    )


def triggers_with_use(triggers: DataFrame, installs: DataFrame, used: DataFrame) -> DataFrame:
    """Trigger log with what was installed and how often it was retrieved."""
    return triggers.join(installs, ["query_name", "doc_id"], "left").join(used, "experience_id", "left").withColumn("times_retrieved", F.coalesce("times_retrieved", F.lit(0)))


def trigger_summary(log: DataFrame) -> DataFrame:
    """Triggers recorded, lessons that came of them and those that did not. log: experience_id, null where none was installed."""
    return log.agg(F.count(F.lit(1)).alias("n_triggers"), F.count("experience_id").alias("n_accepted"), F.count_if(F.col("experience_id").isNull()).alias("n_rejected"))
