"""Running sums and ranks, in two steps: within ranges of the order, and over ranges.

A window over all rows of a predicate would be one task; here a task holds one range of positions,
of sorted values, or of digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settled

#: Positions in one range.
RANGE = 1 << 20


def running(df: DataFrame, key: list[str], order: str, sums: dict[str, Column], width: int = RANGE) -> DataFrame:
    """df with, for each name, the sum of its column over the key's earlier rows (order: a unique integer)."""
    cut = df.withColumns({"_range": F.floor(F.col(order) / width)} | {f"_v_{n}": c for n, c in sums.items()})
    totals = cut.groupBy(*key, "_range").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    over = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*key, "_range", *[F.coalesce(F.sum(f"_t_{n}").over(over), F.lit(0)).alias(f"_b_{n}") for n in sums])
    inner = Window.partitionBy(*key, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = cut.withColumns({f"_i_{n}": F.coalesce(F.sum(f"_v_{n}").over(inner), F.lit(0)) for n in sums})
    out = summed.join(before, [*key, "_range"])
    return out.withColumns({n: F.col(f"_i_{n}") + F.col(f"_b_{n}") for n in sums}).drop("_range", *[f"_{k}_{n}" for n in sums for k in "vib"])


def _shifted(cut: DataFrame, key: list[str], order: list[Column], sums: dict[str, Column], through: bool) -> DataFrame:
    """Sums over the rows before (through: and including) each one; _range places rows before all later ranges."""
    cut = cut.withColumns({f"_v_{n}": c for n, c in sums.items()})
    totals = cut.groupBy(*key, "_range").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    over = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*key, "_range", *[F.coalesce(F.sum(f"_t_{n}").over(over), F.lit(0)).alias(f"_b_{n}") for n in sums])
    inner = Window.partitionBy(*key, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if through else -1)
    summed = cut.withColumns({f"_i_{n}": F.coalesce(F.sum(f"_v_{n}").over(inner), F.lit(0)) for n in sums})
    out = summed.join(before, [*key, "_range"])
    return out.withColumns({n: F.col(f"_i_{n}") + F.col(f"_b_{n}") for n in sums}).drop("_range", *[f"_{k}_{n}" for n in sums for k in "vib"])


def running_by(df: DataFrame, key: list[str], order: list[Column], sums: dict[str, Column], through: bool = True) -> DataFrame:
    """As running, in the order of any columns: rows are dealt into ranges of (key, order), which are settled so that both steps see the same ones."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = settled(df.repartitionByRange(parts, *[F.col(k) for k in key], *order).withColumn("_range", F.spark_partition_id()))
    return _shifted(cut, key, order, sums, through)


def numbered(df: DataFrame, key: list[str], order: list[Column], out: str) -> DataFrame:
    """df with the place of each row among the key's, from 1."""
    return running_by(df, key, order, {out: F.lit(1)})


def numbered_by_digest(df: DataFrame, key: list[str], digest: Column, ties: list[str], out: str) -> DataFrame:
    """As numbered, in the order of a hexadecimal digest; its first three digits are the range, so nothing has to be settled."""
    cut = df.withColumn("_digest", digest).withColumn("_range", F.substring("_digest", 1, 3))
    return _shifted(cut, key, [F.col("_digest"), *[F.col(c) for c in ties]], {out: F.lit(1)}, True).drop("_digest")


def position(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """df with t, the place of each row among the key's, from 1."""
    return running(df, key, order, {"_earlier": F.lit(1)}).withColumn("t", F.col("_earlier") + 1).drop("_earlier")


def history(records: DataFrame, key: str, name: str) -> DataFrame:
    """records with the count of earlier escalations of a key, how many agreed, and what learners see of them.

    Escalations whose large verdict is missing or UNKNOWN teach nothing and do not count.
    """
    told = F.col("escalated") & F.coalesce(F.col("large_prediction") != "UNKNOWN", F.lit(False))
    esc = told.cast("int")
    agree = (told & F.coalesce(F.col("small_prediction") == F.col("large_prediction"), F.lit(False))).cast("int")
    out = running(records, [key], "pos", {f"n_{name}": esc, f"agree_{name}": agree})
    n, a = F.col(f"n_{name}"), F.col(f"agree_{name}")
    return out.withColumn(f"{name}_seen", F.round(F.least(F.log(1 + n) / F.log(F.lit(101.0)), F.lit(1.0)), 6)).withColumn(f"{name}_rate", F.round((a + 1) / (n + 2), 6))


def helpfulness(hits: DataFrame, key: list[str], weighted: bool = False, order: str = "pos") -> DataFrame:
    """hits with pos_<name> and neg_<name>: how earlier escalations with the same key (experience_id, or with query_name) went.

    hits: one row of a lesson shown at a point: pos, experience_id, escalated, small_prediction, large_prediction,
    and, if weighted, small_confidence, by which an observation counts. Rows of one point share a position and do
    not see each other.
    """
    name = "all" if len(key) == 1 else "query"
    told = F.col("escalated") & F.coalesce(F.col("large_prediction") != "UNKNOWN", F.lit(False))
    good = F.coalesce(F.col("small_prediction") == F.col("large_prediction"), F.lit(False))
    step = F.least(F.greatest(F.coalesce("small_confidence", F.lit(1.0)), F.lit(0.0)), F.lit(1.0)) if weighted else F.lit(1.0)
    sums = {f"pos_{name}": F.when(told & good, step).otherwise(0.0), f"neg_{name}": F.when(told & ~good, step).otherwise(0.0)}
    return running(hits, key, order, sums)


def gate(records: DataFrame, rho: float, cap: int, failed: Column | None = None) -> DataFrame:
    """Points that trigger a new lesson: escalated, both models decided, differing, early enough in their predicate, under the cap.

    failed: for points whose generation failed, which give their slot back. Slots are then those of earlier successes,
    as when each generation ends before the next point is looked at.
    """
    placed = position(records, ["query_name"], "pos")
    totals = records.groupBy("query_name").agg(F.count(F.lit(1)).alias("n_q"))
    placed = placed.join(totals, "query_name")
    decided = F.coalesce(F.col("small_prediction") != "UNKNOWN", F.lit(False)) & F.coalesce(F.col("large_prediction") != "UNKNOWN", F.lit(False))
    differs = F.col("escalated") & decided & (F.col("small_prediction") != F.col("large_prediction"))
    early = F.col("t") <= F.col("n_q") / (1 + rho)
    made = F.col("_wish") if failed is None else F.col("_wish") & ~F.coalesce(failed, F.lit(False))
    counted = running(placed.withColumn("_wish", F.coalesce(differs & early, F.lit(False))), ["query_name"], "pos", {"_made": made.cast("int")})
    return counted.withColumn("trigger", F.col("_wish") & (F.col("_made") < cap)).drop("_wish", "_made")


def until_cost(records: DataFrame, cost: Column, cap: float) -> DataFrame:
    """Rows up to and including the first whose cumulative cost exceeds the cap."""
    summed = running(records.withColumn("_all", F.lit(0)).withColumn("cost", cost), ["_all"], "pos", {"_spent": F.col("cost")})
    return summed.where(F.col("_spent") <= cap).withColumn("spent", F.col("_spent") + F.col("cost")).drop("_spent", "_all")
