"""Ordering, splitting, sampling and acquisition.

Ranks over all rows of a predicate are taken in ranges (prefix.py); totals of a predicate are joined.
A window remains only where a limit keeps a few rows of each key, which Spark applies before shuffling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import prefix


def digest(seed: int, *columns: str) -> Column:
    """A pseudo-random order that any engine can repeat."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def ordered(points: DataFrame, key: list[str], order: list[Column], limit: int | None = None) -> DataFrame:
    """points with order_no from 1 within the key, cut off at a limit."""
    if not limit:
        return prefix.numbered(points, key, order, "order_no")
    return points.withColumn("order_no", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("order_no") <= limit)


def _with_totals(df: DataFrame, key: list[str], **totals: Column) -> DataFrame:
    """df with sums over each key. Keys must not be null."""
    return df.join(df.groupBy(*key).agg(*[c.alias(n) for n, c in totals.items()]), key)


def stratified(df: DataFrame, by: list[str], share: float, seed: int, ids: list[str]) -> DataFrame:
    """Of each class the nearest whole number to its share (halves to even), at least one."""
    n = F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(share), 0).cast("long"))
    ranked = prefix.numbered_by_digest(df, by, digest(seed, *ids), ids, "_r")
    return ranked.join(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), by).where(F.col("_r") <= n).drop("_r", "_n")


def two_phases(df: DataFrame, key: list[str], share: float, seed: int, ids: list[str]) -> DataFrame:
    """phase 1 for the share of the key's rows that come first by digest, 2 for the others."""
    ranked = prefix.numbered_by_digest(df, key, digest(seed, *ids), ids, "_r").join(df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")), key)
    return ranked.withColumn("phase", F.when(F.col("_r") <= F.bround(F.col("_n") * F.lit(share), 0), 1).otherwise(2)).drop("_r", "_n")


def held_back(df: DataFrame, key: list[str], share: float, seed: int, ids: list[str]) -> DataFrame:
    """is_val for the share of the key's rows that come first by digest, at least one; a key of one row keeps it for training."""
    ranked = prefix.numbered_by_digest(df, key, digest(seed, *ids), ids, "_r").join(df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")), key)
    n = F.when(F.col("_n") < 2, 0).otherwise(F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(share), 0)))
    return ranked.withColumn("is_val", F.col("_r") <= n).drop("_r", "_n")


def until_both(df: DataFrame, key: list[str], seed: int, least: int, ids: list[str]) -> DataFrame:
    """A seed set in digest order: at least `least` rows, and on until both classes (label 0 or 1) have been seen."""
    place = F.struct(digest(seed, *ids).alias("d"), *ids)
    first = lambda c: F.min(F.when(F.col("label") == c, place))
    ends = df.groupBy(*key).agg(first(0).alias("_f0"), first(1).alias("_f1"))
    ranked = prefix.numbered_by_digest(df, key, digest(seed, *ids), ids, "order_no").join(ends, key)
    missing = F.col("_f0").isNull() | F.col("_f1").isNull()
    return ranked.where((F.col("order_no") <= least) | missing | (place <= F.greatest("_f0", "_f1"))).drop("_f0", "_f1")


def acquisition(scored: DataFrame, key: list[str], score: str, eps: float) -> DataFrame:
    """q: scores below 0 as 0, as shares (equal ones if all are 0), mixed with eps of equal shares."""
    s = F.greatest(F.col(score), F.lit(0.0))
    told = _with_totals(scored, key, _total=F.sum(s), _count=F.count(F.lit(1)))
    share = F.when(F.col("_total") > 0, s / F.greatest("_total", F.lit(1e-300))).otherwise(1 / F.col("_count"))
    return told.withColumn("q", (1 - eps) * share + eps / F.col("_count")).drop("_total", "_count")


def importance(df: DataFrame, key: list[str], low: float = 0.1, high: float = 10.0) -> DataFrame:
    """weight: 1 / q over its mean, held between low and high (training from files holds it below 50)."""
    told = _with_totals(df, key, _mean=F.avg(1 / F.col("q")))
    return told.withColumn("weight", F.least(F.greatest(1 / F.col("q") / F.col("_mean"), F.lit(low)), F.lit(high))).drop("_mean")


def under_confidence(df: DataFrame, key: list[str], cap: float, budget: int, tie: str) -> DataFrame:
    """Rows below the cap; where those are fewer than the budget, the least confident others fill up."""
    inside = df.where(F.col("confidence") < cap)
    held = inside.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("confidence", tie))
    rest = df.where(~F.coalesce(F.col("confidence") < cap, F.lit(False))).withColumn("_r", rank).where(F.col("_r") <= budget)
    fill = rest.join(held, key, "left").where(F.col("_r") <= budget - F.coalesce("_n", F.lit(0))).drop("_r", "_n")
    return inside.unionByName(fill)


def surest(df: DataFrame, key: list[str], p: str, tie: str, n: int) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.desc(F.greatest(F.col(p), 1 - F.col(p))), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def moving_average(df: DataFrame, key: list[str], order: str, value: str, out: str, width: int = 5) -> DataFrame:
    """The mean of the values at most width // 2 places away, over those that exist. df: few rows of a key, as a histogram's bins."""
    half = width // 2
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(-half, half)
    return df.withColumn(out, F.avg(value).over(w))


def random_pairs(docs: DataFrame, n: int, seed: int) -> DataFrame:
    """n pairs of different documents: the first 2 n by digest, in twos. docs: doc_id, text."""
    drawn = docs.select("doc_id", "text").withColumn("_d", digest(seed, "doc_id")).orderBy("_d", "doc_id").limit(2 * n)
    placed = drawn.withColumn("_r", F.row_number().over(Window.orderBy("_d", "doc_id")) - 1)  # at most 2 n rows
    pair = F.floor(F.col("_r") / 2)
    left = placed.where("_r % 2 = 0").select(pair.alias("pair"), "doc_id", "text")
    return left.join(placed.where("_r % 2 = 1").select(pair.alias("pair"), F.col("doc_id").alias("other_id"), F.col("text").alias("other_text")), "pair")
