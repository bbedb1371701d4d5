"""The semantic filter as one batch plan, for routers that do not learn while they run.

Each model stage is settled (written once) before the plan branches on its answers, so the small
model sees every point once and the large one every escalated point without a cached answer once.
Texts stay out of what is settled; where the large model needs them, they are joined again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import routing
from ..sources import cache as answers
from ..sources.shared import settled

#: Columns that a model needs and records do not.
HEAVY = ("text", "messages", "vec")
KEY = ["query_name", "doc_id"]

Stage = Callable[[DataFrame], DataFrame]


def light(df: DataFrame) -> DataFrame:
    return df.drop(*HEAVY)


def with_heavy(rows: DataFrame, points: DataFrame) -> DataFrame:
    """rows with the heavy columns of their points."""
    more = [c for c in HEAVY if c in points.columns and c not in rows.columns]
    return rows.join(points.select(*KEY, *more), KEY) if more else rows


def semantic_filter(
    points: DataFrame, small: Stage, large: Stage, escalate: Column, cached: DataFrame | None = None,
    save: Stage = settled, store: Callable[[DataFrame], None] | None = None, verify: Stage | None = None,
) -> DataFrame:
    """Records of all points: the small verdict, whether it was escalated, the large one for those, the final one.

    Only escalated points reach the large model, and of those only the ones the cache does not hold;
    store gets the live answers (query_name, doc_id, prediction, raw). verify adds what a self-checking router
    needs. A point is one row of (query_name, doc_id).
    """
    told = small(points) if verify is None else verify(small(points))
    decided = save(light(routing.decide(told, escalate)))
    held = decided.where("escalated")
    kept = decided.where("not escalated").withColumn("large_prediction", F.lit(None).cast("string")).withColumn("from_cache", F.lit(False))
    hits = None
    if cached is not None:
        probed = answers.probe(held, cached)
        hits = probed.where("hit").withColumn("large_prediction", F.col("cached_prediction")).withColumn("from_cache", F.lit(True)).drop("hit", "cached_prediction")
        held = probed.where("not hit").drop("hit", "cached_prediction")
    live = save(light(large(with_heavy(held, points)))).withColumn("from_cache", F.lit(False))
    if store is not None:
        raw = F.col("large_raw") if "large_raw" in live.columns else F.col("large_prediction")
        store(live.where("large_prediction is not null").select(*KEY, F.col("large_prediction").alias("prediction"), raw.alias("raw")))
    out = kept.unionByName(live, allowMissingColumns=True)
    return routing.final(out if hits is None else out.unionByName(hits, allowMissingColumns=True))


def all_large(points: DataFrame, large: Stage) -> DataFrame:
    """Every point straight to the large model: no small call, nothing escalated."""
    return large(points).withColumn("prediction", F.col("large_prediction")).withColumn("escalated", F.lit(False)).withColumn("routed_to", F.lit("large")).withColumn("small_prediction", F.lit(None).cast("string"))
