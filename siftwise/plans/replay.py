"""Learning from stored outcomes: heads by replaying rollouts in order, routers with checkpoints, joint pretraining."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import confidence
from ..operators import learners, metrics, retrieval, routing, sampling
from ..operators.memory import Lesson, Memory
from ..operators.memory import shown as show
from ..sources import experiences
from ..sources.shared import exists, settled

WIDTH = len(retrieval.PHI)


def train_memory(rollouts: DataFrame, memory: Memory, order: str = "pos") -> int:
    """Fold labelled rollouts (query_name, doc_id, vec, text, small_prediction, large_prediction, small_confidence) into a memory; how many taught it.

    Lessons and their features are those that the memory shows before any of the rollouts.
    """
    told = rollouts.where("z is not null and small_prediction is not null and large_prediction is not null")
    rows = show(told, memory).select(order, "query_name", "hits", "small_prediction", "large_prediction", "small_confidence")
    return learners.fold_in_order(rows, order, lambda r: memory.observe(r["query_name"], [(h["experience_id"], np.array(h["phi"], float)) for h in r["hits"]], r["small_prediction"], r["large_prediction"], r["small_confidence"]))


def train_heads(rollouts: DataFrame, width: int = WIDTH, lean: float = 20.0, per_query: bool = False) -> learners.SharedHeads:
    """Heads from rollouts whose features hold the mean features of the lessons shown behind the point's 14: one observation each."""
    head = learners.SharedHeads(width, lean, per_query)
    n = len(routing.POINT)
    rows = rollouts.where("z is not null").withColumn("phi", F.slice("features", n + 1, width)).where(F.exists("phi", lambda x: x != 0))
    keyed = rows.select("cand_id", "doc_id", "predicate", "phi", "z", F.xxhash64("cand_id", "doc_id").alias("pos"))
    learners.fold_in_order(keyed, "pos", lambda r: head.observe(r["predicate"], np.array([r["phi"]], float), bool(r["z"])))
    return head


def train_router(rollouts: DataFrame, path: str, kind: str = "gbt", val_share: float = 0.15, seed: int = 0, threshold: float = 0.5, calibrate: str | bool | None = True, width: int | None = None, ips: bool = True) -> dict:
    """Fit a router head on rollouts (cand_id, doc_id, features, z, q), write its checkpoint, and give its held-out figures.

    Rows weigh by how rarely they would have been drawn, held between 0.1 and 50. One class alone raises.
    """
    told = rollouts.where("z is not null").withColumn("_all", F.lit(0))
    if width is not None:
        told = told.withColumn("features", F.slice("features", 1, width))
    weighed = sampling.importance(told.withColumn("q", F.greatest("q", F.lit(1e-9))), ["_all"], high=50.0) if ips else told.withColumn("weight", F.lit(1.0))
    parted = settled(sampling.held_back(weighed, ["_all"], val_share, seed, ["cand_id", "doc_id"]).drop("_all"))
    train, val = parted.where("not is_val"), parted.where("is_val")
    model = learners.fit_router(train, kind, weight="weight", calibrate=calibrate)
    if model is None:
        raise ValueError("rollouts of one class, or fewer than 20 of them, cannot train a router")
    told = settled(learners.predict(model, val))
    row = told.agg(F.count(F.lit(1)).alias("n_val"), F.avg(((F.col("p_agree") >= threshold).cast("int") == F.col("z")).cast("double")).alias("val_accuracy"), F.avg("z").alias("val_pos_rate")).first()
    facts = {**row.asDict(), "val_log_loss": learners.log_loss(told).first()[0], **train.agg(F.count(F.lit(1)).alias("n_train"), F.sum("z").alias("n_pos_train")).first().asDict()}
    learners.save_router(model, path, threshold, {"kind": kind, "width": width, "metrics": facts})
    return facts


@dataclass(frozen=True)
class Joint:
    """Settings of joint pretraining. budgets: large calls of each round, the last one for all later rounds."""

    rounds: int = 4
    budgets: tuple[int, ...] = (100,)
    working: int = 400
    cap: float | None = 0.95
    eps: float = 0.1
    seed: int = 0
    least_fit: int = 40
    leave_out: bool = True
    no_lessons: bool = False
    most_calls: int = 24


def pretrain(points: DataFrame, memory: Memory, small: Callable, large: Callable, generate: Callable | None = None, settings: Joint = Joint(), done: str | None = None) -> tuple[DataFrame, Memory, learners.Logit | None, list[dict]]:
    """Rollouts of all rounds, the memory with its pool, the router, and what each round did.

    points: pos, query_name, doc_id, vec and what the models need. Each round shows the current pool's lessons for a
    working set, draws a budget of points by uncertainty, labels them, tries each set of lessons without one of them
    where lessons matter, folds all that into the memory, and makes lessons of disagreements. Rounds are settled as
    soon as they are drawn, so that no call is repeated. done: a folder to which rollouts are added.
    """
    rolls, router, log = None, None, []
    for r in range(settings.rounds):
        fresh = points if rolls is None else points.join(rolls.where("role = 'main'").select("pos"), "pos", "left_anti")
        subset = fresh.withColumn("_d", sampling.digest(settings.seed + r, "doc_id", "query_name")).orderBy("_d", "pos").limit(settings.working).drop("_d")
        budget = settings.budgets[min(r, len(settings.budgets) - 1)]
        # a bounded working set: `working` points
        scored = settled(_answered(settled(subset), memory, small).withColumn("_one", F.lit(0)))
        if not scored.count():
            break
        within = scored if settings.cap is None else sampling.under_confidence(scored, ["_one"], settings.cap, budget, "pos")
        unsure = F.coalesce(confidence.renormalised_entropy(F.col("p_yes"), F.col("p_no")), F.lit(0.0))
        if router is not None:
            p = router.chance()
            unsure = p * (1 - p)
        shares = sampling.acquisition(within.withColumn("score", unsure), ["_one"], "score", settings.eps)
        drawn = settled(sampling.importance(retrieval.draw(shares, ["_one"], F.col("q"), "pos", budget, settings.seed + r), ["_one"]))
        told = large(drawn).withColumns({"role": F.lit("main"), "left_out": F.lit(-1), "acquisition": F.lit("s_entropy" if router is None else "router")})
        main = settled(told.withColumn("z", confidence.agreement(F.col("small_prediction"), F.col("large_prediction"))))
        parts = [main]
        if settings.leave_out:
            parts.append(settled(_variants(main, points.columns, small, settings)))
        keep = ["pos", "query_name", "doc_id", "role", "left_out", "features", "small_prediction", "confidence", "large_prediction", "z", "q", "weight", "acquisition", "hits"]
        rows = settled(parts[0].select(*keep) if len(parts) == 1 else parts[0].select(*keep).unionByName(parts[1].select(*keep))).withColumn("round_idx", F.lit(r))
        for x in rows.orderBy("pos", F.col("role") != "main", "left_out").collect():  # at most budget x most_calls
            memory.observe(x["query_name"], [(h["experience_id"], np.array(h["phi"], float)) for h in x["hits"] or []], x["small_prediction"], x["large_prediction"], x["confidence"], x["weight"])
        seeded = 0
        if generate is not None:
            wrong = main.where("z = 0 and small_prediction <> 'UNKNOWN' and large_prediction <> 'UNKNOWN' and small_prediction <> large_prediction")
            for x in settled(generate(wrong)).orderBy("query_name", "doc_id").collect():  # at most budget
                if x["status"] == "accepted":
                    seeded += memory.add(Lesson(x["experience_id"], x["query_name"], x["doc_id"], x["experience_text"], x["source_doc_excerpt"] or "", x["vec"] and list(x["vec"]), x["excerpt_vec"] and list(x["excerpt_vec"])))
        rolls = rows if rolls is None else rolls.unionByName(rows)
        if done:
            experiences.write(rows.drop("hits"), done)
        buffer = rolls.where("z is not null").select("features", "z", "q").collect()  # all rounds' budgets
        if len(buffer) >= settings.least_fit:
            inv = 1 / np.maximum([b["q"] for b in buffer], 1e-9)
            found = learners.Logit.fit(np.array([b["features"] for b in buffer], float), np.array([b["z"] for b in buffer]), np.clip(inv / inv.mean(), 0.1, 10))
            router = found or router
        counts = rows.groupBy("role").agg(F.count(F.lit(1)).alias("n")).collect()
        log.append({"round": r, "pool": len(memory.lessons), "seeded": seeded, "fitted": router is not None, **{c["role"]: c["n"] for c in counts}})
    return rolls, memory, router, log


def _answered(points: DataFrame, memory: Memory | None, small: Callable) -> DataFrame:
    """points with lessons, the small verdict and the router's features."""
    told = small(points if memory is None else show(points, memory))
    vector = retrieval.router_vector(routing.point_features(told.columns), F.col("mean_phi"), F.col("mean_p"))
    return told.withColumn("features", vector)


def _variants(main: DataFrame, own: list[str], small: Callable, settings: Joint) -> DataFrame:
    """The labelled points again with one lesson left out, where the answer without any lesson differs."""
    # what the answers added to a point (its own columns: own) must not be there when it is asked again
    given = [*own, "hits", "mean_phi", "mean_p", "lessons"]
    carried = ["large_prediction", "q", "weight", "acquisition"]
    with_hits = main.where(F.size("hits") > 0).select(*given, *carried, F.col("small_prediction").alias("_answer"))
    bare = with_hits.withColumns({"_all_hits": F.col("hits"), "_all_lessons": F.col("lessons"), "hits": F.slice("hits", 1, 0), "lessons": F.slice("lessons", 1, 0), "mean_phi": F.lit(None).cast("array<double>"), "mean_p": F.lit(None).cast("double")})
    told = settled(_answered(bare, None, small))
    gate = told.where(~F.col("small_prediction").eqNullSafe(F.col("_answer")))
    sets = gate.withColumns({"role": F.lit("aug_noexp"), "left_out": F.lit(-1)})
    loo = gate.where((F.size("_all_hits") > 1) & (F.size("_all_hits") + 1 <= settings.most_calls))
    loo = loo.select(*given, *carried, "_all_hits", "_all_lessons", F.explode(F.sequence(F.lit(0), F.size("_all_hits") - 1)).alias("left_out"))
    others = lambda c: F.filter(c, lambda x, i: i != F.col("left_out"))
    loo = loo.withColumns({"hits": others("_all_hits"), "lessons": others("_all_lessons")})
    n = F.size("hits")
    mean = F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda k: F.aggregate("hits", F.lit(0.0), lambda s, h: s + F.get(h["phi"], k)) / n)
    loo = loo.withColumns({"mean_phi": mean, "mean_p": F.aggregate("hits", F.lit(0.0), lambda s, h: s + h["p"]) / n})
    again = _answered(loo, None, small).withColumn("role", F.lit("aug_loo"))
    out = again.unionByName(sets, allowMissingColumns=True) if settings.no_lessons else again
    return out.withColumn("z", confidence.agreement(F.col("small_prediction"), F.col("large_prediction")))


def resumed(spark: SparkSession, path: str, make: Callable[[str], None]) -> bool:
    """Run a stage that writes path, unless it is there already; whether it ran."""
    if exists(spark, path):
        return False
    make(path)
    if not exists(spark, path):
        raise RuntimeError(f"the stage did not write {path}")
    return True


def study(records: DataFrame, share: float, seed: int, kind: str = "gbt", truth: DataFrame | None = None) -> DataFrame:
    """A learned router as a detector of disagreement: fitted on the first share of each predicate's points, frozen, and scored on the rest."""
    phases = settled(sampling.two_phases(records, ["query_name"], share, seed, ["doc_id"]))
    model = learners.fit_router(phases.where("phase = 1"), kind)
    told = learners.predict(model, phases.where("phase = 2"))
    rule = routing.learned(0.5, trained=model is not None)
    return routing.detector_rows(told.withColumn("escalated", F.coalesce(rule, F.lit(True))), truth)


def checked(records: DataFrame) -> DataFrame:
    """Counts of a study's rows."""
    return routing.detector_counts(records).join(metrics.escalation(records, []).select("n_points", "n_escalated"))
