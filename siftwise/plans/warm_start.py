"""Offline warm start: synthetic predicates, actively labelled rollouts, a first router and head."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import confidence, parsing, prompts
from ..operators import learners, retrieval, sampling
from ..sources import clients, experiences
from ..sources.shared import settled

FEATURES = ("confidence", "p_yes", "p_no", "p_unsure", "margin", "entropy_2way", "entropy_3way")


def contrasting_pairs(docs: DataFrame, clusters: int, per_cluster: int, seed: int) -> DataFrame:
    """Documents of different clusters side by side. docs: doc_id, text, vec."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = docs.withColumn("features", array_to_vector("vec"))
    told = KMeans(k=clusters, seed=seed, maxIter=10).fit(ready).transform(ready).select("doc_id", "text", F.col("prediction").alias("cluster"))
    picked = sampling.ordered(told, ["cluster"], [sampling.digest(seed, "doc_id").asc()], per_cluster)
    other = picked.select(F.col("doc_id").alias("other_id"), F.col("text").alias("other_text"), ((F.col("cluster") + clusters - 1) % clusters).alias("cluster"), "order_no")
    return picked.join(other, ["cluster", "order_no"])


def synthesize(pairs: DataFrame, make: Callable[[], clients.Chat]) -> DataFrame:
    """Candidates: conditions written for pairs, kept if a second call confirms both documents' answers."""
    asked = settled(clients.ask(pairs.withColumn("prompt", prompts.predicate_from_pair(F.col("text"), F.col("other_text"))), make))
    written = asked.withColumn("predicate", parsing.flat_json_field(F.col("raw"), "condition")).where("predicate is not null").drop("prompt", "raw", "prompt_tokens", "completion_tokens", "error")
    for name, text, wanted in (("first", "text", "Yes"), ("second", "other_text", "No")):
        checked = clients.ask(written.withColumn("prompt", prompts.confirm(F.col("predicate"), F.col(text))), make)
        written = checked.where(F.coalesce(parsing.parse_leading_yes_no(F.col("raw")) == wanted, F.lit(False))).drop("prompt", "raw", "prompt_tokens", "completion_tokens", "error")
    _, _, cand = experiences.synthetic_ids("predicate")
    one = written.withColumn("answers", F.array(F.struct(F.col("doc_id").alias("d"), F.lit("Yes").alias("a")), F.struct(F.col("other_id").alias("d"), F.lit("No").alias("a"))))
    rows = one.select("predicate", F.explode("answers").alias("x")).select("predicate", F.col("x.d").alias("doc_id"), F.col("x.a").alias("expected_answer"))
    return rows.withColumn("cand_id", cand).select("cand_id", "predicate", "doc_id", "expected_answer", F.lit("pair").alias("source"))


def spread(predicates: DataFrame, docs: DataFrame, per_predicate: int, seed: int) -> DataFrame:
    """Each predicate with a sample of documents of its own: cand_id, predicate, doc_id."""
    shared = docs.select("doc_id").orderBy(sampling.digest(seed, "doc_id"), "doc_id").limit(per_predicate * 4)
    rows = predicates.select("predicate").distinct().join(F.broadcast(shared))  # a bounded sample of documents
    picked = sampling.ordered(rows, ["predicate"], [sampling.digest(seed, "predicate", "doc_id").asc(), F.col("doc_id").asc()], per_predicate)
    _, cand, _ = experiences.synthetic_ids("predicate")
    return picked.withColumn("cand_id", cand).select("cand_id", "predicate", "doc_id")


def uncertainty(scored: DataFrame, model) -> DataFrame:
    """score: entropy of the small verdict before there is a router, then p (1 - p)."""
    if model is None:
        return scored.withColumn("score", confidence.renormalised_entropy(F.col("p_yes"), F.col("p_no")))
    return learners.predict(model, scored).withColumn("score", F.col("p_agree") * (1 - F.col("p_agree"))).drop("p_agree")


def acquire(points: DataFrame, small: Callable, large: Callable, rounds: int, budget: int, working: int, cap: float = 0.95, eps: float = 0.1, seed: int = 0, save: Callable[[DataFrame], DataFrame] = settled):
    """Rollouts of all rounds, the last router (or None) and the shared head.

    Each round takes a fresh working set in digest order, scores it with the small model, draws
    `budget` points in proportion to their uncertainty, labels them with the large one, and refits.
    save must fix a round's rows, since drawing them again would repeat paid calls.
    """
    done, model, head = None, None, learners.SharedHeads(len(FEATURES))
    for r in range(rounds):
        fresh = points if done is None else points.join(done.select("pos"), "pos", "left_anti")
        subset = fresh.withColumn("_d", sampling.digest(seed + r, "doc_id", "query_name")).orderBy("_d", "pos").limit(working).drop("_d")
        scored = save(small(subset).withColumn("features", F.array(*FEATURES)).withColumn("_one", F.lit(0)))
        capped = sampling.under_confidence(scored, ["_one"], cap, budget, "pos")
        shares = sampling.acquisition(uncertainty(capped, model), ["_one"], "score", eps)
        drawn = retrieval.draw(shares, ["_one"], F.col("q"), "pos", budget, seed + r)
        weighed = sampling.importance(drawn, ["_one"])
        labelled = large(weighed).withColumn("z", confidence.agreement(F.col("small_prediction"), F.col("large_prediction")))
        rows = save(labelled.select("pos", "doc_id", "query_name", "features", "small_prediction", F.col("confidence").alias("small_confidence"), "large_prediction", "z", "q", "weight", F.lit(r).alias("round_idx")))
        # at most `budget` rows, in order
        for x in rows.orderBy("pos").select("query_name", "features", "z").collect():
            head.observe(x["query_name"], np.array([x["features"]], float), bool(x["z"]))
        done = rows if done is None else done.unionByName(rows)
        model = learners.fit_router(done, "logistic", weight="weight")
    return done, model, head
