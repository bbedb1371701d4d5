"""All registered queries of the semantic-filter engine, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import confidence, parsing, prompts
from ..operators import baselines, learners, metrics, prefix, retrieval, routing, sampling
from ..operators.memory import Memory, Policy, from_pool
from ..sources import cache, experiences, points as pts, reports
from ..sources.shared import settled
from ..streaming import online
from . import cascade, oracle, replay, stages, warm_start
from . import simulated as sim

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _records(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return cascade.semantic_filter(sim.truths(s, d, "n_chars", *columns), sim.small, sim.large, routing.by_confidence(0.8))


def _with_large(s: SparkSession, d: str, *columns: str) -> DataFrame:
    """Both models' verdicts for every point, and whether the confidence router escalates it."""
    return routing.decide(sim.large(sim.small(sim.truths(s, d, "n_chars", *columns))), routing.by_confidence(0.8))


def _metered(s: SparkSession, d: str) -> DataFrame:
    out = _records(s, d)
    zero = F.lit(0).cast("long")
    sure = F.when(F.col("escalated"), F.col("small_in") * 2).otherwise(zero)
    return out.withColumns({"verify_calls": F.col("escalated").cast("long"), "verify_in": sure, "verify_out": F.col("escalated").cast("long"), "large_in": F.when(F.col("escalated"), F.col("small_in") + 40).otherwise(zero), "large_out": F.col("escalated").cast("long")})


def _point_vectors(s: SparkSession, d: str) -> DataFrame:
    return sim.truths(s, d).join(sim.vectors(s, d), "doc_id").select("pos", "doc_id", "query_name", "vec")


def _hits(s: SparkSession, d: str, k: int = 8) -> DataFrame:
    docs = sim.vectors(s, d)
    return retrieval.top_k(docs, sim.lessons(s, d), ["doc_id"], k, keep=["doc_id"])


# ---- the filter itself

@query
def cascade_confidence(s: SparkSession, d: str) -> DataFrame:
    return _records(s, d).select("doc_id", "query_name", "small_prediction", F.round("confidence", 6).alias("confidence"), "escalated", "large_prediction", "prediction", "ground_truth")


@query
def metrics_overall(s, d):
    return metrics.binary(_records(s, d), [])


@query
def metrics_per_query(s, d):
    r = _records(s, d)
    return metrics.binary(r, ["query_name"]).join(metrics.escalation(r, ["query_name"]), "query_name")


@query
def all_small(s, d):
    out = routing.final(routing.decide(sim.small(sim.truths(s, d)), routing.all_small()).withColumn("large_prediction", F.lit(None).cast("string")))
    return metrics.binary(out, ["query_name"])


@query
def all_big(s, d):
    return metrics.binary(cascade.all_large(sim.truths(s, d), sim.large), ["query_name"])


# ---- points

@query
def points_ordered(s, d):
    p = sim.truths(s, d, _chars=F.length("text")).select("query_name", "doc_id", "_chars")  # orders need no texts
    out = None
    for order in pts.ORDERS:
        one = sampling.ordered(p, ["query_name"], pts.order_key(order, 7, F.col("_chars"))).select(F.lit(order).alias("ordering"), "query_name", "doc_id", F.col("order_no").cast("long").alias("order_no"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def limit_per_query(s, d):
    return sampling.ordered(sim.truths(s, d, "text"), ["query_name"], pts.order_key("longest"), 25).select("query_name", "doc_id", F.col("order_no").cast("long").alias("order_no"))


@query
def point_scan(s, d):
    docs = sim.table(s, d, "documents").select(F.col("doc_id").alias("document_id"), "text")
    pairs = sim.table(s, d, "labels").select(F.col("doc_id").alias("document_id"), F.expr("explode(array(struct('high_quality' AS query_name, CASE WHEN quality = 1 THEN 'Yes' ELSE 'No' END AS ground_truth), struct('unknown_query' AS query_name, CASE WHEN toxic = 1 THEN 'Yes' ELSE 'No' END AS ground_truth)))").alias("x")).select("document_id", "x.*")
    p = pts.points(docs, pairs, sim.predicates(s).select("query_name", "query_description"))
    return p.groupBy("query_name", "query_description", "ground_truth").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query
def query_slice(s, d):
    names = sim.truths(s, d).select("query_name")
    slices = {"first": None, "prefix": "prefix", "all": "all", "list": "toxic, long_doc ,nothing"}
    out = None
    for k, wanted in slices.items():
        one = pts.resolve(names, wanted, ("is_english", "toxic"), "h").select(F.lit(k).alias("slice"), "query_name")
        out = one if out is None else out.union(one)
    return out


@query
def matrix_melt(s, d):
    wide = sim.table(s, d, "labels").select(F.col("doc_id").alias("document_id"), F.when(F.col("quality") == 1, "Yes").otherwise("No").alias("high_quality"), F.when(F.col("toxic") == 1, "Yes").otherwise("No").alias("toxic"))
    return pts.melt(wide)


@query
def manifest(s, d):
    p = sim.truths(s, d)
    chosen = sampling.stratified(p, ["query_name", "ground_truth"], 0.3, 5, ["doc_id"])
    return reports.manifest(p.select("doc_id", "query_name", "ground_truth"), sim.table(s, d, "documents").select("doc_id"), chosen)


@query
def layout(s, d):
    return reports.layout(sim.truths(s, d).withColumn("gold", F.col("ground_truth"))).select("query_name", "doc_id", "gold", F.col("order_no").cast("long").alias("order_no"))


@query
def layout_meta(s, d):
    return reports.layout_meta(sim.truths(s, d, "text"))


@query
def task_package(s, d):
    t = reports.tasks(sim.described(sim.truths(s, d)), "A document.", "Answer:")
    return t.select("query_name", "question", F.md5("instruction").alias("instruction_md5"), "prefix", "suffix", "n_docs")


@query
def small_features(s, d):
    """Cached large answers with log-odds of a small model that lacks every seventh of them, and a stand-in truth that lacks every fifth."""
    p = sim.large(sim.small(sim.truths(s, d))).withColumn("document_id", F.col("doc_id"))
    answers = p.select("document_id", "query_name", F.col("large_prediction").alias("prediction"), "ground_truth")
    small = p.where("h % 7 <> 0").select("document_id", "query_name", (F.col("lp_yes") * 9).alias("logprob_true"), F.col("lp_no").alias("logprob_false"))
    gold = p.where("h % 5 <> 0").select("document_id", "query_name", F.lit("Yes").alias("prediction"))
    rows, _ = pts.with_small(answers, small, gold)
    return rows.select("query_name", "document_id", F.round("log_odds", 6).alias("log_odds"), "gold", "human")


@query
def small_features_lost(s, d):
    p = sim.small(sim.truths(s, d)).withColumn("document_id", F.col("doc_id"))
    answers = p.select("document_id", "query_name", F.col("ground_truth").alias("prediction"), "ground_truth")
    small = p.where("h % 7 <> 0").select("document_id", "query_name", F.col("lp_yes").alias("logprob_true"), F.col("lp_no").alias("logprob_false"))
    return pts.with_small(answers, small)[1]


@query
def ladder_rows(s, d):
    """Two rungs, one of which lacks some points, and the sample's mask."""
    p = sim.small(sim.truths(s, d)).withColumn("document_id", F.col("doc_id"))
    base = p.select("document_id", "query_name", (F.col("lp_yes") - F.col("lp_no")).alias("odds0"))
    rung = p.where("h % 11 <> 0").select("document_id", "query_name", (F.col("lp_yes") * 2).alias("log_odds"))
    mask = p.where("h % 3 = 0").select("document_id", "query_name", F.lit(True).alias("in_sample"))
    out = pts.ladder(base, {"odds1": rung}, mask)
    return out.select("document_id", "query_name", F.round("odds0", 6).alias("odds0"), F.round("odds1", 6).alias("odds1"), "in_sample", "finite")


# ---- scalar rules

def _edge(s, d, values):
    docs = sim.table(s, d, "documents").select("doc_id")
    listed = F.array(*[F.lit(v) for v in values])
    return docs.withColumn("raw", F.get(listed, (F.col("doc_id") % len(values)).cast("int")))


@query
def parse_yes_no(s, d):
    return _edge(s, d, oracle.YES_NO).select("doc_id", parsing.parse_yes_no(F.col("raw")).alias("verdict"))


@query
def parse_3way(s, d):
    return _edge(s, d, oracle.THREE).select("doc_id", parsing.parse_3way(F.col("raw")).alias("verdict"))


@query
def parse_zero_shot(s, d):
    return _edge(s, d, oracle.ZERO_SHOT).select("doc_id", parsing.parse_zero_shot(F.col("raw")).alias("verdict"))


@query
def parse_predicate(s, d):
    return _edge(s, d, oracle.YES_NO).select("doc_id", parsing.parse_leading_yes_no(F.col("raw")).alias("verdict"))


@query
def parse_json(s, d):
    return _edge(s, d, oracle.JSON).select("doc_id", parsing.json_field(F.col("raw"), "lesson").alias("lesson"))


@query
def scan_logprobs(s, d):
    p = sim.small(sim.truths(s, d)).withColumn("lp_top", F.lit(0.5))
    top = F.array(*[F.struct(F.lit(t).alias("token"), F.col(c).alias("logprob")) for t, c in (("True", "lp_yes"), (" n", "lp_no"), ("Un", "lp_unsure"), ("trueish", "lp_top"))])
    words = F.array(F.struct(F.lit("So").alias("token"), F.lit(-0.1).alias("logprob"), F.slice(top, 1, 0).alias("top")), F.struct(F.lit("well").alias("token"), F.lit(-0.2).alias("logprob"), top.alias("top")))
    at = confidence.scan(words)
    return p.select("doc_id", "query_name", F.round(at["yes"], 6).alias("yes"), F.round(at["no"], 6).alias("no"), F.round(at["unsure"], 6).alias("unsure"))


@query
def features_2way(s, d):
    p = sim.small(sim.truths(s, d))
    known = F.col("h") % 7 != 0
    f = confidence.features_2way(F.when(known, F.col("lp_yes")), F.when(known, F.col("lp_no")), F.lit("UNKNOWN"))
    return p.withColumn("f", f).select("doc_id", "query_name", "f.prediction", *[F.round(f"f.{c}", 6).alias(c) for c in ("confidence", "p_yes", "p_no", "margin", "entropy")])


@query
def features_3way(s, d):
    p = sim.small(sim.truths(s, d)).select("doc_id", "query_name", "lp_yes", "lp_no", "lp_unsure")
    f = confidence.features_3way(F.col("lp_yes"), F.col("lp_no"), F.col("lp_unsure"), F.lit("UNKNOWN"))
    p = p.withColumn("f", f).select("doc_id", "query_name", F.col("f.prediction").alias("small_prediction"), "f.*")
    return p.select("doc_id", "query_name", "small_prediction", *[F.round(c, 6).alias(c) for c in ("confidence", "p_yes", "p_no", "p_unsure", "margin", "entropy_2way", "entropy_3way")])


@query
def features_collector(s, d):
    p = sim.small(sim.truths(s, d))
    some = lambda c, k: F.when(F.col("h") % k != 0, F.col(c))
    said = F.element_at(F.array(*[F.lit(v) for v in ("Yes", "No", "unsure", "PARSE_FAIL")]), (F.col("h") % 4).cast("int") + 1)
    f = confidence.collector_features(some("lp_yes", 3), some("lp_no", 2), some("lp_unsure", 5), said)
    return p.withColumn("f", f).select("doc_id", "query_name", *[F.round(f"f.{c}", 6).alias(c) for c in ("p_true", "p_false", "p_unsure", "confidence", "entropy")])


@query
def parse_match(s, d):
    return _edge(s, d, oracle.MATCH).select("doc_id", parsing.parse_match_json(F.col("raw")).alias("verdict"))


@query
def parse_flat_json(s, d):
    return _edge(s, d, oracle.FLAT).select("doc_id", parsing.flat_json_field(F.col("raw"), "condition").alias("condition"))


@query
def yes_as_int(s, d):
    return _edge(s, d, oracle.TRUTHY).select("doc_id", parsing.yes_as_int(F.col("raw")).alias("label"), parsing.truthy(F.col("raw")).alias("truthy"))


@query
def collector_scan(s, d):
    p = sim.small(sim.truths(s, d))
    top = F.array(*[F.struct(F.lit(t).alias("token"), F.col(c).alias("logprob")) for t, c in ((" True", "lp_yes"), ("false}", "lp_no"), ("sure", "lp_unsure"))])
    word = lambda t, v, top: F.struct(F.lit(t).alias("token"), F.lit(v).alias("logprob"), top.alias("top"))
    at = confidence.collector_scan(F.array(word("{", -0.1, top), word(' "', -0.2, top), word("false", -0.3, top)))
    return p.select("doc_id", "query_name", F.round(at["yes"], 6).alias("yes"), F.round(at["no"], 6).alias("no"), F.round(at["unsure"], 6).alias("unsure"))


@query
def legacy_confidence(s, d):
    p = sim.small(sim.truths(s, d))
    known = F.col("h") % 7 != 0
    f = confidence.features_2way(F.when(known, F.col("lp_yes")), F.when(known, F.col("lp_no")), F.lit("No"))
    t = p.withColumn("f", f).withColumn("t", confidence.legacy(F.col("f"), F.lit("No.")))
    return t.select("doc_id", "query_name", "t.prediction", F.round("t.confidence", 6).alias("confidence"), "t.raw", F.round("f.logprob_yes", 6).alias("logprob_yes"), "f.logprobs_available")


def _history(s, d, *columns):
    """Every point with both verdicts and the histories of its predicate and document before it."""
    r = _with_large(s, d, *columns)
    q = prefix.history(r.select("pos", "query_name", "escalated", "small_prediction", "large_prediction"), "query_name", "query").select("pos", "n_query", "agree_query", "query_seen", "query_rate")
    o = prefix.history(r.select("pos", "doc_id", "escalated", "small_prediction", "large_prediction"), "doc_id", "doc").select("pos", "n_doc", "agree_doc", "doc_seen", "doc_rate")
    return sim.described(r.join(q, "pos").join(o, "pos"))


def _listed(c):
    return F.array_join(F.transform(c, lambda x: F.round(x * 10000).cast("long").cast("string")), ",")


@query
def point_features(s, d):
    p = _history(s, d, "text").withColumn("p_yes", F.when(F.col("h") % 23 != 0, F.col("p_yes")))
    return p.select("doc_id", "query_name", _listed(routing.point_features(p.columns)).alias("features"))


@query
def s_entropy(s, d):
    p = sim.small(sim.truths(s, d)).withColumn("p_yes", F.when(F.col("h") % 11 != 0, F.col("p_yes")))
    return p.select("doc_id", "query_name", F.round(confidence.renormalised_entropy(F.col("p_yes"), F.col("p_no")), 6).alias("s_entropy"))


@query
def z_label(s, d):
    r = _with_large(s, d).withColumn("large_prediction", F.when(F.col("h") % 13 != 0, F.col("large_prediction")))
    return r.select("doc_id", "query_name", confidence.agreement(F.col("small_prediction"), F.col("large_prediction")).alias("z"))


@query
def clipped_sigmoid(s, d):
    p = sim.small(sim.truths(s, d))
    return p.select("doc_id", "query_name", F.round(confidence.clipped_sigmoid((F.col("lp_yes") - F.col("lp_no")) * 5), 6).alias("p"))


@query
def synthetic_ids(s, d):
    p = sim.truths(s, d).withColumn("predicate", F.concat(F.lit(" "), F.col("query_name"), F.lit(" ")))
    a, b, c = experiences.synthetic_ids()
    return p.select("doc_id", "query_name", a.alias("synthq"), b.alias("md"), c.alias("dc"), experiences.experience_id().alias("experience_id"))


# ---- prompts

def _demos(s, d):
    return F.array(F.struct(F.lit("a first text").alias("text"), F.lit("Yes").alias("label")), F.struct(F.lit("a second text").alias("text"), F.lit("No").alias("label")))


def _prompted(s, d):
    names = sim.predicates(s).select("query_name", "query_description")
    return sim.truths(s, d, "text").join(F.broadcast(names), "query_name")


@query
def prompt_small(s, d):
    lessons = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("Look at the title."), F.lit("Ignore quotes."))).otherwise(F.array().cast("array<string>"))
    m = prompts.chat(F.col("query_description"), F.col("text"), lessons, _demos(s, d), "three")
    return _prompted(s, d).select("doc_id", "query_name", F.md5(prompts.rendered(m)).alias("prompt_md5"), F.size(m).cast("long").alias("n_messages"))


@query
def prompt_two_way(s, d):
    m = prompts.chat(F.col("query_description"), F.col("text"), F.array().cast("array<string>"), F.slice(_demos(s, d), 1, 1), "two")
    return _prompted(s, d).select("doc_id", "query_name", F.md5(prompts.rendered(m)).alias("prompt_md5"))


@query
def prompt_verify(s, d):
    p = prompts.verify(F.array(F.lit("demo one"), F.lit("demo two")), F.col("query_description"), F.col("text"), F.lit("Yes"))
    return _prompted(s, d).select("doc_id", "query_name", F.md5(p).alias("prompt_md5"))


@query
def prompt_lesson(s, d):
    c, t = F.col("query_description"), F.col("text")
    return _prompted(s, d).select("doc_id", "query_name", F.md5(prompts.explain(c, t, F.lit("No"))).alias("explain_md5"), F.md5(prompts.lesson(c, t, F.lit("No"), F.lit("Yes"), F.lit("because"))).alias("lesson_md5"))


@query
def prompt_predicate(s, d):
    t = F.col("text")
    return _prompted(s, d).select("doc_id", "query_name", F.md5(prompts.confirm(F.col("query_description"), t)).alias("confirm_md5"), F.md5(prompts.predicate_from_pair(t, F.reverse(t))).alias("pair_md5"), F.md5(prompts.instruction(F.lit("Read {"), t, F.lit("}."))).alias("task_md5"))


@query
def prompt_zero_shot(s, d):
    told = [F.md5(prompts.rendered(prompts.zero_shot(F.col("query_description"), F.col("text"), v))).alias(f"{v}_md5") for v in prompts.ZERO_SHOT]
    return _prompted(s, d).select("doc_id", "query_name", *told)


# ---- cache

def _cache_rows(s, d):
    docs = sim.table(s, d, "documents").select("doc_id", "lang", "n_chars")
    one = lambda no, keep, pred, raw: docs.where(keep).select(F.lit("is_english").alias("query_name"), F.when(F.col("doc_id") % 29 == 0, F.concat(F.lit("x"), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string")).alias("doc_id"), pred.alias("prediction"), raw.alias("raw"), F.lit(no).alias("source_no"), F.col("n_chars").alias("line_no"))
    first = one(1, F.col("doc_id") % 3 != 0, F.when(F.col("lang") == "en", "Yes").otherwise("No"), F.lit("first"))
    second = one(2, F.col("doc_id") % 5 == 0, F.when(F.col("doc_id") % 2 == 0, "UNKNOWN").otherwise(F.lit("  ")), F.lit("No, it is not."))
    return first.union(second)


@query
def cache_last_wins(s, d):
    return cache.merge(_cache_rows(s, d))


@query
def cache_probe(s, d):
    p = sim.truths(s, d).select("query_name", "doc_id")
    return cache.probe(p, cache.merge(_cache_rows(s, d)))


@query
def cache_misses(s, d):
    p = sim.truths(s, d).select("query_name", "doc_id")
    return cache.misses(p, cache.merge(_cache_rows(s, d)))


@query
def cache_stats(s, d):
    merged = cache.merge(_cache_rows(s, d))
    return cache.stats(cache.probe(sim.truths(s, d), merged), merged).withColumn("stores", F.col("stores").cast("long"))


@query
def cascade_cached(s, d):
    r = cascade.semantic_filter(sim.truths(s, d), sim.small, sim.large, routing.by_confidence(0.8), cache.merge(_cache_rows(s, d)))
    return r.groupBy("query_name").agg(F.count_if("from_cache").alias("from_cache"), F.count_if(F.col("escalated") & ~F.col("from_cache")).alias("live"), F.count_if(F.col("prediction") == F.col("ground_truth")).alias("correct"))


# ---- cost and reports

@query
def token_summary(s, d):
    return metrics.tokens(_metered(s, d))


@query
def cost_usd(s, d):
    return metrics.cost(_metered(s, d), ["query_name"])


@query
def cost_abort(s, d):
    return prefix.until_cost(_metered(s, d).select("pos", "doc_id", "query_name", "escalated", "small_in", "small_out", "large_in"), metrics.point_cost(), 0.02).select("pos", "doc_id", "query_name", F.round("spent", 9).alias("spent"))


@query
def timing_summary(s, d):
    r = _records(s, d).withColumns({"t_small": (F.col("h") % 50) / 100.0, "t_large": F.when(F.col("escalated"), (F.col("h") % 30) / 10.0), "t_retrieve": (F.col("doc_id") % 10) / 1000.0})
    return metrics.timings(r, ["t_small", "t_large", "t_retrieve"])


@query
def frontier_delta(s, d):
    told = settled(_records(s, d))
    r = metrics.binary(told, ["query_name"]).select(F.col("query_name").alias("name"), "accuracy").join(metrics.escalation(told, ["query_name"]).select(F.col("query_name").alias("name"), "escalation_rate"), "name")
    f = s.createDataFrame([(0.1, 0.7), (0.4, 0.8), (0.45, 0.86), (0.9, 0.95)], "esc double, acc double")
    return metrics.frontier_delta(r.select("name", F.col("escalation_rate").alias("esc"), F.col("accuracy").alias("acc")), f)


@query
def frontier_delta_f1(s, d):
    r = settled(_records(s, d))
    told = metrics.binary(r, ["query_name"]).select(F.col("query_name").alias("name"), "f1").join(metrics.escalation(r, ["query_name"]).select(F.col("query_name").alias("name"), F.col("escalation_rate").alias("esc")), "name")
    f = s.createDataFrame([(0.1, 0.6), (0.4, 0.75), (0.45, 0.8), (0.9, 0.9)], "esc double, f1 double")
    return metrics.frontier_delta(told, f, "f1")


@query
def accuracy_per_query(s, d):
    return metrics.accuracies(_records(s, d))


@query
def record_projection(s, d):
    r = reports.projected(_metered(s, d).withColumn("p_agree", F.lit(None).cast("double")))
    return r.select("doc_id", "query_name", "prediction", "routed_to", "small_prediction", "small_confidence", "escalated", "router_bootstrap", "small_prompt_tokens", "large_prompt_tokens", "verify_small_calls", "small_p_yes", "small_p_unsure")


@query
def call_log_summary(s, d):
    r = _metered(s, d)
    log = r.select(F.when(F.col("doc_id") % 4 == 0, "discover").otherwise("apply").alias("phase"), F.when(F.col("escalated"), "large").otherwise("small").alias("model"), F.col("query_name").alias("kind"), F.col("small_in").alias("tokens_in"), F.col("small_out").alias("tokens_out"), (F.col("small_in") * 1e-8).alias("usd"))
    return metrics.calls(log)


@query
def overhead_cost(s, d):
    r = _metered(s, d)
    return baselines.overheads(r.select(F.when(F.col("doc_id") % 4 == 0, "discover").otherwise("apply").alias("phase"), (F.col("small_in") * 1e-8).alias("usd")))


@query
def variant_summary(s, d):
    r = _records(s, d).select("query_name", "prediction", "ground_truth", (F.col("doc_id") % 5 == 0).alias("is_test"), F.when(F.col("escalated"), "deep").otherwise("plain").alias("variant"), F.when(F.col("doc_id") % 2 == 0, 0.9).otherwise(0.95).alias("alpha"))
    return metrics.variants(r)


# ---- retrieval

def _doc_hits(h):
    return h.select("doc_id", "experience_id", F.round("cos", 6).alias("cos"), F.col("rank").cast("long").alias("rank"))


@query
def topk_cosine(s, d):
    return _doc_hits(_hits(s, d))


@query
def topk_same_query(s, d):
    h = retrieval.top_k(_point_vectors(s, d), sim.lessons(s, d), ["query_name", "doc_id"], 3, same_query=True)
    return h.select("query_name", "doc_id", "experience_id", F.round("cos", 6).alias("cos"), F.col("rank").cast("long").alias("rank"))


def _counters(s, d):
    return sim.lessons(s, d).select("experience_id", (F.col("source_doc_id") % 7).alias("pos"), (F.col("source_doc_id") % 4).alias("neg"))


@query
def helpfulness_rerank(s, d):
    h = retrieval.by_helpfulness(_hits(s, d, 16), _counters(s, d), ["doc_id"], 8)
    return h.select("doc_id", "experience_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query
def mmr_select(s, d):
    own = sim.lessons(s, d).select("experience_id", F.col("vec").alias("exp_vec"))
    short = _hits(s, d, 6).select("doc_id", "experience_id", "cos").join(own, "experience_id")
    return retrieval.mmr(short, ["doc_id"], 2, 0.7).withColumn("rank", F.col("rank").cast("long"))


@query
def weighted_draw(s, d):
    h = retrieval.draw(_hits(s, d, 16).drop("rank"), ["doc_id"], F.greatest((F.col("cos") + 1) / 2, F.lit(0.0)), "experience_id", 4, 3)
    return h.select("doc_id", "experience_id", "rank")


@query
def fewshot_topk(s, d):
    known = sim.small(sim.truths(s, d)).select("pos", "doc_id", "query_name", F.col("small_prediction").alias("prediction"), F.when(F.col("h") % 2 == 0, "large").otherwise("small").alias("produced_by"))
    r = settled(known.join(sim.vectors(s, d), "doc_id"))
    h = retrieval.demonstrations(r, r, 2, ("large",))
    return h.select("query_name", "doc_id", "demo_doc", "label", F.round("cos", 6).alias("cos"), F.col("rank").cast("long").alias("rank"))


@query
def bm25_idf(s, d):
    return retrieval.bm25_corpus(sim.table(s, d, "documents")).withColumn("idf", F.round("idf", 6))


@query
def bm25_score(s, d):
    return retrieval.bm25(sim.table(s, d, "documents"), sim.lessons(s, d)).withColumn("bm25", F.round("bm25", 6))


def _seen(s, d, k=8):
    """Shown lessons of escalated points with both verdicts."""
    r = _with_large(s, d).where("escalated").select("pos", "doc_id", "query_name", "escalated", "small_prediction", "large_prediction", F.col("large_prediction").alias("final"), F.col("confidence").alias("small_confidence"))
    return _hits(s, d, k).select("doc_id", "experience_id", "rank").join(r, "doc_id")


def _featured(s, d, k=4):
    """The nearest lessons of every point with their 19 features, under the counters of the whole run."""
    names, few = ["query_name", "source_query"], F.broadcast
    pool = sim.with_sources(sim.lessons(s, d), s, d)
    qv = s.createDataFrame(sorted(sim.query_vectors(s, d).items()), "query_name string, qvec array<double>")
    pairs = qv.crossJoin(qv.select(F.col("query_name").alias("source_query"), F.col("qvec").alias("svec")))  # predicates by predicates: 25 rows
    pairs = pairs.select(*names, retrieval.dot(F.col("qvec"), F.col("svec")).alias("cos_query_source"))
    asked = pool.select("experience_id", "vec").crossJoin(few(qv)).select("query_name", "experience_id", retrieval.dot(F.col("qvec"), F.col("vec")).alias("cos_query_text"))  # lessons by predicates
    hits = retrieval.top_k(sim.vectors(s, d), sim.lessons(s, d), ["doc_id"], k).withColumnRenamed("cos", "cos_doc_text")
    hits = hits.join(few(pool.select("experience_id", "source_doc_id", "excerpt_vec")), "experience_id").withColumn("cos_doc_source", retrieval.dot(F.col("vec"), F.col("excerpt_vec"))).drop("vec", "excerpt_vec")
    hits = retrieval.bm25_of_hits(hits, sim.table(s, d, "documents"), pool, {"experience_text": "bm25_text", "source_doc_excerpt": "bm25_source"})
    seen = settled(_seen(s, d))
    own = metrics.helpfulness(seen, ["experience_id"]).withColumnsRenamed({"pos": "good", "neg": "bad"})
    by_query = metrics.helpfulness(seen, ["experience_id", "query_name"]).withColumnsRenamed({"pos": "good_q", "neg": "bad_q"})
    p = prefix.position(_history(s, d).select("pos", "doc_id", "query_name", "n_query", "agree_query", "n_doc", "agree_doc").withColumn("_all", F.lit(0)), ["_all"], "pos")
    p = p.join(F.broadcast(p.agg(F.count(F.lit(1)).alias("total")))).withColumn("stream_pos", F.col("t") / F.col("total"))
    rows = p.join(hits, "doc_id").join(few(pairs), names).join(few(asked), ["query_name", "experience_id"]).join(few(own), "experience_id", "left").join(few(by_query), ["experience_id", "query_name"], "left")
    return retrieval.features(rows)


@query
def phi_features(s, d):
    return _featured(s, d).select("query_name", "doc_id", "experience_id", *[F.round(F.get("phi", F.lit(i)), 6).alias(n) for i, n in enumerate(retrieval.PHI)])


@query
def router_signals(s, d):
    h = retrieval.top_k(_point_vectors(s, d), sim.lessons(s, d), ["query_name", "doc_id"], 8).drop("vec")
    seen = settled(_seen(s, d))
    return retrieval.signals(h, metrics.helpfulness(seen, ["experience_id"]), metrics.helpfulness(seen, ["experience_id", "query_name"]), sim.lessons(s, d), ["query_name", "doc_id"])


#: A head's mean for queries that need one; a pattern, not a trained one.
HEAD = [round((i % 5 - 2) / 4, 2) for i in range(len(retrieval.PHI))]


def _under_head(s, d, k=4):
    """Shown lessons with the chance and the variance that HEAD with a unit spread gives."""
    h = _featured(s, d, 2 * k)
    own = retrieval.by_head(h, HEAD, ["query_name", "doc_id"], k)
    return own.withColumn("var", F.round(retrieval.dot(F.col("phi"), F.col("phi")), 9))


@query
def head_rerank(s, d):
    return _under_head(s, d).select("query_name", "doc_id", "experience_id", F.round("p", 6).alias("p"), F.col("rank").cast("long").alias("rank"))


@query
def head_signals(s, d):
    return retrieval.head_signals(_under_head(s, d), ["query_name", "doc_id"], 100)


@query
def bandit_rerank(s, d):
    unit = [[float(i == j) / 2 for j in range(len(HEAD))] for i in range(len(HEAD))]
    r = retrieval.by_bandit(_featured(s, d, 8), HEAD, unit, 1.0, ["query_name", "doc_id"], 4)
    return r.select("query_name", "doc_id", "experience_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query
def router_vector(s, d):
    """All 34 numbers of every point: its own 14, the mean features of its lessons, and their mean chance under HEAD."""
    mean = retrieval.mean_features(_under_head(s, d), ["query_name", "doc_id"])
    p = _history(s, d, "text").join(mean.where("doc_id % 3 <> 0"), ["query_name", "doc_id"], "left")
    v = retrieval.router_vector(routing.point_features(p.columns), F.col("mean_phi"), F.col("mean_p"))
    return p.select("query_name", "doc_id", F.size(v).cast("long").alias("width"), _listed(F.slice(v, 15, 20)).alias("set_part"))


@query
def rollout_vector(s, d):
    """What pretraining without lessons gives a router: 14 numbers with neutral histories, and zeros."""
    p = sim.described(sim.small(sim.truths(s, d, "text")))
    v = retrieval.router_vector(routing.point_features(p.columns), F.lit(None).cast("array<double>"), F.lit(None).cast("double"))
    return p.select("query_name", "doc_id", _listed(v).alias("features"))


# ---- prefix state

@query
def query_history(s, d):
    return prefix.history(_with_large(s, d), "query_name", "query").select("pos", "query_name", F.col("n_query").cast("long").alias("n_query"), F.col("agree_query").cast("long").alias("agree_query"), "query_seen", "query_rate")


@query
def doc_history(s, d):
    return prefix.history(_with_large(s, d), "doc_id", "doc").select("pos", "doc_id", F.col("n_doc").cast("long").alias("n_doc"), F.col("agree_doc").cast("long").alias("agree_doc"), "doc_seen", "doc_rate")


@query
def position_gate(s, d):
    return prefix.gate(_with_large(s, d), 1.5, 1 << 30).select("pos", "query_name", F.col("t").cast("long").alias("t"), "n_q", "trigger")


@query
def generation_cap(s, d):
    return prefix.gate(_with_large(s, d), 0.5, 5).where("trigger").select("pos", "query_name", "doc_id")


@query
def stream_position(s, d):
    r = prefix.position(sim.truths(s, d).withColumn("_all", F.lit(0)), ["_all"], "pos")
    n = sim.truths(s, d).agg(F.count(F.lit(1)).alias("total"))
    return r.join(n).select("pos", F.round(F.least(F.col("t") / F.col("total"), F.lit(1.0)), 6).alias("stream_pos"))


@query
def generation_cap_released(s, d):
    """Slots under the cap when the lessons of every third document fail."""
    return prefix.gate(_with_large(s, d), 0.5, 5, F.col("doc_id") % 3 == 0).where("trigger").select("pos", "query_name", "doc_id")


@query
def helpfulness_prefix(s, d):
    h = prefix.helpfulness(_seen(s, d, 4), ["experience_id"])
    return h.select("pos", "experience_id", F.col("pos_all").cast("long").alias("pos_all"), F.col("neg_all").cast("long").alias("neg_all"))


@query
def helpfulness_prefix_query(s, d):
    h = prefix.helpfulness(_seen(s, d, 4), ["experience_id", "query_name"], weighted=True)
    return h.select("pos", "experience_id", F.round("pos_query", 6).alias("pos_query"), F.round("neg_query", 6).alias("neg_query"))


@query
def helpfulness_weighted(s, d):
    return metrics.helpfulness(_seen(s, d), ["experience_id"], weighted=True)


@query
def helpfulness_rollup(s, d):
    return metrics.rollup(metrics.helpfulness(_seen(s, d), ["experience_id"]))


@query
def helpfulness_counters(s, d):
    return metrics.helpfulness(_seen(s, d), ["experience_id", "query_name"])


@query
def usage_recordings(s, d):
    h = retrieval.top_k(_point_vectors(s, d), sim.lessons(s, d), ["query_name", "doc_id"], 4)
    u = metrics.usage(h.select("experience_id", "query_name", F.col("rank").cast("long").alias("rank")))
    own = F.array_join(F.transform(F.sort_array(F.map_entries("by_query")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return u.withColumn("by_query", own)


@query
def trigger_usage(s, d):
    t = prefix.gate(_with_large(s, d), 0.5, 40).where("trigger").select("query_name", "doc_id")
    installs = t.where("doc_id % 2 = 0").withColumn("experience_id", F.format_string("exp_%03d", (F.col("doc_id") % 40)))
    used = metrics.usage(_hits(s, d).withColumn("query_name", F.lit("x")).select("experience_id", "query_name", "rank")).select("experience_id", "times_retrieved")
    return metrics.triggers_with_use(t, installs, used)


@query
def trigger_summary(s, d):
    t = prefix.gate(_with_large(s, d), 0.5, 40).where("trigger").select("query_name", "doc_id", F.when(F.col("doc_id") % 2 == 0, F.format_string("exp_%03d", F.col("doc_id") % 40)).alias("experience_id"))
    return metrics.trigger_summary(t)


@query
def generation_log(s, d):
    """What a generation stage's log adds up to: every fifth call fails, and every seventh answer cannot be read."""
    t = prefix.gate(_with_large(s, d), 0.5, 50).where("trigger")
    status = F.when(F.col("doc_id") % 5 == 0, "error").when(F.col("doc_id") % 7 == 0, "unreadable").otherwise("accepted")
    rows = t.select("query_name", status.alias("status"), F.lit(10).alias("explain_in"), F.lit(2).alias("explain_out"), F.lit(20).alias("lesson_in"), F.lit(4).alias("lesson_out"), ((F.col("doc_id") % 8) / 8.0).alias("explain_s"), F.lit(0.5).alias("lesson_s"))
    return stages.generation_stats(rows, ["query_name"])


@query
def loo_gated(s, d):
    """Sets of lessons with the variants worth trying: where the answer without any lesson (here by document number) differs."""
    ids = _hits(s, d, 3).groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "experience_id"))), lambda x: x["experience_id"]).alias("ids"))
    sets = ids.withColumns({"answer": F.lit("Yes"), "answer_without": F.when(F.col("doc_id") % 4 == 0, "No").otherwise("Yes")})
    return retrieval.set_variants(sets).select("doc_id", "role", F.col("left_out").cast("long").alias("left_out"), F.array_join("kept", ",").alias("kept"))


@query
def loo_variants(s, d):
    sets = _hits(s, d, 3).groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "experience_id"))), lambda x: x["experience_id"]).alias("ids"))
    return retrieval.leave_one_out(sets).select("doc_id", F.col("left_out").cast("long").alias("left_out"), "without", F.array_join("kept", ",").alias("kept"))


# ---- sampling

@query
def stratified_sample(s, d):
    return sampling.stratified(sim.truths(s, d), ["query_name", "ground_truth"], 0.15, 3, ["doc_id"]).select("query_name", "ground_truth", "doc_id")


@query
def two_phase_split(s, d):
    return sampling.two_phases(sim.truths(s, d), ["query_name"], 0.6, 11, ["doc_id"]).select("query_name", "doc_id", "phase")


@query
def seed_until_both(s, d):
    p = sim.truths(s, d).withColumn("label", F.col("truth").cast("int"))
    return sampling.until_both(p, ["query_name"], 4, 3, ["doc_id"]).select("query_name", "doc_id", F.col("order_no").cast("long").alias("order_no"))


@query
def acq_distribution(s, d):
    p = sim.small(sim.truths(s, d)).withColumn("score", F.col("confidence") - 0.6)
    return sampling.acquisition(p, ["query_name"], "score", 0.1).select("query_name", "doc_id", F.round(F.col("q") * 1000, 6).alias("q_milli"))


@query
def ips_weights(s, d):
    p = sampling.acquisition(sim.small(sim.truths(s, d)).withColumn("score", 1 - F.col("confidence")), ["query_name"], "score", 0.2)
    return sampling.importance(p, ["query_name"]).select("query_name", "doc_id", F.round("weight", 6).alias("weight"))


@query
def conf_cap(s, d):
    p = sim.small(sim.truths(s, d)).withColumn("confidence", F.round("confidence", 6))
    return sampling.under_confidence(p, ["query_name"], 0.5, 120, "doc_id").select("query_name", "doc_id", "confidence")


@query
def surest_batch(s, d):
    p = sim.small(sim.truths(s, d)).withColumn("p", F.round("p_yes", 6))
    return sampling.surest(p, ["query_name"], "p", "doc_id", 20).select("query_name", "doc_id", F.col("rank").cast("long").alias("rank"))


@query
def train_val_split(s, d):
    return sampling.held_back(sim.truths(s, d), ["query_name"], 0.15, 9, ["doc_id"]).select("query_name", "doc_id", "is_val")


@query
def random_pairs(s, d):
    return sampling.random_pairs(sim.table(s, d, "documents"), 40, 3).select("pair", "doc_id", "other_id")


@query
def smoothed_histogram(s, d):
    h = baselines.histogram(_ladder_rows(s, d), ["query_name"], "p_yes", 0.0, 1.0)
    return sampling.moving_average(h, ["query_name"], "bin", "n", "smooth").select("query_name", "bin", F.round("smooth", 6).alias("smooth"))


@query
def candidates_with_docs(s, d):
    """Candidates whose document exists: every second one names a document far beyond the last."""
    docs = sim.table(s, d, "documents").select("doc_id", "text")
    cands = sim.truths(s, d).select(F.when(F.col("pos") % 2 == 0, F.col("doc_id")).otherwise(F.col("doc_id") + 10**9).alias("doc_id"), F.col("query_name").alias("predicate"))
    return cands.join(docs, "doc_id").select("doc_id", "predicate", F.length("text").cast("long").alias("chars"))


# ---- routers

@query
def automix_threshold(s, d):
    p = sim.small(sim.truths(s, d))
    votes = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when((F.col("h") + i * 13) % 5 < 3, "The answer is Correct").when((F.col("h") + i * 13) % 5 == 3, "incorrect").otherwise("hm"))
    out = routing.decide(p.withColumn("verify_score", F.round(routing.verify_score(votes), 6)), routing.by_verification(0.75))
    return out.select("doc_id", "query_name", "verify_score", "escalated")


@query
def router_bootstrap(s, d):
    return routing.decide(sim.small(sim.truths(s, d)), routing.learned(0.5, trained=False)).select("doc_id", "query_name", "escalated")


@query
def router_veto(s, d):
    p = sim.small(sim.truths(s, d)).withColumn("p_agree", F.when(F.col("h") % 17 != 0, (F.col("h") % 100) / 100.0))
    return routing.decide(p, routing.learned(0.6, veto=0.85)).select("doc_id", "query_name", "escalated")


@query
def detector_meta(s, d):
    return routing.detector_counts(sim.small(sim.truths(s, d)).withColumn("p_agree", F.when(F.col("h") % 17 != 0, 0.5)))


def _router_rows(s, d):
    r = _with_large(s, d, "text")
    return cascade.light(r.withColumn("features", F.array("confidence", "p_yes", "p_no", "p_unsure", "margin", "entropy_2way", "entropy_3way")).withColumn("z", confidence.agreement(F.col("small_prediction"), F.col("large_prediction"))))


def _fitted(s, d, kind, calibrate=None):
    rows = settled(sampling.two_phases(_router_rows(s, d), ["query_name"], 0.6, 1, ["doc_id"]))
    model = learners.fit_router(rows.where("phase = 1"), kind, calibrate=calibrate)
    out = learners.predict(model, rows.where("phase = 2"))
    return out.select("doc_id", "query_name", "z", F.round("p_agree", 6).alias("p_agree"), (F.col("p_agree") < 0.5).alias("escalated"))


@query
def detector_rows(s, d):
    """A study's rows where the large verdict of escalated points comes from the run and of others from a table of answers."""
    r = sim.small(sim.truths(s, d)).withColumn("p_agree", F.when(F.col("h") % 17 != 0, 0.5))
    r = routing.decide(r, routing.by_confidence(0.8))
    large = sim.large(sim.truths(s, d)).select("query_name", "doc_id", F.col("large_prediction").alias("oracle_label"))
    own = r.join(large, ["query_name", "doc_id"]).withColumn("large_prediction", F.when(F.col("escalated"), F.col("oracle_label"))).drop("oracle_label")
    return routing.detector_rows(own, large)


@query
def log_loss(s, d):
    r = _with_large(s, d).withColumns({"z": confidence.agreement(F.col("small_prediction"), F.col("large_prediction")), "p_agree": F.col("confidence")})
    return learners.log_loss(r)


@query
def router_forest(s, d):
    return _fitted(s, d, "forest", "sigmoid")


@query
def router_mlp(s, d):
    return _fitted(s, d, "mlp")


@query
def router_gbt(s, d):
    return _fitted(s, d, "gbt")


@query
def router_logistic(s, d):
    return _fitted(s, d, "logistic", "isotonic")


# ---- comparison cascades

def _ladder_rows(s, d):
    p = sim.large(sim.small(sim.truths(s, d)))
    odds = F.col("lp_yes") - F.col("lp_no")
    return p.withColumns({"odds0": odds, "odds1": odds * 2 + F.when(F.col("h") % 3 == 0, 4.0).otherwise(-1.0), "large": (F.col("large_prediction") == "Yes").cast("int"), "truth": F.col("truth").cast("int")})


@query
def scaledoc_histogram(s, d):
    return baselines.histogram(_ladder_rows(s, d), ["query_name"], "p_yes", 0.0, 1.0)


@query
def scaledoc_sweep(s, d):
    return baselines.band_sweep(_ladder_rows(s, d), ["query_name"], "p_yes", [i / 32 for i in range(33)], [i / 10 for i in range(1, 11)])


@query
def best_threshold(s, d):
    return baselines.best_threshold(_ladder_rows(s, d).withColumn("x", F.round("p_yes", 4)), ["query_name"], "x")


@query
def stretto_simulate(s, d):
    out = baselines.ladder(_ladder_rows(s, d), [("odds0", -2.0, 2.5, True), ("odds0", 0.0, 0.0, False), ("odds1", -1.0, 3.0, True)])
    return out.select("doc_id", "query_name", F.col("rung").cast("long").alias("rung"), F.col("verdict").cast("long").alias("verdict"))


@query
def rung_counts(s, d):
    out = baselines.ladder(_ladder_rows(s, d), [("odds0", -2.0, 2.5, True), ("odds1", -1.0, 3.0, True)])
    return out.groupBy("query_name", F.col("rung").cast("long").alias("rung")).agg(F.count(F.lit(1)).alias("n"))


@query
def uqe_served(s, d):
    p = sim.large(sim.small(sim.truths(s, d))).withColumns({"labelled": F.col("doc_id") % 4 == 0, "proxy": F.round("p_yes", 6), "large_prediction": F.when(F.col("h") % 19 == 0, "UNKNOWN").otherwise(F.col("large_prediction"))})
    return baselines.served(p).select("doc_id", "query_name", "served")


@query
def lightproxy_outcomes(s, d):
    p = sim.large(sim.small(sim.truths(s, d))).withColumns({"probed": F.col("doc_id") % 5 == 0, "proxy": F.round("p_yes", 6)})
    return baselines.proxy_outcomes(p, ["query_name"], 0.8)


@query
def taskcascade_replay(s, d):
    p = sim.large(sim.small(sim.truths(s, d)))
    one = lambda name, x: p.select("doc_id", "query_name", F.lit(name).alias("stage"), F.when(x >= 0.5, "Yes").otherwise("No").alias("prediction"), F.greatest(x, 1 - x).alias("confidence"), "large_prediction")
    rows = one("a", F.round("p_yes", 6)).union(one("b", F.round(1 - F.col("p_no"), 6)))
    stages = s.createDataFrame([("a", 1, 0.8, 0.9), ("b", 2, 0.7, 0.75)], "stage string, stage_no int, yes_at double, no_at double")
    return baselines.replay(rows, stages, ["doc_id", "query_name"])


@query
def cascade_against_gold(s, d):
    r = _with_large(s, d)
    return metrics.against_gold(routing.final(r), ["query_name"])


@query
def served_confusion(s, d):
    p = sim.large(sim.small(sim.truths(s, d))).withColumns({"served": (F.col("p_yes") >= 0.5).cast("int"), "gold": F.col("truth").cast("int")})
    return metrics.confusion(p, ["query_name"], "served", "gold", F.col("h") % 19 == 0)


@query
def band_outcome(s, d):
    """A fixed band, with every tenth document labelled: what the proxy, the band and the sample serve."""
    return baselines.banded(_ladder_rows(s, d).withColumn("large_in", F.lit(100)), "p_yes", 0.3, 0.7, F.col("doc_id") % 10 == 0, ["query_name"])


@query
def degenerate_rows(s, d):
    return baselines.degenerate(_ladder_rows(s, d).withColumn("large_in", F.lit(100)), ["query_name"])


@query
def alpha_bands(s, d):
    h = baselines.histogram(_ladder_rows(s, d), ["query_name"], "p_yes", 0.0, 1.0, 16)
    return baselines.alpha_thresholds(h, ["query_name"], [0.8, 0.9, 0.95])


@query
def stretto_threshold_fit(s, d):
    rows = sampling.stratified(_ladder_rows(s, d), ["query_name", "large"], 0.2, 2, ["doc_id"]).select("query_name", F.round("odds0", 6).alias("x"), "large")
    return baselines.fit_one_rung(rows, ["query_name"], 0.8, 0.8, 0.9)


#: Labelled rows of a predicate on which plans of several rungs are fitted.
PLAN_ROWS = 400


@query
def stretto_plan_fit(s, d):
    """A plan of two rungs for each predicate, from its first labelled rows by digest."""
    rows = _ladder_rows(s, d).withColumn("_d", sampling.digest(2, "doc_id"))
    sample = rows.withColumn("_r", F.row_number().over(Window.partitionBy("query_name").orderBy("_d", "doc_id"))).where(F.col("_r") <= PLAN_ROWS).select("query_name", "odds0", "odds1", "large")

    def fit(pdf):
        plan = baselines.fit_rungs(pdf[["odds0", "odds1"]].to_numpy().T, pdf["large"].to_numpy(), [1e-8, 4e-8], 1e-6, 0.8, 0.8, 0.9, sweeps=2, grid=9)
        return pdf.head(1)[["query_name"]].assign(low=[plan["low"]], high=[plan["high"]], esc=plan["esc"], feasible=plan["feasible"])

    return sample.groupBy("query_name").applyInPandas(fit, "query_name string, low array<double>, high array<double>, esc double, feasible boolean")


def _proxy_rows(s, d):
    return _ladder_rows(s, d).select("query_name", "doc_id", "truth", F.when(F.col("h") % 19 != 0, F.col("large")).alias("large"), F.array("p_yes", "p_no", "p_unsure").alias("vec"))


@query
def proxy_both_outcomes(s, d):
    return baselines.serve_both(_proxy_rows(s, d), ["query_name"], 0.2, 1, 3, 0.8)


@query
def uqe_rounds(s, d):
    return baselines.active_rounds(_proxy_rows(s, d), ["query_name"], 0.2, 0.3, 1, rounds=2)


# ---- learners in order

def _run_points(s, d):
    return sim.described(sim.truths(s, d, "text")).join(sim.vectors(s, d).withColumn("vec", F.col("vec").cast("array<double>")), "doc_id")


def _memory(s, d, method, **settings):
    pool = sim.with_sources(sim.lessons(s, d), s, d)
    return from_pool(pool, Policy(method, **settings), sim.table(s, d, "documents"), sim.query_vectors(s, d))


def _learned(s, d, method):
    """The memory after all points, under lessons and routing by confidence, in epochs."""
    plan = online.Plan(sim.small, sim.large, "confidence_threshold", 0.8)
    return online.run(_run_points(s, d), plan, online.State(_memory(s, d, method, k=4)), EPOCH)


#: Points of an epoch of the registered runs.
EPOCH = 20_000


@query
def care_fold(s, d):
    """The shared head after a run, weight by weight."""
    _, state = _learned(s, d, "care")
    head = state.memory.head.whole
    return s.createDataFrame([(n, round(float(m), 6), head.n) for n, m in zip(retrieval.PHI, head.mean, strict=True)], "feature string, weight double, updates long")


@query
def care_pq_fold(s, d):
    """One head over all predicates and one for each, after a run."""
    _, state = _learned(s, d, "care_pq")
    h = state.memory.head
    rows = [("", h.whole.n, 0.0, [round(float(x), 6) for x in h.whole.mean])]
    rows += [(q, o.n, round(h.share(q), 6), [round(float(x), 6) for x in o.mean]) for q, o in sorted(h.own.items())]
    return s.createDataFrame(rows, "query_name string, updates long, share double, weights array<double>")


@query
def linucb_fold(s, d):
    _, state = _learned(s, d, "linucb")
    b = state.memory.head
    return s.createDataFrame([(n, round(float(m), 6), b.n) for n, m in zip(retrieval.PHI, b.a_inv @ b.b, strict=True)], "feature string, theta double, updates long")


@query
def bandit_sums(s, d):
    """What a linear bandit adds up over the shown lessons of all escalations, whatever their order."""
    h = _featured(s, d).join(_with_large(s, d).where("escalated").select("query_name", "doc_id", (F.col("small_prediction") == F.col("large_prediction")).cast("double").alias("y")), ["query_name", "doc_id"])
    return learners.bandit_sums(h).select("i", "j", F.round("value", 3).alias("value"))


@query
def online_counters(s, d):
    """Counters of lessons after a run that shows the nearest ones."""
    _, state = _learned(s, d, "similar")
    rows = [(k, int(c[0]), int(c[1])) for k, c in sorted(state.memory.help.items())]
    return s.createDataFrame(rows, "experience_id string, pos long, neg long")


@query
def online_histories(s, d):
    """Predicates' histories after a run."""
    _, state = _learned(s, d, "similar")
    return s.createDataFrame([(q, int(n), int(a)) for q, (n, a) in sorted(state.memory.queries.items())], "query_name string, n_query long, agree_query long")


@query
def online_run(s, d):
    """The whole loop: heads of each predicate, a router that is refitted, lessons made of disagreements."""
    docs = sim.table(s, d, "documents")
    plan = online.Plan(sim.small, sim.large, "learned", 0.6, 0.8, generate=sim.made(s, d), rho=0.5, most_per_query=20, corpus=settled(retrieval.bm25_corpus(docs)))
    state = online.State(Memory(Policy("care_pq", k=4), query_vecs=sim.query_vectors(s, d)), learners.Refits(500, 10, 30, 5000))
    r, _ = online.run(_run_points(s, d), plan, state, EPOCH // 10)
    return metrics.binary(r, ["query_name"]).join(metrics.escalation(r, ["query_name"]), "query_name")


@query
def online_single_epoch(s, d):
    """One epoch is the batch plan: the same result as metrics_per_query."""
    r, _ = online.run(sim.truths(s, d), online.Plan(sim.small, sim.large, "confidence_threshold", 0.8), epoch=1 << 62)
    return metrics.binary(r, ["query_name"]).join(metrics.escalation(r, ["query_name"]), "query_name")


@query
def online_frozen(s, d):
    """A frozen run with a pool: lessons are shown and nothing is learned; the verdicts are those of the batch plan."""
    plan = online.frozen(online.Plan(sim.small, sim.large, "confidence_threshold", 0.8))
    r, _ = online.run(_run_points(s, d), plan, online.State(_memory(s, d, "similar", k=4)))
    return r.select("doc_id", "query_name", F.size("hits").cast("long").alias("n_lessons"), "escalated", "prediction")


@query
def online_cost_abort(s, d):
    """A run in epochs that stops after the point with which its cost passes the cap."""
    plan = online.Plan(sim.small, sim.large, "confidence_threshold", 0.8, cost=_flat_cost(), cap=0.02)
    r, _ = online.run(sim.truths(s, d), plan, epoch=EPOCH // 10)
    return r.select("pos", "doc_id", "query_name")


def _flat_cost():
    return F.lit(1e-6) + F.when(F.col("escalated"), 5e-5).otherwise(0.0)


@query
def kmeans_pairs(s, d):
    """Pairs of documents from different clusters, for predicates that tell them apart."""
    docs = sim.table(s, d, "documents").select("doc_id", "text").join(sim.vectors(s, d), "doc_id")
    return warm_start.contrasting_pairs(docs, 5, 6, 1).select("doc_id", "other_id", "cluster")


@query
def pretrain_loop(s, d):
    """Two rounds of active labelling; what was labelled, and how often the models agreed."""
    points = sim.truths(s, d)
    rows, model, head = warm_start.acquire(points, sim.small, sim.large, 2, 60, 200)
    return rows.groupBy("round_idx", "query_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("z") == 1).alias("agreed"), F.round(F.avg("weight"), 6).alias("mean_weight"))


@query
def joint_pretrain(s, d):
    """Two rounds of labelling with lessons, leave-one-out variants and a pool grown from disagreements; what each round gave."""
    memory = Memory(Policy("care_pq", k=4), query_vecs=sim.query_vectors(s, d))
    joint = replay.Joint(rounds=2, budgets=(60,), working=200)
    points = _run_points(s, d)
    rolls, *_ = replay.pretrain(points, memory, sim.small, sim.large, sim.made(s, d), joint)
    return rolls.groupBy("round_idx", "role").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("z") == 1).alias("agreed"))


@query
def detector_study(s, d):
    """A learned router frozen after the first phase, as a detector in the second."""
    r = _router_rows(s, d)
    return routing.detector_counts(replay.study(r, 0.6, 11))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade_confidence(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracle.SQL.items() if k in QUERIES}
