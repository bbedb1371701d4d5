"""Model stages: points in, answers and features out, through clients that speak to real models.

A stage adds its columns and calls its model once a row; plans settle it before they use it twice.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import confidence, parsing, prompts
from ..functions.columns import fixed
from ..operators import retrieval, routing
from ..operators.memory import Memory, Policy, from_pool
from ..sources import cache, clients, config, experiences
from ..streaming import online
from . import cascade

Make = Callable[[], clients.Chat]


def _list_of(points: DataFrame, name: str, kind: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast(kind)) if name in points.columns else F.array().cast(kind)


def small(points: DataFrame, make: Make, style: str = "three", concurrency: int | None = None) -> DataFrame:
    """points (query_description, text, and if at hand lessons, demos) with the small model's verdict and features.

    style: of prompts.SYSTEM; "two" asks for Yes or No, others for True, False or Unsure. A call that fails leaves
    an UNKNOWN verdict, which routers escalate, and its error.
    """
    three = style != "two"
    lessons, demos = _list_of(points, "lessons", "array<string>"), _list_of(points, "demos", "array<struct<text:string,label:string>>")
    asked = points.withColumn("messages", prompts.chat(F.col("query_description"), F.col("text"), lessons, demos, style))
    told = clients.chat(asked, make, concurrency).drop("messages")
    verdict = parsing.parse_3way(F.col("raw")) if three else parsing.parse_yes_no(F.col("raw"))
    told = fixed(told, _lp=confidence.scan(F.col("content"), three), _said=F.when(F.col("error").isNull(), verdict).otherwise("UNKNOWN"))
    lp = [F.col(f"_lp.{c}") for c in (("yes", "no", "unsure") if three else ("yes", "no"))]
    told = fixed(told, _f=(confidence.features_3way if three else confidence.features_2way)(*lp, F.col("_said")))
    names = ["confidence", "p_yes", "p_no", "margin", "logprob_yes", "logprob_no", "logprobs_available"] + (["p_unsure", "entropy_2way", "entropy_3way"] if three else [])
    out = told.withColumns({n: F.col(f"_f.{n}") for n in names} | {"small_prediction": F.col("_f.prediction"), "small_in": F.col("prompt_tokens"), "small_out": F.col("completion_tokens"), "small_error": F.col("error")})
    if not three:
        out = out.withColumn("entropy_2way", F.col("_f.entropy"))
    return out.withColumnsRenamed({"raw": "small_raw", "seconds": "t_small"}).drop("_lp", "_said", "_f", *clients.ANSWER)


def large(points: DataFrame, make: Make, concurrency: int | None = None) -> DataFrame:
    """points with the large model's verdict: a plain question without lessons or demonstrations. A call that fails leaves no verdict."""
    none = F.array().cast("array<string>"), F.array().cast("array<struct<text:string,label:string>>")
    asked = points.withColumn("messages", prompts.chat(F.col("query_description"), F.col("text"), *none, "two"))
    told = clients.chat(asked, make, concurrency)
    said = F.when(F.col("error").isNull(), parsing.parse_yes_no(F.col("raw")))
    out = told.withColumns({"large_prediction": said, "large_in": F.col("prompt_tokens"), "large_out": F.col("completion_tokens"), "large_error": F.col("error")})
    return out.withColumnsRenamed({"raw": "large_raw", "seconds": "t_large"}).drop(*clients.ANSWER)


def votes(points: DataFrame, make: Make, demos: list[str] = (), longest: int = 2000) -> DataFrame:
    """points with a self-check's answers: one request each, for as many answers as the client gives."""
    shown = F.array(*[F.lit(d) for d in demos]) if demos else F.array().cast("array<string>")
    prompt = prompts.verify(shown, F.col("query_description"), F.col("text"), F.col("small_prediction"), longest=longest)
    told = clients.chat(points.withColumn("messages", F.array(prompts.message("user", prompt))), make)
    out = told.withColumns({"votes": F.when(F.col("error").isNull(), F.col("choices")), "verify_in": F.col("prompt_tokens"), "verify_out": F.col("completion_tokens")})
    return out.drop(*clients.ANSWER)


def explained(triggers: DataFrame, small_chat: Make, large_chat: Make, embed: Callable[[], clients.Embed] | None = None, excerpt: int = 20_000) -> DataFrame:
    """Lessons of triggers, as rows of online.LESSONS with the tokens and times of both calls.

    triggers: query_name, doc_id, query_description, text, small_prediction, large_prediction. The small model explains
    its verdict, the large one turns both into a lesson. status: accepted, error (a call failed), unreadable.
    """
    condition, text = F.col("query_description"), F.col("text")
    one = clients.chat(triggers.withColumn("messages", F.array(prompts.message("user", prompts.explain(condition, text, F.col("small_prediction"))))), small_chat)
    one = one.withColumns({"reason": F.trim("raw"), "explain_in": F.col("prompt_tokens"), "explain_out": F.col("completion_tokens"), "explain_s": F.col("seconds"), "failed": F.col("error").isNotNull()}).drop(*clients.ANSWER)
    ask = F.array(prompts.message("user", prompts.lesson(condition, text, F.col("small_prediction"), F.col("large_prediction"), F.col("reason"))))
    parts = []
    for ok in (True, False):  # a failed explanation costs no second call
        rows = one.where(~F.col("failed") if ok else F.col("failed"))
        told = clients.chat(rows.withColumn("messages", ask), large_chat) if ok else rows.withColumn("messages", ask).withColumns({n: F.lit(None).cast(k) for n, k in clients.ANSWER_KINDS.items()})
        parts.append(told)
    told = parts[0].unionByName(parts[1])
    lesson = parsing.json_field(F.col("raw"), "lesson")
    status = F.when(F.col("failed") | F.col("error").isNotNull(), "error").when(lesson.isNull(), "unreadable").otherwise("accepted")
    out = told.select(
        "query_name", "doc_id", status.alias("status"), experiences.experience_id().alias("experience_id"), lesson.alias("experience_text"), F.substring(text, 1, excerpt).alias("source_doc_excerpt"),
        "small_prediction", "large_prediction", "reason", "explain_in", "explain_out", "explain_s", F.col("prompt_tokens").alias("lesson_in"), F.col("completion_tokens").alias("lesson_out"), F.col("seconds").alias("lesson_s"),
    )
    if embed is None:
        return out.withColumns({"vec": F.lit(None).cast("array<double>"), "excerpt_vec": F.lit(None).cast("array<double>")})
    out = clients.embed(out, embed, "experience_text").withColumn("vec", F.col("vec").cast("array<double>"))
    return clients.embed(out, embed, "source_doc_excerpt", "excerpt_vec").withColumn("excerpt_vec", F.col("excerpt_vec").cast("array<double>"))


def generation_stats(log: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts, tokens and mean times of a log of explained triggers."""
    keys = keys or []
    count = lambda s: F.count_if(F.col("status") == s)
    return log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("attempted"), count("accepted").alias("succeeded"), count("unreadable").alias("parse_failures"), count("error").alias("llm_errors"),
        F.coalesce(F.sum("explain_in"), F.lit(0)).alias("explain_in"), F.coalesce(F.sum("explain_out"), F.lit(0)).alias("explain_out"),
        F.coalesce(F.sum("lesson_in"), F.lit(0)).alias("lesson_in"), F.coalesce(F.sum("lesson_out"), F.lit(0)).alias("lesson_out"),
        F.round(F.avg("explain_s"), 4).alias("avg_explain_s"), F.round(F.avg("lesson_s"), 4).alias("avg_lesson_s"),
    )


def point_vectors(points: DataFrame, make: Callable[[], clients.Embed], prefix: int = 1500) -> DataFrame:
    """points with vec: of the description and the beginning of the text."""
    return clients.embed(points.withColumn("_asked", F.concat_ws(" | ", "query_description", F.substring("text", 1, prefix))), make, "_asked").drop("_asked")


# ---- from settings to a run

RETRIEVERS = {"topk_semantic": "similar", "topk_semantic_online": "helpful", "care": "care", "care_pq": "care_pq", "linucb": "linucb"}
#: Demonstrations by which model's verdicts they show.
FEWSHOT: dict[str, tuple[str, ...]] = {"topk_semantic": (), "topk_semantic_large_only": ("large",)}
GENERATORS = {"online_discrepancy": explained}


def known(table: dict, name: str, kind: str):
    if name not in table:
        raise KeyError(f"unknown {kind} {name!r}; known: {sorted(table)}")
    return table[name]


def reached(chat: clients.HttpChat, what: str) -> clients.HttpChat:
    """The client, if its server answers; a run that needs it must not start without."""
    if not chat.healthy():
        raise SystemExit(f"{what} model unreachable at {chat.url}")
    return chat


def policy(settings: config.Retrieval) -> Policy:
    method = known(RETRIEVERS, settings.name, "retriever")
    return Policy(method, settings.k, settings.multiplier, settings.diversity if method in ("care", "care_pq") else 1.0, same_query=settings.restrict_to_query)


def memory(spark: SparkSession, run: config.Run, documents: DataFrame, pool: DataFrame | None = None, query_vecs: dict | None = None) -> Memory:
    return from_pool(pool, policy(run.retrieval), documents, query_vecs) if pool is not None else Memory(policy(run.retrieval), query_vecs=query_vecs or {})


def plan(run: config.Run, models: config.Models, cached: DataFrame | None = None, corpus: DataFrame | None = None, probe: bool = True) -> online.Plan:
    """What a run does, from its settings: clients, router, generation. Models that the router needs are probed on the driver."""
    router = {"lightgbm": "learned"}.get(run.router.name, run.router.name)
    known(routing.ROUTERS | {"all_big": None}, router, "router")
    small_chat = clients.HttpChat(models.small_url, models.small_model, models.max_tokens, models.temperature, models.top_logprobs, models.timeout)
    large_chat = clients.HttpChat(models.large_url, models.large_model, models.max_tokens, models.temperature, 0, models.timeout, extra=models.large_extra)
    generates = run.generation.name != "" and not run.frozen
    if probe:
        if router != "all_big":
            reached(small_chat, "small")
        if routing.needs_large(router, generates) and models.large_url:
            reached(large_chat, "large")
    embed = (lambda: clients.HttpEmbed(models.embed_url)) if models.embed_url else None
    write = known(GENERATORS, run.generation.name, "generator") if generates else None
    return online.Plan(
        small=partial(small, make=lambda: small_chat, style=models.style, concurrency=models.workers), large=partial(large, make=lambda: large_chat, concurrency=models.workers),
        router=router, threshold=run.router.threshold, bootstrap=run.router.bootstrap, veto=run.router.veto,
        generate=(lambda t: write(t, lambda: small_chat.longer(150), lambda: large_chat.longer(300), embed)) if write else None,
        rho=run.generation.rho or None, most_per_query=run.generation.most_per_query, frozen=run.frozen, cached=cached, corpus=corpus, cap=run.cost_cap,
    )


def automix(points: DataFrame, run: config.Run, models: config.Models, cached: DataFrame | None = None) -> DataFrame:
    """Records under the self-checking router, whose answers need a stage of their own."""
    small_chat = clients.HttpChat(models.small_url, models.small_model, models.max_tokens, models.temperature, models.top_logprobs, models.timeout)
    check = clients.HttpChat(models.small_url, models.small_model, 250, run.router.temperature, 0, models.timeout, extra={"n": run.router.k, "stop": ["---"]})
    large_chat = clients.HttpChat(models.large_url, models.large_model, models.max_tokens, models.temperature, 0, models.timeout, extra=models.large_extra)
    checked = lambda told: routing.with_verification(told, lambda t: votes(t, lambda: check), run.router.k)
    return cascade.semantic_filter(points, partial(small, make=lambda: small_chat, style=models.style), partial(large, make=lambda: large_chat), routing.by_verification(run.router.threshold), cached, verify=checked)


def all_answers(points: DataFrame, done: DataFrame | None, make: Make, variant: str = "word") -> DataFrame:
    """A collector: verdicts for points that are not done yet (query_name, doc_id), to be appended. variant: of prompts.ZERO_SHOT."""
    left = points if done is None else cache.misses(points, done)
    told = clients.chat(left.withColumn("messages", prompts.zero_shot(F.col("query_description"), F.col("text"), variant)), make)
    if variant != "json":
        parse = parsing.parse_zero_shot if variant == "reasoned" else parsing.parse_yes_no
        return told.select("query_name", "doc_id", parse(F.col("raw")).alias("prediction"), "raw", "prompt_tokens", "completion_tokens", "error")
    said = parsing.parse_match_json(F.col("raw"))
    told = fixed(told, _said=said, _at=confidence.collector_scan(F.col("content")))
    lp = [F.col(f"_at.{n}") for n in ("yes", "no", "unsure")]
    told = fixed(told, _f=confidence.collector_features(*lp, F.col("_said")))
    return told.select("query_name", "doc_id", F.col("_said").alias("prediction"), "raw", "_f.*", *[c.alias(f"logprob_{n}") for c, n in zip(lp, ("true", "false", "unsure"), strict=True)], "error")


def demos(points: DataFrame, records: DataFrame, settings: config.Retrieval) -> DataFrame:
    """points with demos: the texts and labels of their nearest earlier points, nearest last before the question. records: also text."""
    hits = retrieval.demonstrations(points, records, settings.demos, known(FEWSHOT, settings.fewshot, "demonstration retriever"))
    texts = records.select(F.col("doc_id").alias("demo_doc"), F.col("text").alias("demo_text")).dropDuplicates(["demo_doc"])
    listed = hits.join(texts, "demo_doc").groupBy("query_name", "doc_id").agg(F.sort_array(F.collect_list(F.struct("rank", "demo_text", "label"))).alias("l"))
    shown = listed.select("query_name", "doc_id", F.transform("l", lambda x: F.struct(x["demo_text"].alias("text"), x["label"].alias("label"))).alias("demos"))
    return points.join(shown, ["query_name", "doc_id"], "left")
