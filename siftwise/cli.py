"""Command line: python -m siftwise.cli COMMAND ... on any Spark master.

run      the semantic filter as a settings file says; records, summary and state go to its output
collect  zero-shot answers for points that a folder does not hold yet
embed    vectors of documents into a cache folder
replay   train a head on stored escalations
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import metrics, prefix, retrieval, sampling
from .operators.memory import WIDTH
from .plans import cascade, replay, stages
from .sources import cache, clients, config, experiences, reports
from .sources import points as pts
from .sources.shared import exists
from .streaming import online


def load_points(spark: SparkSession, run: config.Run) -> tuple[DataFrame, DataFrame]:
    """points with pos, query_name, doc_id, text, query_description, ground_truth, in the order of the run; and the documents."""
    d = run.data
    documents, pairs, queries = pts.load(spark, pts.Dataset(d.documents, d.pairs, d.queries, d.text_column))
    wanted = pts.resolve(pairs.select("query_name"), d.wanted, ())
    points = pts.points(documents, pairs.join(wanted, "query_name", "left_semi"), queries).withColumnRenamed("document_id", "doc_id")
    keyed = points.select("query_name", "doc_id", "text")
    placed = sampling.ordered(keyed, ["query_name"], pts.order_key(run.order, run.seed), d.limit).select("query_name", "doc_id", "order_no")
    placed = prefix.numbered(placed.withColumn("_all", F.lit(0)), ["_all"], [F.col("query_name"), F.col("order_no")], "pos").drop("_all", "order_no")
    return points.join(placed, ["query_name", "doc_id"]), documents


def read_cache(spark: SparkSession, run: config.Run) -> DataFrame | None:
    """Cached answers: the sources of the settings in their order, then the folder that live answers are added to."""
    rows = None
    for i, at in enumerate([*run.models.cache, *([run.models.cache_to] if run.models.cache_to else [])]):
        if at == run.models.cache_to and at not in run.models.cache and not exists(spark, at):
            continue
        one = cache.read(spark, at).withColumn("source_no", F.lit(i).cast("long"))
        rows = one if rows is None else rows.unionByName(one)
    return None if rows is None else cache.merge(rows)


def run_filter(spark: SparkSession, run: config.Run) -> dict:
    """Run the filter, write its records, summary and state below the output, and give the summary."""
    points, documents = load_points(spark, run)
    if run.models.embed_url:
        points = cascade.settled(stages.point_vectors(points, lambda: clients.HttpEmbed(run.models.embed_url), run.retrieval.prefix_chars))
    cached = read_cache(spark, run)
    if run.router.name == "automix":
        records, state = stages.automix(points, run, run.models, cached), None
    elif run.router.name == "all_big":
        records, state = cascade.settled(cascade.all_large(points, stages.plan(run, run.models).large)), None
    else:
        pool = experiences.read_experiences(spark, run.retrieval.pool) if run.retrieval.pool else None
        if pool is not None and run.models.embed_url:
            pool = clients.embed(pool, lambda: clients.HttpEmbed(run.models.embed_url), "experience_text")
        corpus = cascade.settled(retrieval.bm25_corpus(documents)) if run.generation.name else None
        state = online.State(stages.memory(spark, run, documents, pool))
        state.refits = online.learners.Refits(run.router.refit_every, run.router.least_new, run.router.least_class, run.router.newest)
        if run.retrieval.snapshot:
            state.memory.warm(json.loads(spark.read.text(run.retrieval.snapshot, wholetext=True).first()[0]))
        records, state = online.run(points, stages.plan(run, run.models, cached, corpus), state, run.epoch)
    if run.models.cache_to and "large_raw" in records.columns:
        live = records.where("large_prediction is not null and not coalesce(from_cache, false)")
        cache.append(live.select("query_name", F.col("doc_id"), F.col("large_prediction").alias("prediction"), F.col("large_raw").alias("raw")), run.models.cache_to)
    summary = {"overall": metrics.binary(records, []), "per_query": metrics.binary(records, ["query_name"]).join(metrics.escalation(records, ["query_name"]), "query_name")}
    reports.write_results(reports.projected(records), summary, run.output)
    about = {} if state is None else state.info()
    if state is not None:
        spark.createDataFrame([(state.dump(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{run.output}/state")
    return {**reports.as_dict(summary["overall"]), "state": about}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="siftwise", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = parser.add_subparsers(dest="command", required=True)
    one = sub.add_parser("run")
    one.add_argument("--config", required=True)
    one.add_argument("--set", action="append", default=[], metavar="key.key=JSON")
    two = sub.add_parser("collect")
    two.add_argument("--config", required=True)
    two.add_argument("--set", action="append", default=[])
    two.add_argument("--variant", default="word")
    two.add_argument("--model", choices=("small", "large"), default="large")
    three = sub.add_parser("embed")
    three.add_argument("--documents", required=True)
    three.add_argument("--url", required=True)
    three.add_argument("--out", required=True)
    four = sub.add_parser("replay")
    four.add_argument("--rollouts", required=True)
    four.add_argument("--out", required=True)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("siftwise").getOrCreate()
    if a.command == "run":
        reports.show(run_filter(spark, config.load(a.config, tuple(a.set))))
    elif a.command == "collect":
        run = config.load(a.config, tuple(a.set))
        points, _ = load_points(spark, run)
        m = run.models
        chat = clients.HttpChat(getattr(m, f"{a.model}_url"), getattr(m, f"{a.model}_model"), 20 if a.variant == "json" else m.max_tokens, m.temperature, m.top_logprobs, m.timeout)
        done = cache.merge(cache.read(spark, run.output)) if exists(spark, run.output) else None
        stages.all_answers(points, done, lambda: stages.reached(chat, a.model), a.variant).write.mode("append").json(run.output)
    elif a.command == "embed":
        clients.embedded(spark.read.parquet(a.documents), a.out, lambda: clients.HttpEmbed(a.url)).count()
    else:
        head = replay.train_heads(experiences.read_rollouts(spark, a.rollouts), WIDTH)
        spark.createDataFrame([(json.dumps(head.dump()),)], "value string").coalesce(1).write.mode("overwrite").text(a.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
