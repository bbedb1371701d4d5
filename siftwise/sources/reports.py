"""Sinks: records, summaries, task packages, manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import prefix

#: What a record shows, in order. small_p_* are kept besides.
RECORD = (
    "doc_id", "query_name", "ground_truth", "prediction", "raw", "routed_to", "retrieved_experiences", "retrieved_fewshot", "latency", "small_prediction", "small_confidence", "escalated",
    "router_p_z1", "router_bootstrap", "t_small", "t_route_decision", "t_large", "t_retrieve_exp", "t_retrieve_fs", "t_router_signals", "t_observe",
    "small_prompt_tokens", "small_completion_tokens", "large_prompt_tokens", "large_completion_tokens", "verify_small_calls", "verify_small_prompt_tokens", "verify_small_completion_tokens", "verify_score",
)
_FROM = {
    "small_confidence": "confidence", "router_p_z1": "p_agree", "small_prompt_tokens": "small_in", "small_completion_tokens": "small_out", "large_prompt_tokens": "large_in",
    "large_completion_tokens": "large_out", "verify_small_calls": "verify_calls", "verify_small_prompt_tokens": "verify_in", "verify_small_completion_tokens": "verify_out",
}
_PLACES = {"latency": 4, "small_confidence": 4, "router_p_z1": 6, "t_small": 4, "t_route_decision": 6, "t_large": 4, "t_retrieve_exp": 6, "t_retrieve_fs": 6, "t_router_signals": 6, "t_observe": 6}


def projected(records: DataFrame) -> DataFrame:
    """Records with the columns of RECORD, rounded, and small_p_yes, small_p_no, small_p_unsure; what a run does not have is null."""
    have = set(records.columns)
    text = {"raw", "ground_truth", "prediction", "routed_to", "small_prediction"}

    def column(name: str):
        if name == "raw" and "raw" not in have:
            parts = [F.col(c) for c in ("large_raw", "small_raw") if c in have]
            return F.coalesce(*parts) if parts else F.lit(None).cast("string")
        if name == "routed_to" and "escalated" in have:
            return F.when(F.col("escalated"), "large").otherwise(F.col("routed_to"))
        if name == "router_bootstrap" and "p_agree" in have and name not in have:
            return F.col("p_agree").isNull()
        if name == "retrieved_experiences" and "hits" in have:
            return F.transform("hits", lambda h: F.struct(h["experience_id"].alias("experience_id"), h["source_query"].alias("source_query"), F.round(h["score"], 4).alias("score")))
        own = name if name in have else _FROM.get(name, name)
        if own not in have:
            return F.lit(None).cast("string" if name in text else "double")
        return F.round(F.col(own), _PLACES[name]) if name in _PLACES else F.col(own)

    shares = [F.round(F.col(f"p_{c}"), 6).alias(f"small_p_{c}") for c in ("yes", "no", "unsure") if f"p_{c}" in have]
    return records.select(*[column(n).alias(n) for n in RECORD], *shares)


def write_results(records: DataFrame, summary: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """records as Parquet and each summary table as JSON below path."""
    records.write.mode(mode).parquet(f"{path}/records")
    for name, df in summary.items():
        df.coalesce(1).write.mode(mode).json(f"{path}/{name}")


def write_recordings(triggers: DataFrame, summary: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The trigger log, with what was installed and used, and its summary, beside a run's results."""
    triggers.write.mode(mode).json(f"{path}/triggers")
    summary.coalesce(1).write.mode(mode).json(f"{path}/summary")


def write_detector(rows: DataFrame, counts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One CSV row of each held-out point, and the counts as JSON."""
    rows.write.mode(mode).option("header", True).csv(f"{path}/rows")
    counts.coalesce(1).write.mode(mode).json(f"{path}/meta")


def write_tasks(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A CSV folder for each predicate."""
    rows.write.mode(mode).option("header", True).partitionBy("query_name").csv(path)


def tasks(points: DataFrame, prefix_text: str = "", suffix: str = "") -> DataFrame:
    """One row a predicate: its question, instruction (braces doubled) and documents."""
    asked = F.replace(F.replace(F.trim("query_description"), F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))
    text = F.concat(F.lit("Answer the question about the document.\n\nQuestion: "), asked, F.lit("\n\n- True if the answer is Yes.\n- False if it is No."))
    one = points.groupBy("query_name").agg(F.max("query_description").alias("query_description"), F.count(F.lit(1)).alias("n_docs"))
    return one.select("query_name", F.trim("query_description").alias("question"), F.lit(prefix_text).alias("prefix"), text.alias("instruction"), F.lit(suffix).alias("suffix"), "n_docs")


def write_package(points: DataFrame, answers: DataFrame, path: str, overhead: int = 25) -> None:
    """tasks as JSON, and for each predicate its documents with gold, the large verdict and token counts; a point without an answer raises when written."""
    tasks(points).coalesce(1).write.mode("overwrite").json(f"{path}/tasks")
    rows = points.join(answers.select("query_name", "doc_id", "prediction"), ["query_name", "doc_id"], "left")
    told = F.when(F.col("prediction").isin("Yes", "No"), (F.col("prediction") == "Yes").cast("int")).otherwise(F.raise_error(F.concat(F.lit("no large verdict for document "), F.col("doc_id").cast("string"))).cast("int"))
    write_tasks(rows.select("query_name", "doc_id", (F.col("ground_truth") == "Yes").cast("int").alias("gold"), told.alias("oracle_pred"), token_estimate(overhead=overhead).alias("oracle_prompt_tokens"), F.lit(1).alias("oracle_output_tokens")), f"{path}/rows")


def token_estimate(text: str = "text", overhead: int = 25):
    """Tokens of a prompt where no count is known: a quarter of its characters and some overhead."""
    return F.length(text) / 4 + overhead


def layout(points: DataFrame) -> DataFrame:
    """The rows of each predicate's document list, in order of doc_id: query_name, order_no, doc_id, gold. To be written by predicate."""
    return prefix.numbered(points.select("query_name", "doc_id", "gold"), ["query_name"], [F.col("doc_id")], "order_no")


def layout_meta(points: DataFrame) -> DataFrame:
    """Documents and the mean token estimate of each predicate."""
    return points.groupBy("query_name").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg(token_estimate()), 6).alias("avg_tokens"))


def manifest(pairs: DataFrame, docs: DataFrame, sampled: DataFrame) -> DataFrame:
    """pairs whose document exists, with a flag for sampled ones; a pair without a document raises when read."""
    known = docs.select("doc_id").withColumn("_known", F.lit(True))
    flags = sampled.select("query_name", "doc_id").withColumn("in_sample", F.lit(True))
    out = pairs.join(known, "doc_id", "left").join(flags, ["query_name", "doc_id"], "left")
    checked = F.when(F.col("_known"), F.coalesce("in_sample", F.lit(False))).otherwise(F.raise_error(F.concat(F.lit("no document "), F.col("doc_id").cast("string"))).cast("boolean"))
    return out.withColumn("in_sample", checked).drop("_known")


def as_dict(table: DataFrame) -> dict:
    """A table of one row."""
    row = table.first()
    return {} if row is None else row.asDict()


def show(summary: dict) -> None:
    """A run's figures on the console, one line each."""
    for k, v in summary.items():
        print(f"{k:>24}: {json.dumps(v) if isinstance(v, dict) else v}")


def safely(call) -> dict:
    """What a report calls; an error becomes its text, so that a finished run is still written."""
    try:
        return call()
    except Exception as e:
        return {"error": f"{type(e).__name__}: {e}"}
