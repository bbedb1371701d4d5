"""Cached answers of the large model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parsing import parse_yes_no

KEY = ["query_name", "doc_id"]


def merge(rows: DataFrame) -> DataFrame:
    """One answer per key. rows: query_name, doc_id (text or number), prediction, raw, source_no, line_no.

    Blank predictions and ids that are no integers go; other answers are normalised, from the raw
    text if the prediction does not tell; the last line of the last source wins.
    """
    ids = F.expr("try_cast(trim(cast(doc_id AS string)) AS bigint)")
    clean = rows.withColumn("doc_id", ids).where("doc_id is not null and trim(coalesce(prediction, '')) <> ''")
    said = parse_yes_no(F.col("prediction"))
    clean = clean.withColumn("prediction", F.when(said == "UNKNOWN", parse_yes_no(F.col("raw"))).otherwise(said))
    last = F.max_by(F.struct("prediction", "raw"), F.struct("source_no", "line_no"))
    return clean.groupBy(*KEY).agg(last.alias("_last")).select(*KEY, "_last.prediction", "_last.raw")


def probe(points: DataFrame, cache: DataFrame) -> DataFrame:
    """points with cached_prediction and hit."""
    held = cache.select(*KEY, F.col("prediction").alias("cached_prediction"), F.lit(True).alias("hit"))
    return points.join(held, KEY, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def misses(points: DataFrame, cache: DataFrame) -> DataFrame:
    """points that need a live call."""
    return points.join(cache.select(*KEY), KEY, "left_anti")


def stats(probed: DataFrame, cache: DataFrame, stored: int = 0) -> DataFrame:
    """n_entries, hits, misses, stores, hit_rate."""
    n = cache.agg(F.count(F.lit(1)).alias("n_entries"))
    use = probed.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    rate = F.col("hits") / F.greatest(F.col("hits") + F.col("misses"), F.lit(1))
    return n.join(use).select("n_entries", "hits", "misses", F.lit(stored).alias("stores"), F.round(rate, 6).alias("hit_rate"))


def append(answers: DataFrame, path: str) -> None:
    """Add answers to a JSON-lines cache folder; what is read back is merged."""
    answers.select(*KEY, "prediction", "raw").write.mode("append").json(path)


def read(spark, path: str) -> DataFrame:
    """Rows of a cache folder, ready for merge: a later file is a later source."""
    raw = spark.read.schema("query_name string, doc_id string, prediction string, raw string").json(path)
    timed = raw.withColumn("source_no", F.unix_micros("_metadata.file_modification_time")).withColumn("line_no", F.monotonically_increasing_id())
    return timed


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in an order."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
