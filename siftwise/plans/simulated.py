"""Deterministic stand-ins for predicates and models, over the shared test tables.

Verdicts and log-probabilities come from integer arithmetic on ids, so that any engine can repeat
them. They say nothing about real models.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import fixed as answered

#: (number, name, description, needs a label)
PREDICATES = (
    (0, "is_english", "The document is written in English.", False),
    (1, "long_doc", "The document has more than 1000 characters.", False),
    (2, "has_digit", "The document holds a digit.", False),
    (3, "high_quality", "The document is of high quality.", True),
    (4, "toxic", "The document is toxic.", True),
)
#: Points of a document have neighbouring positions.
STRIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def predicates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PREDICATES, "qid int, query_name string, query_description string, needs_label boolean")


def truths(spark: SparkSession, sf_dir: str, *columns: str, **more: Column) -> DataFrame:
    """pos, doc_id, qid, query_name, truth (and columns of documents, and more of them by name) of every point; labelled predicates exist for labelled documents."""
    own = {"_english": F.col("lang") == "en", "_long": F.col("n_chars") > 1000, "_digit": F.col("text").rlike("[0-9]")}
    docs = table(spark, sf_dir, "documents").withColumns(own | more).select("doc_id", *columns, *more, *own)  # texts that nothing asks for stay out of the join
    columns = (*columns, *more)
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    rows = docs.join(labels, "doc_id", "left")
    facts = [*[F.col(c) for c in own], F.col("quality") == 1, F.col("toxic") == 1]
    listed = F.array(*[F.struct(F.lit(q).alias("qid"), F.lit(n).alias("query_name"), t.alias("truth")) for (q, n, _, _), t in zip(PREDICATES, facts, strict=True)])
    out = rows.select("doc_id", *columns, F.explode(listed).alias("x")).select("doc_id", *columns, "x.*").where("truth is not null")
    return out.withColumn("pos", F.col("doc_id") * STRIDE + F.col("qid")).withColumn("ground_truth", F.when(F.col("truth"), "Yes").otherwise("No"))


def _h() -> Column:
    return (F.col("doc_id") * 7919 + F.col("qid") * 104729 + 17) % 1000


def _g() -> Column:
    return (F.col("doc_id") * 31 + F.col("qid") * 17) % 100


def small(points: DataFrame) -> DataFrame:
    """points with the small model's log-probabilities and features."""
    out = answered(points, h=_h())
    out = answered(out, says=F.when(F.col("h") < 150, ~F.col("truth")).otherwise(F.col("truth")), lp_top=-(F.col("h") % 50) / 100.0)
    out = answered(out, lp_alt=F.col("lp_top") - (2 + F.col("h") % 40) / 10.0, lp_unsure=F.when((F.col("h") >= 150) & (F.col("h") < 250), F.col("lp_top") + 0.5).otherwise(F.col("lp_top") - 3.0))
    pick = lambda a, b: F.when(F.col("says"), F.col(a)).otherwise(F.col(b))
    out = answered(out, lp_yes=pick("lp_top", "lp_alt"), lp_no=pick("lp_alt", "lp_top"))
    top = F.greatest("lp_yes", "lp_no", "lp_unsure")
    out = answered(out, **{f"_{c}": F.exp(F.col(f"lp_{c}") - top) for c in ("yes", "no", "unsure")})
    total = F.col("_yes") + F.col("_no") + F.col("_unsure")
    out = answered(out, **{f"p_{c}": F.col(f"_{c}") / total for c in ("yes", "no", "unsure")}).drop("_yes", "_no", "_unsure", "says", "lp_top", "lp_alt")
    y, n, u = F.col("p_yes"), F.col("p_no"), F.col("p_unsure")
    share = y / (y + n)
    out = answered(
        out, small_prediction=F.when((y >= n) & (y >= u), "Yes").when(n >= u, "No").otherwise("Unsure"), confidence=F.greatest(y, n), margin=F.abs(y - n),
        entropy_2way=-(share * F.log(share) + (1 - share) * F.log(1 - share)), entropy_3way=-(y * F.log(y) + n * F.log(n) + u * F.log(u)),
    )
    out = out.withColumns({f"logprob_{c}": F.col(f"lp_{c}") for c in ("yes", "no", "unsure")})
    tokens = {"small_in": F.floor(F.col("n_chars") / 4).cast("long") + 25, "small_out": F.lit(1).cast("long")} if "n_chars" in points.columns else {}
    return out.withColumns(tokens)


def large(points: DataFrame) -> DataFrame:
    """points with the large model's verdict."""
    says = F.when(_g() < 5, ~F.col("truth")).otherwise(F.col("truth"))
    return answered(points, large_prediction=F.when(says, "Yes").otherwise("No"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, vec: documents take the test table's vectors by remainder. A convention of the fixture."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    n = emb.count()
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return docs.join(emb, F.col("doc_id") % n == F.col("vec_id")).select("doc_id", "vec")


def described(points: DataFrame) -> DataFrame:
    """points with the description of their predicate."""
    table_ = F.create_map(*[F.lit(x) for _, n, d, _ in PREDICATES for x in (n, d)])
    return points.withColumn("query_description", table_[F.col("query_name")])


def query_vectors(spark: SparkSession, sf_dir: str) -> dict[str, list[float]]:
    """A vector for each predicate: that of its number. A convention of the fixture."""
    rows = table(spark, sf_dir, "embeddings").where(F.col("vec_id") < len(PREDICATES)).collect()
    held = {r["vec_id"]: [float(x) for x in r["embedding"]] for r in rows}
    return {n: held[q] for q, n, _, _ in PREDICATES if q in held}


def lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool from the benchmark table: every item that has a vector, dealt over the predicates, with a document as its source."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    names = F.array(*[F.lit(n) for _, n, _, _ in PREDICATES])
    pool = table(spark, sf_dir, "benchmark").join(emb, F.col("item_id") == F.col("vec_id")).select(
        F.format_string("exp_%03d", "item_id").alias("experience_id"), F.element_at(names, (F.col("item_id") % len(PREDICATES)).cast("int") + 1).alias("source_query"),
        (F.col("item_id") * 3).alias("source_doc_id"), F.col("text").alias("experience_text"), "vec",
    )
    return pool


def with_sources(pool: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lessons with the text of their source document and its vector."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_doc_id"), F.col("text").alias("source_doc_excerpt"))
    own = vectors(spark, sf_dir).select(F.col("doc_id").alias("source_doc_id"), F.col("vec").alias("excerpt_vec"))
    return pool.join(docs, "source_doc_id", "left").join(own, "source_doc_id", "left")


def made(spark: SparkSession, sf_dir: str):
    """A stage that makes a lesson of each trigger, as two model calls would; every seventh document's answer cannot be read."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    n = emb.count()

    def stage(triggers: DataFrame) -> DataFrame:
        bad = F.col("doc_id") % 7 == 0
        text = F.concat(F.lit("For "), F.col("query_name"), F.lit(" the answer is "), F.col("large_prediction"))
        rows = triggers.select("query_name", "doc_id", "large_prediction").join(emb, F.col("doc_id") % n == F.col("vec_id"))  # as vectors gives them
        return rows.select(
            "query_name", "doc_id", F.when(bad, "unreadable").otherwise("accepted").alias("status"),
            F.concat(F.lit("online__"), "query_name", F.lit("__doc_"), F.col("doc_id").cast("string")).alias("experience_id"),
            text.alias("experience_text"), F.lit("").alias("source_doc_excerpt"), "vec", F.col("vec").alias("excerpt_vec"),
        )

    return stage
