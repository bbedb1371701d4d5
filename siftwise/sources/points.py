"""Points: one row per document and predicate, in a fixed order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDERS = ("doc_id", "shortest", "longest", "shuffled")

DOCUMENTS = T.StructType([T.StructField("document_id", T.LongType()), T.StructField("document_name", T.StringType()), T.StructField("text", T.StringType())])
PAIRS = T.StructType([T.StructField("document_id", T.LongType()), T.StructField("query_name", T.StringType()), T.StructField("ground_truth", T.StringType())])
QUERIES = T.StructType([T.StructField("query_name", T.StringType()), T.StructField("query_description", T.StringType())])


@dataclass(frozen=True)
class Dataset:
    """Where the files of a collection lie."""

    documents: str
    pairs: str
    queries: str
    text_column: str = "text"
    first_six: tuple[str, ...] = ()


class Registry:
    """Named collections; an unknown name raises and lists the known ones."""

    def __init__(self, known: dict[str, Dataset] | None = None):
        self.known = dict(known or {})

    def add(self, name: str, dataset: Dataset) -> None:
        self.known[name] = dataset

    def __getitem__(self, name: str) -> Dataset:
        if name not in self.known:
            raise KeyError(f"unknown dataset {name!r}; known: {sorted(self.known)}")
        return self.known[name]


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV file whose text fields may hold line breaks; columns are found by name."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return raw.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])


def load(spark: SparkSession, dataset: Dataset) -> tuple[DataFrame, DataFrame, DataFrame]:
    """documents, pairs, queries."""
    named = T.StructType([T.StructField("document_id", T.LongType()), T.StructField("document_name", T.StringType()), T.StructField(dataset.text_column, T.StringType())])
    documents = read_csv(spark, dataset.documents, named).withColumnRenamed(dataset.text_column, "text")
    queries = read_csv(spark, dataset.queries, QUERIES).withColumn("query_description", F.trim("query_description"))
    return documents, read_csv(spark, dataset.pairs, PAIRS), queries


def melt(matrix: DataFrame, id_column: str = "document_id") -> DataFrame:
    """Pairs from a matrix with one Yes/No column per predicate."""
    names = [c for c in matrix.columns if c != id_column]
    return matrix.unpivot([id_column], names, "query_name", "ground_truth")


def resolve(names: DataFrame, wanted: str | None, first: tuple[str, ...], prefix: str = "") -> DataFrame:
    """The predicates of a slice: '' or first (fixed list), prefix (by name), all, or a comma list."""
    distinct = names.select("query_name").distinct()
    if wanted in (None, "", "first"):
        return distinct.where(F.col("query_name").isin(*first))
    if wanted == "prefix":
        return distinct.where(F.col("query_name").startswith(prefix))
    if wanted == "all":
        return distinct
    return distinct.where(F.col("query_name").isin(*[w.strip() for w in wanted.split(",")]))


#: An answer that is missing counts as No where a large model's answers stand in for the truth.
MISSING_GOLD = "No"


def log_odds(yes: str = "logprob_true", no: str = "logprob_false", clip: float = 30.0) -> Column:
    return F.least(F.greatest(F.col(yes) - F.col(no), F.lit(-clip)), F.lit(clip))


def with_small(answers: DataFrame, small: DataFrame, gold: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Large answers with the small model's log-odds, and one row that says how many had none.

    answers: query_name, document_id (or document_name, which decides if it is there), prediction, ground_truth; small: the same key,
    logprob_true, logprob_false. gold: other large answers (document_id, query_name, prediction) to stand in; a missing one is No.
    """
    key = ["document_name" if "document_name" in answers.columns and "document_name" in small.columns else "document_id", "query_name"]
    found = answers.join(small.select(*key, log_odds().alias("log_odds")), key)
    lost = answers.join(small, key, "left_anti").agg(F.count(F.lit(1)).alias("lost")).join(answers.agg(F.count(F.lit(1)).alias("n")))
    label = F.col("prediction")
    if gold is not None:
        found = found.join(gold.select("document_id", "query_name", F.col("prediction").alias("_gold")), ["document_id", "query_name"], "left")
        label = F.coalesce("_gold", F.lit(MISSING_GOLD))
    yes = lambda c: F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))).isin("yes", "1", "true").cast("int")
    out = found.withColumns({"gold": yes(label), "human": yes(F.col("ground_truth"))})
    return out.drop("_gold"), lost


def read_rungs(spark: SparkSession, path: str) -> DataFrame:
    """document_id, query_name, log_odds of a ladder's CSV."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(F.col("document_id").cast("long").alias("document_id"), "query_name", log_odds_of(raw).alias("log_odds"))


def log_odds_of(raw: DataFrame) -> Column:
    return F.least(F.greatest(F.col("logprob_true").cast("double") - F.col("logprob_false").cast("double"), F.lit(-30.0)), F.lit(30.0))


def read_mask(spark: SparkSession, path: str) -> DataFrame:
    """document_id, query_name, in_sample of a manifest's CSV; only true is true."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(F.col("document_id").cast("long").alias("document_id"), "query_name", (F.lower(F.trim("in_sample")) == "true").alias("in_sample"))


def ladder(base: DataFrame, rungs: dict[str, DataFrame], mask: DataFrame, key: tuple[str, ...] = ("document_id", "query_name")) -> DataFrame:
    """base with a column of log-odds for each rung and in_sample. Points that a rung does not have are null there and have finite false."""
    out = base.join(mask.select(*key, "in_sample"), list(key), "left").withColumn("in_sample", F.coalesce("in_sample", F.lit(False)))
    finite = F.lit(True)
    for name, rows in rungs.items():
        out = out.join(rows.select(*key, F.col("log_odds").alias(name)), list(key), "left")
        finite = finite & F.col(name).isNotNull() & ~F.isnan(name)
    return out.withColumn("finite", finite)


def points(documents: DataFrame, pairs: DataFrame, queries: DataFrame) -> DataFrame:
    """pairs with their document (pairs without one go) and the predicate's description (empty if unknown)."""
    joined = pairs.join(documents, "document_id").join(queries, "query_name", "left")
    return joined.withColumn("query_description", F.coalesce("query_description", F.lit("")))


def order_key(order: str, seed: int = 0, length: Column | None = None) -> list[Column]:
    """Sort columns within a predicate; the seeded shuffle sorts by a digest. length: characters of the text, where the text itself is not at hand."""
    if order not in ORDERS:
        raise ValueError(f"unknown order {order!r}; known: {ORDERS}")
    chars = F.length("text") if length is None else length
    by = {
        "doc_id": [],
        "shortest": [chars.asc()],
        "longest": [chars.desc()],
        "shuffled": [F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("query_name"), F.col("doc_id").cast("string"))).asc()],
    }[order]
    return [*by, F.col("doc_id").asc()]
