"""Learners that see observations in order: Bayesian logistic heads, linear bandits, refitted routers."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import settled
from . import prefix

#: Rows that a fold in order brings to the driver at once.
FOLD_ROWS = 20_000


def sigmoid(x: float, eps: float = 1e-6) -> float:
    p = 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))
    return min(max(p, eps), 1 - eps)


@dataclass
class LogisticHead:
    """A Gaussian belief over the weights of a logistic model, updated one observation at a time."""

    mean: np.ndarray
    spread: np.ndarray  # inverse precision
    n: int = 0

    @classmethod
    def new(cls, width: int, precision: float = 1.0) -> "LogisticHead":
        return cls(np.zeros(width), np.eye(width) / precision)

    def score(self, phi: np.ndarray) -> float:
        return float(phi @ self.mean)

    def update(self, phi: np.ndarray, y: float, weight: float = 1.0) -> None:
        p = sigmoid(self.score(phi))
        r = weight * p * (1 - p)
        u = self.spread @ phi
        whole = 1 + r * float(phi @ u)
        self.spread = self.spread - np.outer(u * (r / whole), u)
        self.mean = self.mean - u * (weight * (p - y) / whole)  # the new spread times phi is u / whole
        self.n += 1

    def dump(self) -> str:
        return json.dumps({"mean": self.mean.tolist(), "spread": self.spread.tolist(), "n": self.n})

    @classmethod
    def load(cls, text: str) -> "LogisticHead":
        d = json.loads(text)
        out = cls(np.array(d["mean"]), np.array(d["spread"]), int(d["n"]))
        if out.spread.shape != (len(out.mean), len(out.mean)):
            raise ValueError("a head's spread must be square and fit its mean")
        return out


def credits(p: np.ndarray) -> np.ndarray:
    """Weights of a set's members: its size times the softmax of their log-odds."""
    p = np.clip(p, 1e-6, 1 - 1e-6)
    z = np.log(p / (1 - p))
    e = np.exp(z - z.max())
    return len(p) * e / e.sum()


@dataclass
class SharedHeads:
    """A head for all predicates, and one for each, which counts more the more it has seen. Without own heads the shared one decides."""

    width: int
    lean: float = 20.0
    per_query: bool = True
    precision: float = 1.0
    whole: LogisticHead = field(init=False)
    own: dict[str, LogisticHead] = field(default_factory=dict)

    def __post_init__(self):
        self.whole = LogisticHead.new(self.width, self.precision)

    def share(self, query: str) -> float:
        """Weight of a predicate's own head; it counts lessons seen, not escalations."""
        n = self.own[query].n if query in self.own else 0
        return n / (n + self.lean)

    def _mixed(self, query: str, of: Callable[[LogisticHead], np.ndarray]) -> np.ndarray:
        w = self.share(query)
        return (1 - w) * of(self.whole) + w * of(self.own[query]) if w else of(self.whole)

    def score(self, query: str, phi: np.ndarray) -> float:
        return float(phi @ self._mixed(query, lambda h: h.mean))

    def scores(self, query: str, phis: np.ndarray) -> np.ndarray:
        """The chance that the small model is right, for each lesson."""
        return 1 / (1 + np.exp(-np.clip(phis @ self._mixed(query, lambda h: h.mean), -60, 60)))

    def variance(self, query: str, phis: np.ndarray) -> np.ndarray:
        """Posterior variance of the log-odds, with the spreads blended as the means are."""
        spread = self._mixed(query, lambda h: h.spread)
        return np.maximum(np.einsum("ij,ij->i", phis @ spread, phis), 0.0)

    def observe(self, query: str, phis: np.ndarray, agreed: bool, weight: float = 1.0) -> None:
        """A set of lessons and whether the small model was right with them."""
        if not len(phis):
            return
        mean = self._mixed(query, lambda h: h.mean)
        p = np.array([sigmoid(x) for x in (phis @ mean).tolist()])
        own = self.own.setdefault(query, LogisticHead.new(self.width, self.precision)) if self.per_query else None
        for x, c in zip(phis, credits(p), strict=True):
            self.whole.update(x, float(agreed), float(c) * weight)
            if own is not None:
                own.update(x, float(agreed), float(c) * weight)

    def dump(self) -> dict:
        return {"width": self.width, "lean": self.lean, "per_query": self.per_query, "precision": self.precision, "whole": self.whole.dump(), "own": {q: h.dump() for q, h in self.own.items()}}

    @classmethod
    def load(cls, d: dict, shared_only: bool = False) -> "SharedHeads":
        """shared_only: as from an offline snapshot, after which predicates start anew."""
        out = cls(d["width"], d["lean"], d["per_query"], d["precision"])
        out.whole = LogisticHead.load(d["whole"])
        if out.whole.mean.shape != (out.width,):
            raise ValueError(f"a head of width {len(out.whole.mean)} does not fit {out.width} features")
        out.own = {} if shared_only else {q: LogisticHead.load(t) for q, t in d["own"].items()}
        return out


@dataclass
class LinearBandit:
    """Upper confidence bounds of a linear reward."""

    a_inv: np.ndarray
    b: np.ndarray
    alpha: float = 1.0

    @classmethod
    def new(cls, width: int, alpha: float = 1.0) -> "LinearBandit":
        return cls(np.eye(width), np.zeros(width), alpha)

    def score(self, phi: np.ndarray) -> float:
        return float(phi @ self.a_inv @ self.b + self.alpha * np.sqrt(max(0.0, float(phi @ self.a_inv @ phi))))

    n: int = 0

    def update(self, phi: np.ndarray, reward: float) -> None:
        u = self.a_inv @ phi
        self.a_inv = self.a_inv - np.outer(u, u) / (1 + float(phi @ u))
        self.b = self.b + reward * phi
        self.n += 1

    def scores(self, query: str, phis: np.ndarray) -> np.ndarray:
        return phis @ (self.a_inv @ self.b) + self.alpha * np.sqrt(self.variance(query, phis))

    def variance(self, query: str, phis: np.ndarray) -> np.ndarray:
        return np.maximum(np.einsum("ij,ij->i", phis @ self.a_inv, phis), 0.0)

    def observe(self, query: str, phis: np.ndarray, agreed: bool, weight: float = 1.0) -> None:
        for x in phis:
            self.update(x, float(agreed))

    def dump(self) -> dict:
        return {"a_inv": self.a_inv.tolist(), "b": self.b.tolist(), "alpha": self.alpha, "n": self.n}

    @classmethod
    def load(cls, d: dict) -> "LinearBandit":
        return cls(np.array(d["a_inv"]), np.array(d["b"]), d["alpha"], d["n"])


@dataclass
class Refits:
    """When a router's buffer of observations is due for a new fit."""

    every: int = 500
    least_new: int = 10
    least_class: int = 30
    newest: int = 5000
    rows: list[tuple[list[float], int]] = field(default_factory=list)
    since: int = 0
    new: int = 0

    def point(self) -> None:
        self.since += 1

    def observe(self, features: list[float], agreed: int) -> bool:
        """Adds an observation; whether a fit is due now. One that is due too early is put off by a whole period."""
        self.rows.append((features, agreed))
        del self.rows[: -self.newest]
        self.new += 1
        if self.since < self.every:
            return False
        classes = [sum(1 for _, y in self.rows if y == c) for c in (0, 1)]
        ready = self.new >= self.least_new and min(classes) >= self.least_class
        self.since = 0
        if ready:
            self.new = 0
        return ready


    def dump(self) -> dict:
        return {"rows": self.rows, "since": self.since, "new": self.new}


def bandit_sums(rows: DataFrame, features: str = "phi", reward: str = "y") -> DataFrame:
    """(i, j, value) of the sum of phi phi', and (i, -1, value) of the sum of reward x phi.

    What a linear bandit learns from rows does not depend on their order, so it is added up where the rows are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.array(b.column(features).to_pylist(), np.float64)
            whole = np.column_stack([np.array(b.column(reward).to_pylist(), np.float64) @ x, x.T @ x])
            i, j = np.indices(whole.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32) - 1), pa.array(whole.ravel())], ["i", "j", "value"])

    return rows.select(features, reward).mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))


def bandit_of(sums: DataFrame, width: int, alpha: float = 1.0, n: int = 0) -> LinearBandit:
    """The bandit after the rows of bandit_sums (width x (width + 1) numbers), from a unit prior."""
    a, b = np.eye(width), np.zeros(width)
    for r in sums.collect():
        if r["j"] < 0:
            b[r["i"]] += r["value"]
        else:
            a[r["i"], r["j"]] += r["value"]
    return LinearBandit(np.linalg.inv(a), b, alpha, n)


def fold_in_order(rows: DataFrame, order: str, step: Callable, at_once: int = FOLD_ROWS) -> int:
    """step(row) for every row in an order that no parallel plan can replace; the number of rows.

    rows are settled under their place in the order, and at most `at_once` of them are on the driver at a time.
    """
    placed = settled(prefix.position(rows.withColumn("_all", F.lit(0)), ["_all"], order).drop("_all"))
    n = placed.count()
    for low in range(0, n, at_once):
        for r in placed.where((F.col("t") > low) & (F.col("t") <= low + at_once)).orderBy("t").collect():
            step(r)
    return n


@dataclass
class Logit:
    """A logistic model on scaled features, small enough to be one column expression."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    @staticmethod
    def fits(y: list | np.ndarray, least: int = 20) -> bool:
        """Whether fit gives a model for these labels."""
        return len(y) >= least and len(np.unique(y)) >= 2

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, c: float = 1.0, rounds: int = 50, least: int = 20) -> "Logit | None":
        """Newton steps on the balanced, ridge-penalised likelihood; None with fewer than `least` rows or one class."""
        y = np.asarray(y, float)
        if not cls.fits(y, least):
            return None
        mean, scale = x.mean(0), x.std(0)
        scale[scale == 0] = 1.0
        z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
        w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))) * (1.0 if weight is None else weight)
        ridge = np.append(np.full(x.shape[1], 1 / c), 1e-9)
        theta = np.zeros(z.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ theta, -60, 60)))
            grad = z.T @ (w * (p - y)) + ridge * theta
            curve = (z * (w * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ z + np.diag(ridge)
            move = np.linalg.solve(curve, grad)
            theta = theta - move
            if np.abs(move).max() < 1e-10:
                break
        return cls(mean, scale, theta[:-1], float(theta[-1]))

    def chance(self, features: str = "features") -> Column:
        """p_agree as an expression, so scoring stays in the JVM."""
        slope = self.weights / self.scale
        lit = F.array(*[F.lit(float(x)) for x in slope])
        total = F.aggregate(F.zip_with(F.col(features), lit, lambda a, b: a * b), F.lit(self.bias - float(self.mean @ slope)), lambda s, v: s + v)
        return 1 / (1 + F.exp(-F.least(F.greatest(total, F.lit(-60.0)), F.lit(60.0))))

    def dump(self) -> dict:
        return {"mean": self.mean.tolist(), "scale": self.scale.tolist(), "weights": self.weights.tolist(), "bias": self.bias}

    @classmethod
    def load(cls, d: dict) -> "Logit":
        return cls(np.array(d["mean"]), np.array(d["scale"]), np.array(d["weights"]), d["bias"])


HEADS = ("gbt", "forest", "logistic", "mlp")


def _stages(kind: str, width: int) -> list:
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
    from pyspark.ml.feature import StandardScaler

    shared = {"labelCol": "label", "weightCol": "balance", "probabilityCol": "probability"}
    scaler = StandardScaler(inputCol="vector", outputCol="scaled", withMean=True)
    if kind == "gbt":
        return [GBTClassifier(featuresCol="vector", maxIter=20, maxDepth=4, stepSize=0.1, minInstancesPerNode=5, seed=0, labelCol="label", weightCol="balance")]
    if kind == "forest":
        return [RandomForestClassifier(featuresCol="vector", numTrees=40, seed=0, **shared)]
    if kind == "logistic":
        return [scaler, LogisticRegression(featuresCol="scaled", regParam=0.01, **shared)]
    if kind == "mlp":  # has no weights
        return [scaler, MultilayerPerceptronClassifier(featuresCol="scaled", layers=[width, 32, 2], maxIter=100, seed=0, labelCol="label", probabilityCol="probability")]
    raise KeyError(f"unknown head {kind!r}; known: {HEADS}")


def fit_router(rows: DataFrame, kind: str = "gbt", features: str = "features", label: str = "z", weight: str | None = None, calibrate: str | bool | None = None, folds: int = 3):
    """A fitted pipeline that adds p_agree; None if there are fewer than 20 rows or one class (then the bootstrap rule decides).

    calibrate: "sigmoid", "isotonic", or True for the first below 200 rows and the second from there on. It is fitted
    on predictions for rows that the model which made them has not seen: folds by a hash of the features.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import array_to_vector

    if kind not in HEADS:
        raise KeyError(f"unknown head {kind!r}; known: {HEADS}")
    told = rows.where(F.col(label).isNotNull()).withColumn("label", F.col(label).cast("double"))
    counted = told.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max(F.size(features)).alias("width")).collect()
    classes = {r["label"]: r["n"] for r in counted}
    total = sum(classes.values())
    if total < 20 or len(classes) < 2:
        return None
    share = F.when(F.col("label") == 1, total / (2 * classes[1.0])).otherwise(total / (2 * classes[0.0]))
    ready = told.withColumn("vector", array_to_vector(features)).withColumn("balance", share if weight is None else share * F.col(weight))
    pipeline = Pipeline(stages=_stages(kind, counted[0]["width"]))
    model = pipeline.fit(ready)
    if not calibrate:
        return model
    method = calibrate if isinstance(calibrate, str) else "sigmoid" if total < 200 else "isotonic"
    folds = max(2, min(folds, *classes.values()))
    parted = ready.withColumn("_fold", F.pmod(F.xxhash64(features), F.lit(folds)))
    seen = None
    for f in range(folds):
        part = parted.where(F.col("_fold") != f)
        if part.select("label").distinct().count() < 2:
            return model
        out = predict(pipeline.fit(part), parted.where(F.col("_fold") == f), features).select("p_agree", "label")
        seen = out if seen is None else seen.unionByName(out)
    return model, _calibrator(seen, method)


def _calibrator(seen: DataFrame, method: str):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    if method == "isotonic":
        return IsotonicRegression(featuresCol="p_agree", labelCol="label", predictionCol="calibrated").fit(seen)
    if method != "sigmoid":
        raise KeyError(f"unknown calibration {method!r}; known: sigmoid, isotonic")
    return Pipeline(stages=[VectorAssembler(inputCols=["p_agree"], outputCol="own"), LogisticRegression(featuresCol="own", labelCol="label", probabilityCol="pair", rawPredictionCol="raw_pair", predictionCol="none")]).fit(seen)


def predict(model, rows: DataFrame, features: str = "features") -> DataFrame:
    """rows with p_agree; null without a model."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    if model is None:
        return rows.withColumn("p_agree", F.lit(None).cast("double"))
    model, step = model if isinstance(model, tuple) else (model, None)
    out = model.transform(rows.withColumn("vector", array_to_vector(features)))
    out = out.withColumn("p_agree", vector_to_array("probability")[1]).select(*rows.columns, "p_agree")
    if step is None:
        return out
    told = step.transform(out)
    value = F.col("calibrated") if "calibrated" in told.columns else vector_to_array("pair")[1]
    return told.withColumn("p_agree", value).select(*rows.columns, "p_agree")


def fit_proxy(rows: DataFrame, features: str = "vec", label: str = "large") -> Callable[[DataFrame], DataFrame]:
    """A cheap stand-in for the large model: adds proxy, the chance of Yes. With one class it is that class, without rows one half.

    Up to FOLD_ROWS labelled rows are fitted on the driver and scored by an expression; more are fitted where they are.
    """
    told = rows.where(F.col(label).isNotNull()).select(F.col(features).alias("x"), F.col(label).alias("y"))
    held = told.limit(FOLD_ROWS + 1).collect()
    classes = {r["y"] for r in held}
    if len(held) > FOLD_ROWS:
        model = fit_router(rows, "logistic", features, label)
        if model is not None:
            return lambda df: predict(model, df, features).withColumnRenamed("p_agree", "proxy")
    elif len(classes) == 2:
        logit = Logit.fit(np.array([r["x"] for r in held], float), np.array([r["y"] for r in held]), least=2)
        return lambda df: df.withColumn("proxy", logit.chance(features))
    flat = float(classes.pop()) if classes else 0.5
    return lambda df: df.withColumn("proxy", F.lit(flat))


def save_router(model, path: str, threshold: float = 0.5, about: dict | None = None) -> None:
    """A checkpoint folder: the pipeline, its calibration, and what is known of it."""
    from pyspark.sql import SparkSession as S

    model, step = model if isinstance(model, tuple) else (model, None)
    model.write().overwrite().save(f"{path}/model")
    if step is not None:
        step.write().overwrite().save(f"{path}/calibration")
    facts = {"threshold": threshold, "calibration": type(step).__name__ if step is not None else "", **(about or {})}
    S.getActiveSession().createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_router(spark: SparkSession, path: str, threshold: float = 0.5):
    """(model, threshold, facts) of a checkpoint; its threshold holds unless another than one half is given."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.regression import IsotonicRegressionModel

    facts = json.loads(spark.read.text(f"{path}/about").first()[0])
    model = PipelineModel.load(f"{path}/model")
    if facts["calibration"]:
        kind = IsotonicRegressionModel if facts["calibration"].startswith("Isotonic") else PipelineModel
        model = (model, kind.load(f"{path}/calibration"))
    return model, facts["threshold"] if math.isclose(threshold, 0.5) else threshold, facts


def out_of_fold_agreement(rows: DataFrame, key: list[str], features: str = "vec", label: str = "large", folds: int = 5, id_column: str = "doc_id") -> DataFrame:
    """For each key: how often a proxy fitted on the other folds agrees with the label (agreement, n, note). Few keys.

    Folds alternate within each class in digest order; a key with one class agrees trivially, as does one whose
    smaller class has fewer than two rows.
    """
    w = Window.partitionBy(*key, label).orderBy(F.md5(F.col(id_column).cast("string")), id_column)
    held = settled(rows.where(F.col(label).isNotNull()).withColumn("_i", F.row_number().over(w) - 1))
    out = []
    for r in held.groupBy(*key).agg(F.count_if(F.col(label) == 1).alias("a"), F.count_if(F.col(label) == 0).alias("b")).collect():
        own = held.where(" and ".join(f"{k} <=> '{r[k]}'" for k in key))
        n = r["a"] + r["b"]
        least = min(r["a"], r["b"])
        if least < 2:
            out.append((*[r[k] for k in key], 1.0, n, "one class" if not least else "too few"))
            continue
        parts = min(folds, least)
        right = 0
        for f in range(parts):
            here = F.pmod(F.col("_i"), F.lit(parts)) == f
            told = fit_proxy(own.where(~here), features, label)(own.where(here))
            right += told.where((F.col("proxy") >= 0.5).cast("int") == F.col(label)).count()
        out.append((*[r[k] for k in key], right / n, n, f"{parts} folds"))
    return rows.sparkSession.createDataFrame(out, ", ".join(f"{k} string" for k in key) + ", agreement double, n long, note string")


def log_loss(df: DataFrame, p: str = "p_agree", label: str = "z") -> DataFrame:
    q = F.least(F.greatest(F.col(p), F.lit(1e-9)), F.lit(1 - 1e-9))
    return df.agg(F.round(F.avg(-(F.col(label) * F.log(q) + (1 - F.col(label)) * F.log(1 - q))), 6).alias("log_loss"))
