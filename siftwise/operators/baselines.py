"""Comparison cascades: threshold sweeps, simulated ladders, replays, proxies."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.config import Price
from ..sources.shared import settled
from . import learners, metrics, prefix, sampling


def histogram(df: DataFrame, key: list[str], x: str, low: float, high: float, bins: int = 64) -> DataFrame:
    """Rows per equal-width bin; the upper end belongs to the last bin."""
    width = (high - low) / bins
    at = F.greatest(F.least(F.floor((F.col(x) - low) / width), F.lit(bins - 1)), F.lit(0)).cast("int")
    return df.groupBy(*key, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("truth") == 1).alias("n_pos"))


def band(x: Column, low: Column, high: Column) -> Column:
    """0 below low, 1 from high on, -1 between."""
    return F.when(x < low, 0).when(x >= high, 1).otherwise(-1)


def band_sweep(df: DataFrame, key: list[str], x: str, steps: list[float], budgets: list[float]) -> DataFrame:
    """For each budget (share sent to the large model) the band of the best accuracy within it.

    df: x, truth, large (0 or 1). Rows are counted by step once, so the sweep over all pairs of
    steps works on counts and not on rows. Ties go to fewer calls, then the lower and narrower band;
    a key without a band within budget has none.
    """
    edges = F.array(*[F.lit(float(s)) for s in steps])
    place = F.size(F.filter(edges, lambda e: e <= F.col(x)))  # steps at or below x
    counts = df.groupBy(*key, place.alias("place")).agg(F.count(F.lit(1)).alias("n"), F.sum("truth").alias("pos"), F.count_if(F.col("truth") == F.col("large")).alias("large_right"))
    spark = df.sparkSession
    pairs = spark.createDataFrame([(i, j, float(steps[i]), float(steps[j])) for i in range(len(steps)) for j in range(i, len(steps))], "i int, j int, low double, high double")
    swept = counts.join(F.broadcast(pairs))  # fixed number of pairs
    below, above = F.col("place") <= F.col("i"), F.col("place") > F.col("j")
    right = F.when(below, F.col("n") - F.col("pos")).when(above, F.col("pos")).otherwise(F.col("large_right"))
    sent = F.when(below | above, 0).otherwise(F.col("n"))
    totals = swept.groupBy(*key, "low", "high").agg(F.sum(right).alias("right"), F.sum(sent).alias("sent"), F.sum("n").alias("n"))
    b = spark.createDataFrame([(float(x),) for x in budgets], "budget double")
    within = totals.join(F.broadcast(b), F.col("sent") <= F.col("budget") * F.col("n"))
    w = Window.partitionBy(*key, "budget").orderBy(F.desc("right"), "sent", "low", "high")
    return within.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*key, "budget", "low", "high", F.round(F.col("right") / F.col("n"), 6).alias("accuracy"), F.round(F.col("sent") / F.col("n"), 6).alias("sent_share"))


def best_threshold(df: DataFrame, key: list[str], x: str) -> DataFrame:
    """The best accuracy and the best F1 of a single cut: all rows from it on are taken as positive, or none (cut null).

    Equal scores stay together, since no threshold parts them. Ties go to fewer positives. Sums run in ranges of scores.
    """
    per = df.groupBy(*key, F.col(x).alias("cut")).agg(F.count(F.lit(1)).alias("n"), F.sum("truth").alias("pos"))
    upto = prefix.running_by(per, key, [F.desc("cut")], {"taken": F.col("n"), "tp": F.col("pos")}).select(*key, "cut", "taken", "tp")
    totals = df.groupBy(*key).agg(F.count(F.lit(1)).alias("total"), F.sum("truth").alias("all_pos"))
    none = totals.select(*key, F.lit(None).cast("double").alias("cut"), F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("tp"))
    swept = upto.withColumn("cut", F.col("cut").cast("double")).unionByName(none).join(totals, key)
    fp, fn = F.col("taken") - F.col("tp"), F.col("all_pos") - F.col("tp")
    right = F.col("total") - fp - fn
    f1 = F.when(2 * F.col("tp") + fp + fn > 0, 2 * F.col("tp") / F.greatest(2 * F.col("tp") + fp + fn, F.lit(1))).otherwise(0.0)
    swept = swept.withColumns({"right": right, "_f1": F.round(f1, 9)})
    best = lambda value: F.max(F.struct(F.col(value).alias("v"), (-F.col("taken")).alias("less"), F.col("cut").alias("cut")))
    out = swept.groupBy(*key).agg(best("right").alias("a"), best("_f1").alias("f"), F.max("total").alias("total"))
    return out.select(*key, F.col("a.cut").alias("cut"), F.round(F.col("a.v") / F.col("total"), 6).alias("accuracy"), F.col("f.cut").alias("f1_cut"), F.round("f.v", 6).alias("f1"))


def banded(df: DataFrame, x: str, low: float, high: float, always: Column | None = None, key: list[str] | None = None, price: Price = Price()) -> DataFrame:
    """What a pair of thresholds serves: rows of the band, and those of `always` (labelled samples), have the large answer.

    df: truth and large (0 or 1), large_in. Gives for each key accuracy, f1, agreement with the large model, escalations and their dollars.
    """
    key = key or []
    place = band(F.col(x), F.lit(low), F.lit(high))
    sent = (place == -1) | (F.coalesce(always, F.lit(False)) if always is not None else F.lit(False))
    told = df.withColumns({"_sent": sent, "_served": F.when(sent, F.col("large")).otherwise(place)})
    tokens = F.col("large_in") if "large_in" in df.columns else F.lit(0)
    more = told.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_valid"), F.count_if(place == -1).alias("n_uncertain"), F.round(F.avg(F.col("_sent").cast("double")), 6).alias("esc_rate"),
        F.round(F.avg((F.col("_served") == F.col("large")).cast("double")), 6).alias("acc_vs_large"), F.round(F.sum(F.when(F.col("_sent"), tokens * price.large_in + price.large_out).otherwise(0.0)), 9).alias("usd"),
    )
    base = metrics.confusion(told, key, "_served", "truth")
    return base.join(more, key) if key else base.join(more)


def degenerate(df: DataFrame, key: list[str], price: Price = Price()) -> DataFrame:
    """As banded, for keys whose proxy cannot be trained: every row has the large answer."""
    return banded(df.withColumn("_x", F.lit(0.0)), "_x", -1.0, 1.0, None, key, price)


def alpha_thresholds(counts: DataFrame, key: list[str], alphas: list[float]) -> DataFrame:
    """For each target share of right verdicts outside the band, the narrowest band on smoothed histograms that reaches it.

    counts: key, bin, n, n_pos (a labelled sample's histogram; a few dozen bins a key). Below low all are taken as 0,
    from high on as 1. A key without such a band has the whole range in it.
    """
    kinds = dict(counts.dtypes)
    smooth = sampling.moving_average(sampling.moving_average(counts.withColumn("n_neg", F.col("n") - F.col("n_pos")), key, "bin", "n_pos", "pos"), key, "bin", "n_neg", "neg")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        pos, neg, bins = pdf["pos"].to_numpy(), pdf["neg"].to_numpy(), pdf["bin"].to_numpy()
        p, q = np.concatenate([[0], np.cumsum(pos)]), np.concatenate([[0], np.cumsum(neg)])
        n, out = len(bins), []
        for a in alphas:
            best = None
            for i in range(n + 1):
                for j in range(i, n + 1):
                    outside = p[i] + q[i] + (p[n] - p[j]) + (q[n] - q[j])
                    right = q[i] + (p[n] - p[j])
                    if outside > 0 and right >= a * outside and (best is None or j - i < best[1] - best[0]):
                        best = (i, j)
            i, j = best or (0, n)
            out.append({**{k: pdf[k].iloc[0] for k in key}, "alpha": a, "low_bin": int(bins[i]) if i < n else int(bins[-1]) + 1, "high_bin": int(bins[j]) if j < n else int(bins[-1]) + 1})
        return pd.DataFrame(out)

    return smooth.groupBy(*key).applyInPandas(fit, ", ".join(f"{k} {kinds[k]}" for k in key) + ", alpha double, low_bin int, high_bin int")


def ladder(df: DataFrame, rungs: list[tuple[str, float, float, bool]], fallback: str = "large") -> DataFrame:
    """Verdicts of a cascade of rungs (column of log-odds, lower and upper threshold, picked): below lower 0, above upper 1, else the next; the large model at the end."""
    verdict, rung = F.lit(None).cast("int"), F.lit(None).cast("int")
    for k, (column, low, high, picked) in enumerate(rungs):
        if not picked:
            continue
        x = F.least(F.greatest(F.col(column), F.lit(-30.0)), F.lit(30.0))
        own = F.when(x < low, 0).when(x > high, 1)
        rung = F.when(verdict.isNull() & own.isNotNull(), k).otherwise(rung)
        verdict = F.coalesce(verdict, own)
    return df.withColumn("rung", F.coalesce(rung, F.lit(len(rungs)))).withColumn("verdict", F.coalesce(verdict, F.col(fallback)))


def replay(rows: DataFrame, stages: DataFrame, key: list[str]) -> DataFrame:
    """The first stage, in order, whose confidence reaches its class's threshold; else the large verdict.

    rows: keys, stage, prediction, confidence, large_prediction; stages: stage, stage_no, yes_at, no_at.
    """
    told = rows.join(F.broadcast(stages), "stage")
    at = F.when(F.col("prediction") == "Yes", F.col("yes_at")).when(F.col("prediction") == "No", F.col("no_at"))
    sure = F.col("confidence") >= at
    first = F.min_by(F.when(sure, F.struct("prediction", "stage")), F.when(sure, F.col("stage_no")))
    out = told.groupBy(*key).agg(first.alias("f"), F.first("large_prediction").alias("large_prediction"))
    return out.select(*key, F.coalesce("f.prediction", "large_prediction").alias("prediction"), F.coalesce("f.stage", F.lit("large")).alias("stage"), F.col("f").isNull().alias("escalated"), "large_prediction")


def served(df: DataFrame) -> DataFrame:
    """Labelled rows have the large answer (an undecided one is unknown), others the proxy's by one half."""
    large = F.when(F.col("large_prediction").isin("Yes", "No"), F.col("large_prediction")).otherwise("UNKNOWN")
    return df.withColumn("served", F.when(F.col("labelled"), large).otherwise(F.when(F.col("proxy") >= 0.5, "Yes").otherwise("No")))


def proxy_outcomes(df: DataFrame, key: list[str], agree_at: float) -> DataFrame:
    """Whether the proxy serves a predicate: its agreement with the large model on probed rows reaches the limit, else all goes to the large one."""
    agree = F.avg(F.when(F.col("probed"), ((F.col("proxy") >= 0.5) == (F.col("large_prediction") == "Yes")).cast("double")))
    out = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count_if("probed").alias("n_probe"), agree.alias("agreement"))
    use = F.coalesce(F.col("agreement") >= agree_at, F.lit(False))
    return out.select(*key, "n", "n_probe", F.round("agreement", 6).alias("agreement"), use.alias("proxy_used"), F.when(use, F.col("n_probe")).otherwise(F.col("n")).alias("large_calls"))


def serve_both(df: DataFrame, key: list[str], probe_share: float, seed: int, folds: int, agree_at: float, features: str = "vec", serves_all: bool = False) -> DataFrame:
    """A proxy trained on a labelled probe of each key: whether it may serve, by agreement on folds, and how both outcomes do.

    df: key, doc_id, features, large (0, 1 or null), truth. The probe has at least 20 rows. Few keys, one model each.
    """
    n = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    size = F.least(F.col("_n"), F.greatest(F.lit(20), F.bround(F.col("_n") * probe_share, 0)))
    ranked = prefix.numbered_by_digest(df, key, sampling.digest(seed, "doc_id"), ["doc_id"], "_r").join(n, key)
    rows = settled(ranked.withColumn("probed", F.col("_r") <= size).drop("_r", "_n"))
    agreement = learners.out_of_fold_agreement(rows.where("probed"), key, features, "large", folds)
    out = None
    for r in rows.select(*key).distinct().collect():
        own = rows.where(" and ".join(f"{k} <=> '{r[k]}'" for k in key))
        told = learners.fit_proxy(own.where("probed"), features, "large")(own)
        out = told if out is None else out.unionByName(told)
    own_answer = (F.col("proxy") >= 0.5).cast("int")
    served = own_answer if serves_all else F.when(F.col("probed") & F.col("large").isNotNull(), F.col("large")).otherwise(own_answer)
    unknown = F.lit(False) if serves_all else F.col("probed") & F.col("large").isNull()
    both = out.withColumns({"_served": served, "_unknown": unknown})
    rename = lambda d, name: d.select(*key, *[F.col(c).alias(f"{name}_{c}") for c in d.columns if c not in key])
    one = rename(metrics.confusion(both, key, "_served", "truth", F.col("_unknown")), "proxy")
    two = rename(metrics.confusion(both, key, "large", "truth"), "large")
    return one.join(two, key).join(agreement, key).withColumn("proxy_used", F.col("agreement") >= agree_at)


def active_rounds(df: DataFrame, key: list[str], seed_share: float, round_share: float, seed: int, rounds: int | None = None, features: str = "vec") -> DataFrame:
    """Labelling of the most confident rows first: for each key and round, how the rows are served.

    df: key, doc_id, features, large (0, 1 or null), truth. The seed set goes on until both classes are in it; each round
    labels the rows that the proxy is surest of, and the proxy is fitted anew. It ends when all rows are labelled.
    """
    counts = {tuple(r[k] for k in key): r["n"] for r in df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).collect()}
    out = None
    for own_key, n in counts.items():
        own = settled(df.where(" and ".join(f"{k} <=> '{v}'" for k, v in zip(key, own_key, strict=True))))
        known = own.where("large is not null").withColumn("label", F.col("large"))
        first = sampling.until_both(known, key, seed, max(2, round(seed_share * n)), ["doc_id"]).select("doc_id")
        labelled, batch, r = settled(first.withColumn("at", F.lit(0))), max(1, round(round_share * n)), 0
        while True:
            marked = own.join(labelled.select("doc_id", F.lit(True).alias("labelled")), "doc_id", "left").withColumn("labelled", F.coalesce("labelled", F.lit(False)))
            told = settled(learners.fit_proxy(marked.where("labelled and large is not null"), features, "large")(marked))
            answer = F.when(F.col("labelled"), F.col("large")).otherwise((F.col("proxy") >= 0.5).cast("int"))
            row = metrics.confusion(told.withColumn("_served", answer), key, "_served", "truth").join(told.groupBy(*key).agg(F.count_if("labelled").alias("n_large"), F.count(F.lit(1)).alias("n")), key).withColumn("round_idx", F.lit(r))
            out = row if out is None else out.unionByName(row)
            left = told.where("not labelled")
            if (rounds is not None and r >= rounds) or left.isEmpty():
                break
            more = sampling.surest(left, key, "proxy", "doc_id", batch).select("doc_id")
            r += 1
            labelled = settled(labelled.unionByName(more.withColumn("at", F.lit(r))))
    return out.withColumn("share", F.round(F.col("n_large") / F.col("n"), 6))


def beta_lower(hits: int, misses: int, confidence: float) -> float:
    """The (1 - confidence) quantile of Beta(hits + 1, misses + 1), by bisection of its distribution."""
    a, b, p = hits + 1, misses + 1, 1 - confidence
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if _beta_cdf(mid, a, b) < p else (low, mid)
    return (low + high) / 2


def _beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    value = d
    for m in range(1, 10_000):
        step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / (1 + step * d or tiny)
        c = 1 + step / c or tiny
        value *= c * d
        step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + step * d or tiny)
        c = 1 + step / c or tiny
        value *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return min(1.0, front * value)


def reaches(hits: int, misses: int, target: float, confidence: float) -> bool:
    """Whether beta_lower(hits, misses, confidence) is target or more, by one value of the distribution."""
    return _beta_cdf(target, hits + 1, misses + 1) <= 1 - confidence


def fit_one_rung(sample: DataFrame, key: list[str], precision: float, recall: float, confidence: float) -> DataFrame:
    """Thresholds (low, high) of one rung of each key and the share they settle (settled), by trying all cuts.

    sample: key, x (log-odds), large (0 or 1). The share of right verdicts below low must reach recall, and that above high
    precision, with the confidence given; of the pairs that do, the one that settles most is taken. Rows are counted by
    score and summed in ranges, so a key may have any number of them.
    """
    per = sample.groupBy(*key, "x").agg(F.count(F.lit(1)).alias("n"), F.sum("large").alias("pos"))
    upto = prefix.running_by(per, key, [F.asc("x")], {"i": F.col("n"), "p": F.col("pos")}, through=False)
    totals = sample.groupBy(*key).agg(F.count(F.lit(1)).alias("total"), F.sum("large").alias("all_pos"), F.max("x").alias("top"))
    end = totals.select(*key, F.lit(None).cast("double").alias("x"), F.col("total").alias("i"), F.col("all_pos").alias("p"))
    cuts = upto.select(*key, "x", "i", "p").unionByName(end).join(totals, key)

    @F.pandas_udf("boolean")
    def ok(hits: pd.Series, misses: pd.Series, target: pd.Series) -> pd.Series:
        return pd.Series([reaches(int(h), int(m), t, confidence) for h, m, t in zip(hits, misses, target, strict=True)])

    low_ok = (F.col("i") == 0) | ok(F.col("i") - F.col("p"), F.col("p"), F.lit(float(recall)))
    above_pos = F.col("all_pos") - F.col("p")
    high_ok = (F.col("i") == F.col("total")) | ok(above_pos, F.col("total") - F.col("i") - above_pos, F.lit(float(precision)))
    told = settled(cuts.withColumns({"low_ok": low_ok, "high_ok": high_ok}))
    low = told.where("low_ok").groupBy(*key).agg(F.max_by("x", "i").alias("low"), F.max("i").alias("i_low"))
    high = told.join(low, key).where(F.col("high_ok") & (F.col("i") >= F.col("i_low"))).groupBy(*key, "low", "i_low", "total").agg(F.min("i").alias("i_high"))
    # high is the largest score below the cut
    under = per.join(high, key).join(upto.select(*key, "x", "i"), [*key, "x"]).where(F.col("i") < F.col("i_high")).groupBy(*key).agg(F.max("x").alias("high"))
    out = high.join(under, key, "left")
    low_value = F.coalesce("low", F.lit(31.0))
    settled_share = (F.col("i_low") + F.col("total") - F.col("i_high")) / F.col("total")
    some = settled_share > 0
    return out.select(
        *key, F.when(some, low_value).otherwise(-31.0).alias("low"), F.when(some, F.greatest(low_value, F.coalesce("high", F.lit(-31.0)))).otherwise(31.0).alias("high"), settled_share.alias("settled"),
    )


def fit_rungs(scores: np.ndarray, gold: np.ndarray, costs: list[float], gold_cost: float, precision: float, recall: float, confidence: float = 0.95, sweeps: int = 4, grid: int = 25) -> dict:
    """Thresholds of several rungs on a bounded labelled sample: rung by rung, each pair of cuts that lowers the cost and keeps both bounds.

    scores: (rungs, rows) log-odds in order of cost. A rung that settles nothing is not picked and costs nothing. Without any
    pair within the bounds all rows go on to the large model, which meets them.
    """
    k, n = scores.shape
    low, high = np.full(k, -31.0), np.full(k, 31.0)
    cuts = [np.unique(np.concatenate([[-31.0, 31.0], np.quantile(s, np.linspace(0, 1, grid))])) for s in scores]

    def run(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, float, float]:
        open_, pred, cost = np.ones(n, bool), np.full(n, -1), 0.0
        for r in range(k):
            if low[r] > -31 or high[r] < 31:
                cost += open_.sum() * costs[r]
            yes, no = open_ & (scores[r] > high[r]), open_ & (scores[r] < low[r])
            pred[yes], pred[no] = 1, 0
            open_ &= ~yes & ~no
        pred[open_] = gold[open_]
        return pred, cost + open_.sum() * gold_cost, float(open_.mean())

    def allowed(pred: np.ndarray) -> bool:
        tp, fp, fn = (int(((pred == a) & (gold == b)).sum()) for a, b in ((1, 1), (1, 0), (0, 1)))
        return reaches(tp, fp, precision, confidence) and reaches(tp, fn, recall, confidence)

    pred, best, esc = run(low, high)
    feasible = allowed(pred)
    for _ in range(sweeps):
        before = best
        for r in range(k):
            for a in cuts[r]:
                for b in cuts[r][cuts[r] >= a]:
                    l2, h2 = low.copy(), high.copy()
                    l2[r], h2[r] = a, b
                    pred, cost, share = run(l2, h2)
                    if cost < best - 1e-15 and (allowed(pred) or not feasible):
                        low, high, best, esc = l2, h2, cost, share
        if best == before:
            break
    picked = [bool(low[r] > -31 or high[r] < 31) for r in range(k)]
    return {"low": low.tolist(), "high": high.tolist(), "pick": picked, "cost": best / max(n, 1), "esc": esc, "feasible": feasible}


def overheads(log: DataFrame, phases: tuple[str, ...] = ("prepare", "discover", "apply")) -> DataFrame:
    """Dollars of a call log by phase, with a row for phases without calls."""
    spark = log.sparkSession
    rows = spark.createDataFrame([(p,) for p in phases], "phase string")
    return rows.join(log.groupBy("phase").agg(F.count(F.lit(1)).alias("n_calls"), F.round(F.sum("usd"), 9).alias("usd")), "phase", "left").fillna(0, ["n_calls"]).fillna(0.0, ["usd"])

