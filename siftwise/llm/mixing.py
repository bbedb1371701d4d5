"""Mixing sources to target weights by fitting word budgets as subset sums.

Documents are counted by source and exact length. A source whose target is t times its size
gives every document floor(t) times; the rest of its budget is a bounded subset sum over those
counts: an equal share of each length first, long lengths next, and for the remainder a dynamic
program over reachable sums. The plan says how many documents of each length to take once more;
which ones is settled by a seeded hash of doc_id, by rank within the length.

Defined results: a null or empty text has the size 0 and is taken 0 times; sources are ordered by
code point with null last, and null is a source like any other; documents with a null doc_id and
repeated rows are drawn like others; an empty table gives no rows; other columns of the input are
ignored by `mix` and kept by `mixed`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
SEED = 7
#: Sources are listed on the driver, one row each; more than this raises.
MOST_SOURCES = 1_000_000
#: Sums that the dynamic program looks at.
SUMS = 1 << 16


def word_count(text: str = "text") -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Budgets by repeating weights; what exceeds most x size is dealt again by weight until none does."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    left = share * sum(sizes)
    out = [0.0] * len(sizes)
    live = list(range(len(sizes)))
    while live:
        per = left / sum(w[i] for i in live)
        over = {i for i in live if per * w[i] > most * sizes[i]}
        if not over:
            for i in live:
                out[i] = per * w[i]
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
        live = [i for i in live if i not in over]
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that their sum comes as near the budget as found, not above it."""
    take = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    if budget <= 0 or not total:
        return take
    order = np.argsort(-lengths)
    take = np.minimum(counts, (counts.astype(float) * (budget / total)).astype(np.int64))
    left = budget - int((take * lengths).sum())
    reserve = int(lengths.max())  # what is kept for the dynamic program
    for i in order:
        if left <= reserve:
            break
        n = min(int(counts[i] - take[i]), (left - reserve) // int(lengths[i]) if lengths[i] else 0)
        take[i] += n
        left -= n * int(lengths[i])
    return take + _reach(lengths, counts - take, left)


def _reach(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded subset sum by dynamic programming; sums are counted in steps if the budget is beyond SUMS."""
    take = np.zeros(len(lengths), np.int64)
    while budget > SUMS:  # a few long documents first
        fits = np.flatnonzero((counts - take > 0) & (lengths > 0) & (lengths <= budget))
        if not len(fits):
            return take
        i = fits[np.argmax(lengths[fits])]
        n = min(int(counts[i] - take[i]), budget // int(lengths[i]))
        take[i] += n
        budget -= n * int(lengths[i])
    if budget <= 0:
        return take
    by, used = np.full(budget + 1, -1, np.int64), np.zeros(budget + 1, np.int64)
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    for i in np.argsort(-lengths):
        size, free = int(lengths[i]), int(counts[i] - take[i])
        if not size or size > budget or not free:
            continue
        used[:] = 0
        # sums reached with this length: step by step from sums reached without it
        for s in range(min(free, budget // size)):
            at = np.flatnonzero(reached[: budget + 1 - size] & ~reached[size:] & (used[: budget + 1 - size] == s))
            if not len(at):
                break
            reached[at + size] = True
            used[at + size] = s + 1
            by[at + size] = i
        if reached[budget]:
            break
    s = int(np.flatnonzero(reached)[-1])
    while s:
        i = by[s]
        take[i] += 1
        s -= int(lengths[i])
    return take


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one source: how many documents of each length to take once more."""
    rest = int(round(pdf["rest"].iloc[0]))
    return pdf.assign(extra=fit(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), rest))[["source_no", "size", "extra"]]


def _drawn(rows: DataFrame, weights: tuple[int, ...], share: float, most: float, seed: int) -> DataFrame:
    """rows (doc_id, source, size, text_key; no texts) with source_no, source_size, target, base, extra, rank and times."""
    spark = rows.sparkSession
    lengths = common.checkpointed(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    sources = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(sources) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    listed = sorted(((r["source"], int(r["size"])) for r in sources), key=lambda s: (s[0] is None, (s[0] or "").encode("utf-8")))
    goal = targets([n for _, n in listed], weights, share, most)
    facts = []
    for i, ((name, size), t) in enumerate(zip(listed, goal, strict=True)):
        base = int(t // size) if size else 0
        facts.append((i, name, size, float(t), base, t - base * size))
    about = spark.createDataFrame(facts, "source_no long, name string, source_size long, target double, base long, rest double")

    def numbered(df: DataFrame) -> DataFrame:
        return df.join(about, df["source"].eqNullSafe(about["name"])).drop("name")

    plan = numbered(lengths).groupBy("source_no").applyInPandas(_plan, "source_no long, size long, extra long")
    plan = common.checkpointed(plan.where("extra > 0"))
    ranked = common.gapless_rank(numbered(rows).drop("rest"), ["source_no", "size"], _order(seed), ["doc_id", "text_key"], "rank", about=plan)
    return ranked.withColumn("times", F.col("base") + F.when(F.col("rank") < F.coalesce("extra", F.lit(0)), 1).otherwise(0))


def _order(seed: int) -> Column:
    """What deals the documents of a length over salts, in whose order they are taken."""
    return F.xxhash64(F.lit(seed), "doc_id", "text_key")


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key"), *more)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted), times, for every document."""
    common.prepare(docs.sparkSession)
    out = _drawn(common.checkpointed(_sized(docs)), weights, share, most, seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """docs with each row as often as the mix takes it; documents without words go.

    Which rows are taken once more is told by the last one of each source and length, so texts do not move: a row up to
    that place is taken. Rows that repeat it, id and text alike, are ranked among themselves.
    """
    common.prepare(docs.sparkSession)
    rows = _sized(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    drawn = common.checkpointed(_drawn(common.checkpointed(_sized(docs)), weights, share, most, seed).withColumn("extra", F.coalesce("extra", F.lit(0))).where("size > 0"))
    place = F.struct(F.pmod(_order(seed), F.lit(common.RANK_BUCKETS)).alias("salt"), "doc_id", "text_key")
    taken = drawn.where("rank < extra")
    last = taken.groupBy("source", "size").agg(F.max(place).alias("last"))
    last = common.checkpointed(last)
    named = lambda df: df.withColumnsRenamed({"source": "_source", "size": "_size"})
    ends = F.broadcast(named(last)) if last.count() <= common.SENT_ROWS else named(last)
    at = drawn.join(ends, _same("source", "size")).where(place == F.col("last"))
    cut = at.groupBy("source", "size").agg(F.count(F.lit(1)).alias("alike"), F.count_if(F.col("rank") < F.col("extra")).alias("of_them"))
    facts = drawn.groupBy("source", "size").agg(F.max("base").alias("base"))
    plan = facts.join(named(last), _same("source", "size"), "left").drop("_source", "_size").join(named(cut), _same("source", "size"), "left").drop("_source", "_size")
    plan = common.checkpointed(named(plan))
    known = F.broadcast(plan) if plan.count() <= common.SENT_ROWS else plan  # a row for each source and length
    out = rows.where("size > 0").join(known, _same("source", "size"))
    here, end = place, F.col("last")
    extra = F.when(end.isNull(), 0).when(here < end, 1).when(here == end, F.when(F.col("alike") == F.col("of_them"), 1)).otherwise(0)
    told = out.select("row", "source", "size", "doc_id", "text_key", "of_them", "base", extra.alias("extra"))
    sure = told.where("extra is not null").select("row", (F.col("base") + F.col("extra")).alias("times"))
    # copies of one row, of which some are taken
    rank = F.row_number().over(Window.partitionBy("source", "size", "doc_id", "text_key").orderBy("of_them"))
    split = told.where("extra is null").withColumn("_r", rank).select("row", (F.col("base") + F.when(F.col("_r") <= F.col("of_them"), 1).otherwise(0)).alias("times"))
    both = sure.union(split).where("times > 0")
    return both.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")


def _same(source: str, size: str) -> Column:
    return F.col(source).eqNullSafe(F.col(f"_{source}")) & (F.col(size) == F.col(f"_{size}"))
