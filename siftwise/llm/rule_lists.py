"""Quality rules: learned decision lists over text statistics.

Each text is reduced to counts of words, symbols, repeated lines and repeated phrases. From a
bounded sample of labelled rows, sequential covering learns an ordered list of rules: a rule
starts empty and takes the threshold that gains most information about low quality, until it
covers hardly anything else; it is then pruned, last condition first, on rows kept aside, and
rows it covers are taken out before the next rule is grown. A rule stays only if it is precise
on both parts. The list becomes one ordered conditional expression.

Defined results: a null or empty text has no words and fails the base rules; labels without a
value, with clashing values for one doc_id or a null doc_id teach nothing; without labelled rows
the list is empty and the base rules alone decide; every row gets a verdict, repeated rows the
same; an empty table gives no rows; clashing names of other columns do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .quality_model import held_out

#: Labelled rows learned from; a third of them is kept for pruning.
SAMPLE = 20_000
RULES, CONDITIONS = 8, 4
#: Share of low quality among what a rule covers, and the fewest rows it covers.
PRECISION, COVER = 0.97, 8
THRESHOLDS = 32
SEED = 3
LEAST_WORDS, REPEATED = 20, 30
SPAN = 8

_SYMBOLS = bytes(c for c in b"#*$%&|<>")
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_distinct", "n_ends")


def repeated_words(ids: np.ndarray, span: int = SPAN) -> int:
    """Words in windows of `span` words that are found twice or more, first included. ids: equal words have equal ids."""
    n = len(ids) - span + 1
    if n < 2:
        return 0
    code, size = ids, 1
    while size < span:  # codes of windows of twice the size, exact
        step = min(size, span - size)
        pair = code[: len(code) - step].astype(np.int64) * (int(code.max()) + 1) + code[step:]
        code = np.unique(pair, return_inverse=True)[1]
        size += step
    hits = np.flatnonzero(np.bincount(code)[code] > 1)
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, hits, 1)
    np.add.at(edge, hits + span, -1)
    return int((np.cumsum(edge) > 0).sum())


def counts(text: bytes) -> tuple[int, ...]:
    """The statistics of a text in the order of _COUNTS."""
    words = text.split()
    if not words:
        return (0,) * len(_COUNTS)
    flat = b"".join(words)
    chars = len(flat) - len(flat.translate(None, bytes(range(128)) + bytes(range(192, 256))))  # without continuation bytes
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    numbers: dict[bytes, int] = {}
    ids = np.fromiter([numbers.setdefault(w, len(numbers)) for w in words], np.int64, len(words))
    upper = len(flat) - len(flat.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    ends = sum(w[-1] in b".!?" for w in words)
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(ids), len(lines), upper, len(numbers), ends


def _measure(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [counts(t) for t in common.binary_list(b.column("text"))]
            cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * len(_COUNTS)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *cols], [*names, *_COUNTS])

    return run


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, id_key, text_key and the statistics of every text."""
    common.prepare(docs.sparkSession)
    names = ["doc_id", "id_key", "text_key"]
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.id_key().alias("id_key"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return slim.mapInArrow(_measure(names), f"doc_id long, id_key long, text_key long, {', '.join(f'{c} long' for c in _COUNTS)}")


#: What conditions look at, as Spark expressions of the counts.
FEATURES = {
    "n_words": "n_words",
    "mean_chars": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "end_share": "n_ends / greatest(n_words, 1)",
}


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    value: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        column = x[:, list(FEATURES).index(self.feature)]
        return column >= self.value if self.at_least else column <= self.value

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>=' if self.at_least else '<='} {self.value!r}D"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _gain(p: np.ndarray, n: np.ndarray, p0: float, n0: float) -> np.ndarray:
    """Information gained about positives by going from (p0, n0) to (p, n) rows."""
    with np.errstate(divide="ignore", invalid="ignore"):
        out = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
    return np.where(p > 0, out, -np.inf)


def grow(x: np.ndarray, bad: np.ndarray) -> Rule:
    """Conditions added one by one, each the threshold of the most gain."""
    rule: Rule = ()
    own = np.ones(len(x), bool)
    while len(rule) < CONDITIONS:
        p0, n0 = float(bad[own].sum()), float((~bad[own]).sum())
        if not p0 or not n0:
            break
        best = (1e-9, None)
        for k, name in enumerate(FEATURES):
            column = x[own, k]
            for value in np.unique(np.quantile(column, np.linspace(0, 1, THRESHOLDS + 1), method="nearest")):
                for at_least in (True, False):
                    hit = column >= value if at_least else column <= value
                    gain = float(_gain(np.float64(bad[own][hit].sum()), np.float64((~bad[own][hit]).sum()), p0, n0))
                    if gain > best[0]:
                        best = (gain, Condition(name, at_least, float(value)))
        if best[1] is None:
            break
        rule = (*rule, best[1])
        own = covers(rule, x)
    return rule


def prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """The rule without those last conditions whose loss raises (p - n) / (p + n) on rows kept aside."""

    def worth(r: Rule) -> float:
        hit = covers(r, x)
        p, n = bad[hit].sum(), (~bad[hit]).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: (worth(r), len(r)))


def learn(x: np.ndarray, bad: np.ndarray, seed: int = SEED) -> list[Rule]:
    """Ordered rules, each for low quality; what none covers is kept."""
    rules: list[Rule] = []
    order = np.random.default_rng(seed).permutation(len(x))
    cut = len(x) * 2 // 3
    grown, aside = order[:cut], order[cut:]
    while len(rules) < RULES and bad[grown].sum() >= COVER:
        rule = grow(x[grown], bad[grown])
        if not rule:
            break
        rule = prune(rule, x[aside], bad[aside])
        hit, near = covers(rule, x[grown]), covers(rule, x[aside])
        n = hit.sum() + near.sum()
        if n < COVER or (bad[grown][hit].sum() + bad[aside][near].sum()) < PRECISION * n:
            break
        rules.append(rule)
        grown, aside = grown[~hit], aside[~near]
    return rules


def rejects(rules: list[Rule]) -> Column:
    """One conditional expression in the order of the list: whether a rule rejects."""
    out = "false"
    for rule in reversed(rules):
        out = f"CASE WHEN {' AND '.join(c.sql() for c in rule)} THEN true ELSE {out} END"
    return F.expr(out)


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE) -> list[Rule]:
    """Rules from at most `rows` labelled rows that pass the base rules, those of the least hashes."""
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    told = told.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
    named = stats.where(~base_failed()).select("doc_id", *[F.expr(e).cast("double").alias(f"f_{n}") for n, e in FEATURES.items()])
    picked = named.join(told, "doc_id").withColumn("h", F.xxhash64(F.lit(SEED), "doc_id")).orderBy("h", "doc_id", *[f"f_{n}" for n in FEATURES]).limit(rows).collect()
    if not picked:
        return []
    x = np.array([[r[f"f_{n}"] for n in FEATURES] for r in picked])
    return learn(x, np.array([r["label"] == 0 for r in picked]))


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept of every document."""
    stats = common.checkpointed(measured(docs))
    rules = fit(stats, labels)
    out = stats.withColumn("base_failed", base_failed())
    kept = F.when(F.col("base_failed"), False).otherwise(~rejects(rules))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the base rules or the learned list reject.

    Texts are measured once; what is rejected, as keys of id and text, is then left out of the rows.
    """
    stats = common.checkpointed(measured(docs))
    rejected = common.checkpointed(stats.where(base_failed() | rejects(fit(stats, labels))).select("id_key", "text_key", F.lit(True).alias("_rejected")).distinct())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), common.id_key().alias("id_key"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key"))
    return common.spread_join(rows, rejected, ["id_key", "text_key"], "left").where("_rejected is null").select("row.*")
