"""Quality classifier: supervised subword embeddings.

Every word and every character n-gram of it (n from 3 to 5, with marks at the word's ends) has a
hashed row in a table of learned vectors. A document is the average of its rows, and a softmax
layer on top gives its classes. Training is plain stochastic gradient descent in numpy on a
bounded sample of labelled documents: at most `sample` rows, spread by hash, whole texts each.
Scores need no gradient, so the softmax of an average is an average of per-word numbers: each
distinct word's sum is kept, and a text costs one lookup a word.

Defined results: labels without a value or a text, with clashing values for one doc_id, or with a
null doc_id teach nothing; a null or empty text has the score of the bias alone; every row gets a
score, repeated rows the same; an empty table gives no rows; without labelled rows all scores are
one half; other columns of the inputs are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS, DIMENSION = 1 << 16, 8
SAMPLE, SAMPLE_BYTES = 4000, 16 << 20
EPOCHS, RATE = 6, 0.5
SHORTEST, LONGEST = 3, 5
THRESHOLD = 0.3
SEED = 5
CACHE = 400_000


def features(word: bytes, buckets: int = BUCKETS) -> list[int]:
    """Rows of a word: itself, and the character n-grams of it between marks."""
    from zlib import crc32

    marked = f"<{word.decode('utf-8', 'replace')}>"
    out = [crc32(word) % buckets]
    for n in range(SHORTEST, LONGEST + 1):
        out += [crc32(marked[i : i + n].encode(), n) % buckets for i in range(len(marked) - n + 1)]
    return out


@dataclass
class Model:
    vectors: np.ndarray  # (buckets, dimension)
    layer: np.ndarray  # (dimension,), class 1 less class 0 of the softmax
    bias: float

    def weights(self) -> np.ndarray:
        """What each row adds to the difference of the classes."""
        return (self.vectors @ self.layer).astype(np.float32)


class _Bags:
    """Feature counts of texts, by word."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.rows: dict[bytes, np.ndarray] = {}

    def bag(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Distinct rows and their shares in the text."""
        words: dict[bytes, int] = {}
        for w in text.split():
            words[w] = words.get(w, 0) + 1
        if not words:
            return np.empty(0, np.int64), np.empty(0)
        parts = []
        for w in words:
            if (own := self.rows.get(w)) is None:
                own = np.array(features(w, self.buckets), np.int32)
                if len(self.rows) < CACHE:
                    self.rows[w] = own
            parts.append(own)
        counts = np.bincount(np.concatenate(parts), np.repeat(np.fromiter(words.values(), float, len(words)), [len(p) for p in parts]), 0)
        rows = np.flatnonzero(counts)
        return rows.astype(np.int32), (counts[rows] / counts.sum()).astype(np.float32)


def train(texts: list[bytes], labels: list[int], buckets: int = BUCKETS, dimension: int = DIMENSION, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Stochastic gradient descent on the log loss, classes weighted to count alike."""
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / dimension, 1 / dimension, (buckets, dimension))
    layer, bias = random.uniform(-0.1, 0.1, dimension), 0.0
    y = np.array(labels)
    if not len(y):
        return Model(vectors, np.zeros(dimension), 0.0)
    bags = _Bags(buckets)
    held = [bags.bag(t) for t in texts]
    share = np.clip(y.mean(), 0.02, 0.98)
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    # an average moves little in any one row: rows of few documents get larger steps
    grown = np.full(buckets, 1e-8)
    steps, total = 0, epochs * len(y)
    for _ in range(epochs):
        for i in random.permutation(len(y)):
            rows, part = held[i]
            now = rate * (1 - steps / total)
            steps += 1
            own = vectors[rows]
            hidden = part @ own
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(hidden @ layer) + bias))))
            error = (p - y[i]) * weight[i]
            if len(rows):
                grown[rows] += part * part
                vectors[rows] = own - (now * error) * (part / np.sqrt(grown[rows]))[:, None] * layer
            layer = layer - now * error * hidden
            bias -= 0.1 * now * error
    # the classes counted alike; back to how often they are
    bias += math.log(share / (1 - share))
    return Model(vectors, layer, bias)


def _scores(weights: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = len(weights)

        class Sums(dict):
            def __missing__(self, word: bytes) -> complex:
                rows = features(word, buckets)
                s = complex(float(weights[rows].sum()), len(rows))
                if len(self) < CACHE:
                    self[word] = s
                return s

        sums = Sums()
        for b in batches:
            out = []
            for text in common.binary_list(b.column("text")):
                s = sum(map(sums.__getitem__, text.split()), 0j)  # what the rows add, and how many they are
                z = bias + (s.real / s.imag if s.imag else 0.0)
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    return run


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id's text is divisible by 5."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> tuple[list[bytes], list[int]]:
    """Labelled documents to learn from: those of the least hashes, at most `rows` and about `most_bytes`.

    Texts of more than a quarter of those bytes are scored like others, but not learned from.
    """
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    told = told.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
    picked = told.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(2 * rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null and text <> ''").where(F.octet_length("text") <= most_bytes // 4)
    found = picked.join(texts, "doc_id").select("doc_id", "label", "text").withColumn("h", F.xxhash64(F.lit(SEED), "doc_id"))
    got, size, out = [], 0, []
    for r in found.orderBy("h", "doc_id", "text").limit(rows).toLocalIterator():
        text = r["text"].encode()
        size += len(text)
        if size > most_bytes:
            break
        got.append(text)
        out.append(r["label"])
    return got, out


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    common.prepare(docs.sparkSession)
    model = train(*sample(docs, labels, label))
    weights, bias = model.weights(), model.bias
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    out = texts.mapInArrow(_scores(weights, bias), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
