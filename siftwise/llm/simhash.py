"""SimHash near-duplicates by the generalised pigeonhole principle.

Each text gets a 64-bit fingerprint of its word shingles. Distinct fingerprints are linked at
`distance` or fewer differing bits:

1. From how often any two bits are set together, correlated bits are grouped into parts, so that
   the parts are skewed, each in its own way.
2. Two fingerprints within the distance differ in at most t_i bits in some part i as long as the
   thresholds satisfy sum(t_i + 1) = distance + 1, where -1 leaves a part out. For each
   fingerprint a dynamic program over the parts picks the thresholds for which the counts of part
   values promise the fewest candidates: a crowded value is left out, a rare one gets more.
3. A fingerprint is filed under each part's value and probes all values within its thresholds.
   Inside a bucket, verified links are reduced to a forest, so that at most one row per
   fingerprint leaves it, however many pairs are linked. A wide search, whose probes are many,
   starts from the components of a narrow one: only links between those leave a bucket.
4. Links become components by rounds of large-star and small-star steps.

Defined results: a text without words, empty or null, has fingerprint zero and links like any
other; repeated rows stay rows of their own; rows with a null doc_id take part, count as last
and get a null component_id only if no member has an id; an empty table gives no rows; other
columns of the input are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 64
SEED = 42
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: A part's value counts are kept for at most so many of its bits.
COUNTED_BITS = 20
#: Buckets of up to this many rows compare all rows at once.
SMALL = 48
DISTANCE, SHINGLE = 3, 3


# ---- fingerprints

def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority of each bit over the XXH64 (seed 42) of all shingles of A-Z lower-cased words."""
    from xxhash import xxh64_intdigest

    words = text.translate(LOWER).split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends[:-1])]
    last = ends[shingle - 1 :] or ends[-1:]
    hashes = np.fromiter(map(xxh64_intdigest, map(flat.__getitem__, map(slice, starts, last)), itertools.repeat(SEED)), np.uint64, len(last))
    return _majority(hashes)


def _majority(hashes: np.ndarray) -> int:
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        block = hashes[at : at + (1 << 14)]
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.fromiter((fingerprint(t, shingle) for t in common.binary_list(b.column("text"))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("id_key"), b.column("text_key"), pa.array(prints.view(np.int64))], ["id_key", "text_key", "print"])

    return run


# ---- grouping bits and allotting thresholds

def _bits(prints: np.ndarray) -> np.ndarray:
    return np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((BITS, BITS))
    for b in batches:
        x = _bits(b.column("print").to_numpy().view(np.uint64)).astype(np.float32)
        total += x.T @ x
    i, j = np.triu_indices(BITS)
    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j].astype(np.int64))], ["i", "j", "n"])


def group_bits(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in `parts` groups: each starts from the most correlated free pair and takes the bit most correlated to it."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    tie = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(tie, -1)
    free, groups = set(range(BITS)), []
    sizes = [BITS // parts + (k < BITS % parts) for k in range(parts)]
    for size in sizes:
        order = sorted(free)
        sub = tie[np.ix_(order, order)]
        a = int(np.argmax(sub.max(1)))
        group = [order[a]]
        free.remove(order[a])
        while len(group) < size:
            order = sorted(free)
            best = order[int(np.argmax(tie[np.ix_(order, group)].mean(1)))]
            group.append(best)
            free.remove(best)
        groups.append(group)
    return groups


def part_values(prints: np.ndarray, group: list[int]) -> np.ndarray:
    out = np.zeros(len(prints), np.uint64)
    for k, bit in enumerate(group):
        out |= (prints >> np.uint64(bit) & np.uint64(1)) << np.uint64(k)
    return out


def _value_counts(groups: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = b.column("print").to_numpy().view(np.uint64)
            for k, g in enumerate(groups):
                v, n = np.unique(part_values(prints, g[:COUNTED_BITS]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k, np.int32)), pa.array(v.astype(np.int64)), pa.array(n)], ["part", "value", "n"])

    return run


def near_counts(counts: np.ndarray, most: int) -> list[np.ndarray]:
    """For t = 0..most: how many fingerprints have a value within t bits of each value."""
    bits = int(math.log2(len(counts)))
    rings = [counts.astype(np.float64)] + [np.zeros(len(counts))] * most
    at = np.arange(len(counts))
    for k in range(bits):
        rings = [rings[0]] + [rings[t] + rings[t - 1][at ^ (1 << k)] for t in range(1, most + 1)]
    return list(np.cumsum(rings, axis=0))


def allotments(parts: int, distance: int) -> list[tuple[int, ...]]:
    """All ways to deal distance + 1 units over the parts; a part's threshold is its units less one."""
    return [a for a in itertools.product(range(distance + 2), repeat=parts) if sum(a) == distance + 1]


def allot(estimates: list[np.ndarray], distance: int) -> np.ndarray:
    """Thresholds of each fingerprint, (n, parts). estimates[i]: (n, distance + 2) cost of 0.. units for part i."""
    n = len(estimates[0])
    best, choice = None, []
    for e in estimates:
        if best is None:
            best, pick = e.copy(), np.tile(np.arange(distance + 2), (n, 1))
        else:
            sums = np.full((n, distance + 2), np.inf)
            pick = np.zeros((n, distance + 2), np.int64)
            for total in range(distance + 2):
                for units in range(total + 1):
                    cost = best[:, total - units] + e[:, units]
                    better = cost < sums[:, total]
                    sums[better, total] = cost[better]
                    pick[better, total] = units
            best = sums
        choice.append(pick)
    left = np.full(n, distance + 1)
    out = np.empty((n, len(estimates)), np.int64)
    for i in range(len(estimates) - 1, -1, -1):
        out[:, i] = choice[i][np.arange(n), left]
        left -= out[:, i]
    return out - 1


def _masks(bits: int, t: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for k in range(t + 1) for c in itertools.combinations(range(bits), k)], np.uint64)


def _deal(groups: list[list[int]], near: list[list[np.ndarray]], distance: int):
    """Rows (part, value, print, label, probe): each fingerprint filed under its parts, and probing by its thresholds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = b.column("print").to_numpy().view(np.uint64)
            values = [part_values(prints, g) for g in groups]
            estimates = []
            for i, g in enumerate(groups):
                low = (values[i] & np.uint64((1 << min(len(g), COUNTED_BITS)) - 1)).astype(np.int64)
                thin = 2.0 ** max(0, len(g) - COUNTED_BITS)
                probes = np.cumsum([math.comb(len(g), t) for t in range(distance + 1)])
                estimates.append(np.stack([np.zeros(len(prints))] + [near[i][t][low] / thin + probes[t] for t in range(distance + 1)], 1))
            limits = allot(estimates, distance)
            labels = b.column("label").to_numpy().view(np.uint64)
            for i, g in enumerate(groups):
                yield _rows(i, values[i], prints, labels, False)
                for t in range(distance + 1):
                    if (own := limits[:, i] == t).any():
                        masks = _masks(len(g), t)
                        yield _rows(i, (values[i][own][:, None] ^ masks[None]).ravel(), np.repeat(prints[own], len(masks)), np.repeat(labels[own], len(masks)), True)

    return run


def _rows(part: int, values: np.ndarray, prints: np.ndarray, labels: np.ndarray, probe: bool) -> pa.RecordBatch:
    n = len(values)
    columns = [pa.array(np.full(n, part, np.int32)), *(pa.array(x.view(np.int64)) for x in (values, prints, labels)), pa.array(np.full(n, probe))]
    return pa.RecordBatch.from_arrays(columns, ["part", "value", "print", "label", "probe"])


# ---- links within buckets

def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def forest(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints: (member, root) for all but roots.

    Breadth first: a member is compared with those not reached yet, so a dense group costs a few
    passes and no pairs are kept.
    """
    out = []
    rest = prints
    while len(rest):
        root, rest = rest[0], rest[1:]
        queue = [root]
        while queue and len(rest):
            near = _popcount(rest ^ queue.pop()) <= distance
            if near.any():
                found, rest = rest[near], rest[~near]
                out += [(int(f), int(root)) for f in found]
                queue += list(found)
    return out


def _bucket_links(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] | None = None
        for b in batches:
            now = (b.column("part").to_numpy(), b.column("value").to_numpy(), b.column("print").to_numpy().view(np.uint64), b.column("label").to_numpy().view(np.uint64), b.column("probe").to_numpy(zero_copy_only=False))
            if held is not None:
                now = tuple(np.concatenate(x) for x in zip(held, now, strict=True))
            last = int(np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))[-1]) + 1 if (now[0] != now[0][-1]).any() or (now[1] != now[1][-1]).any() else 0
            held = tuple(x[last:] for x in now)
            if last:
                yield from _links(tuple(x[:last] for x in now), distance)
        if held is not None:
            yield from _links(held, distance)

    return run


def _links(rows: tuple[np.ndarray, ...], distance: int) -> Iterator[pa.RecordBatch]:
    """Links of whole buckets, between labels; rows are sorted by part, value and print."""
    part, value, prints, labels, probe = rows
    new = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (value[1:] != value[:-1])))
    sizes = np.diff(np.append(new, len(part)))
    links: list[tuple[np.ndarray, np.ndarray]] = []
    big = np.flatnonzero(sizes > SMALL)
    for k in big.tolist():
        own = slice(new[k], new[k] + sizes[k])
        if probe[own].all() or not probe[own].any() or (labels[own] == labels[new[k]]).all():
            continue  # a pair is sure to meet where one is filed and the other probes
        members, at = np.unique(prints[own], return_index=True)
        got = forest(members, distance)
        if got:
            named = labels[own][at]
            links.append(tuple(named[np.searchsorted(members, np.array(x, np.uint64))] for x in zip(*got, strict=True)))
    small = np.repeat(sizes <= SMALL, sizes)
    p, name, q, bucket = prints[small], labels[small], probe[small], np.repeat(np.arange(len(sizes)), sizes)[small]
    for shift in range(1, int(sizes[sizes <= SMALL].max(initial=0))):
        if len(p) <= shift:
            break
        a, b = p[:-shift], p[shift:]
        ok = (bucket[:-shift] == bucket[shift:]) & (q[:-shift] != q[shift:]) & (name[:-shift] != name[shift:])
        at = np.flatnonzero(ok)
        at = at[_popcount(a[at] ^ b[at]) <= distance]
        if len(at):
            links.append((name[at], name[at + shift]))
    if links:
        a, b = (np.concatenate(x) for x in zip(*links, strict=True))
        if (apart := a != b).any():
            yield from _star(a[apart], b[apart])


def _star(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Links as member and smallest reachable member, one row for each member but the smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = label.copy()
        np.minimum.at(low, label[i], label[j])
        np.minimum.at(low, label[j], label[i])
        while (low != low[low]).any():
            low = low[low]
        low = low[label]
        if (low == label).all():
            break
        label = low
    own = np.flatnonzero(label != np.arange(len(nodes)))
    if len(own):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own].view(np.int64)), pa.array(nodes[label[own]].view(np.int64))], ["a", "b"])


# ---- components

#: Links that one task settles (16 bytes each).
FEW_LINKS = 500_000


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if b.num_rows]
    if held:
        yield from _star(*(np.concatenate(x) for x in zip(*held, strict=True)))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every linked node, root the smallest of its component.

    links: (a, b) of any order. Each round hangs larger neighbours under the smallest one, then
    smaller ones too; a node's smallest neighbour is an aggregate, so no neighbour list is built.
    Up to FEW_LINKS links, which fit a task, are settled in one.
    """
    edges = common.checkpointed(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    if edges.count() <= FEW_LINKS:
        return edges.coalesce(1).mapInArrow(_settle, "a long, b long").toDF("node", "root")
    state = None
    for _ in range(rounds):
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # every edge now leads from a node down to a smaller one
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = common.checkpointed(small.where("a <> b").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def n_parts(n: int) -> int:
    """Parts so long that a value is shared by few of n fingerprints, if they were spread evenly."""
    return 4 if n <= 1 << 20 else 3 if n <= 1 << 26 else 2


def linked(prints: DataFrame, distance: int = DISTANCE, parts: int | None = None) -> DataFrame:
    """(a, b) links that join all distinct fingerprints (column print) within the distance.

    With a column label (a fingerprint for each known group) links are between labels.
    """
    if "label" not in prints.columns:
        prints = prints.withColumn("label", F.col("print"))
    n = prints.count()
    parts = parts or n_parts(n)
    together = np.zeros((BITS, BITS))
    for i, j, c in prints.mapInArrow(_together, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n")).collect():  # 2080 rows
        together[i, j] = together[j, i] = c
    groups = group_bits(together, n, parts)
    counts = [np.zeros(1 << min(len(g), COUNTED_BITS)) for g in groups]
    # at most 2^20 values for each of up to four parts
    for k, v, c in prints.mapInArrow(_value_counts(groups), "part int, value long, n long").groupBy("part", "value").agg(F.sum("n")).toLocalIterator():
        counts[k][v] = c
    near = [[x.astype(np.float32) for x in near_counts(c, distance)] for c in counts]
    held = prints.sparkSession.sparkContext.broadcast(near)
    dealt = prints.mapInArrow(lambda batches: _deal(groups, held.value, distance)(batches), "part int, value long, print long, label long, probe boolean")
    sorted_ = dealt.repartition("part", "value").sortWithinPartitions("part", "value", "print")
    return sorted_.mapInArrow(_bucket_links(distance), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row per document: id_key, text_key, print, root (smallest linked print), component (smallest id_key)."""
    spark = docs.sparkSession
    common.prepare(spark)
    texts = docs.select(common.id_key().alias("id_key"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    rows = common.checkpointed(texts.mapInArrow(_fingerprints(shingle), "id_key long, text_key long, print long"))
    classes = common.checkpointed(rows.groupBy("print").agg(F.min("id_key").alias("first")))
    tree = components(linked(classes.select("print"), min(distance, DISTANCE)))
    if distance > DISTANCE:
        known = classes.select("print").join(tree.withColumnRenamed("node", "print"), "print", "left").select("print", F.coalesce("root", "print").alias("label"))
        wide = linked(common.checkpointed(known), distance)
        tree = components(wide.union(tree.select("node", "root")))
    rooted = common.checkpointed(classes.join(tree.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print")))
    lowest = common.checkpointed(rooted.groupBy("root").agg(F.min("first").alias("component")))
    members = common.checkpointed(common.spread_join(rooted.select("print", "root"), lowest, ["root"]))
    return common.spread_join(rows, members, ["print"]).select("id_key", "text_key", "print", "root", "component")


def near_duplicate_ids(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    found = near_duplicates(docs)
    return found.select(common.id_of("id_key").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), common.id_of("component").alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id, then text hash; null ids last."""
    return first_rows(docs, near_duplicates(docs, shingle, distance))


def first_rows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of docs for each root of found (id_key, text_key, root), that of the smallest keys.

    Texts move only where rows repeat a kept one's id and text, or where the keys to keep are too many to send.
    """
    keys = ["id_key", "text_key"]
    kept = found.groupBy("root").agg(F.min(F.struct(*keys)).alias("k")).select("k.*")
    repeated = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    kept = common.checkpointed(kept.join(repeated, keys, "left").select(*keys, F.col("n").isNotNull().alias("_again")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), common.id_key().alias("id_key"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key"))
    named = common.spread_join(rows, kept, keys)
    once = named.where("_again").dropDuplicates(keys)
    return named.where("not _again").select("row.*").union(once.select("row.*"))
