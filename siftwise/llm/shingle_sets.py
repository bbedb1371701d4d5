"""Near duplicates: SimHash candidates of five-word shingles, checked and completed by exact Jaccard similarity.

Texts are linked whose sets of five-word shingles have a Jaccard similarity of 4/5 or more. Fingerprints within
three bits, found by the generalised pigeonhole of simhash.py, are the first candidates. At that similarity
fingerprints differ in 10 of 64 bits on average, which no pigeonhole on 64 bits finds without meeting most random
pairs too, so the rest is found on the sets themselves: no pair is missed, and no link is below the limit:

1. Equal sets are one label. Labels of sizes a and b are similar if and only if they differ in at
   most (a + b) / 9 shingles.
2. The sizes are cut into classes that double. A class deals shingles over a fixed number of parts;
   the token of a part is the hash of the shingles in it. A differing shingle spoils one part, so
   labels with at most d differences share one of the first d + 1 tokens in any common order. The
   fullest parts come first, which leaves tokens of one frequent shingle, and empty parts, unused.
   A label also takes part in the next class if a similar one may be there.
3. Labels that share a token are candidates. Parity sketches, which never part similar sets, travel
   with the tokens, so that pairs are ruled out within their bucket and only those that may be
   similar leave it: first neighbours in the bucket (and the fingerprints' candidates), then, for each two components that meet in it,
   their nearest pair, then every pair of components that are still apart. The sets of the pairs of
   each round are compared, and linked labels become components before the next, so a large group
   of copies leaves few pairs.
4. Links become components as those of fingerprints do.

Defined results: words are those of simhash.py; a text with fewer words than a shingle is one
shingle; texts without words, empty or null, are equal; rows with a null doc_id take part and come
last; an empty table gives no rows; all columns are kept.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash

SHINGLE = 5
#: Bytes of a long text that are looked at together.
PIECE = 1 << 18
_BLANK = re.compile(rb"[\x20\x09-\x0d]")
#: Up to so many labels of candidates (or their components) are sent to tasks; more are joined.
SENT = 1_000_000
#: Rows of buckets worked on at once, and rows of a bucket whose pairs are looked at together.
AT_ONCE, SMALL = 16_384, 128


def _hashed(words: list[bytes]) -> np.ndarray:
    """XXH64 (seed 42) of the shingles of words, in order; of fewer words than a shingle, of all of them."""
    from xxhash import xxh64_intdigest

    flat = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends[:-1])]
    last = ends[SHINGLE - 1 :] or ends[-1:]
    return np.fromiter(map(xxh64_intdigest, map(flat.__getitem__, map(slice, starts, last)), itertools.repeat(simhash.SEED)), np.uint64, len(last))


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text cut at blanks into pieces of about PIECE bytes."""
    at = 0
    while at < len(text):
        blank = _BLANK.search(text, at + PIECE)
        end = blank.start() if blank else len(text)
        yield text[at:end]
        at = end


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of A-Z lower-cased words. Long texts are taken piece by piece."""
    found, words = [], []
    for piece in _pieces(text):
        words = words[1 - SHINGLE :] + piece.translate(simhash.LOWER).split()
        if len(words) >= SHINGLE:
            found.append(np.unique(_hashed(words)))
    if not found:
        return np.unique(_hashed(words)) if words else np.empty(0, np.uint64)
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have a Jaccard similarity of 4/5 or more."""
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _parts(top: int) -> int:
    """Parts of the class of sizes up to top: more than any differences, few enough to be mostly filled."""
    return top * {7: 8, 15: 8, 31: 6, 63: 5}.get(top, 4) // 10 + 1


def _class_tokens(own: np.ndarray, top: int, partner: int) -> np.ndarray:
    k = _parts(top)
    part = (own % np.uint64(k)).astype(np.int64)
    filled = np.bincount(part, minlength=k)
    total = np.zeros(k, np.uint64)
    np.add.at(total, part, _mixed(own))
    tokens = _mixed(total ^ _mixed(np.arange(k, dtype=np.uint64) + np.uint64(top << 32)))
    return tokens[np.lexsort((tokens, -filled))[: (len(own) + partner) // 9 + 1]]


def tokens(own: np.ndarray) -> np.ndarray:
    """Tokens of which any similar, unequal set shares one."""
    a = len(own)
    if a < 4:
        return np.empty(0, np.uint64)
    top, most = (1 << a.bit_length()) - 1, 5 * a // 4
    out = [_class_tokens(own, top, min(most, top))]
    if most > top:
        out.append(_class_tokens(own, 2 * top + 1, most))
    return np.concatenate(out)


def fingerprint(own: np.ndarray) -> int:
    """A bit is 1 if more than half of the shingles have it; no shingles: 0."""
    votes = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(own), bitorder="little").view(np.uint64)[0])


def _label(own: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(own.tobytes(), simhash.SEED)


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in common.slices(batches, "text"):
        held = [shingles(t) for t in common.binary_list(b.column("text"))]
        labels = np.array([_label(x) for x in held], np.uint64)
        sketches = pa.array([sketch(x).tobytes() for x in held], pa.binary())
        prints = np.array([fingerprint(x) for x in held], np.uint64)
        dealt = pa.array([tokens(x).tobytes() for x in held], pa.binary())
        sizes = pa.array([len(x) for x in held], pa.int32())
        columns = [b.column("id_key"), b.column("text_key"), pa.array(labels.view(np.int64)), pa.array(prints.view(np.int64)), sketches, sizes, dealt]
        yield pa.RecordBatch.from_arrays(columns, ["id_key", "text_key", "label", "print", "sketch", "size", "tokens"])


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of the labels, one row each; each label once in a task."""
    known: set[int] = set()
    for b in batches:
        labels = b.column("label").to_pylist()
        fresh = [i for i, x in enumerate(labels) if not (x in known or known.add(x))]
        held = [np.frombuffer(x, np.int64) for x in b.column("tokens").take(pa.array(fresh, pa.int64())).to_pylist()]
        n = np.array([len(x) for x in held], np.int64)
        own, size = (b.column(c).to_numpy()[fresh] for c in ("label", "size"))
        columns = [np.concatenate([np.empty(0, np.int64), *held]), np.repeat(own, n), np.repeat(size, n)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["token", "label", "size"])


def _array(column: pa.Array) -> np.ndarray:
    """Numbers as they are, sketches as rows of eight words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 8) if pa.types.is_binary(column.type) else column.to_numpy()


def _by_bucket(columns: tuple[str, ...], work: Callable[..., Iterator[pa.RecordBatch]]):
    """work on whole buckets, many at once; rows are sorted by token, the first column, and label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in columns]
        n = 0
        for b in batches:
            for own, c in zip(held, columns, strict=True):
                own.append(_array(b.column(c)))
            n += b.num_rows
            if n < AT_ONCE:
                continue
            whole = [np.concatenate(x) for x in held]
            last = int(np.searchsorted(whole[0], whole[0][-1]))
            if last:
                yield from work(*(x[:last] for x in whole))
            held, n = [[x[last:]] for x in whole], len(whole[0]) - last
        if n:
            yield from work(*(np.concatenate(x) for x in held))

    return run


def _crowded(token: np.ndarray, label: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of buckets with several labels, each label once."""
    fresh = np.append(True, (token[1:] != token[:-1]) | (label[1:] != label[:-1]))
    token, label, size = token[fresh], label[fresh], size[fresh]
    same = token[1:] == token[:-1]
    keep = np.append(same, False) | np.append(False, same)
    if keep.any():
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (token, label, size)], ["token", "label", "size"])


def _near_sizes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 5 * np.minimum(a, b).astype(np.int64) >= 4 * np.maximum(a, b).astype(np.int64)


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _may_be_similar(size: np.ndarray, marks: np.ndarray, i: np.ndarray | int, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether sizes and sketches allow it, and how many places differ."""
    apart = np.bitwise_count(marks[i] ^ marks[j]).sum(-1, dtype=np.int64)
    return _near_sizes(size[i], size[j]) & (apart <= (size[i].astype(np.int64) + size[j]) // 9), apart


def _neighbours(token: np.ndarray, label: np.ndarray, size: np.ndarray, marks: np.ndarray) -> Iterator[pa.RecordBatch]:
    at = np.flatnonzero(token[1:] == token[:-1])
    at = at[_may_be_similar(size, marks, at, at + 1)[0]]
    if len(at):
        yield _pairs(label[at], label[at + 1])


def _roots(known, label: np.ndarray) -> np.ndarray:
    """The component of each label, itself if it is not linked; known: sorted nodes and their roots."""
    nodes, roots = known
    if not len(nodes):
        return label
    at = np.minimum(np.searchsorted(nodes, label), len(nodes) - 1)
    return np.where(nodes[at] == label, roots[at], label)


def _meetings(nearest: bool, known: Callable[[], tuple] | None = None):
    """Pairs of a bucket between components that may be similar: for each two components the nearest, or all.

    Labels are taken in order of size, so each meets only those up to a quarter larger; what is held of a bucket
    is one row's partners, and the nearest pairs.
    """

    def work(token: np.ndarray, label: np.ndarray, size: np.ndarray, marks: np.ndarray, root: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        root = _roots(known(), label) if root is None else root
        new = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        rows = np.diff(np.append(new, len(token)))
        few = np.flatnonzero(np.repeat(rows <= SMALL, rows))
        one, two, apart = _small_buckets(token[few], size[few], marks[few], root[few])
        one, two = few[one], few[two]
        if nearest:
            keep = _nearest(token[one], root[one], root[two], apart, label[one], label[two])
            one, two = one[keep], two[keep]
        if len(one):
            yield _pairs(label[one], label[two])
        for i, n in zip(new[rows > SMALL].tolist(), rows[rows > SMALL].tolist(), strict=True):
            yield from large(label[i : i + n], size[i : i + n].astype(np.int64), marks[i : i + n], root[i : i + n])

    def large(label: np.ndarray, size: np.ndarray, marks: np.ndarray, root: np.ndarray) -> Iterator[pa.RecordBatch]:
        if (root == root[0]).all():
            return
        order = np.argsort(size, kind="stable")
        label, size, marks, root = label[order], size[order], marks[order], root[order]
        upto = np.searchsorted(size, 5 * size // 4, "right")
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        found: list[np.ndarray] = []
        for x in range(len(label) - 1):
            at = x + 1 + np.flatnonzero(root[x + 1 : upto[x]] != root[x])
            ok, apart = _may_be_similar(size, marks, x, at)
            at, apart = at[ok], apart[ok]
            if not len(at):
                continue
            if not nearest:
                found.append(np.stack([np.repeat(label[x], len(at)), label[at]]))
                if sum(f.shape[1] for f in found) >= AT_ONCE:
                    yield _pairs(*np.concatenate(found, axis=1))
                    found = []
                continue
            for y, d in zip(at.tolist(), apart.tolist(), strict=True):
                key = (min(root[x], root[y]), max(root[x], root[y]))
                if key not in best or (d, label[x], label[y]) < best[key]:
                    best[key] = (d, label[x], label[y])
        if best:
            found = [np.array([p[1:] for p in best.values()], np.int64).T]
        if found:
            yield _pairs(*np.concatenate(found, axis=1))

    return work


def _small_buckets(token: np.ndarray, size: np.ndarray, marks: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of all pairs of components that may be similar, and how many places of their sketches differ."""
    one, two, far = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for d in range(1, SMALL):
        same = token[d:] == token[:-d]
        if not same.any():
            break
        at = np.flatnonzero(same & (root[d:] != root[:-d]))
        ok, apart = _may_be_similar(size, marks, at, at + d)
        one.append(at[ok])
        two.append(at[ok] + d)
        far.append(apart[ok])
    return np.concatenate(one), np.concatenate(two), np.concatenate(far)


def _nearest(token: np.ndarray, x: np.ndarray, y: np.ndarray, apart: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the nearest pair of each bucket and two components."""
    low, high = np.minimum(x, y), np.maximum(x, y)
    order = np.lexsort((b, a, apart, high, low, token))
    token, low, high = token[order], low[order], high[order]
    return order[np.append(True, (token[1:] != token[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]))] if len(order) else order


def sketch(own: np.ndarray) -> np.ndarray:
    """Parities of a set's shingles over 512 places: sets that differ in d shingles differ in d places at most."""
    return np.packbits(np.bincount((own % np.uint64(512)).astype(np.int64), minlength=512) & 1)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        held = [shingles(t).tobytes() for t in common.binary_list(b.column("text"))]
        yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(held, pa.binary())], ["label", "own"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
        yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _links(pairs: DataFrame, texts: DataFrame, first: DataFrame) -> DataFrame:
    """The similar ones of pairs (a, b) of labels, by their sets. first: a text (id_key, text_key) of each label."""
    pairs = common.checkpointed(pairs.distinct())
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("label")).distinct()
    named = common.checkpointed(first.join(wanted, "label", "left_semi"))
    held = F.broadcast(named) if named.count() <= SENT else named  # a bounded number of labels, so that other texts do not move
    own = texts.join(held, ["id_key", "text_key"]).select("label", "text").mapInArrow(_sets, "label long, own binary")
    own = common.checkpointed(own.dropDuplicates(["label"]))
    one, two = own.select(F.col("label").alias("a"), F.col("own").alias("x")), own.select(F.col("label").alias("b"), F.col("own").alias("y"))
    return common.checkpointed(pairs.join(one, "a").join(two, "b").mapInArrow(_verified, "a long, b long"))


def _meet(buckets: DataFrame, tree: DataFrame, nearest: bool) -> DataFrame:
    """Candidate pairs (a, b) of components that are still apart. buckets: settled by token, in order."""
    names = ("token", "label", "size", "sketch")
    if tree.count() <= SENT:
        rows = tree.toArrow()
        nodes, roots = rows["node"].to_numpy(), rows["root"].to_numpy()
        order = np.argsort(nodes)
        sent = buckets.sparkSession.sparkContext.broadcast((nodes[order], roots[order]))
        return buckets.mapInArrow(_by_bucket(names, _meetings(nearest, lambda: sent.value)), "a long, b long")
    rooted = buckets.join(tree.withColumnRenamed("node", "label"), "label", "left").withColumn("root", F.coalesce("root", "label"))
    again = rooted.repartition("token").sortWithinPartitions("token", "label")
    return again.mapInArrow(_by_bucket((*names, "root"), _meetings(nearest)), "a long, b long")


def _by_print(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of labels whose fingerprints are equal or linked; a fingerprint stands for the smallest label that has it."""
    own = common.checkpointed(rows.select("label", "print").distinct())
    first = common.checkpointed(own.groupBy("print").agg(F.min("label").alias("a")))
    same = common.spread_join(own, first, ["print"]).where("a <> label").select("a", F.col("label").alias("b"))
    links = simhash.linked(first.select("print")).withColumnsRenamed({"a": "p", "b": "q"})
    named = links.join(first.withColumnsRenamed({"print": "p"}), "p").join(first.withColumnsRenamed({"print": "q", "a": "b"}), "q")
    return same.union(named.select("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: id_key, text_key, label (its set), root (smallest label linked to it)."""
    common.prepare(docs.sparkSession)
    texts = docs.select(common.id_key().alias("id_key"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    kinds = "id_key long, text_key long, label long, print long, sketch binary, size int, tokens binary"
    folder = common.new_folder(docs.sparkSession, "shingles")
    texts.mapInArrow(_labelled, kinds).write.parquet(folder)
    wide = docs.sparkSession.read.schema(kinds).parquet(folder)
    rows = common.checkpointed(wide.drop("size", "tokens"))
    dealt = wide.select("label", "size", "tokens").mapInArrow(_dealt, "token long, label long, size int")
    sorted_ = dealt.repartition("token").sortWithinPartitions("token", "label")
    crowded = common.checkpointed(sorted_.mapInArrow(_by_bucket(("token", "label", "size"), _crowded), "token long, label long, size int"))
    common.drop_folder(docs.sparkSession, folder)
    first = rows.join(crowded.select("label").distinct(), "label", "left_semi").groupBy("label").agg(F.min(F.struct("id_key", "text_key", "sketch")).alias("k"))
    first = common.checkpointed(first.select("label", "k.*"))
    marked = crowded.join(first.select("label", "sketch"), "label").select("token", "label", "size", "sketch")
    buckets = common.checkpointed(marked.repartition("token").sortWithinPartitions("token", "label"))
    named = first.drop("sketch")
    near = buckets.mapInArrow(_by_bucket(("token", "label", "size", "sketch"), _neighbours), "a long, b long")
    tree = common.checkpointed(simhash.components(_links(near.union(_by_print(rows)), texts, named)))
    for nearest in (True, False):
        found = _links(_meet(buckets, tree, nearest), texts, named)
        tree = common.checkpointed(simhash.components(found.union(tree.select("node", "root"))))
    return common.spread_join(rows.select("id_key", "text_key", "label"), tree.withColumnRenamed("node", "label"), ["label"], "left").withColumn("root", F.coalesce("root", "label"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id, then text hash; null ids last."""
    return simhash.first_rows(docs, near_duplicates(docs))
