"""Removal of repeated word sequences with sharded Aho-Corasick automata.

A window is `window` consecutive words of one document. Words covered by a window that also
starts earlier (smaller doc_id, or same document and earlier start) are removed.

Texts that repeat an earlier document's whole text are one passage from end to end: they are told
by their SHA-256 digests alone, covered whole, and take no part in what follows, so a crowd
of copies counts once.

1. Every window is filed under an anchor: the smallest hash among its short word grams. Equal
   windows have equal anchors, and neighbouring windows mostly share one, so a text has few
   segments (runs of windows with one anchor). Anchors seen once in the corpus end here.
2. The words of segments with recurring anchors are cut out of the texts. As long as the recurring
   anchors are few enough to send to every task, that is one more pass; beyond that size, anchors
   are joined to segments and segments to texts.
3. Segments go to the shard of their anchor. There, passages that recur are confirmed by their
   words, with the first place of each; passages are compiled into automata over word numbers,
   run by run, and all segments are streamed through them: every occurrence but the first covers
   its words.
4. An anchor with very many segments is not for one task. Its windows are counted by aggregation,
   equal segments first. Such anchors are taken together in blocks, and the documents that hold their
   segments are dealt over several shards of a block, each with all its passages; so a document's
   ranges are joined where they are found, and a crowd of near copies gives a range a document.

Documents are told apart by (doc_id, hash of id and text): a row that repeats another counts as
the same document and gets the same result; a null doc_id comes last in the order. A null or
empty text has no words; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, GRAM = 20, 6
#: Occurrences of one anchor that a single group of a shard gets.
CROWD = 4096
#: Crowded anchors taken together, how many such blocks there are at most, and segments of a shard of theirs.
BLOCK, BLOCKS, SHARD = 256, 1024, 65_536
#: Recurring anchors that are sent to every task (16 bytes each); more are joined.
SENT_ANCHORS = 2_000_000
#: Word ranges to remove that are sent to every task (32 bytes each); more are joined.
SENT_COVERS = 1_000_000
#: Words of passages in one automaton, and words of segments held before they are streamed.
AUTOMATON_WORDS, STREAM_WORDS = 200_000, 400_000
#: Copies of whole texts whose keys are sent to every task (8 bytes each); more are joined.
SENT_COPIES = 2_000_000
#: End of a range that covers a whole text.
WHOLE = 1 << 40

_PACK = 1 << 24  # first window * _PACK + number of windows
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """Place of the first smallest value in each run of `size` values."""
    at = np.arange(len(values))
    span = 1
    while span < size:
        step = min(span, size - span)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(values[left] <= values[right], left, right)
        span += step
    return at


_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []  # of _BASE and of its inverse


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        _powers[:] = [np.cumprod(np.append(np.uint64(1), np.full(size - 1, b, np.uint64)), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end in bytes."""
    blank = _BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if len(data) and not blank[0]:
        edge = np.append(0, edge)
    if len(data) and not blank[-1]:
        edge = np.append(edge, len(data))
    return edge[::2], edge[1::2]


class Texts:
    """Words of a run of texts, and the segments of all their windows."""

    def __init__(self, texts: list[bytes], window: int):
        self.flat = b"\n".join(texts)
        data = np.frombuffer(self.flat, np.uint8)
        self.begin, self.end = words_of(data)
        sizes = np.array([len(t) + 1 for t in texts])
        starts = np.cumsum(sizes) - sizes
        self.doc = np.searchsorted(starts, self.begin, "right") - 1
        self.base = np.searchsorted(self.begin, starts)  # first word of each text
        self.window = window
        n = len(self.begin) - window + 1
        self.anchor = self.first = self.size = np.empty(0, np.int64)
        if n < 1:
            return
        power, inverse = _power(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
        h = (sums[self.end] - sums[self.begin]) * inverse[self.begin]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        gram = min(GRAM, window)
        grams = np.zeros(len(h) - gram + 1, np.uint64)
        for k in range(gram):
            grams += h[k : k + len(grams)] * np.uint64(pow(_BASE, k + 1, 1 << 64))
        grams = (grams ^ (grams >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        grams ^= grams >> np.uint64(30)
        place = _least(grams, window - gram + 1)[:n]
        inside = self.doc[:n] == self.doc[window - 1 :]
        new = np.append(True, (place[1:] != place[:-1]) | (self.doc[1:n] != self.doc[: n - 1]))
        at = np.flatnonzero(inside & (new | np.append(True, ~inside[:-1])))
        long = np.flatnonzero(np.diff(np.append(at, n)) >= _PACK)
        if len(long):  # a run of one anchor too long to be written down as one
            at = np.unique(np.concatenate([at, *(np.arange(at[i], at[i + 1] if i + 1 < len(at) else n, _PACK - 1) for i in long.tolist())]))
            at = at[inside[at]]
        group = np.cumsum(np.bincount(at, minlength=n)) - 1
        self.size = np.bincount(group[inside], minlength=len(at))
        self.anchor, self.first = grams[place[at]].view(np.int64), at

    def cut(self, first: int, size: int) -> bytes:
        """Words of `size` windows from the word `first` on, joined by spaces."""
        return b" ".join(self.flat[self.begin[first] : self.end[first + size + self.window - 2]].split())


def _fresh(b: pa.RecordBatch, copies) -> list[bytes]:
    """The texts of a batch, empty where the row is in the broadcast copies (sorted keys)."""
    texts = common.binary_list(b.column("text"))
    if copies is None or not len(known := copies.value):
        return texts
    keys = b.column("doc_key").to_numpy()
    for i in np.flatnonzero(known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys).tolist():
        texts[i] = b""
    return texts


def _anchors(window: int, only: bool, copies):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "text", 1 << 20):
            t = Texts(_fresh(b, copies), window)
            anchor = pa.array(t.anchor)
            if only:
                yield pa.RecordBatch.from_arrays([anchor], ["anchor"])
                continue
            doc = t.doc[t.first]
            yield pa.RecordBatch.from_arrays([anchor, b.column("doc_key").take(pa.array(doc)), pa.array((t.first - t.base[doc]) * _PACK + t.size)], ["anchor", "doc_key", "run"])

    return run


_CUT = pa.schema([("anchor", pa.int64()), ("seen", pa.int64()), ("content", pa.binary()), ("id_key", pa.int64()), ("doc_key", pa.int64()), ("first", pa.int64())])
CUT = "anchor long, seen long, content binary, id_key long, doc_key long, first long"


def _cut_known(window: int, known, copies):
    """Segments whose anchors are in the broadcast known: sorted anchors, and how often each was seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, seen = known.value
        for b in common.slices(batches, "text", 1 << 20):
            t = Texts(_fresh(b, copies), window)
            at = np.minimum(np.searchsorted(anchors, t.anchor), len(anchors) - 1)
            hit = np.flatnonzero(anchors[at] == t.anchor) if len(anchors) else np.empty(0, np.int64)
            first, doc = t.first[hit], t.doc[t.first[hit]]
            contents = [t.cut(f, n) for f, n in zip(first.tolist(), t.size[hit].tolist(), strict=True)]
            docs = pa.array(doc)
            yield pa.RecordBatch.from_arrays([pa.array(t.anchor[hit]), pa.array(seen[at[hit]]), pa.array(contents, pa.binary()), b.column("id_key").take(docs), b.column("doc_key").take(docs), pa.array(first - t.base[doc])], schema=_CUT)

    return run


def _cut_listed(window: int):
    """Segments listed for each text. Texts whose keys clash share lists: what does not fit is left out, the rest is told apart by its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "text", 1 << 20):
            rows = []
            for id_key, key, text, runs in zip(b.column("id_key").to_pylist(), b.column("doc_key").to_pylist(), common.binary_list(b.column("text")), b.column("runs").to_pylist(), strict=True):
                words = text.split()
                for r in runs:
                    first, n = divmod(r["run"], _PACK)
                    if first + n - 1 + window <= len(words):
                        rows.append((r["anchor"], r["seen"], b" ".join(words[first : first + n - 1 + window]), id_key, key, first))
            cols = list(zip(*rows, strict=True)) or [()] * len(_CUT)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _CUT.types, strict=True)], schema=_CUT)

    return run


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _CUT.append(pa.field("n", pa.int64()))
        for b in batches:
            rows = []
            for anchor, seen, content, place, n in zip(*(b.column(c).to_pylist() for c in ("anchor", "seen", "content", "place", "n")), strict=True):
                words = content.split(b" ")
                rows += [(anchor, seen, b" ".join(words[k : k + window]), place["id_key"], place["doc_key"], place["first"] + k, n) for k in range(len(words) - window + 1)]
            cols = list(zip(*rows, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

    return run


Place = tuple[int, int, int]  # id_key, doc_key, first word


class _Shard:
    """Passages of consecutive groups, and the segments to be streamed through them."""

    def __init__(self, window: int):
        self.window = window
        self.covers: list[tuple] = []
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.passages: list[tuple[tuple[int, ...], Place]] = []
        self.waiting: list[tuple[bytes, list[Place]]] = []
        self.size = self.waiting_size = 0
        self.automaton = None

    def passage(self, content: bytes, place: Place) -> None:
        numbers = self.numbers
        words = tuple([numbers.setdefault(w, len(numbers) + 1) for w in content.split(b" ")])
        self.passages.append((words, place))
        self.size += len(words)
        self.automaton = None

    def segment(self, content: bytes, places: list[Place]) -> None:
        self.waiting.append((content, places))
        self.waiting_size += content.count(b" ") + len(places)

    def confirm(self, found: dict[bytes, list[Place]]) -> None:
        """Passages of one anchor, whose segments are all here, by content."""
        if len(found) == 1:
            (content, places), = found.items()
            if len(places) == 1:
                return
            self.passage(content, min(places))
        else:
            first: dict[bytes, Place] = {}
            again: set[bytes] = set()
            for content, places in found.items():
                words = content.split(b" ")
                a, b, c = min(places)
                for k in range(len(words) - self.window + 1):
                    w = b" ".join(words[k : k + self.window])
                    if w in first or len(places) > 1:
                        again.add(w)
                    first[w] = min(first.get(w, (a, b, c + k)), (a, b, c + k))
            if not again:
                return
            for w in again:
                self.passage(w, first[w])
        for content, places in found.items():
            self.segment(content, places)
        if self.size >= AUTOMATON_WORDS:
            self.stream()
            self.clear()

    def stream(self) -> None:
        """Locate all passages in the waiting segments."""
        if self.passages and self.waiting:
            if self.automaton is None:
                from ahocorasick import KEY_SEQUENCE, STORE_ANY, Automaton

                self.automaton = Automaton(STORE_ANY, KEY_SEQUENCE)
                for words, place in self.passages:
                    self.automaton.add_word(words, (len(words), place))
                self.automaton.make_automaton()
            number = self.numbers.get
            for content, places in self.waiting:
                coded = tuple([number(w, 0) for w in content.split(b" ")])  # 0: in no passage
                hits = [(end - n + 1, end + 1, place) for end, (n, place) in self.automaton.iter(coded)]
                if not hits:
                    continue
                for id_key, key, at in places:
                    low = high = -1
                    for begin, end, place in hits:
                        if place == (id_key, key, at + begin):
                            continue
                        if low >= 0 and begin <= high:
                            low, high = min(low, begin), max(high, end)
                            continue
                        if low >= 0:
                            self.cover(id_key, key, at + low, at + high)
                        low, high = begin, end
                    if low >= 0:
                        self.cover(id_key, key, at + low, at + high)
        self.waiting, self.waiting_size = [], 0

    def cover(self, id_key: int, key: int, begin: int, end: int) -> None:
        """Add a range, to the last one if they are of one document and touch."""
        if self.covers and self.covers[-1][:2] == (id_key, key) and begin <= self.covers[-1][3] and end >= self.covers[-1][2]:
            begin, end = min(begin, self.covers[-1][2]), max(end, self.covers[-1][3])
            self.covers.pop()
        self.covers.append((id_key, key, begin, end))

    def take(self) -> pa.RecordBatch:
        cols = list(zip(*self.covers, strict=True)) or [()] * 4
        self.covers = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["id_key", "doc_key", "begin", "end"])


COVER = "id_key long, doc_key long, begin long, end long"


def _confirm_and_locate(window: int):
    """All segments of an anchor are in one partition, in order; there are at most CROWD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, now, found = _Shard(window), None, {}
        for b in batches:
            for anchor, content, id_key, key, first in zip(*(b.column(c).to_pylist() for c in ("anchor", "content", "id_key", "doc_key", "first")), strict=True):
                if anchor != now:
                    if found:
                        shard.confirm(found)
                    now, found = anchor, {}
                found.setdefault(content, []).append((id_key, key, first))
            if len(shard.covers) >= 10_000:
                yield shard.take()
        if found:
            shard.confirm(found)
        shard.stream()
        yield shard.take()

    return run


def _locate(window: int):
    """Rows of a group are its passages (kind 0), then its segments by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, now = _Shard(window), None
        for b in batches:
            for block, salt, kind, content, id_key, key, first in zip(*(b.column(c).to_pylist() for c in ("block", "salt", "kind", "content", "id_key", "doc_key", "first")), strict=True):
                if (block, salt) != now:
                    shard.stream()
                    shard.clear()
                    now = (block, salt)
                if kind == 0:
                    shard.passage(content, (id_key, key, first))
                else:
                    shard.segment(content, [(id_key, key, first)])
                    if shard.waiting_size >= STREAM_WORDS:
                        shard.stream()
            if len(shard.covers) >= 10_000:
                yield shard.take()
        shard.stream()
        yield shard.take()

    return run


def _keep(window: int, known=None):
    """What is left of each text. Ranges to remove are in the column covers, or in the broadcast known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, begins, ends = known.value if known is not None else [None] * 4
        for b in common.slices(batches, "text", 1 << 20):
            if known is None:
                ranges = [sorted((c["begin"], c["end"]) for c in own or []) for own in b.column("covers").to_pylist()]
            else:
                key, own_id = b.column("doc_key").to_numpy(), b.column("id_key").to_pylist()
                low, high = np.searchsorted(keys, key, "left").tolist(), np.searchsorted(keys, key, "right").tolist()
                ranges = [sorted((int(begins[i]), int(ends[i])) for i in range(x, y) if ids[i] == z) for x, y, z in zip(low, high, own_id, strict=True)]
            total, gone, sums, kept_texts = [], [], [], []
            for text, covers in zip(common.binary_list(b.column("text")), ranges, strict=True):
                words = text.split()
                upto, kept = 0, []
                if covers and covers[0][1] == WHOLE:
                    covers = [(0, len(words))] if len(words) >= window else []
                for begin, end in covers:
                    kept += words[upto : max(upto, begin)]
                    upto = max(upto, end)
                kept += words[upto:]
                joined = b" ".join(kept)
                total.append(len(words))
                gone.append(len(words) - len(kept))
                sums.append(hashlib.sha256(joined).hexdigest())
                kept_texts.append(joined if len(kept) < len(words) else None)
            extra = [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sums, pa.string()), pa.array(kept_texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([b.column("row"), *extra], ["row", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def _copies(rows: DataFrame) -> DataFrame:
    """(id_key, doc_key) of rows whose whole text another document has before them."""
    light = common.checkpointed(rows.select("id_key", "doc_key", F.unhex(F.sha2("text", 256)).alias("same")))
    first = light.groupBy("same").agg(F.min(F.struct("id_key", "doc_key")).alias("first"), F.max(F.struct("id_key", "doc_key")).alias("last")).where("first <> last").select("same", "first")
    later = common.spread_join(light, common.checkpointed(first), ["same"]).where(F.struct("id_key", "doc_key") != F.col("first"))
    return common.checkpointed(later.select("id_key", "doc_key").distinct())


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ranges of each document, joined where they touch."""
    for b in batches:
        out = []
        for id_key, key, covers in zip(*(b.column(c).to_pylist() for c in ("id_key", "doc_key", "covers")), strict=True):
            low = high = -1
            for begin, end in sorted((c["begin"], c["end"]) for c in covers):
                if low >= 0 and begin <= high:
                    high = max(high, end)
                    continue
                if low >= 0:
                    out.append((id_key, key, low, high))
                low, high = begin, end
            out.append((id_key, key, low, high))
        cols = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["id_key", "doc_key", "begin", "end"])


def _recurring(texts: DataFrame, window: int, copies) -> DataFrame:
    """Segments with recurring anchors, as in CUT. texts: id_key, doc_key, text."""
    spark = texts.sparkSession
    keyed = texts.select("doc_key", "text")
    seen = keyed.mapInArrow(_anchors(window, True, copies), "anchor long").groupBy("anchor").agg(F.count(F.lit(1)).alias("seen")).where("seen > 1")
    seen = common.checkpointed(seen)
    if seen.count() <= SENT_ANCHORS:
        known = spark.sparkContext.broadcast(_columns(seen, "anchor"))
        return texts.mapInArrow(_cut_known(window, known, copies), CUT)
    runs = keyed.mapInArrow(_anchors(window, False, copies), "anchor long, doc_key long, run long").join(seen, "anchor")
    listed = runs.groupBy("doc_key").agg(F.collect_set(F.struct("anchor", "seen", "run")).alias("runs"))
    found = texts.join(listed, "doc_key").select("id_key", "doc_key", "text", "runs")
    return found.mapInArrow(_cut_listed(window), CUT)


def _columns(df: DataFrame, by: str) -> list[np.ndarray]:
    """A small table of whole numbers as arrays, in the order of its first column."""
    rows = df.toArrow()
    order = np.argsort(rows[by].to_numpy(), kind="stable")
    return [rows[c].to_numpy()[order] for c in df.columns]


def covered(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id_key, doc_key, begin, end): word ranges to remove. texts: id_key, doc_key, text."""
    spark = texts.sparkSession
    folder = common.new_folder(spark, "segments")
    again, sent = _copies(texts), None
    if again.count() <= SENT_COPIES:
        sent = spark.sparkContext.broadcast(_columns(again.select("doc_key"), "doc_key")[0])
    else:
        texts = texts.join(again, ["id_key", "doc_key"], "left_anti").select(texts.columns)
    _recurring(texts, window, sent).write.option("compression", "zstd").parquet(folder)
    cut = spark.read.schema(CUT).parquet(folder)
    few = cut.where(F.col("seen") <= CROWD).drop("seen")
    near = few.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_confirm_and_locate(window), COVER)

    many = cut.where(F.col("seen") > CROWD)
    first = F.min(F.struct("id_key", "doc_key", "first")).alias("place")
    contents = many.groupBy("anchor", "seen", "content").agg(first, F.count(F.lit(1)).alias("n"))
    single = contents.mapInArrow(_windows(window), f"{CUT}, n long")
    passages = single.groupBy("anchor", "seen", "content").agg(first, F.sum("n").alias("n")).where("n > 1").select("anchor", "seen", "content", "place.*")
    crowded = common.checkpointed(many.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")))
    count = crowded.count()
    blocks = max(1, -(-count // max(BLOCK, -(-count // BLOCKS))))
    block = F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int")
    need = {r["block"]: r["shards"] for r in crowded.groupBy(block.alias("block")).agg(F.ceil(F.sum("n") / SHARD).cast("int").alias("shards")).collect()}  # at most BLOCKS rows
    shards = F.get(F.array(*[F.lit(need.get(i, 1)) for i in range(blocks)]), F.col("block"))
    columns = ["block", "salt", "kind", "content", "id_key", "doc_key", "first"]
    dealt = passages.withColumn("block", block).withColumn("salt", F.explode(F.sequence(F.lit(0), shards - 1))).withColumn("kind", F.lit(0)).select(columns)
    dealt = dealt.union(many.withColumn("block", block).withColumn("salt", F.pmod(F.xxhash64("doc_key"), shards).cast("int")).withColumn("kind", F.lit(1)).select(columns))
    far = dealt.repartition("block", "salt").sortWithinPartitions("block", "salt", "kind", "id_key", "doc_key", "first").mapInArrow(_locate(window), COVER)
    lists = near.union(far).groupBy("id_key", "doc_key").agg(F.collect_set(F.struct("begin", "end")).alias("covers"))
    whole = again.select("id_key", "doc_key", F.lit(0).cast("long").alias("begin"), F.lit(WHOLE).cast("long").alias("end"))
    return common.checkpointed(lists.mapInArrow(_merge, COVER).union(whole))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """row (all columns of docs), n_words, n_removed, kept_sha256, and kept_text where words went (else null)."""
    common.prepare(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), common.id_key().alias("id_key"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("doc_key", F.xxhash64("id_key", "text"))
    covers = covered(rows.select("id_key", "doc_key", "text"), window)
    kind = rows.schema["row"].dataType.simpleString()
    schema = f"row {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string"
    if covers.count() <= SENT_COVERS:
        known = docs.sparkSession.sparkContext.broadcast(_columns(covers.select("doc_key", "id_key", "begin", "end"), "doc_key"))
        return rows.mapInArrow(_keep(window, known), schema)
    per_doc = covers.groupBy("id_key", "doc_key").agg(F.collect_set(F.struct("begin", "end")).alias("covers"))
    return rows.join(per_doc, ["id_key", "doc_key"], "left").select("row", "text", "covers").mapInArrow(_keep(window), schema)


def repeat_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    out = remove_repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", "text"))
    return out.select("row.doc_id", "n_words", "n_removed", "kept_sha256")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with texts that lost words replaced by the words left, joined by spaces; n_chars follows if there is one."""
    out = remove_repeats(docs)
    text = F.coalesce("kept_text", "row.text")
    cols = [text.alias(c) if c == "text" else F.coalesce(F.length("kept_text").cast(t), F.col(f"row.`{c}`")).alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c, t in docs.dtypes]
    return out.select(*cols)
