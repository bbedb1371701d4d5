"""Content-addressed store of token ids.

A rolling hash over the ids of a document cuts its stream into chunks. A chunk is stored once
under the digest of its bytes; a recipe lists the chunks of a document in order, with the Merkle
root over their digests; a manifest holds a root over each range of recipes. Reading checks
every digest, recipe and root. Layout below the store's folder:

    blobs/kind=0   chunks: key (digest), payload (ids, two or four bytes each), width, n
    blobs/kind=1   recipes as encoded, unordered
    recipes        recipes in ascending doc_id order (null last), with the id count before each
    manifest       a root for each range of recipes

Defined results: a null text is empty and gives the end id alone; repeated rows are documents of
their own; an empty table gives an empty store; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import END_ID, Encoder, with_end

WINDOW = 8
LEAST, MEAN_BITS, MOST = 64, 9, 4096
DIGEST = 16
#: Steps that double the ids a rolling hash sums up, and the factor of the ids that many places before.
_SHIFTS = [(1 << k, np.uint64(pow(0xD6E8FEB86659FD93, 1 << k, 1 << 64))) for k in range(WINDOW.bit_length() - 1)]

_BLOB = pa.schema([("kind", pa.int32()), ("key", pa.binary()), ("payload", pa.binary()), ("width", pa.int32()), ("n", pa.int64()), ("doc_id", pa.int64())])
BLOB = "kind int, key binary, payload binary, width int, n long, doc_id long"


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream; they depend on nearby ids alone."""
    n = len(ids)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    rolling = mixed
    for k, factor in _SHIFTS:  # over 2, 4 and 8 ids
        longer = rolling.copy()
        longer[k:] += rolling[:-k] * factor
        rolling = longer
    marks = np.flatnonzero((rolling >> np.uint64(64 - MEAN_BITS)) == 0) + 1
    ends, begin = [], 0
    for m in marks.tolist():
        while m - begin > MOST:
            begin += MOST
            ends.append(begin)
        if m - begin >= LEAST:
            begin = m
            ends.append(m)
    while n - begin > MOST:
        begin += MOST
        ends.append(begin)
    if begin < n:
        ends.append(n)
    return ends


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root over digests, pair by pair; an odd one goes up as it is."""
    level = leaves or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\1" + b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.load(path)
        sent: set[bytes] = set()  # digests this task has sent lately
        for b in common.slices(batches, "text"):
            rows: list[tuple] = []
            for doc, ids in zip(b.column("doc_id").to_pylist(), encoder.encode(common.binary_list(b.column("text"))), strict=True):
                ids = with_end(ids, end_id)
                parts, begin = [], 0
                narrow = ids.astype("<u2").tobytes() if ids.max() < 1 << 16 else None
                for end in cuts(ids):
                    if narrow is not None:
                        width, data = 2, narrow[2 * begin : 2 * end]
                    else:
                        width = 2 if ids[begin:end].max() < 1 << 16 else 4
                        data = ids[begin:end].astype(f"<u{width}").tobytes()
                    key = digest(bytes([width]) + data)
                    parts.append(key)
                    if key not in sent:
                        if len(sent) >= 100_000:
                            sent.clear()
                        sent.add(key)
                        rows.append((0, key, data, width, end - begin, None))
                    begin = end
                rows.append((1, merkle(parts), b"".join(parts), 0, len(ids), doc))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _BLOB.types, strict=True)], schema=_BLOB)

    return run


def _unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All recipes, and each chunk once; rows with equal keys are in one partition."""
    seen: set[bytes] = set()
    for b in batches:
        keep = []
        for kind, key in zip(b.column("kind").to_pylist(), b.column("key").to_pylist(), strict=True):
            keep.append(kind == 1 or key not in seen)
            if kind == 0:
                seen.add(key)
        yield b.filter(pa.array(keep))


def write_store(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode all documents into a store below folder, which must be new."""
    spark = docs.sparkSession
    common.prepare(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    blobs = texts.mapInArrow(_encode(tokenizer, end_id), BLOB)
    # a document's copies have the same root: its id spreads them
    dealt = blobs.withColumn("_to", F.when(F.col("kind") == 0, F.xxhash64("key")).otherwise(F.xxhash64("key", "doc_id", F.monotonically_increasing_id())))
    dealt = dealt.repartition("_to").drop("_to").mapInArrow(_unique, BLOB)
    dealt.write.partitionBy("kind").option("compression", "zstd").parquet(f"{folder}/blobs")
    raw = _kind(spark, folder, 1).select("doc_id", common.id_key().alias("id_key"), F.col("key").alias("root"), F.col("payload").alias("parts"), "n")
    ordered = common.prefix_sum(raw, "id_key", ["root"], "n", "start")
    ordered = ordered.select("_range", "id_key", "doc_id", "start", "n", "root", "parts")
    ordered.repartition("_range").sortWithinPartitions("_range", "start").write.option("compression", "zstd").parquet(f"{folder}/recipes")
    _roots(spark.read.parquet(f"{folder}/recipes")).write.parquet(f"{folder}/manifest")


def _kind(spark: SparkSession, folder: str, kind: int) -> DataFrame:
    return spark.read.schema(BLOB).parquet(f"{folder}/blobs").where(F.col("kind") == kind)


def _roots(recipes: DataFrame) -> DataFrame:
    """A root for each range of recipes; a range has a bounded number of rows."""
    listed = F.sort_array(F.collect_list(F.struct("start", "n", F.hex("root").alias("root"))))
    line = F.transform("listed", lambda r: F.concat_ws(":", r["start"].cast("string"), r["n"].cast("string"), r["root"]))
    return recipes.groupBy("_range").agg(listed.alias("listed")).select("_range", F.sha2(F.concat_ws("\n", line), 256).alias("range_root"))


def _read_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sums = []
        for key, data, width, n in zip(*(b.column(c).to_pylist() for c in ("key", "payload", "width", "n")), strict=True):
            if digest(bytes([width]) + data) != key or len(data) != width * n:
                raise ValueError(f"chunk {key.hex()} is damaged")
            sums.append(zlib.crc32(np.frombuffer(data, f"<u{width}").astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(sums, pa.int64()), b.column("n")], ["key", "crc", "n_ids"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of each recipe, whose root is checked."""
    for b in batches:
        rows = b.column("parts").to_pylist()
        n = np.array([len(parts) // DIGEST for parts in rows], np.int64)
        for s, root, parts in zip(b.column("start").to_pylist(), b.column("root").to_pylist(), rows, strict=True):
            if len(parts) % DIGEST or merkle([parts[i : i + DIGEST] for i in range(0, len(parts), DIGEST)]) != root:
                raise ValueError(f"the recipe at {s} is damaged")
        total = int(n.sum())
        keys = pa.Array.from_buffers(pa.binary(), total, [None, pa.py_buffer(np.arange(total + 1, dtype=np.int32) * DIGEST), pa.py_buffer(b"".join(rows))])
        place = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("start").to_numpy(), n)), pa.array(place.astype(np.int32)), keys], ["start", "place", "key"])


class Crc32Join:
    """crc32 of joined data from the parts' own: a part's sum moves on by linear maps, one for each power of two of zero bytes."""

    def __init__(self):
        step = []  # one zero bit
        for bit in range(32):
            v = 1 << bit
            step.append((v >> 1) ^ (0xEDB88320 if v & 1 else 0))
        for _ in range(3):
            step = self._twice(step)
        self.maps, self.tables = [step], []

    @staticmethod
    def _apply(columns: list[int], v: int) -> int:
        out = bit = 0
        while v:
            if v & 1:
                out ^= columns[bit]
            v >>= 1
            bit += 1
        return out

    def _twice(self, columns: list[int]) -> list[int]:
        return [self._apply(columns, c) for c in columns]

    def _map(self, k: int) -> np.ndarray:
        """What 2^k zero bytes make of each value of each of a sum's four bytes."""
        while len(self.maps) <= k:
            self.maps.append(self._twice(self.maps[-1]))
        while len(self.tables) <= k:
            columns = np.array(self.maps[len(self.tables)], np.uint32).reshape(4, 8, 1)
            bits = np.arange(256, dtype=np.uint32) >> np.arange(8, dtype=np.uint32)[:, None] & 1
            self.tables.append(np.bitwise_xor.reduce(columns * bits, 1))
        return self.tables[k]

    def joined(self, crc: np.ndarray, size: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The sums of many documents: crc and size (bytes) of their parts on end, and where each document's parts begin (it has some)."""
        total = crc.astype(np.uint32)
        ends = np.cumsum(size)
        n = np.diff(begins, append=len(crc))
        left = np.repeat(ends[begins + n - 1], n) - ends  # bytes of the document behind a part
        k = 0
        while len(at := np.flatnonzero(left >> k)):
            at = at[left[at] >> k & 1 == 1]
            table, v = self._map(k), total[at]
            total[at] = table[0][v & 255] ^ table[1][v >> 8 & 255] ^ table[2][v >> 16 & 255] ^ table[3][v >> 24]
            k += 1
        return np.bitwise_xor.reduceat(total, begins)

    def __call__(self, parts: list[tuple[int, int]]) -> int:
        """parts: (crc32, bytes) in order."""
        if not parts:
            return 0
        crc, size = zip(*parts, strict=True)
        return int(self.joined(np.array(crc, np.uint32), np.array(size, np.int64), np.zeros(1, np.int64))[0])


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    join = Crc32Join()
    for b in batches:
        if not b.num_rows:
            continue
        parts = b.column("parts")
        n = np.diff(parts.offsets.to_numpy())
        begins, flat = np.cumsum(n) - n, parts.flatten()
        sizes = flat.field("n_ids").to_numpy(zero_copy_only=False)
        sums = join.joined(flat.field("crc").to_numpy(zero_copy_only=False), 4 * sizes, begins)
        counts = np.add.reduceat(sizes, begins)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n"), pa.array(sums.astype(np.int64)), pa.array(counts)], ["doc_id", "start", "n_tokens", "ids_crc32", "n_read"])


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as the files hold it: doc_id, start, n_tokens, ids_crc32.

    All chunk files are read and checked; the sum over a document's ids is joined from those of
    its chunks, so no ids are moved. Damage of a chunk, recipe or manifest raises.
    """
    common.prepare(spark)
    recipes = spark.read.parquet(f"{folder}/recipes")
    found, kept = _roots(recipes), spark.read.parquet(f"{folder}/manifest")
    if found.exceptAll(kept).take(1) or kept.exceptAll(found).take(1):
        raise ValueError("recipes and manifest differ")
    chunks = _kind(spark, folder, 0).select("key", "payload", "width", "n").mapInArrow(_read_chunks, "key binary, crc long, n_ids long")
    entries = recipes.select("start", "root", "parts").mapInArrow(_entries, "start long, place int, key binary")
    parts = entries.join(chunks, "key", "left").groupBy("start").agg(F.sort_array(F.collect_list(F.struct("place", F.coalesce("crc", F.lit(0)).alias("crc"), F.coalesce("n_ids", F.lit(0)).alias("n_ids")))).alias("parts"))
    whole = recipes.select("doc_id", "start", "n").join(parts, "start").select("doc_id", "start", "n", "parts")
    out = whole.mapInArrow(_sum_up, "doc_id long, start long, n_tokens long, ids_crc32 long, n_read long")
    checked = F.when(F.col("n_read") == F.col("n_tokens"), F.col("ids_crc32")).otherwise(F.raise_error(F.concat(F.lit("ids are missing at "), F.col("start").cast("string"))).cast("long"))
    return out.select("doc_id", "start", "n_tokens", checked.alias("ids_crc32"))


def read_ids(spark: SparkSession, folder: str, doc_id: int) -> list[list[int]]:
    """The ids of one document, once for each row that has this doc_id."""
    out = []
    for r in spark.read.parquet(f"{folder}/recipes").where(F.col("doc_id") == doc_id).orderBy("start").collect():
        keys = [bytes(r["parts"][i : i + DIGEST]) for i in range(0, len(r["parts"]), DIGEST)]
        held = {bytes(c["key"]): np.frombuffer(bytes(c["payload"]), f"<u{c['width']}") for c in _kind(spark, folder, 0).where(F.col("key").isin(list(set(keys)))).collect()}
        out.append([int(x) for k in keys for x in held[k]])
    return out


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """write_store, then read_store, in a folder that goes afterwards."""
    spark = docs.sparkSession
    folder = common.new_folder(spark, "store")
    write_store(docs, folder, tokenizer, end_id)
    out = common.checkpointed(read_store(spark, folder))
    common.drop_folder(spark, folder)
    return out
