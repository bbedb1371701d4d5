"""Best-fit packing of documents into token sequences by bin completion.

Documents are encoded once; a document longer than a sequence is cut so that only its first
piece may be short. What is left to decide depends on the count of pieces of each length alone,
at most `capacity` numbers. The driver searches over those: around the largest remaining length
it enumerates fillings of the rest of a sequence that no other filling dominates, applies one as
often as the counts allow (later also half as often, and once), and goes on; branches that cannot
beat the incumbent by the waste bound are cut off. The first incumbent is the best-fit packing. The plan maps (length, rank of
the piece among its length) to a sequence and an offset, so placing pieces needs no grouping.

Defined results: a null text counts as empty and gives the end id alone; rows with a null
doc_id or repeated rows are packed like all others; an empty table gives no rows; other columns
of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import END_ID, Encoder, with_end

#: Search steps on the driver, whatever the number of documents.
NODES = 3000
#: Undominated fillings tried at one step, and steps of their enumeration.
FILLINGS, FILLING_STEPS = 6, 400

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
Pattern = tuple[tuple[int, int], ...]  # (length, copies), longest first


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """Cuts of a document of n ids: full pieces, after a first one that may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    cuts = [0, *range(first, n + 1, capacity)]
    return list(zip(cuts, cuts[1:], strict=False))


def _encode_pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.load(path)
        for b in common.slices(batches, "text"):
            cols: list[list[int | None]] = [[], [], [], [], []]
            for doc, ids in zip(b.column("doc_id").to_pylist(), encoder.encode(common.binary_list(b.column("text"))), strict=True):
                ids = with_end(ids, end_id)
                for k, (x, y) in enumerate(piece_bounds(len(ids), capacity)):
                    for c, v in zip(cols, (doc, k, x, y - x, zlib.crc32(ids[x:y].tobytes())), strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: the best of the bounds by waste over all thresholds.

    For a threshold a, lengths over capacity - a stand alone, other lengths over half open a
    sequence each, and lengths from a to half fill at most the rest of those.
    """
    lengths = np.arange(capacity + 1)
    half = capacity // 2
    number, total = np.cumsum(counts), np.cumsum(counts * lengths)
    a = np.arange(0, half + 1)
    big = number[capacity] - number[capacity - a]
    mid = number[capacity - a] - number[half]
    room = mid * capacity - (total[capacity - a] - total[half])
    small = total[half] - np.where(a > 0, total[np.maximum(a - 1, 0)], 0)
    need = big + mid + np.maximum(0, -((room - small) // capacity))
    return int(need.max())


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing, on counts: each length goes to the fullest sequences that can take it."""
    open_: dict[int, list[list]] = {}  # room left: [pattern, number of sequences]
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        for room in sorted(r for r in open_ if r >= length):
            each = room // length
            groups = open_.get(room, [])
            while groups and left:
                pattern, n = groups.pop()
                if take := min(n, left // each):
                    open_.setdefault(room - each * length, []).append([(*pattern, (length, each)), take])
                    n, left = n - take, left - take * each
                if n and left < each and left:
                    open_.setdefault(room - left * length, []).append([(*pattern, (length, left)), 1])
                    n, left = n - 1, 0
                if n:
                    groups.append([pattern, n])
                    break
            if not left:
                break
        each = capacity // length
        if left // each:
            open_.setdefault(capacity - each * length, []).append([((length, each),), left // each])
        if left % each:
            open_.setdefault(capacity - left % each * length, []).append([((length, left % each),), 1])
    return [(p, n) for groups in open_.values() for p, n in groups]


def undominated(room: int, counts: np.ndarray) -> list[Pattern]:
    """Fillings of `room` that no other beats, least waste first.

    A filling is dominated if a length left outside could replace some of its parts, being at
    least as long as they are together and still fitting.
    """
    lengths = np.flatnonzero(counts[: room + 1])[::-1].tolist()
    if not lengths:
        return [()]
    if lengths[0] == room:
        return [((room, 1),)]
    found: list[tuple[int, list[int]]] = []
    steps = 0
    used: dict[int, int] = {}

    def extend(at: int, left: int, chosen: list[int]) -> None:
        nonlocal steps
        fits = False
        for k in range(at, len(lengths)):
            x = lengths[k]
            if x > left or used.get(x, 0) >= counts[x]:
                continue
            if steps >= FILLING_STEPS or len(found) >= 4 * FILLINGS:
                return
            steps += 1
            fits = True
            used[x] = used.get(x, 0) + 1
            extend(k, left - x, [*chosen, x])
            used[x] -= 1
        if not fits and not any(x <= left and used.get(x, 0) < counts[x] for x in lengths[:at][::-1]):
            found.append((left, chosen))

    extend(0, room, [])
    kept = []
    for waste, chosen in sorted(found, key=lambda f: (f[0], [-x for x in f[1]])):
        sums, pairs = 1, 0  # bit s: some parts, or two and more, have the sum s
        for x in chosen:
            pairs |= (sums & ~1 | pairs) << x
            sums |= sums << x
        for x in lengths:
            if chosen.count(x) >= counts[x]:
                continue
            between = ((1 << waste) - 1) << max(x - waste, 0) if waste else 0  # sums from x - waste to x - 1
            if sums & between & ((1 << x) - 1) & ~1 or pairs >> x & 1:
                break
        else:
            kept.append(tuple((x, chosen.count(x)) for x in sorted(set(chosen), reverse=True)))
        if len(kept) == FILLINGS:
            break
    if not kept:
        waste, chosen = min(found)
        kept.append(tuple((x, chosen.count(x)) for x in sorted(set(chosen), reverse=True)))
    return kept


def complete(counts: np.ndarray, capacity: int, nodes: int = NODES) -> list[tuple[Pattern, int]]:
    """Patterns and how often each is used, covering all counts exactly. Depth-first, best filling first."""
    incumbent = best_fit(counts, capacity)
    best, goal = sum(n for _, n in incumbent), lower_bound(counts, capacity)
    path: list[tuple[Pattern, int]] = []
    left, used, stack = counts.copy(), 0, []

    def branches() -> Iterator[tuple[Pattern, int]]:
        big = int(np.flatnonzero(left)[-1])
        rest = left.copy()
        rest[big] -= 1
        fewer = []
        for filling in undominated(capacity - big, rest):
            need = dict(filling)
            need[big] = need.get(big, 0) + 1
            pattern, most = tuple(sorted(need.items(), reverse=True)), min(int(left[x]) // c for x, c in need.items())
            yield pattern, most
            fewer += [(pattern, n) for n in sorted({most // 2, 1}, reverse=True) if 0 < n < most]
        yield from fewer

    stack.append(branches() if left.any() else iter(()))
    while stack and best > goal and nodes > 0:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if path:
                pattern, times = path.pop()
                used -= times
                for x, c in pattern:
                    left[x] += c * times
            continue
        nodes -= 1
        pattern, times = step
        path.append(step)
        used += times
        for x, c in pattern:
            left[x] -= c * times
        if not left.any():
            if used < best:
                best, incumbent = used, list(path)
            stack.append(iter(()))
        elif used + lower_bound(left, capacity) >= best:
            stack.append(iter(()))
        else:
            stack.append(branches())
    return incumbent


def placing(plan: list[tuple[Pattern, int]], span: int) -> tuple[np.ndarray, ...]:
    """The plan as ranges: from key = length * span + rank on, times, first sequence, offset of the first copy."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in plan:
        offset = 0
        for length, copies in pattern:
            rank = taken.get(length, 0)
            rows.append((length * span + rank, times, sequence, offset, length))
            taken[length] = rank + copies * times
            offset += length * copies
        sequence += times
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else tuple(np.empty(0, np.int64) for _ in range(5))


def _place(ranges: tuple[np.ndarray, ...], span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times, first, offset, size = ranges
        for b in batches:
            key = b.column("length").to_numpy() * span + b.column("_rank").to_numpy()
            at = np.searchsorted(keys, key, "right") - 1
            copy, within = np.divmod(key - keys[at], times[at])
            b = b.drop_columns(["_rank"])
            b = b.append_column("sequence_id", pa.array(first[at] + within))
            yield b.append_column("offset", pa.array(offset[at] + copy * size[at]))

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = END_ID, nodes: int = NODES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    common.prepare(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    pieces = common.checkpointed(texts.mapInArrow(_encode_pieces(tokenizer, capacity, end_id), PIECES))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # one row per length
        counts[length] = n
    span = int(counts.max()) + 1
    ranges = placing(complete(counts, capacity, nodes), span)
    ranked = common.gapless_rank(pieces, ["length"], F.xxhash64("doc_id", "piece", "ids_crc32"), ["doc_id", "piece", "ids_crc32"], "_rank")
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank")
    return ranked.mapInArrow(_place(ranges, span), f"{PIECES}, sequence_id long, offset long")
