"""Shards of near equal bytes by a k-d tree over document metadata.

Rows with equal texts form a group with the metadata of its smallest doc_id, so that copies stay
together. A cell of the tree is cut along the dimension in which it is widest, relative to the
whole table, at the weighted median of bytes, until the leaves have the target size. A median is
found by counting: the order within a cell is a key of 72 bits (scaled dimension, text hash,
row hash), and each round sums bytes under 4096 values of the next 12 bits of it inside the one
range that holds the median. The driver sees those sums alone. A cut goes between groups unless a
group is too heavy for that; then it goes through it.

Defined results: a null text has the size 1 and the crc of nothing; a null dimension sorts first;
null doc_ids and repeated rows are dealt like others; an empty table gives no rows; other columns
of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SHARDS = 16
RADIX_BITS, ROUNDS = 12, 6
#: A cut may miss the exact median by this share of a leaf, to keep a group whole.
SLACK = 0.01

_SCALE = (1 << 24) - 1


@dataclass
class Cut:
    node: int
    dimension: int
    key: tuple[int, ...]  # digits; rows below it go left


def _dimensions(docs: DataFrame, dimensions: list[str]) -> DataFrame:
    """size, crc, and for each group of equal texts its dimensions as numbers."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kinds = dict(docs.dtypes)
    columns = [c for c in dimensions if c in kinds]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        common.id_key().alias("id_key"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("text_key"),
        *[_number(F.col(f"`{c}`"), kinds[c]).alias(f"d{i}") for i, c in enumerate(columns)],
    )
    rows = common.checkpointed(rows.withColumn("row_key", F.xxhash64("id_key", "text_key")))
    names = [f"d{i}" for i in range(len(columns))] or ["d0"]
    if not columns:
        rows = rows.withColumn("d0", F.lit(0).cast("double"))
    # a text that occurs once needs no other row's metadata
    groups = rows.groupBy("text_key").agg(F.min(F.struct("id_key", *names)).alias("g"), F.count(F.lit(1)).alias("n")).where("n > 1").select("text_key", "g")
    found = common.spread_join(rows, common.checkpointed(groups), ["text_key"], "left")
    return found.select("*", *[F.coalesce(f"g.{n}", n).alias(f"g_{n}") for n in names]).drop("g", *names)


def _number(c: Column, kind: str) -> Column:
    """Order-keeping number of a value; of a string, its first six bytes. Null is -1."""
    if kind == "string":
        digits = F.rpad(F.hex(F.substring(c.cast("binary"), 1, 6)), 12, "0")
        out = F.conv(digits, 16, 10).cast("double")
    else:
        out = c.cast("double")
    return F.coalesce(F.when(~F.isnan(out), out), F.lit(-1.0))


def _number_of(key: tuple[int, ...]) -> int:
    out = 0
    for d in key:
        out = (out << RADIX_BITS) + d
    return out


def _digit(k: int, dimension: int) -> Column:
    """The k-th 12 bits of a row's key: four in column a (dimension and text hash), two in column b (row hash)."""
    source, shift = (f"a{dimension}", 3 - k) if k < 4 else ("b", 5 - k)
    return F.shiftright(source, RADIX_BITS * shift).bitwiseAND(F.lit((1 << RADIX_BITS) - 1)).cast("int")


def _below(key: tuple[int, ...], dimension: int) -> Column:
    """Whether a row's digits come before the key."""
    full = (*key, *[0] * (ROUNDS - len(key)))
    a, b = F.lit(_number_of(full[:4])), F.lit(_number_of(full[4:]))
    return (F.col(f"a{dimension}") < a) | ((F.col(f"a{dimension}") == a) & (F.col("b") < b))


def _prefix(key: tuple[int, ...], dimension: int) -> Column:
    """Whether a row's digits begin with the key."""
    k = len(key)
    if k <= 4:
        return F.shiftright(f"a{dimension}", RADIX_BITS * (4 - k)) == _number_of(key)
    return (F.col(f"a{dimension}") == _number_of(key[:4])) & (F.shiftright("b", RADIX_BITS * (6 - k)) == _number_of(key[4:]))


def _by_node(nodes: dict[int, Column], otherwise: Column) -> Column:
    out = otherwise
    for node, c in nodes.items():
        out = F.when(F.col("node") == node, c).otherwise(out)
    return out


def partition(docs: DataFrame, shards: int = SHARDS, dimensions: tuple[str, ...] = ("source", "lang", "n_chars", "doc_id")) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot. shards: a power of two."""
    if shards < 1 or shards & (shards - 1):
        raise ValueError("the number of shards must be a power of two")
    common.prepare(docs.sparkSession)
    # one file pass per cut level reads this table, which holds no texts
    rows = common.checkpointed(_dimensions(docs, list(dimensions)))
    names = [c for c in rows.columns if c.startswith("g_d")]
    whole = rows.agg(F.sum("size"), *[f(c) for c in names for f in (F.min, F.max)]).first()
    total = whole[0] or 0
    low, high = list(whole[1::2]), list(whole[2::2])
    if not total:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    width = [(b - a) or 1.0 for a, b in zip(low, high, strict=True)]
    hashed = F.shiftrightunsigned("text_key", 40)
    scaled = [F.floor((F.col(c) - low[i]) / width[i] * _SCALE).cast("long") for i, c in enumerate(names)]
    rows = rows.select("doc_id", "id_key", "size", "text_crc32", "text_key", "row_key", *[F.shiftleft(x, 24).bitwiseOR(hashed).alias(f"a{i}") for i, x in enumerate(scaled)], F.shiftrightunsigned("row_key", 40).alias("b"))
    tree = rows.withColumn("node", F.lit(1))
    level = 1
    while level < shards:
        sides = {c.node: F.when(_below(c.key, c.dimension), 0).otherwise(1) for c in _cut_level(tree, len(names), total / shards)}
        tree = common.checkpointed(tree.withColumn("node", F.col("node") * 2 + _by_node(sides, F.lit(0))))  # else each level repeats the earlier ones' conditions
        level *= 2
    placed = tree.withColumn("shard", (F.col("node") - shards).cast("int"))
    return common.gapless_rank(placed, ["shard"], F.col("row_key"), ["id_key", "text_key"], "slot").select("doc_id", "size", "text_crc32", "shard", "slot")


def _cut_level(tree: DataFrame, dims: int, leaf: float) -> list[Cut]:
    """A cut for each cell of a level: at most as many cells as shards."""
    spans = tree.groupBy("node").agg(F.sum("size").alias("bytes"), *[(F.max(F.shiftright(f"a{i}", 24)) - F.min(F.shiftright(f"a{i}", 24))).alias(f"w{i}") for i in range(dims)]).collect()
    state = {}
    for r in spans:
        wide = max(range(dims), key=lambda i: (r[f"w{i}"], -i))
        state[r["node"]] = {"dim": wide, "goal": r["bytes"] / 2, "before": 0, "key": (), "done": False}
    for k in range(ROUNDS):
        live = {n: s for n, s in state.items() if not s["done"]}
        if not live:
            break
        digit = _by_node({n: _digit(k, s["dim"]) for n, s in live.items()}, F.lit(None).cast("int"))
        inside = _by_node({n: _prefix(s["key"], s["dim"]) for n, s in live.items()}, F.lit(False))
        sums: dict[int, list[tuple[int, int, int, int]]] = {}
        found = tree.where(inside).groupBy("node", digit.alias("digit")).agg(F.sum("size").alias("bytes"), F.max("size").alias("most"), F.count(F.lit(1)).alias("n")).collect()
        for r in found:
            sums.setdefault(r["node"], []).append((r["digit"], r["bytes"], r["most"], r["n"]))
        for n, s in live.items():
            upto = s["before"]
            for d, size, _, count in sorted(sums[n]):
                if upto + size >= s["goal"]:
                    break
                upto += size
            # the cut is within digit d, or at one of its ends
            after, before = upto + size - s["goal"], s["goal"] - upto
            near = min(after, before)
            last = k == ROUNDS - 1 or count == 1
            whole_group = k >= 3 and near <= SLACK * leaf  # all of one text hash
            if last or whole_group or near <= SLACK * leaf / 8:
                s["key"] = (*s["key"], d if before <= after else d + 1)
                s["done"] = True
            else:
                s["key"], s["before"] = (*s["key"], d), upto
    return [Cut(n, s["dim"], s["key"]) for n, s in state.items()]


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    out = partition(docs, shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
