"""Shared pieces of the training-data operators."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Stands for a null doc_id in keys, so that such rows sort last.
NULL_ID = (1 << 63) - 1
#: Batches sent to Python hold at most this many rows.
BATCH_ROWS = 512
#: Salts over which the rows of one group are ranked.
RANK_BUCKETS = 1024
#: Rows of keys and numbers that a join sends to every task; larger sides are dealt over salts.
SENT_ROWS = 1_000_000
SPREAD = 16

_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Send this package to the executors once for each application, and bound the rows of an Arrow batch."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    at = os.path.join(tempfile.mkdtemp(), f"{os.path.basename(root)}.zip")
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    p = os.path.join(folder, n)
                    z.write(p, os.path.relpath(p, os.path.dirname(root)))
    spark.sparkContext.addPyFile(at)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir. On one machine an unset one becomes a temporary folder; on a cluster that raises."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if spark.sparkContext.getCheckpointDir() is None:
        if not at:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            at = f"file://{tempfile.mkdtemp()}"
        spark.sparkContext.setCheckpointDir(at)
    return at or spark.sparkContext.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Rows of df written to the shared folder, with its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/siftwise-{kind}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_key(name: str = "doc_id") -> Column:
    """A doc_id as a key that is never null."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def id_of(key: str | Column) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.when(key != NULL_ID, key)


def binary_list(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one holds about `most` bytes of a column, or a single row."""
    for b in batches:
        at, total = 0, 0
        sizes = [len(x) for x in binary_list(b.column(column))]
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield b.slice(at, i - at)
                at, total = i, 0
            total += n
        if at < b.num_rows:
            yield b.slice(at)


def spread_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """left joined (inner or left) to a settled table of keys and numbers, so that a key with a third of all rows is not one task's.

    A table of up to SENT_ROWS rows goes to every task. A larger one is repeated for each of SPREAD salts, over which the
    rows of a key are dealt.
    """
    if right.count() <= SENT_ROWS:
        return left.join(F.broadcast(right), on, how)
    rest = [c for c in left.columns if c not in on]  # not a row's place, which a retry could change
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*rest) if rest else F.lit(0), F.lit(SPREAD)).cast("int"))
    every = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return salted.join(every, [*on, "_salt"], how).drop("_salt")


def offsets_before(counts: DataFrame, group: list[str], bucket: str, n: str, out: str) -> DataFrame:
    """For each (group, bucket): the sum of n over the group's earlier buckets."""
    w = Window.partitionBy(*group) if group else Window.partitionBy()
    w = w.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*group, bucket, F.coalesce(F.sum(n).over(w), F.lit(0)).alias(out))


def gapless_rank(df: DataFrame, group: list[str], salt: Column, order: list[str], out: str, buckets: int = RANK_BUCKETS, about: DataFrame | None = None) -> DataFrame:
    """Number the rows of each group from 0 without gaps; about: columns by group to add (left join).

    A group is dealt over `buckets` salts, each is numbered by itself and shifted by the rows of
    the earlier ones, so that no task has to hold a hot group. group columns must not be null.
    """
    salted = df.withColumn("_salt", F.pmod(salt, F.lit(buckets)))
    counts = salted.groupBy(*group, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = offsets_before(counts, group, "_salt", "_n", "_before")
    if about is not None:
        before = before.join(about, group, "left")
    inner = Window.partitionBy(*group, "_salt").orderBy(*order)
    ranked = salted.withColumn("_rn", F.row_number().over(inner) - 1)
    return ranked.join(before, [*group, "_salt"]).withColumn(out, (F.col("_rn") + F.col("_before")).cast("long")).drop("_rn", "_before", "_salt")


def prefix_sum(df: DataFrame, key: str, ties: list[str], value: str, out: str, rows_per_range: int = 50_000) -> DataFrame:
    """Sum of value over all rows before each row in the order of key, then ties.

    Rows are dealt into ranges of that order, of about `rows_per_range` rows, and kept so; each range is summed by itself
    and shifted by the total of the earlier ones. Also returns the range as _range.
    """
    parts = max(1, -(-df.count() // rows_per_range))
    cut = checkpointed(df.repartitionByRange(parts, key, *ties).withColumn("_range", F.spark_partition_id()))
    before = offsets_before(cut.groupBy("_range").agg(F.sum(value).alias("_sum")), [], "_range", "_sum", "_before")
    w = Window.partitionBy("_range").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return cut.withColumn("_in", F.coalesce(F.sum(value).over(w), F.lit(0))).join(F.broadcast(before), "_range").withColumn(out, (F.col("_in") + F.col("_before")).cast("long")).drop("_in", "_before")


@contextlib.contextmanager
def conf(spark: SparkSession, **pairs: str):
    """Session settings that hold within the block; underscores stand for dots."""
    names = {k.replace("__", "."): v for k, v in pairs.items()}
    old = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
