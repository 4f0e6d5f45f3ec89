"""Shared helpers: tables in the shared scratch folder, size-checked broadcasts, exact distributed ranks."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A side of a join is broadcast only when it has at most this many narrow rows; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
_LIBC = ctypes.CDLL(None)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session without that setting gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/quillstone-scratch"


def slices(batches, rows: int = 512):
    """Arrow batches in slices, so that Python holds the objects of a few hundred rows at a time."""
    for batch in batches:
        for k in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(k, rows)


def runs(texts, chars: int = 2_000_000):
    """[begin, end) runs of texts of about ``chars`` characters (one text at least)."""
    begin = held = 0
    for k, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= chars:
            yield begin, k + 1
            begin, held = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def give_back() -> None:
    """Returns freed memory to the system: Spark reuses Python workers, which else keep the peak of every step so far."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(_LIBC, "malloc_trim", None):
        trim(0)


def tidy(run):
    """An Arrow function over batches that gives memory back when it ends."""

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def byte_runs(column: pa.Array, most: int = 1 << 19):
    """(first row, bytes, bounds) of runs of about ``most`` bytes of a binary column (one value at least); nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data or b"", np.uint8)
    k = 0
    while k < len(column):
        end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + most, "right")) - 1)
        yield k, data[offsets[k] : offsets[end]], offsets[k : end + 1] - offsets[k]
        k = end


class Scratch:
    """Intermediate tables of one job, written as Parquet to the shared folder.

    A written table cuts lineage, and survives the loss of any executor. Shuffle files of a step go as soon as its
    table is written. ``drop`` removes tables that no later step reads, ``keep_only`` all but those that the returned DataFrame reads.
    """

    #: Held while a table is written: shuffle files go at the end of the step, and Python gets batches of bounded size (both sides hold some copies of one).
    HELD = {
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    }

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        self.n = 0
        self.held: dict[str, DataFrame] = {}

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        before = {k: self.spark.conf.get(k) for k in self.HELD}
        for k, v in self.HELD.items():
            self.spark.conf.set(k, v)
        try:
            df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held[path] = out
        return out

    def drop(self, *tables: DataFrame) -> None:
        for path in [p for p, t in self.held.items() if any(t is x for x in tables)]:
            del self.held[path]
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def keep_only(self, *tables: DataFrame) -> None:
        self.drop(*[t for t in self.held.values() if not any(t is x for x in tables)])


def small(df: DataFrame, n: int) -> DataFrame:
    """``df`` with a broadcast hint if its checked row count ``n`` is below the bound; else left to shuffle joins."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with a number behind it that makes it no column of ``df``."""
    own = {c.lower() for c in df.columns}
    return [next(n for k in range(len(own) + 1) if (n := f"{name}_{k}") not in own) for name in names]


def order_ids(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Adds ``out``, numbers that rise with ``order`` (with gaps). Save the result before it is used twice: ranges are sampled."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(out, F.monotonically_increasing_id())


def hash_range(key: Column, n: int) -> Column:
    """The one of ``n`` equal ranges of the unsigned upper 32 bits of a 64-bit hash."""
    return F.shiftright(F.shiftrightunsigned(key, 32) * F.lit(n).cast("long"), 32)


def exact_rank(df: DataFrame, group: list[str], key: str, tie: list[str], n_ranges: int, out: str) -> DataFrame:
    """Adds ``out``: the row's 0-based rank in its group by the 64-bit hash column ``key``, gapless, whatever the group's size.

    A group is cut into ``n_ranges`` ranges of the hash; rows are ranked inside (group, range), and the
    counts of lower ranges are added. So no task ever holds more than one range of a group.
    """
    cut = df.withColumn("_range", hash_range(F.col(key), n_ranges))
    cells = cut.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_cell"))
    before = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_cell").over(before), F.lit(0)))
    inside = W.partitionBy(*group, "_range").orderBy(F.shiftrightunsigned(F.col(key), 1), key, *tie)
    ranked = cut.withColumn("_inside", F.row_number().over(inside) - 1)
    return (
        ranked.join(cells, [*group, "_range"])
        .withColumn(out, (F.col("_before") + F.col("_inside")).cast("long"))
        .drop("_range", "_cell", "_before", "_inside")
    )
