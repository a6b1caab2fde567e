"""Shared scratch folder and text expressions."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word pattern [^\x20\x09-\x0D]+ as a Java character class.
SPACES = r"[\x20\x09-\x0D]+"
#: Bits of a broadcast key filter: 2 MB, whatever the data's size.
BITS = 1 << 24
#: Rows of texts that go to a Python worker at once where memory is short.
BATCH = 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local tests a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):  # local-cluster has executors of its own
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='corvane-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def stage_thin(df: DataFrame, name: str) -> DataFrame:
    """stage, with BATCH rows at once for Python workers, so that neither they nor the JVM hold a task's texts together."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, min(BATCH, int(before)) if int(before) > 0 else BATCH)
    try:
        return stage(df, name)
    finally:
        conf.set(key, before)


def discard(*frames: DataFrame | None) -> None:
    """Delete staged tables that nothing reads any more: all that was derived from them must be staged by now."""
    for df in frames:
        path = df.__dict__.pop("_staged", None) if df is not None else None
        if path:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def maybe_in(df: DataFrame, key: str, wanted: DataFrame, inside: bool = True) -> DataFrame:
    """Rows of df whose ``key`` may be among the keys in wanted (one column), or with ``inside`` false those whose key surely is not.

    A bitmap of BITS bits is broadcast as a table of words, at most BITS / 64 rows, so its size has a fixed bound; it only
    thins df before an exact join. Null keys are never inside.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS))
    place = lambda c: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(bit(c), F.lit(64)).cast("int"))
    word = lambda c: F.floor(bit(c) / 64).cast("int")
    only = F.col(wanted.columns[0])
    words = wanted.where(only.isNotNull()).select(word(only).alias("_word"), place(only).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    held = df.withColumns({"_word": F.when(F.col(key).isNotNull(), word(F.col(key))), "_bit": place(F.col(key))}).join(F.broadcast(words), "_word", "left")
    hit = F.coalesce(F.col("_bits").bitwiseAND(F.col("_bit")) != 0, F.lit(False))
    return held.where(hit if inside else ~hit).select(*df.columns)


def slices(column: pa.Array, n: int = 256) -> Iterator[list]:
    """The column's values as Python lists of n, so that a worker never holds a whole batch of texts as strings."""
    for at in range(0, len(column), n):
        yield column.slice(at, n).to_pylist()


def give_back() -> None:
    """Memory that a Python worker holds and does not use goes back to the system: Arrow's pool keeps some 100 MB after texts."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
        trim(0)


def resting(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, after which the worker, which waits for its next task, holds no free memory."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def words(text: Column) -> Column:
    """Words between ASCII white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
