"""The append-only change log as a Parquet directory of write and delete records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidAction
from ..functions.encoders import JSONEncoder
from ..operators.writes import DELETE, LOG_SCHEMA, WRITE
from .storage import Files


def write_actions(entries: DataFrame, encoder: JSONEncoder, seq: Column, ts: Column) -> DataFrame:
    """Each entry as a write record; with seq 0 this is a snapshot."""
    value = encoder.encode(F.struct(*entries.columns))
    return entries.select(
        seq.cast("bigint").alias("seq"), ts.alias("ts"), F.lit(WRITE).cast("tinyint").alias("type"), F.col("id").alias("key"), F.base64(value).alias("value")
    )


def delete_actions(ids: DataFrame, seq: Column, ts: Column) -> DataFrame:
    return ids.select(
        seq.cast("bigint").alias("seq"), ts.alias("ts"), F.lit(DELETE).cast("tinyint").alias("type"), F.col("id").alias("key"), F.lit(None).cast("string").alias("value")
    )


def decode_values(state: DataFrame, encoder: JSONEncoder, schema) -> DataFrame:
    """Write records back to entries."""
    entry = encoder.decode(F.unbase64("value"), schema)
    return state.where(F.col("type") == WRITE).select(entry.alias("entry")).select("entry.*")


class ChangeLog:
    """Records in order of seq under one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, actions: DataFrame) -> None:
        known = F.when(F.col("type").isin(WRITE, DELETE), F.col("type")).otherwise(F.raise_error(F.lit(InvalidAction.__name__)))
        actions.withColumn("type", known.cast("tinyint")).write.mode("append").parquet(self.path)

    def exists(self) -> bool:
        return any(not n.startswith("_") for n in Files(self.spark, self.path).names())

    def read(self) -> DataFrame:
        if not self.exists():
            return self.spark.createDataFrame([], LOG_SCHEMA)
        return self.spark.read.schema(LOG_SCHEMA).parquet(self.path)

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(LOG_SCHEMA).parquet(self.path)

    def for_each(self, fn) -> None:
        """Call fn(row) in log order on the driver, a partition at a time."""
        for row in self.read().orderBy("seq").toLocalIterator():
            fn(row)

    def after(self, seq: int) -> DataFrame:
        """Records later than seq; the filter reaches the files' statistics."""
        return self.read().where(F.col("seq") > seq)

    def last_seq(self) -> int:
        return self.read().agg(F.max("seq")).first()[0] or 0
