"""Proportional stratified interleaving of rows into shards. DataFrame functions only.

Rows of each stratum are ranked in a seeded random order; the fractional rank (rank - 1/2) / size spreads every
stratum evenly over (0, 1), so that sorting all rows by it and cutting the order into equal runs gives shards that
all match the corpus's mixture. Ranks come from counts of hash buckets plus the rank within a bucket, hence no
task sees a whole stratum, however large, and no global sort runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells that the fractional rank is cut into; a task sorts about rows / CELLS.
CELLS = 4096


def interleave(df: DataFrame, strata: str, key: Column, shards: int, seed: int = 42) -> DataFrame:
    """df plus ``position`` (0.., global), ``shard`` and ``slot`` (0.. in the shard); shards differ by a row at most.

    A null stratum is a stratum of its own. Rows with equal keys are ordered arbitrarily but each gets its own place.
    An empty table gives an empty result.
    """
    names = df.columns
    keyed = df.withColumns({"_s": F.coalesce(F.concat(F.lit("s"), F.col(strata).cast("string")), F.lit("n")), "_k": F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit(""))))})
    keyed = keyed.withColumn("_b", F.conv(F.substring("_k", 1, 3), 16, 10).cast("int"))

    def ranked(rows: DataFrame) -> DataFrame:
        counts = keyed.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("_c"))
        up_to = F.sum("_c").over(Window.partitionBy("_s").orderBy("_b"))
        offsets = counts.select("_s", "_b", (up_to - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy("_s")).alias("_of"))
        within = F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_k"))
        out = rows.withColumn("_r", within).join(offsets, ["_s", "_b"])
        frac = (F.col("_r") + F.col("_before") - F.lit(0.5)) / F.col("_of")
        out = out.withColumn("_f", frac).withColumn("_cell", F.floor(F.col("_f") * CELLS).cast("int"))
        return out.drop("_r", "_before", "_of", "_b")

    cells = ranked(keyed.select("_s", "_k", "_b")).groupBy("_cell").agg(F.count(F.lit(1)).alias("_c"))
    # One row a cell, CELLS at most.
    starts = cells.select("_cell", (F.sum("_c").over(Window.orderBy("_cell")) - F.col("_c")).alias("_start"), F.sum("_c").over(Window.partitionBy()).alias("_n"))
    in_cell = F.row_number().over(Window.partitionBy("_cell").orderBy("_f", "_k", "_s"))
    placed = ranked(keyed).withColumn("_i", in_cell).join(starts, "_cell")
    position = (F.col("_start") + F.col("_i") - 1).cast("bigint")
    out = placed.withColumn("position", position)
    out = out.withColumn("shard", F.expr(f"cast(position * {shards} div _n as int)"))
    return out.withColumn("slot", F.expr(f"position - (cast(shard as bigint) * _n + {shards - 1}) div {shards}")).select(*names, "position", "shard", "slot")


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 42) -> DataFrame:
    """Law `rows`: doc_id, size (UTF-8 bytes plus 8), text_crc32, law, shard, slot, grown_shard (null)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    # rows that share an id differ in size or text, or else in nothing, so a task that runs again finds the same order
    out = interleave(rows, "source", F.concat_ws(":", "doc_id", "size", "text_crc32"), shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
