"""Writes as pure DataFrame transformations: old state and changes in, new state out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import INDEX_LENGTH, padded_id, parse_index
from ..spec import RelationshipSpec

#: Change-log record types.
WRITE, DELETE, COMMENT = 1, 2, 3
TYPE_NAMES = {0: "unset", WRITE: "write", DELETE: "delete", COMMENT: "comment"}
LOG_SCHEMA = "seq bigint, ts timestamp, type tinyint, key string, value string"


def type_name(column: Column) -> Column:
    out = F.lit("invalid")
    for code, name in TYPE_NAMES.items():
        out = F.when(column == code, F.lit(name)).otherwise(out)
    return out


def stamp(values: DataFrame, now: Column) -> DataFrame:
    """createdAt stays unless 0 or null; updatedAt becomes now."""
    created = F.when(F.coalesce(F.col("createdAt"), F.lit(0)) == 0, now).otherwise(F.col("createdAt"))
    return values.withColumns({"createdAt": created.cast("bigint"), "updatedAt": now.cast("bigint")})


def put(entries: DataFrame, values: DataFrame, now: Column) -> DataFrame:
    """Upsert by ID; values hold each ID once."""
    fresh = stamp(values, now).select(*entries.columns)
    return entries.join(fresh.select("id"), "id", "left_anti").select(*entries.columns).unionByName(fresh)


def remove(entries: DataFrame, ids: DataFrame) -> DataFrame:
    return entries.join(ids.select("id"), "id", "left_anti")


def number(values: DataFrame, first: int, order: list[str], length: int = INDEX_LENGTH) -> DataFrame:
    """IDs for new values: consecutive from ``first`` in the given order, which should be nearly unique.

    A sample gives the bounds of ranges of the order. They are fixed before anything is counted, so that the count of each
    range and the ranks within it speak of the same rows; no task sees them all.
    """
    spark = values.sparkSession
    parts = min(256, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = values.count()
    known = values.select(*order).sample(min(1.0, 100.0 * parts / n), seed=7).orderBy(*order).collect() if n else []  # about 100 keys a range
    bounds = spark.createDataFrame([tuple(known[i * len(known) // parts]) for i in range(1, parts)] if known else [], values.select(*order).schema).distinct()
    bounds = bounds.agg(F.sort_array(F.collect_list(F.struct(*order))).alias("_bounds"))  # one row
    key = F.struct(*order)
    placed = values.join(F.broadcast(bounds)).withColumn("_part", F.size(F.filter("_bounds", lambda b: b <= key))).drop("_bounds")
    ranked = placed.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    base = placed.groupBy("_part").count()
    base = base.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_base"))  # a row a range
    out = ranked.join(F.broadcast(base), "_part").withColumn("id", padded_id(F.col("_base") + F.col("_rank") - 1 + F.lit(first), length))
    return out.drop("_part", "_rank", "_base")


def next_index(entries: DataFrame) -> DataFrame:
    """One row: the number that follows the largest numeric ID."""
    return entries.agg((F.coalesce(F.max(parse_index(F.col("id"))), F.lit(-1)) + 1).alias("current_index"))


DELETED = "_deleted"


def latest(changes: list[DataFrame], schema) -> DataFrame:
    """The last of several sets of changes (entries plus DELETED, each ID once a set), one row an ID."""
    if len(changes) == 1:
        return changes[0]
    names = [f.name for f in schema.fields]
    rows = [c.select("id", F.lit(i).alias("_at"), F.struct(*names, DELETED).alias("_row")) for i, c in enumerate(changes)]
    last = reduce(DataFrame.unionByName, rows).groupBy("id").agg(F.max_by("_row", "_at").alias("_row"))
    return last.select("_row.*")


def changed(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """Entries with a set of changes applied."""
    fresh = changes.where(~F.col(DELETED)).select(*entries.columns)
    return remove(entries, changes).select(*entries.columns).unionByName(fresh)


def index_delta(spec: RelationshipSpec, old: DataFrame, new: DataFrame) -> DataFrame:
    """(rel_key, rel_id, entry_id, change): pairs that a write adds or removes."""
    was, now = spec.index(old), spec.index(new)
    on = ["rel_key", "rel_id", "entry_id"]
    added = now.join(was, on, "left_anti").withColumn("change", F.lit("add"))
    return added.unionByName(was.join(now, on, "left_anti").withColumn("change", F.lit("remove")))


def fold(log: DataFrame) -> DataFrame:
    """The last write or delete of each key, one row a key; comments and unknown types do not count."""
    last = F.max_by(F.struct("type", "value"), F.col("seq")).alias("last")
    known = log.where(F.col("type").isin(WRITE, DELETE))
    return known.groupBy("key").agg(F.max("seq").alias("seq"), last).select("key", "seq", "last.type", "last.value")


def merge_state(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Folded state plus a batch of log rows; tombstones stay, so that a replayed batch changes nothing."""
    return fold(state.select("key", "seq", "type", "value").unionByName(batch.select("key", "seq", "type", "value")))


def live(state: DataFrame) -> DataFrame:
    return state.where(F.col("type") == WRITE)
