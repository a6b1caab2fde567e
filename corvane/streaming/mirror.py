"""A mirror: log records stream into a folded state, kept as a base and what each micro-batch changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.encoders import JSONEncoder
from ..operators.writes import fold, live, merge_state
from ..sources.changelog import ChangeLog, decode_values
from ..sources.storage import Files

STATE_SCHEMA = "key string, seq bigint, type tinyint, value string"
#: Micro-batches after which the state is written whole again.
MOST_PARTS = 16


class Mirror:
    """foreachBatch delivers at least once; the state keeps seq and tombstones, so a replayed batch is a no-op.

    ``s<n>`` holds a micro-batch's last record of each key, or with a file ``_WHOLE`` in it all that came before too. Folding
    parts takes the largest seq of a key, so their order does not matter, and a batch costs what it changes.
    """

    def __init__(self, spark: SparkSession, log: ChangeLog, path: str, schema, encoder: JSONEncoder | None = None, on_import: Callable[[str, DataFrame], None] | None = None):
        self.spark, self.log, self.path = spark, log, path.rstrip("/")
        self.schema, self.encoder, self.on_import = schema, encoder or JSONEncoder(), on_import
        self.files = Files(spark, self.path)

    def _versions(self) -> list[int]:
        return sorted(int(n[1:]) for n in self.files.names() if n[:1] == "s" and n[1:].isdigit() and self.files.exists(f"{n}/_SUCCESS"))

    def _parts(self) -> list[int]:
        """The versions that make up the state: the last whole one and those after it."""
        found = self._versions()
        whole = [n for n in found if self.files.exists(f"s{n}/_WHOLE")]
        return [n for n in found if not whole or n >= whole[-1]]

    def state(self) -> DataFrame:
        parts = self._parts()
        if not parts:
            return self.spark.createDataFrame([], STATE_SCHEMA)
        rows = self.spark.read.schema(STATE_SCHEMA).parquet(*[f"{self.path}/s{n}" for n in parts])
        return fold(rows).select("key", "seq", "type", "value") if len(parts) > 1 else rows

    def entries(self) -> DataFrame:
        return decode_values(live(self.state()), self.encoder, self.schema)

    def _write(self, rows: DataFrame, whole: bool) -> None:
        found = self._versions()
        n = found[-1] + 1 if found else 0
        rows.write.mode("overwrite").parquet(f"{self.path}/s{n}")
        if whole:
            self.files.write(f"s{n}/_WHOLE", "")
            for old in found[:-1]:  # the last is kept for readers that have it open
                self.files.delete(f"s{old}")

    def apply(self, batch: DataFrame, _epoch: int = 0) -> None:
        many = len(self._parts()) >= MOST_PARTS
        self._write(merge_state(self.state(), batch) if many else fold(batch).select("key", "seq", "type", "value"), many)
        if self.on_import:
            self.on_import("log", batch)

    def load_snapshot(self, snapshot: DataFrame) -> None:
        """The snapshot replaces whatever the mirror held."""
        self._write(fold(snapshot).select("key", "seq", "type", "value"), True)
        if self.on_import:
            self.on_import("snapshot", snapshot)

    def start(self, once: bool = False) -> StreamingQuery:
        writer = self.log.stream().writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.path}/_checkpoint")
        return (writer.trigger(availableNow=True) if once else writer).start()
