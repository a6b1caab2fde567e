"""Versioned Parquet directories.

A whole commit writes ``v<n>/entries`` and ``v<n>/relationships``, a commit of changes only ``v<n>/changes``, and either
then creates ``v<n>/_COMMITTED``, which names the base and the changes that make up the version. Readers take the largest
committed version and keep it, so a lost executor or driver leaves at worst an unseen directory. Changes are merged on
reading and folded into a new base after MOST_CHANGES commits, so a commit costs what it changes. All file operations go
through Hadoop's FileSystem, so any store that Spark reads will do.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..operators.writes import DELETED, changed, latest, remove
from ..spec import RelationshipSpec

#: Commits of changes after which a version is written whole again.
MOST_CHANGES = 16


class Files:
    """The few file operations that Spark's writers lack."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self.root = root
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self) -> list[str]:
        if not self._fs.exists(self._path("")):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path("")))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def write(self, name: str, text: str) -> None:
        out = self._fs.create(self._path(name), False)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


class Storage:
    """One store's directory: versions of its entries, index and metadata. Single writer."""

    def __init__(self, spark: SparkSession, path: str, spec: RelationshipSpec):
        self.spark, self.path, self.spec = spark, path.rstrip("/"), spec
        self.files = Files(spark, self.path)

    def version(self) -> int:
        """The largest committed version, -1 if there is none."""
        found = [int(n[1:]) for n in self.files.names() if n[:1] == "v" and n[1:].isdigit()]
        return max((n for n in found if self.files.exists(f"v{n}/_COMMITTED")), default=-1)

    def meta(self, version: int) -> dict:
        return json.loads(self.files.read(f"v{version}/_COMMITTED"))

    def _parts(self, version: int) -> tuple[int, list[int]]:
        meta = self.meta(version)
        return meta.get("base", version), meta.get("changes", [])

    def _changes(self, versions: list[int], schema) -> DataFrame:
        return latest([self.spark.read.parquet(f"{self.path}/v{n}/changes") for n in versions], schema)

    def entries(self, version: int) -> DataFrame:
        base, changes = self._parts(version)
        whole = self.spark.read.parquet(f"{self.path}/v{base}/entries")
        return changed(whole, self._changes(changes, whole.schema)) if changes else whole

    def relationships(self, version: int) -> DataFrame:
        base, changes = self._parts(version)
        index = self.spark.read.schema("rel_id string, entry_id string, rel_key string").parquet(f"{self.path}/v{base}/relationships")
        if not changes:
            return index
        schema = self.spark.read.parquet(f"{self.path}/v{base}/entries").schema
        fresh = self._changes(changes, schema)
        kept = remove(index.withColumnRenamed("entry_id", "id"), fresh).withColumnRenamed("id", "entry_id")
        return kept.unionByName(self.spec.index(fresh.where(f"not {DELETED}").drop(DELETED)))

    def _done(self, version: int, meta: dict) -> int:
        self.files.write(f"v{version}/_COMMITTED", json.dumps(meta))
        return version

    def commit(self, entries: DataFrame, meta: dict) -> int:
        """Write a new version whole. The index is derived from the written entries, so the two cannot drift apart."""
        version = self.version() + 1
        self.files.delete(f"v{version}")  # the remains of a commit that failed
        entries.write.parquet(f"{self.path}/v{version}/entries")
        written = self.spark.read.parquet(f"{self.path}/v{version}/entries")
        # Sorting by key first keeps one task from opening a file for each key; row groups then skip by rel_id.
        index = self.spec.index(written).repartitionByRange("rel_key", "rel_id", "entry_id").sortWithinPartitions("rel_key", "rel_id", "entry_id")
        index.write.partitionBy("rel_key").parquet(f"{self.path}/v{version}/relationships")
        return self._done(version, meta | {"base": version, "changes": []})

    def prepare(self, changes: DataFrame) -> int:
        """Write changes (entries plus DELETED, each ID once) as those of the next version, which is not there before finish."""
        version = self.version() + 1
        self.files.delete(f"v{version}")
        changes.write.parquet(f"{self.path}/v{version}/changes")
        return version

    def prepared(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{version}/changes")

    def finish(self, version: int, meta: dict) -> int:
        """Make prepared changes a version; after MOST_CHANGES of them the next version is written whole."""
        base, before = self._parts(version - 1)
        self._done(version, meta | {"base": base, "changes": [*before, version]})
        if len(before) >= MOST_CHANGES:
            return self.commit(self.entries(version), meta)
        return version

    def commit_changes(self, changes: DataFrame, meta: dict) -> int:
        return self.finish(self.prepare(changes), meta)

    def commit_meta(self, meta: dict) -> int:
        """A version with the present one's data and other metadata."""
        now = self.version()
        return self._done(now + 1, meta | dict(zip(("base", "changes"), self._parts(now))))

    def vacuum(self, keep: int = 2) -> None:
        """Remove versions older than the newest ``keep``, but for what these are made of."""
        newest, needed = self.version(), set()
        for n in range(max(0, newest - keep + 1), newest + 1):
            base, changes = self._parts(n)
            needed |= {n, base, *changes}
        for n in range(newest):
            if n not in needed:
                self.files.delete(f"v{n}")
