"""Declared relationships of a store: which columns index its entries."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import RelationshipNotFound

SYSTEM_COLUMNS = ("id", "createdAt", "updatedAt")
INDEX_SCHEMA = "rel_key string, rel_id string, entry_id string"


@dataclass(frozen=True)
class RelationshipSpec:
    """Ordered map of relationship key to the entry column that holds its ID or IDs.

    A scalar string column stands for at most one ID, an ``array<string>`` column for many.
    Empty and null IDs are never indexed.
    """

    columns: Mapping[str, str]

    def column_of(self, key: str) -> str:
        if key not in self.columns:
            raise RelationshipNotFound(f"relationship {key!r} is not declared; known: {sorted(self.columns)}")
        return self.columns[key]

    def validate(self, schema: T.StructType) -> None:
        """Every key needs a string or array-of-string column, and the system columns must exist."""
        names = {f.name: f.dataType for f in schema.fields}
        for name in SYSTEM_COLUMNS:
            if name not in names:
                raise ValueError(f"entries lack the system column {name!r}")
        for key, name in self.columns.items():
            kind = names.get(name)
            if kind is None:
                raise RelationshipNotFound(f"relationship {key!r}: entries lack the column {name!r}")
            of = kind.elementType if isinstance(kind, T.ArrayType) else kind
            if not isinstance(of, T.StringType):
                raise TypeError(f"relationship {key!r}: {name!r} is {kind.simpleString()}, not string or array<string>")

    def is_many(self, schema: T.StructType, key: str) -> bool:
        return isinstance(schema[self.column_of(key)].dataType, T.ArrayType)

    def pairs(self, entries: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
        """(rel_id, id, keep...) of one key, each pair once; scalar keys keep their column visible to push-down."""
        name = self.column_of(key)
        kept = [F.col(c) for c in keep]
        if self.is_many(entries.schema, key):
            exploded = entries.select(F.explode(F.array_distinct(F.col(name))).alias("rel_id"), "id", *kept)
            return exploded.where(F.col("rel_id") != "")
        return entries.where(F.col(name) != "").select(F.col(name).alias("rel_id"), "id", *kept)

    def index(self, entries: DataFrame) -> DataFrame:
        """The whole inverted index in long form, one row per (key, ID, entry)."""
        parts = [
            self.pairs(entries, key).select(F.lit(key).alias("rel_key"), "rel_id", F.col("id").alias("entry_id"))
            for key in self.columns
        ]
        if not parts:
            return entries.sparkSession.createDataFrame([], INDEX_SCHEMA)
        return reduce(DataFrame.unionByName, parts)

    def ids_of(self, schema: T.StructType, key: str) -> Column:
        """The key's IDs as an array without nulls or empty strings."""
        name = self.column_of(key)
        raw = F.col(name) if self.is_many(schema, key) else F.array(F.col(name))
        return F.filter(F.coalesce(raw, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
