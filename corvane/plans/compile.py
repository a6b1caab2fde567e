"""Filters and options to a DataFrame.

All of it is lazy. Later filters become predicates on the entry row itself, so a conjunction over
entries needs no join and no shuffle; with a materialised index (``index=``) they become semi- and
anti-joins on its key partition. Only the final order (or top-k) shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import split_token
from ..operators.filters import Comparison, Filter, InverseMatch, Match, checked
from ..spec import RelationshipSpec


@dataclass(frozen=True)
class Options:
    """limit < 0: all rows. last_id: a page token, exclusive."""

    filters: list = field(default_factory=list)
    last_id: str = ""
    reverse: bool = False
    limit: int = -1


def _python_ids(ids: DataFrame, f: Comparison) -> DataFrame:
    """The distinct IDs that a Python predicate accepts: its calls grow with the IDs, not with the pairs."""
    fn = f.python

    @F.pandas_udf("boolean")
    def accepts(s: pd.Series) -> pd.Series:
        return s.map(lambda x: bool(fn(x))).astype("bool")

    return ids.where(f.native(F.col("rel_id"))).select("rel_id").distinct().where(accepts("rel_id"))


class Plan:
    """One conjunction over a store's entries."""

    def __init__(self, entries: DataFrame, spec: RelationshipSpec, filters: list[Filter], index: DataFrame | None = None):
        self.entries, self.spec, self.filters, self.index = entries, spec, checked(filters), index
        for f in self.filters:
            if f.key or not isinstance(f, Comparison):
                spec.column_of(f.key)

    def _pairs(self, key: str, entries: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
        if self.index is not None and not keep:
            got = self.index.where(F.col("rel_key") == key).select("rel_id", F.col("entry_id").alias("id"))
            return got if entries is None or entries is self.entries else got.join(entries.select("id"), "id", "left_semi")
        return self.spec.pairs(self.entries if entries is None else entries, key, keep)

    def row_test(self, f: Filter) -> Column | None:
        """A later filter as a predicate on the entry row; None if it runs Python."""
        if isinstance(f, Comparison):
            if f.python is not None:
                return None
            if not f.key:
                return f.native(F.col("id"))
        schema = self.entries.schema
        if not self.spec.is_many(schema, f.key):
            value = F.col(self.spec.column_of(f.key))
            if isinstance(f, Match):
                return (value == f.rel_id) & (value != "")
            if isinstance(f, InverseMatch):
                return value.isNull() | (value != f.rel_id) | (value == "")
            return f.native(value) & (value != "") & self._not_stopped(f, value)
        ids = self.spec.ids_of(schema, f.key)
        if isinstance(f, Match):
            return F.array_contains(ids, f.rel_id)
        if isinstance(f, InverseMatch):
            return ~F.array_contains(ids, f.rel_id)
        return F.exists(ids, lambda x: f.native(x) & self._not_stopped(f, x))

    @staticmethod
    def _not_stopped(f: Comparison, value: Column) -> Column:
        return F.lit(True) if f.stop_when is None else ~F.coalesce(f.stop_when(value), F.lit(False))

    def _semi(self, rows: DataFrame, f: Filter) -> DataFrame:
        """A later filter as a join, for the materialised index and for Python predicates."""
        if isinstance(f, Comparison) and not f.key:
            if f.python is None:
                return rows.where(f.native(F.col("id")))
            ok = _python_ids(rows.select(F.col("id").alias("rel_id")), f)
            return rows.join(ok.withColumnRenamed("rel_id", "id"), "id", "left_semi")
        pairs = self._pairs(f.key)
        if isinstance(f, InverseMatch):
            return rows.join(pairs.where(F.col("rel_id") == f.rel_id).select("id"), "id", "left_anti")
        if isinstance(f, Match):
            ids = pairs.where(F.col("rel_id") == f.rel_id)
        else:
            ids = pairs.where(f.native(F.col("rel_id")) & self._not_stopped(f, F.col("rel_id")))
            if f.python is not None:
                ids = ids.join(_python_ids(pairs, f), "rel_id", "left_semi")
        return rows.join(ids.select("id"), "id", "left_semi")

    def rows(self, keep: tuple[str, ...] = ()) -> DataFrame:
        """(rel_id, id, keep...), unordered; rel_id is empty unless the first filter orders by it."""
        entries, joined = self.entries, []
        for f in self.filters[1:]:
            test = None if self.index is not None else self.row_test(f)
            if test is None:
                joined.append(f)
            else:
                entries = entries.where(test)
        out = self._primary(entries, keep)
        for f in joined:
            out = self._semi(out, f)
        return out

    def _primary(self, entries: DataFrame, keep: tuple[str, ...]) -> DataFrame:
        none = F.lit("").alias("rel_id")
        kept = [F.col(c) for c in keep]
        if not self.filters:
            return entries.select(none, "id", *kept)
        f = self.filters[0]
        if isinstance(f, Match):
            if self.index is None:
                return entries.where(self.row_test(f)).select(none, "id", *kept)
            return self._with(self._pairs(f.key).where(F.col("rel_id") == f.rel_id).select(none, "id"), entries, keep)
        if isinstance(f, InverseMatch):
            return self._indexed(entries, f.key, keep).where(F.col("rel_id") != f.rel_id)
        if f.key:
            out = self._indexed(entries, f.key, keep).where(f.native(F.col("rel_id")))
        else:
            out = entries.where(f.native(F.col("id"))).select(none, "id", *kept)
        if f.python is not None:
            of = "rel_id" if f.key else "id"
            ok = _python_ids(out.select(F.col(of).alias("rel_id")), f).withColumnRenamed("rel_id", of)
            out = out.join(ok, of, "left_semi").select("rel_id", "id", *keep)
        if f.stop_when is not None:
            of = F.col("rel_id") if f.key else F.col("id")
            at = out.where(F.coalesce(f.stop_when(of), F.lit(False))).agg(F.min(F.struct("rel_id", "id")).alias("at"))
            # One row: the smallest key at which the traversal ends.
            out = out.join(F.broadcast(at)).where(F.col("at").isNull() | (F.struct("rel_id", "id") < F.col("at"))).drop("at")
        return out

    def _indexed(self, entries: DataFrame, key: str, keep: tuple[str, ...]) -> DataFrame:
        if self.index is None:
            return self._pairs(key, entries, keep)
        return self._with(self._pairs(key), entries, keep)

    @staticmethod
    def _with(rows: DataFrame, entries: DataFrame, keep: tuple[str, ...]) -> DataFrame:
        return rows.join(entries.select("id", *keep), "id").select("rel_id", "id", *keep) if keep else rows

    @property
    def by_rel_id(self) -> bool:
        """Whether rows are ordered by (rel_id, id) rather than by id."""
        return bool(self.filters) and not isinstance(self.filters[0], Match) and bool(self.filters[0].key)

    def after(self, rows: DataFrame, token: str, reverse: bool, inclusive: bool = False) -> DataFrame:
        """Rows beyond a page token. The OR form, unlike a tuple comparison, reaches the Parquet scan."""
        if not token:
            return rows
        rel, last = split_token(token) if self.by_rel_id else ("", token.split("::", 1)[-1])
        one, r = F.col("id"), F.col("rel_id")
        if inclusive:
            edge = one <= last if reverse else one >= last
        else:
            edge = one < last if reverse else one > last
        if not self.by_rel_id:
            return rows.where(edge)
        return rows.where((r < rel if reverse else r > rel) | ((r == rel) & edge))

    def order(self, reverse: bool) -> list[Column]:
        cols = [F.col("rel_id"), F.col("id")] if self.by_rel_id else [F.col("id")]
        return [c.desc() if reverse else c.asc() for c in cols]

    def select(self, options: Options, keep: tuple[str, ...] = ()) -> DataFrame:
        """(rel_id, id, keep...) in the contract's order, after the token, up to the limit."""
        if options.limit == 0:
            return self.rows(keep).limit(0)
        out = self.after(self.rows(keep), options.last_id, options.reverse).orderBy(*self.order(options.reverse))
        return out if options.limit < 0 else out.limit(options.limit)
