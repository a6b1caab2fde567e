"""The store: entries with declared relationships, queried by filters and changed in transactions."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterable
from concurrent.futures import Future
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .context import Context
from .cursor import Cursor
from .errors import BatchSiblingFailed, Break, EmptyEntryID, EntryNotFound, MirrorIsReadOnly, StoreClosed
from .functions.encoders import JSONEncoder
from .functions.ids import INDEX_LENGTH, join_token
from .operators import writes
from .plans.compile import Options, Plan
from .sources.changelog import ChangeLog, decode_values, delete_actions, write_actions
from .sources.storage import Storage
from .spec import RelationshipSpec


@dataclass(frozen=True)
class StoreOptions:
    """batch_calls, batch_seconds: calls and age at which a Batcher commits a group; retry_batch_fail: run the calls before a
    failing one again. storage and log make the classes that keep versions and records, source is another log whose records
    are imported on opening, and on_import(kind, records) is told of what is replayed or imported."""

    index_length: int = INDEX_LENGTH
    batch_calls: int = 1024
    batch_seconds: float = 0.01
    retry_batch_fail: bool = False
    is_mirror: bool = False
    encoder: JSONEncoder = JSONEncoder()
    storage: Callable[[SparkSession, str, RelationshipSpec], Storage] = Storage
    log: Callable[[SparkSession, str], ChangeLog] = ChangeLog
    source: ChangeLog | None = None
    on_import: Callable[[str, DataFrame], None] | None = None


class Page:
    """A query's rows; last_id is the next page's token if the page is full, else empty."""

    def __init__(self, keyed: DataFrame, plan: Plan, limit: int, order: list, data: DataFrame):
        self.keyed, self.df, self._plan, self._limit, self._order = keyed, data, plan, limit, order

    @property
    def last_id(self) -> str:
        if self._limit <= 0:
            return ""
        rows = self.keyed.select("rel_id", "id").collect()  # as many as the limit at most
        if len(rows) < self._limit:
            return ""
        return join_token(rows[-1].rel_id if self._plan.by_rel_id else "", rows[-1].id)


class Reader:
    """Reads over one fixed state of a store."""

    def __init__(self, entries: DataFrame, spec: RelationshipSpec, index: DataFrame | None = None):
        spec.validate(entries.schema)
        self.entries, self.spec, self.index = entries, spec, index

    def plan(self, filters: Iterable = ()) -> Plan:
        return Plan(self.entries, self.spec, list(filters), self.index)

    def get(self, entry_id: str) -> Row:
        found = self.entries.where(F.col("id") == entry_id).limit(1).collect()
        if not found:
            raise EntryNotFound(entry_id)
        return found[0]

    def exists(self, entry_id: str) -> bool:
        return not self.entries.where(F.col("id") == entry_id).limit(1).isEmpty()

    def has_entries(self) -> bool:
        return not self.entries.isEmpty()

    def lookup(self, key: str, rel_id: str) -> DataFrame:
        """IDs in one bucket of the index."""
        from .operators.filters import Match

        return self.plan([Match(key, rel_id)]).rows().select("id")

    def get_filtered(self, options: Options | None = None) -> Page:
        return self._page(options or Options(), tuple(c for c in self.entries.columns if c != "id"))

    def get_filtered_ids(self, options: Options | None = None) -> Page:
        return self._page(options or Options(), ())

    def _page(self, options: Options, keep: tuple[str, ...]) -> Page:
        plan = self.plan(options.filters)
        keyed = plan.select(options, tuple(c for c in keep if c != "rel_id"))
        columns = self.entries.columns if keep else ["id"]
        return Page(keyed, plan, options.limit, plan.order(options.reverse), keyed.select(*columns))

    def append_filtered(self, given: DataFrame, options: Options | None = None) -> DataFrame:
        """Rows of a query after the given ones, repeats kept."""
        return given.unionByName(self.get_filtered(options).df)

    def append_filtered_ids(self, given: DataFrame, options: Options | None = None) -> DataFrame:
        return given.unionByName(self.get_filtered_ids(options).df)

    def get_first(self, options: Options | None = None) -> Row:
        return self._edge(options or Options(), False)

    def get_last(self, options: Options | None = None) -> Row:
        return self._edge(options or Options(), True)

    def _edge(self, options: Options, reverse: bool) -> Row:
        found = self.get_filtered(replace(options, reverse=reverse, limit=1)).df.collect()
        if not found:
            raise EntryNotFound("no entry passes the filters")
        return found[0]

    def for_each(self, fn: Callable[[str, Row], Any], options: Options | None = None) -> None:
        """fn(id, entry) in order; raising Break stops quietly; the limit does not apply."""
        try:
            for row in self.get_filtered(replace(options or Options(), limit=-1)).df.toLocalIterator():
                fn(row.id, row)
        except Break:
            pass

    def for_each_id(self, fn: Callable[[str], Any], options: Options | None = None) -> None:
        try:
            for row in self.get_filtered_ids(replace(options or Options(), limit=-1)).df.toLocalIterator():
                fn(row.id)
        except Break:
            pass

    def cursor(self, filters: Iterable = (), page: int = 256) -> Cursor:
        return Cursor(self.plan(filters), tuple(c for c in self.entries.columns if c != "id"), page)

    def id_cursor(self, filters: Iterable = (), page: int = 256) -> Cursor:
        return Cursor(self.plan(filters), (), page)

    def with_cursor(self, fn: Callable[[Cursor], Any], filters: Iterable = ()) -> None:
        try:
            fn(self.cursor(filters))
        except Break:
            pass


class Transaction(Reader):
    """Writes staged on top of a state. Reads see them; nothing is stored before the commit."""

    def __init__(self, entries: DataFrame, spec: RelationshipSpec, current: int, options: StoreOptions, clock: Callable[[], int]):
        super().__init__(entries, spec)
        self.current, self._options, self._clock = current, options, clock
        self.context: Context | None = None
        #: changes in order: frames, and last the single-entry calls since
        self._frames: list[DataFrame] = []
        self._changed: dict[str, dict | None] = {}
        self._base, self._schema = entries, entries.schema

    def _check(self) -> None:
        if self.context is not None:
            self.context.check()

    @property
    def entries(self) -> DataFrame:
        self._check()
        return self._entries

    @entries.setter
    def entries(self, entries: DataFrame) -> None:
        self._entries = entries

    def _single(self) -> list[DataFrame]:
        """The single-entry changes, which are as many as the caller's calls."""
        if not self._changed:
            return []
        names = [f.name for f in self._schema.fields]
        rows = [tuple(k if c == "id" else (v or {}).get(c) for c in names) + (v is None,) for k, v in self._changed.items()]
        return [self._base.sparkSession.createDataFrame(rows, T.StructType([T.StructField(f.name, f.dataType) for f in self._schema.fields]).add(writes.DELETED, "boolean"))]

    def changes(self) -> DataFrame | None:
        """What the transaction changes: entries plus DELETED, each ID once; None if nothing."""
        parts = [*self._frames, *self._single()]
        return writes.latest(parts, self._schema) if parts else None

    def _refresh(self) -> None:
        changes = self.changes()
        self._entries = self._base if changes is None else writes.changed(self._base, changes)

    def _write(self, entry_id: str, value: dict) -> Row:
        self._check()
        if not entry_id:
            raise EmptyEntryID("an entry ID must not be empty")
        names = self._base.columns
        unknown = set(value) - set(names)
        if unknown:
            raise ValueError(f"unknown columns {sorted(unknown)}")
        now = self._clock()
        out = {c: value.get(c) for c in names} | {"id": entry_id, "createdAt": value.get("createdAt") or now, "updatedAt": now}
        self._changed[entry_id] = out
        self._refresh()
        return Row(**out)

    def new(self, value: dict) -> Row:
        """The next padded ID; an entry that a put left there is overwritten."""
        entry_id = f"{self.current:0{self._options.index_length}d}"
        self.current += 1
        return self._write(entry_id, value)

    def new_frame(self, values: DataFrame, order: list[str]) -> DataFrame:
        """Entries for many values at once, numbered in the given order; returns them with their IDs."""
        numbered = writes.number(values, self.current, order, self._options.index_length)
        self.current += values.count()
        self.put_frame(numbered)
        return numbered

    def put(self, entry_id: str, value: dict) -> Row:
        return self._write(entry_id, value)

    def get(self, entry_id: str) -> Row:
        self._check()
        if entry_id in self._changed:
            if (value := self._changed[entry_id]) is None:
                raise EntryNotFound(entry_id)
            return Row(**value)
        return super().get(entry_id)

    def update(self, entry_id: str, fn: Callable[[dict], dict | None]) -> Row:
        """fn changes the entry's dict in place or returns another one."""
        value = self.get(entry_id).asDict(recursive=True)
        return self._write(entry_id, fn(value) or value)

    def delete(self, entry_id: str) -> Row:
        value = self.get(entry_id)
        self._changed[entry_id] = None
        self._refresh()
        return value

    def _frame(self, changes: DataFrame) -> None:
        self._check()
        self._frames += [*self._single(), changes]
        self._changed = {}
        self._refresh()

    def put_frame(self, values: DataFrame) -> None:
        """Upsert many entries at once; values hold each ID once."""
        self._frame(writes.stamp(values, F.lit(self._clock())).select(*self._base.columns, F.lit(False).alias(writes.DELETED)))

    def delete_frame(self, ids: DataFrame) -> None:
        """Delete many entries at once; IDs that no entry has do nothing."""
        rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in self._schema.fields if f.name != "id"]
        gone = ids.select("id").distinct().select("id", *rest, F.lit(True).alias(writes.DELETED))
        self._frame(gone.select(*self._base.columns, writes.DELETED))


class Store:
    """A store in a directory, with its change log beside it. One writer at a time; readers keep the version they opened.

    The log is written first and is the source of truth: a version's metadata says up to which record the version goes, and
    what the log has beyond it, after a crash between the two, is applied when the store is opened again. An empty directory
    is rebuilt from the log, and a populated one without a log gets its log from the entries.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, spec: RelationshipSpec, options: StoreOptions | None = None, clock: Callable[[], int] | None = None):
        spec.validate(schema)
        self.spark, self.schema, self.spec, self.options = spark, schema, spec, options or StoreOptions()
        self.path, self._clock, self._closed = path.rstrip("/"), clock or (lambda: int(time.time())), False
        self._lock = threading.RLock()  # a batcher's timer commits from a thread of its own
        self.storage, self.log = self.options.storage(spark, f"{self.path}/data", spec), self.options.log(spark, f"{self.path}/log")
        if self.options.is_mirror:
            if self.storage.version() < 0:
                self.storage.commit(spark.createDataFrame([], schema), {"currentIndex": 0, "seq": 0})
            return
        self._start()

    def _start(self) -> None:
        fresh, logged = self.storage.version() < 0, self.log.exists()
        if fresh:
            self.storage.commit(self.spark.createDataFrame([], self.schema), {"currentIndex": 0, "seq": 0})
        if logged:
            self._replay()
        elif not fresh:
            self._build_history()
        if self.options.source is not None:
            self._import(self.options.source)

    def _replay(self) -> None:
        """Apply the log's records beyond the present version."""
        v = self.storage.version()
        meta = self.storage.meta(v)
        tail = self.log.after(meta.get("seq", 0))
        if not tail.isEmpty():
            self._apply(tail, meta, int(tail.agg(F.max("seq")).first()[0]))

    def _apply(self, records: DataFrame, meta: dict, seq: int) -> None:
        folded = writes.fold(records)
        live = decode_values(folded, self.options.encoder, self.schema).withColumn(writes.DELETED, F.lit(False))
        rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields if f.name != "id"]
        gone = folded.where(F.col("type") == writes.DELETE).select(F.col("key").alias("id"), *rest, F.lit(True).alias(writes.DELETED))
        self.storage.commit_changes(live.unionByName(gone), meta | {"seq": seq})
        largest = writes.next_index(self.storage.entries(self.storage.version())).first().current_index
        if largest > meta["currentIndex"]:
            self.storage.commit_meta(self.storage.meta(self.storage.version()) | {"currentIndex": largest})
        if self.options.on_import:
            self.options.on_import("log", records)

    def _build_history(self) -> None:
        """A populated store whose log is gone or never was: every entry becomes a write record."""
        v = self.storage.version()
        entries, meta = self.storage.entries(v), self.storage.meta(v)
        if entries.isEmpty():
            return
        seq = meta.get("seq", 0) + 1
        self.log.append(write_actions(entries, self.options.encoder, F.lit(seq), F.timestamp_seconds(F.lit(self._clock()))))
        current = max(meta["currentIndex"], writes.next_index(entries).first().current_index)
        self.storage.commit_meta(meta | {"currentIndex": current, "seq": seq})

    def _import(self, source: ChangeLog) -> None:
        """Take over another log's records beyond those imported before, as one commit of this store."""
        v = self.storage.version()
        meta = self.storage.meta(v)
        fresh = source.after(meta.get("imported", 0))
        if fresh.isEmpty():
            return
        last, seq = int(fresh.agg(F.max("seq")).first()[0]), meta.get("seq", 0) + 1
        folded = writes.fold(fresh).withColumns({"seq": F.lit(seq).cast("bigint"), "ts": F.timestamp_seconds(F.lit(self._clock()))})
        records = folded.select("seq", "ts", "type", "key", "value")
        self.log.append(records)
        self._apply(records, meta | {"imported": last}, seq)

    def rebuilt(self) -> DataFrame:
        """Entries as the whole log says."""
        return decode_values(writes.fold(self.log.read()), self.options.encoder, self.schema)

    def _open(self) -> None:
        if self._closed:
            raise StoreClosed("the store is closed")

    def _writable(self) -> None:
        self._open()
        if self.options.is_mirror:
            raise MirrorIsReadOnly("a mirror takes no writes")

    def reader(self, use_index: bool = False) -> Reader:
        """The present state. use_index: plan with the materialised index, for stores whose entries are wide."""
        self._open()
        v = self.storage.version()
        return Reader(self.storage.entries(v), self.spec, self.storage.relationships(v) if use_index else None)

    def read_transaction(self, fn: Callable[[Reader], Any], context: Context | None = None) -> Any:
        if context is None:
            return fn(self.reader())
        with context.running(self.spark):
            return fn(self.reader())

    def transaction(self, fn: Callable[[Transaction], Any], context: Context | None = None) -> Any:
        """All of fn's writes or, if it raises or the context is cancelled, none."""
        with self._lock:
            self._writable()
            v = self.storage.version()
            meta = self.storage.meta(v)
            txn = Transaction(self.storage.entries(v), self.spec, meta["currentIndex"], self.options, self._clock)
            if context is None:
                out = fn(txn)
            else:
                with context.running(self.spark):
                    txn.context = context
                    out = fn(txn)
                    context.check()
                txn.context = None
            self._commit(txn, meta)
            return out

    def _commit(self, txn: Transaction, meta: dict) -> None:
        """From here on nothing is cancelled: what the log holds counts."""
        changes = txn.changes()
        if changes is None:
            if txn.current != meta["currentIndex"]:
                self.storage.commit_meta(meta | {"currentIndex": txn.current})
            return
        seq = meta.get("seq", 0) + 1
        # the changes are written once and read back, so that log and version hold the same rows whatever made them
        v = self.storage.prepare(changes)
        rows, ts = self.storage.prepared(v), F.timestamp_seconds(F.lit(self._clock()))
        written = write_actions(rows.where(f"not {writes.DELETED}").drop(writes.DELETED), self.options.encoder, F.lit(seq), ts)
        gone = delete_actions(rows.where(writes.DELETED).select("id"), F.lit(seq), ts)
        self.log.append(written.unionByName(gone))
        self.storage.finish(v, meta | {"currentIndex": txn.current, "seq": seq})

    def new(self, value: dict) -> Row:
        return self.transaction(lambda t: t.new(value))

    def put(self, entry_id: str, value: dict) -> Row:
        return self.transaction(lambda t: t.put(entry_id, value))

    def update(self, entry_id: str, fn: Callable[[dict], dict | None]) -> Row:
        return self.transaction(lambda t: t.update(entry_id, fn))

    def delete(self, entry_id: str) -> Row:
        return self.transaction(lambda t: t.delete(entry_id))

    def batcher(self) -> Batcher:
        self._writable()
        return Batcher(self)

    def batch(self, calls: Iterable[Callable[[Transaction], Any]]) -> list:
        """Run calls in groups, one commit a group."""
        self._writable()
        with Batcher(self, timed=False) as b:
            for c in calls:
                b.add(c)
        return b.results

    def reindex(self) -> None:
        """Rebuild every index from the entries."""
        self._writable()
        v = self.storage.version()
        self.storage.commit(self.storage.entries(v), self.storage.meta(v))

    def snapshot(self, path: str) -> None:
        """All entries as write records in a directory of its own."""
        self._writable()
        v = self.storage.version()
        records = write_actions(self.storage.entries(v), self.options.encoder, F.lit(self.storage.meta(v).get("seq", 0)), F.timestamp_seconds(F.lit(self._clock())))
        records.write.mode("overwrite").parquet(path)

    def close(self) -> None:
        self._open()
        self._closed = True


class Batcher:
    """Groups calls by count or age into one transaction; a group is also run batch_seconds after its first call.

    A call that raises gets its own error. The calls before it in the group are run again if retry_batch_fail is set, and
    else fail with BatchSiblingFailed; those after it run in a group of their own. add() returns a future of the call's result.
    """

    def __init__(self, store: Store, timed: bool = True):
        self._store, self._timed, self._lock = store, timed, threading.RLock()
        self._calls: list[tuple] = []
        self._futures: list[Future] = []
        self._timer: threading.Timer | None = None

    @property
    def results(self) -> list:
        """Results, or errors, of all calls that have run, in the order of add()."""
        return [f.exception() or f.result() for f in self._futures if f.done()]

    def add(self, call: Callable[[Transaction], Any], context: Context | None = None) -> Future:
        with self._lock:
            future: Future = Future()
            self._calls.append((call, context, future))
            self._futures.append(future)
            options = self._store.options
            if len(self._calls) >= options.batch_calls:
                self.flush()
            elif self._timed and self._timer is None:
                self._timer = threading.Timer(options.batch_seconds, self.flush)
                self._timer.daemon = True
                self._timer.start()
            return future

    def flush(self) -> None:
        with self._lock:
            if self._timer is not None:
                self._timer.cancel()
                self._timer = None
            calls, self._calls = self._calls, []
            self._run(calls)

    def _run(self, calls: list[tuple]) -> None:
        while calls:
            done: list = []

            def run(txn: Transaction, calls=calls, done=done) -> None:
                for call, context, _ in calls:
                    if context is None:
                        done.append(call(txn))
                    else:
                        with context.running(self._store.spark):
                            txn.context = context
                            done.append(call(txn))
                            context.check()
                        txn.context = None

            try:
                self._store.transaction(run)
            except Exception as error:  # noqa: BLE001  a caller's function may raise anything
                at = len(done)
                if at == len(calls):  # not a call but the commit failed: none of them is stored
                    for _, _, future in calls:
                        future.set_exception(error)
                    return
                if self._store.options.retry_batch_fail:
                    self._run(calls[:at])
                else:
                    for _, _, future in calls[:at]:
                        future.set_exception(BatchSiblingFailed(f"another call of the batch failed: {error}"))
                calls[at][2].set_exception(error)
                calls = calls[at + 1 :]
            else:
                for (_, _, future), result in zip(calls, done, strict=True):
                    future.set_result(result)
                return

    def __enter__(self) -> Batcher:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.flush()


class ReadWrapper:
    """A store's reads only."""

    def __init__(self, store: Store):
        self._store = store

    def __getattr__(self, name: str):
        if name in ("get", "exists", "lookup", "get_filtered", "get_filtered_ids", "append_filtered", "append_filtered_ids", "get_first", "get_last", "for_each", "for_each_id", "cursor", "id_cursor", "with_cursor", "has_entries"):
            return getattr(self._store.reader(), name)
        raise AttributeError(name)


class WriteWrapper:
    """A store's writes only."""

    def __init__(self, store: Store):
        self._store = store

    def __getattr__(self, name: str):
        if name in ("new", "put", "update", "delete", "batch"):
            return getattr(self._store, name)
        raise AttributeError(name)


class Wrapper(ReadWrapper):
    """Reads and writes without the store's administration."""

    def __getattr__(self, name: str):
        try:
            return super().__getattr__(name)
        except AttributeError:
            return getattr(WriteWrapper(self._store), name)
