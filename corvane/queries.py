"""The query catalogue over the driver's tables, with the SQL that says what each should return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .errors import Break
from .functions.encoders import EncryptedJSONEncoder, JSONEncoder
from .functions.ids import padded_id, parse_index
from .operators import writes
from .operators.filters import Comparison, InverseMatch, Match, greater_than, greater_than_or_equal_to, in_range, less_than, less_than_or_equal_to
from .plans.compile import Options, Plan
from .sources.changelog import decode_values, write_actions
from .sources.scratch import scratch
from .spec import RelationshipSpec
from .store import Reader, Store, StoreOptions, Transaction
from .streaming.mirror import Mirror

ORDERS = RelationshipSpec({"status": "st", "priority": "pr", "customers": "cust", "tags": "tags"})
EVENTS = RelationshipSpec({"users": "user", "types": "type"})
NOW = 1_700_000_000
_STATUS_F, _AF = Match("status", "F"), Match("tags", "AF")


def orders(spark: SparkSession, d: str, tags: bool = True) -> DataFrame:
    """The store over orders; tags are the distinct flag and status pairs of an order's line items."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    out = o.select(
        padded_id(F.col("o_orderkey")).alias("id"),
        F.lit(0).cast("bigint").alias("createdAt"),
        F.lit(0).cast("bigint").alias("updatedAt"),
        F.col("o_orderstatus").alias("st"),
        F.col("o_orderpriority").alias("pr"),
        F.col("o_custkey").cast("string").alias("cust"),
        "o_orderkey",
    )
    if not tags:
        return out.withColumn("tags", F.array().cast("array<string>")).drop("o_orderkey")
    line = spark.read.parquet(f"{d}/lineitem.parquet")
    held = line.groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))).alias("tags"))
    return out.join(held, out.o_orderkey == held.l_orderkey, "left").drop("o_orderkey", "l_orderkey")


def events(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    zero = F.lit(0).cast("bigint")
    return e.select(padded_id(F.col("event_id")).alias("id"), zero.alias("createdAt"), zero.alias("updatedAt"), F.col("user_id").cast("string").alias("user"), F.col("event_type").alias("type"))


def _plan(spark: SparkSession, d: str, *filters, tags: bool = True) -> Plan:
    return Plan(orders(spark, d, tags), ORDERS, list(filters))


def _ids(*filters, tags: bool = False) -> Callable:
    return lambda s, d: _plan(s, d, *filters, tags=tags).rows().select("id")


def _pairs(*filters, tags: bool = False) -> Callable:
    return lambda s, d: _plan(s, d, *filters, tags=tags).rows().select(F.col("rel_id").alias("rid"), "id")


def _page(*filters, tags: bool = False, **options) -> Callable:
    def run(s: SparkSession, d: str) -> DataFrame:
        return _plan(s, d, *filters, tags=tags).select(Options(**options)).select(F.col("rel_id").alias("rid"), "id")

    return run


def _seek(reverse: bool) -> Callable:
    def run(s: SparkSession, d: str) -> DataFrame:
        cursor = _reader(s, d).id_cursor([Match("status", "F")])
        row = (cursor.seek_reverse if reverse else cursor.seek)("00005000")
        return s.createDataFrame([(row.id,)] if row else [], "id string")

    return run


def ranked_order(s: SparkSession, d: str) -> DataFrame:
    """The contract's order as a number, counted a relationship ID at a time."""
    rows = _plan(s, d, InverseMatch("priority", "2-HIGH"), tags=False).rows()
    within = F.row_number().over(Window.partitionBy("rel_id").orderBy("id"))
    sizes = rows.groupBy("rel_id").count()
    before = sizes.select("rel_id", (F.sum("count").over(Window.orderBy("rel_id")) - F.col("count")).alias("before"))
    ranked = rows.withColumn("n", within).join(before, "rel_id")
    return ranked.select(F.col("rel_id").alias("rid"), "id", (F.col("n") + F.col("before")).cast("bigint").alias("rank"))


def _changes(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders of customer 1 to 50 become priority X; orders below 00000100 go."""
    base = orders(s, d, tags=False)
    changed = base.where(F.col("cust").cast("int") <= 50).withColumn("pr", F.lit("X"))
    return base, changed


def put_state(s: SparkSession, d: str) -> DataFrame:
    base, changed = _changes(s, d)
    return writes.put(base, changed, F.lit(NOW)).select("id", "pr", "createdAt", "updatedAt")


def delete_state(s: SparkSession, d: str) -> DataFrame:
    base = orders(s, d, tags=False)
    return writes.remove(base, base.where(F.col("id") < "00000100").select("id")).select("id", "st")


def update_state(s: SparkSession, d: str) -> DataFrame:
    base = orders(s, d, tags=False)
    rows = base.where(F.col("st") == "F").withColumn("st", F.lit("DONE"))
    return writes.put(base, rows, F.lit(NOW)).select("id", "st", "updatedAt")


def new_state(s: SparkSession, d: str) -> DataFrame:
    """Orders get IDs from 500 on, in order of their customers and keys, and keep their other columns."""
    o = s.read.parquet(f"{d}/orders.parquet").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    return writes.number(o, 500, ["o_custkey", "o_orderkey"]).select("id", "o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")


def index_delta(s: SparkSession, d: str) -> DataFrame:
    base, changed = _changes(s, d)
    old = base.join(changed.select("id"), "id", "left_semi").select(*base.columns)
    return writes.index_delta(ORDERS, old, changed).select("rel_key", "rel_id", "entry_id", "change")


def reindex_counts(s: SparkSession, d: str) -> DataFrame:
    index = ORDERS.index(orders(s, d))
    return index.groupBy(F.col("rel_key").alias("rk"), F.col("rel_id").alias("rid")).agg(F.count("*").alias("n"))


def _log(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet")
    kind = F.when(F.col("event_type") == "error", writes.DELETE).otherwise(writes.WRITE)
    return e.select(F.col("event_id").alias("seq"), kind.cast("tinyint").alias("type"), F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"))


def log_state(s: SparkSession, d: str) -> DataFrame:
    return writes.live(writes.fold(_log(s, d))).select("key", "seq", "value")


def mirror_state(s: SparkSession, d: str) -> DataFrame:
    """Three micro-batches, the second delivered twice."""
    log = _log(s, d)
    third = [log.where(F.col("seq") % 3 == i) for i in range(3)]
    state = writes.fold(third[0])
    for batch in (third[1], third[1], third[2]):
        state = writes.merge_state(state, batch)
    return writes.live(state).select("key", "seq", "value")


def action_types(s: SparkSession, d: str) -> DataFrame:
    return _log(s, d).groupBy(writes.type_name(F.col("type")).alias("name")).agg(F.count("*").alias("n"))


def snapshot_rows(s: SparkSession, d: str) -> DataFrame:
    rows = write_actions(orders(s, d, tags=False), JSONEncoder(), F.lit(0), F.lit(None).cast("timestamp"))
    return rows.select("key", F.col("type").cast("int").alias("type"), F.get_json_object(F.unbase64("value").cast("string"), "$.pr").alias("pr"))


def rebuild(s: SparkSession, d: str) -> DataFrame:
    base = orders(s, d, tags=False)
    log = write_actions(base, JSONEncoder(), F.lit(1), F.lit(None).cast("timestamp"))
    return decode_values(writes.fold(log), JSONEncoder(), base.schema).select("id", "st", "cust")


def next_index(s: SparkSession, d: str) -> DataFrame:
    return writes.next_index(orders(s, d, tags=False))


def id_numbers(s: SparkSession, d: str) -> DataFrame:
    from .functions.ids import strip_zeros

    return orders(s, d, tags=False).select("id", strip_zeros(F.col("id")).alias("stripped"), parse_index(F.col("id")).alias("number"))


def _coded(encoder: JSONEncoder, written_by: JSONEncoder | None = None) -> Callable:
    def run(s: SparkSession, d: str) -> DataFrame:
        base = orders(s, d, tags=False)
        coded = base.select("id", (written_by or encoder).encode(F.struct("id", "st", "pr", "cust")).alias("v"))
        back = encoder.decode(F.col("v"), base.select("id", "st", "pr", "cust").schema)
        return coded.select(back.alias("x")).select("x.id", "x.st", "x.pr", "x.cust")

    return run


def _reader(s: SparkSession, d: str, tags: bool = False, index: bool = False) -> Reader:
    entries = orders(s, d, tags)
    return Reader(entries, ORDERS, ORDERS.index(entries) if index else None)


def get(s: SparkSession, d: str) -> DataFrame:
    row = _reader(s, d).get("00000007")
    return s.createDataFrame([(row.id, row.st, row.pr, row.cust)], "id string, st string, pr string, cust string")


def exists(s: SparkSession, d: str) -> DataFrame:
    reader = _reader(s, d)
    return s.createDataFrame([(i, reader.exists(i)) for i in ("00000007", "99999999")], "id string, found boolean")


def append(s: SparkSession, d: str) -> DataFrame:
    reader = _reader(s, d, True)
    return reader.append_filtered_ids(reader.get_filtered_ids(Options([_AF])).df, Options([_STATUS_F]))


def _indexed(*filters, tags: bool = True) -> Callable:
    """IDs through the materialised index: semi- and anti-joins instead of predicates on the entry."""
    return lambda s, d: _reader(s, d, tags, True).get_filtered_ids(Options(list(filters))).df


def cursor_moves(s: SparkSession, d: str) -> DataFrame:
    """A cursor over two filters, each row with the number of the move that gave it."""
    c = _reader(s, d, True).cursor([_STATUS_F, _AF], page=3)
    moves = [c.first, c.next, c.next, c.next, c.prev, lambda: c.seek("::00000500"), c.next, lambda: c.seek_reverse("::00000500"), c.last, c.prev, lambda: c.seek("::99999999")]
    rows = [(i, m()) for i, m in enumerate(moves)]
    return s.createDataFrame([(i, r.id if r else None) for i, r in rows], "move int, id string")


def for_each_rows(s: SparkSession, d: str) -> DataFrame:
    """What a callback saw before it ended the traversal."""
    seen: list[tuple] = []

    def take(entry_id: str, row) -> None:
        if len(seen) == 25:
            raise Break
        seen.append((entry_id, row.pr))

    _reader(s, d).for_each(take, Options([_STATUS_F], reverse=True))
    return s.createDataFrame(seen, "id string, pr string")


def _store(s: SparkSession, d: str, **options) -> Store:
    """A store of its own over the orders, in the shared folder."""
    base = orders(s, d)
    store = Store(s, scratch(s, "store"), base.schema, ORDERS, StoreOptions(**options), clock=lambda: NOW)
    store.transaction(lambda t: t.put_frame(base))
    return store


def store_transactions(s: SparkSession, d: str) -> DataFrame:
    """Frames and single calls mixed, in three commits, of which one fails; read through the store's index."""
    store = _store(s, d)

    def mixed(t: Transaction) -> None:
        t.put("new", {"st": "F", "pr": "9", "cust": "1", "tags": ["ZZ"]})
        t.delete_frame(t.entries.where("pr = '5-LOW'"))
        t.update("00000007", lambda v: v | {"tags": ["ZZ", "AF"]})

    def failing(t: Transaction) -> None:
        t.delete_frame(t.entries)
        raise ValueError("no")

    store.transaction(mixed)
    try:
        store.transaction(failing)
    except ValueError:
        pass
    store.delete("00000007")
    reader = store.reader(use_index=True)
    return reader.plan([InverseMatch("tags", "AF")]).rows().select(F.col("rel_id").alias("rid"), "id")


def store_batches(s: SparkSession, d: str) -> DataFrame:
    """Calls in groups, one of which raises, over an empty store; then what each call was told and what is stored."""

    def fail(_: Transaction) -> None:
        raise ValueError("no")

    schema = events(s, d).schema
    store = Store(s, scratch(s, "store"), schema, EVENTS, StoreOptions(batch_calls=4, retry_batch_fail=True), clock=lambda: NOW)
    calls = [fail if i in (2, 5) else (lambda t, i=i: t.new({"user": str(i), "type": "x"}).id) for i in range(8)]
    told = store.batch(calls)
    found = {r.user: r.id for r in store.reader().entries.collect()}
    rows = [(i, isinstance(x, ValueError), found.get(str(i))) for i, x in enumerate(told)]
    return s.createDataFrame(rows, "call int, failed boolean, id string")


def store_replay(s: SparkSession, d: str) -> DataFrame:
    """A log whose last records no version holds, as after a crash, opened again."""
    store = _store(s, d)
    some = orders(s, d).where("st = 'F'").withColumn("pr", F.lit("X"))
    store.log.append(write_actions(some, JSONEncoder(), F.lit(9), F.lit(None).cast("timestamp")))
    again = Store(s, store.path, store.schema, ORDERS, clock=lambda: NOW)
    return again.reader().entries.select("id", "pr")


def mirror_stream(s: SparkSession, d: str) -> DataFrame:
    """A store's log streamed into a mirror, twice; the second run brings the deletes."""
    store = _store(s, d)
    mirror = Mirror(s, store.log, scratch(s, "mirror"), store.schema)
    mirror.start(once=True).awaitTermination()
    store.transaction(lambda t: t.delete_frame(t.entries.where("st = 'P'")))
    mirror.start(once=True).awaitTermination()
    return mirror.entries().select("id", "st", F.array_join("tags", ",").alias("tags"))


def store_snapshot(s: SparkSession, d: str) -> DataFrame:
    """A store's snapshot loaded by a mirror."""
    store, path = _store(s, d), scratch(s, "snapshot")
    store.snapshot(path)
    mirror = Mirror(s, store.log, scratch(s, "mirror"), store.schema)
    mirror.load_snapshot(s.read.parquet(path))
    return mirror.entries().select("id", "st", "updatedAt")


def take_while(s: SparkSession, d: str) -> DataFrame:
    stop = Comparison("priority", lambda c: c != "1-URGENT", stop_when=lambda c: c.startswith("4"))
    return _pairs(stop)(s, d)


def _event(*filters) -> Callable:
    return lambda s, d: Plan(events(s, d), EVENTS, list(filters)).rows().select("id")



QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_ids": _ids(),
    "get": get,
    "exists": exists,
    "match": _ids(_STATUS_F),
    "match_m2m": _ids(_AF, tags=True),
    "match_empty": _ids(Match("status", "ZZ")),
    "match2": _ids(_STATUS_F, Match("priority", "2-HIGH")),
    "match3": _ids(_STATUS_F, Match("priority", "2-HIGH"), _AF, tags=True),
    "inverse_primary": _pairs(InverseMatch("tags", "AF"), tags=True),
    "inverse_secondary": _ids(_STATUS_F, InverseMatch("tags", "AF"), tags=True),
    "inverse_secondary_unknown": _ids(_STATUS_F, InverseMatch("tags", "ZZ"), tags=True),
    "match_secondary_unknown": _ids(_STATUS_F, Match("tags", "ZZ"), tags=True),
    "inverse_then_match": _pairs(InverseMatch("tags", "AF"), _STATUS_F, tags=True),
    "less_than": _pairs(less_than("priority", "3-MEDIUM")),
    "less_equal": _pairs(less_than_or_equal_to("priority", "3-MEDIUM")),
    "greater": _pairs(greater_than("priority", "3-MEDIUM")),
    "greater_equal": _pairs(greater_than_or_equal_to("priority", "3-MEDIUM")),
    "range": _pairs(in_range("customers", "100", "11")),
    "id_range": _ids(in_range("", "00000010", "00000099")),
    "id_less": _ids(less_than("", "00000100")),
    "id_greater_equal": _ids(greater_than_or_equal_to("", "00014900")),
    "comparison_udf": _pairs(Comparison("priority", lambda c: c.like("%-H%"))),
    "comparison_python": _pairs(Comparison("priority", python=lambda x: "-H" in x)),
    "comparison_m2m": _pairs(Comparison("tags", lambda c: c.endswith("F")), tags=True),
    "comparison_secondary": _ids(_STATUS_F, Comparison("tags", lambda c: c.endswith("F")), tags=True),
    "comparison_secondary_python": _ids(_STATUS_F, Comparison("tags", python=lambda x: x.endswith("F")), tags=True),
    "id_comparison_secondary": _ids(_STATUS_F, less_than("", "00000100")),
    "take_while": take_while,
    "page_forward": _page(greater_than("priority", "1-URGENT"), last_id="2-HIGH::00000500", limit=10),
    "page_reverse": _page(greater_than("priority", "1-URGENT"), last_id="2-HIGH::00000500", limit=10, reverse=True),
    "page_match": _page(_STATUS_F, last_id="::00005000", limit=10),
    "page_unfiltered": _page(last_id="::00005000", limit=10),
    "first_comparison": _page(greater_than("priority", "2"), limit=1),
    "last_inverse": _page(InverseMatch("tags", "RF"), limit=1, reverse=True, tags=True),
    "limit_zero": _page(_STATUS_F, limit=0),
    "seek": _seek(False),
    "seek_reverse": _seek(True),
    "append": append,
    "ranked_order": ranked_order,
    "put": put_state,
    "update": update_state,
    "delete": delete_state,
    "new": new_state,
    "index_delta": index_delta,
    "reindex_counts": reindex_counts,
    "batch_fold": store_batches,
    "log_state": log_state,
    "mirror_state": mirror_state,
    "action_types": action_types,
    "snapshot": snapshot_rows,
    "rebuild": rebuild,
    "next_index": next_index,
    "id_numbers": id_numbers,
    "json_roundtrip": _coded(JSONEncoder()),
    "aes_roundtrip": _coded(EncryptedJSONEncoder(bytes(range(32)))),
    "aes_reads_plain": _coded(EncryptedJSONEncoder(bytes(range(16))), JSONEncoder()),
    "index_match": _indexed(_STATUS_F, _AF),
    "index_inverse": _indexed(_STATUS_F, InverseMatch("tags", "AF")),
    "index_comparison": _indexed(greater_than("priority", "3"), Match("tags", "AF"), less_than("", "00009000")),
    "cursor_moves": cursor_moves,
    "for_each": for_each_rows,
    "store_transactions": store_transactions,
    "store_replay": store_replay,
    "store_snapshot": store_snapshot,
    "mirror_stream": mirror_stream,
    "events_by_type": _event(Match("types", "error")),
    "events_not_type": _event(Match("types", "click"), InverseMatch("users", "1")),
}

_BASE = """with e as (select lpad(cast(o_orderkey as varchar), 8, '0') as id, o_orderkey as k, cast(o_custkey as varchar) as cust, o_orderstatus as st, o_orderpriority as pr from orders),
r as (select 'status' as rk, st as rid, id from e union all select 'priority', pr, id from e union all select 'customers', cust, id from e
union all select distinct 'tags', concat(l_returnflag, l_linestatus), e.id from lineitem join e on l_orderkey = e.k)
"""
_LOG = """with w as (select event_id as seq, cast(user_id as varchar) as key, event_type as value, row_number() over (partition by user_id order by event_id desc) as n from events)
select key, seq, value from w where n = 1 and value <> 'error'"""


def _rel(key: str, where: str, cols: str = "rid, id") -> str:
    return f"{_BASE}select {cols} from r where rk = '{key}' and {where}"


def _with(key: str, where: str) -> str:
    return f"exists (select 1 from r x where x.id = p.id and x.rk = '{key}' and {where})"


def _status_f(more: str) -> str:
    return f"{_BASE}select id from r p where rk = 'status' and rid = 'F' and {more}"


_PUT = "case when o_custkey <= 50 then {} else {} end"

SQL: dict[str, str] = {
    "scan_ids": f"{_BASE}select id from e",
    "get": f"{_BASE}select id, st, pr, cust from e where id = '00000007'",
    "exists": f"{_BASE}select a.id, e.id is not null as found from (values ('00000007'), ('99999999')) a(id) left join e on a.id = e.id",
    "match": _rel("status", "rid = 'F'", "id"),
    "match_m2m": _rel("tags", "rid = 'AF'", "id"),
    "match_empty": _rel("status", "rid = 'ZZ'", "id"),
    "match2": _status_f(_with("priority", "x.rid = '2-HIGH'")),
    "match3": _status_f(_with("priority", "x.rid = '2-HIGH'") + " and " + _with("tags", "x.rid = 'AF'")),
    "inverse_primary": _rel("tags", "rid <> 'AF'"),
    "inverse_secondary": _status_f("not " + _with("tags", "x.rid = 'AF'")),
    "inverse_secondary_unknown": _status_f("not " + _with("tags", "x.rid = 'ZZ'")),
    "match_secondary_unknown": _status_f(_with("tags", "x.rid = 'ZZ'")),
    "inverse_then_match": f"{_BASE}select r.rid, r.id from r join e on e.id = r.id where r.rk = 'tags' and r.rid <> 'AF' and e.st = 'F'",
    "less_than": _rel("priority", "rid < '3-MEDIUM'"),
    "less_equal": _rel("priority", "rid <= '3-MEDIUM'"),
    "greater": _rel("priority", "rid > '3-MEDIUM'"),
    "greater_equal": _rel("priority", "rid >= '3-MEDIUM'"),
    "range": _rel("customers", "rid between '100' and '11'"),
    "id_range": f"{_BASE}select id from e where id between '00000010' and '00000099'",
    "id_less": f"{_BASE}select id from e where id < '00000100'",
    "id_greater_equal": f"{_BASE}select id from e where id >= '00014900'",
    "comparison_udf": _rel("priority", "rid like '%-H%'"),
    "comparison_python": _rel("priority", "rid like '%-H%'"),
    "comparison_m2m": _rel("tags", "rid like '%F'"),
    "comparison_secondary": _status_f(_with("tags", "x.rid like '%F'")),
    "comparison_secondary_python": _status_f(_with("tags", "x.rid like '%F'")),
    "id_comparison_secondary": _status_f("id < '00000100'"),
    "take_while": _rel("priority", "rid <> '1-URGENT' and rid < '4'"),
    "page_forward": _rel("priority", "rid > '1-URGENT' and (rid > '2-HIGH' or (rid = '2-HIGH' and id > '00000500')) order by rid, id limit 10"),
    "page_reverse": _rel("priority", "rid > '1-URGENT' and (rid < '2-HIGH' or (rid = '2-HIGH' and id < '00000500')) order by rid desc, id desc limit 10"),
    "page_match": _rel("status", "rid = 'F' and id > '00005000' order by id limit 10", "'' as rid, id"),
    "page_unfiltered": f"{_BASE}select '' as rid, id from e where id > '00005000' order by id limit 10",
    "first_comparison": _rel("priority", "rid > '2' order by rid, id limit 1"),
    "last_inverse": _rel("tags", "rid <> 'RF' order by rid desc, id desc limit 1"),
    "limit_zero": _rel("status", "false", "'' as rid, id"),
    "seek": _rel("status", "rid = 'F' and id >= '00005000' order by id limit 1", "id"),
    "seek_reverse": _rel("status", "rid = 'F' and id <= '00005000' order by id desc limit 1", "id"),
    "append": f"{_BASE}select id from r where rk = 'tags' and rid = 'AF' union all select id from r where rk = 'status' and rid = 'F'",
    "ranked_order": _rel("priority", "rid <> '2-HIGH'", "rid, id, row_number() over (order by rid, id) as rank"),
    "put": f"select lpad(cast(o_orderkey as varchar), 8, '0') as id, {_PUT.format(chr(39) + 'X' + chr(39), 'o_orderpriority')} as pr, cast({_PUT.format(NOW, 0)} as bigint) as \"createdAt\", cast({_PUT.format(NOW, 0)} as bigint) as \"updatedAt\" from orders",
    "update": f"{_BASE}select id, case when st = 'F' then 'DONE' else st end as st, cast(case when st = 'F' then {NOW} else 0 end as bigint) as \"updatedAt\" from e",
    "delete": f"{_BASE}select id, st from e where id >= '00000100'",
    "new": "select lpad(cast(499 + row_number() over (order by o_custkey, o_orderkey) as varchar), 8, '0') as id, o_custkey, o_orderkey, o_orderstatus, o_totalprice from orders",
    "index_delta": f"{_BASE}select 'priority' as rel_key, x.rid as rel_id, id as entry_id, x.change from e, (values ('add'), ('remove')) c(change), lateral (select case when c.change = 'add' then 'X' else pr end as rid, c.change as change) x where cast(cust as int) <= 50",
    "reindex_counts": f"{_BASE}select rk, rid, count(*) as n from r group by rk, rid",
    "batch_fold": "select cast(i as int) as call, i in (2, 5) as failed, case when i not in (2, 5) then lpad(cast(i - cast(i > 2 as int) - cast(i > 5 as int) as varchar), 8, '0') end as id from range(8) t(i)",
    "log_state": _LOG,
    "mirror_state": _LOG,
    "action_types": "select case when event_type = 'error' then 'delete' else 'write' end as name, count(*) as n from events group by 1",
    "snapshot": f"{_BASE}select id as key, 1 as type, pr from e",
    "rebuild": f"{_BASE}select id, st, cust from e",
    "next_index": "select max(o_orderkey) + 1 as current_index from orders",
    "id_numbers": f"{_BASE}select id, ltrim(id, '0') as stripped, k as number from e",
    "json_roundtrip": f"{_BASE}select id, st, pr, cust from e",
    "aes_roundtrip": f"{_BASE}select id, st, pr, cust from e",
    "aes_reads_plain": f"{_BASE}select id, st, pr, cust from e",
    "index_match": _status_f(_with("tags", "x.rid = 'AF'")),
    "index_inverse": _status_f("not " + _with("tags", "x.rid = 'AF'")),
    "index_comparison": f"{_BASE}select e.id from e join r on r.id = e.id where e.pr > '3' and r.rk = 'tags' and r.rid = 'AF' and e.id < '00009000'",
    "cursor_moves": f"""{_BASE}, m as (select e.id, row_number() over (order by e.id) as n, row_number() over (order by e.id desc) as back from e join r on r.id = e.id where e.st = 'F' and r.rk = 'tags' and r.rid = 'AF'),
lo as (select min(n) as n from m where id >= '00000500'), hi as (select max(n) as n from m where id <= '00000500')
select cast(move as int) as move, (select id from m where (k = 'n' and m.n = v) or (k = 'b' and m.back = v) or (k = 'u' and m.n = (select n from lo) + v) or (k = 'd' and m.n = (select n from hi))) as id
from (values (0, 'n', 1), (1, 'n', 2), (2, 'n', 3), (3, 'n', 4), (4, 'n', 3), (5, 'u', 0), (6, 'u', 1), (7, 'd', 0), (8, 'b', 1), (9, 'b', 2), (10, 'none', 0)) x(move, k, v)""",
    "for_each": f"{_BASE}select id, pr from e where st = 'F' order by id desc limit 25",
    "store_transactions": f"""{_BASE}select rid, r.id from r join e on e.id = r.id where rk = 'tags' and rid <> 'AF' and pr <> '5-LOW' and r.id <> '00000007' union all select 'ZZ', 'new'""",
    "store_replay": f"{_BASE}select id, case when st = 'F' then 'X' else pr end as pr from e",
    "store_snapshot": f"{_BASE}select id, st, cast({NOW} as bigint) as \"updatedAt\" from e",
    "mirror_stream": f"{_BASE}, t as (select id, string_agg(rid, ',' order by rid) as tags from r where rk = 'tags' group by id) select e.id, st, tags from e left join t on t.id = e.id where st <> 'P'",
    "events_by_type": "select lpad(cast(event_id as varchar), 8, '0') as id from events where event_type = 'error'",
    "events_not_type": "select lpad(cast(event_id as varchar), 8, '0') as id from events where event_type = 'click' and user_id <> 1",
}
