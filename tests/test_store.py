"""Writes, versions, log, mirror and encoders."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane import Context, Match, Options, RelationshipSpec, Store, StoreOptions
from corvane.errors import BatchSiblingFailed, Cancelled, EmptyEntryID, EntryNotFound, InvalidKeyLength, MirrorIsReadOnly, StoreClosed
from corvane.functions.encoders import EncryptedJSONEncoder, JSONEncoder
from corvane.operators import writes
from corvane.sources.changelog import ChangeLog
from corvane.sources.storage import MOST_CHANGES, Storage
from corvane.store import ReadWrapper, Wrapper, WriteWrapper
from corvane.streaming.mirror import MOST_PARTS, Mirror

SCHEMA = T.StructType().add("id", "string").add("createdAt", "long").add("updatedAt", "long").add("userID", "string").add("tags", T.ArrayType(T.StringType())).add("value", "string")
SPEC = RelationshipSpec({"users": "userID", "tags": "tags"})


def counts(store, *tags):
    return [store.reader(use_index=True).lookup("tags", t).count() for t in tags]


def test_life_of_a_store(spark, tmp_path):
    store = Store(spark, str(tmp_path), SCHEMA, SPEC, clock=lambda: 100)
    store.transaction(lambda t: [t.new({"userID": "user_1", "tags": tags, "value": "v"}) for tags in (["foo", "bar"], ["bar"], ["baz"])])
    assert counts(store, "foo", "bar", "baz", "beam") == [1, 2, 1, 0]
    page = store.reader().get_filtered(Options([Match("users", "user_1")], limit=2))
    assert [r.id for r in page.df.collect()] == ["00000000", "00000001"] and page.last_id == "::00000001"
    store.transaction(lambda t: [t.update(f"{i:08d}", lambda v: v | {"tags": ["boom"]}) for i in range(3)])
    assert counts(store, "foo", "boom") == [0, 3]
    with pytest.raises(EntryNotFound):
        store.update("7", lambda v: v)
    with pytest.raises(EmptyEntryID):
        store.put("", {})
    store.put("x", {"userID": "u", "tags": [], "value": "w"})
    assert store.delete("00000001").userID == "user_1"
    with pytest.raises(EntryNotFound):
        store.delete("00000001")
    assert sorted(r.id for r in store.rebuilt().collect()) == ["00000000", "00000002", "x"]
    again = Store(spark, str(tmp_path), SCHEMA, SPEC, clock=lambda: 200)
    assert again.new({"userID": "u", "tags": [], "value": ""}).id == "00000003"
    before = sorted(map(str, again.reader(use_index=True).index.select("rel_key", "rel_id", "entry_id").collect()))
    again.reindex()
    assert before == sorted(map(str, again.reader(use_index=True).index.select("rel_key", "rel_id", "entry_id").collect()))
    mirror = Mirror(spark, ChangeLog(spark, f"{tmp_path}/log"), f"{tmp_path}/mirror", SCHEMA)
    for _ in range(2):
        mirror.start(once=True).awaitTermination()
    same = ["id", "userID", "tags", "updatedAt"]
    assert sorted(map(str, mirror.entries().select(*same).collect())) == sorted(map(str, again.reader().entries.select(*same).collect()))
    again.snapshot(f"{tmp_path}/snap")
    mirror.load_snapshot(spark.read.parquet(f"{tmp_path}/snap"))
    assert mirror.entries().count() == 4
    again.close()
    with pytest.raises(StoreClosed):
        again.reader()


def test_batches(spark, tmp_path):
    store = Store(spark, str(tmp_path), SCHEMA, SPEC, StoreOptions(retry_batch_fail=True))

    def fail(_):
        raise ValueError("no")

    got = store.batch([lambda t: t.put("a", {}).id, fail, lambda t: t.put("b", {}).id])
    assert got[0] == "a" and isinstance(got[1], ValueError) and got[2] == "b"
    assert store.reader().entries.count() == 2
    with pytest.raises(MirrorIsReadOnly):
        Store(spark, str(tmp_path), SCHEMA, SPEC, StoreOptions(is_mirror=True)).new({})


@pytest.mark.parametrize("size", [16, 24, 32])
def test_encrypted_values(spark, size):
    value = spark.createDataFrame([(1, "bar")], "foo int, bar string")
    one, plain = EncryptedJSONEncoder(b"k" * size), JSONEncoder()
    coded = value.select(one.encode(F.struct("foo", "bar")).alias("v"), plain.encode(F.struct("foo", "bar")).alias("p"))
    assert len(coded.first().v) == len(coded.first().p) + 28
    assert tuple(coded.select(one.decode(F.col("v"), value.schema).alias("x")).first().x) == (1, "bar")
    assert tuple(coded.select(one.decode(F.col("p"), value.schema).alias("x")).first().x) == (1, "bar")
    other = EncryptedJSONEncoder(b"z" * size)
    with pytest.raises(Exception, match="neither"):
        coded.select(other.decode(F.col("v"), value.schema).alias("x")).collect()


@pytest.mark.parametrize("size", [0, 15, 33])
def test_key_sizes(size):
    with pytest.raises(InvalidKeyLength):
        EncryptedJSONEncoder(b"k" * size)


def ids(store):
    return sorted(r.id for r in store.reader().entries.select("id").collect())


def logged(store):
    return sorted(r.id for r in store.rebuilt().select("id").collect())


def test_mixed_writes_are_all_logged(spark, tmp_path):
    """Single calls before and after frames; log, index and entries agree, and commits hold changes only."""
    store = Store(spark, str(tmp_path), SCHEMA, SPEC, clock=lambda: 5)
    frame = spark.createDataFrame([("b", 0, 0, "u", ["t"], "w"), ("c", 3, 0, "u", [], "w")], SCHEMA)

    def mixed(t):
        t.put("a", {"userID": "u", "tags": ["t"]})
        t.put_frame(frame)
        t.put("d", {"tags": ["t"]})
        t.delete_frame(spark.createDataFrame([("c",), ("never",)], "id string"))
        t.update("b", lambda v: v | {"value": "last"})
        assert t.get_filtered_ids(Options([Match("tags", "t")])).df.count() == 3 and t.exists("b") and not t.exists("c")

    store.transaction(mixed)
    assert ids(store) == logged(store) == ["a", "b", "d"] and store.reader().get("b").value == "last" and store.reader().get("b").createdAt == 5
    assert counts(store, "t") == [3] and store.storage.meta(store.storage.version())["changes"] == [1]
    for i in range(MOST_CHANGES + 2):
        store.put("e", {"value": str(i), "tags": ["t"] if i % 2 else []})
    meta = store.storage.meta(store.storage.version())
    assert 1 <= len(meta["changes"]) < MOST_CHANGES and ids(store) == logged(store) and counts(store, "t") == [4]
    store.storage.vacuum(1)
    assert ids(store) == ["a", "b", "d", "e"]


def test_crash_between_log_and_commit(spark, tmp_path):
    store = Store(spark, str(tmp_path), SCHEMA, SPEC)
    store.put("a", {"value": "1"})
    finish, store.storage.finish = store.storage.finish, lambda *_: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        store.transaction(lambda t: [t.put("00000041", {"value": "2"}), t.delete("a")])
    seen = []
    again = Store(spark, str(tmp_path), SCHEMA, SPEC, StoreOptions(on_import=lambda kind, rows: seen.append((kind, rows.count()))))
    assert ids(again) == logged(again) == ["00000041"] and seen == [("log", 2)]
    assert again.new({}).id == "00000042"
    assert ids(Store(spark, str(tmp_path), SCHEMA, SPEC)) == ["00000041", "00000042"]


def test_three_ways_to_start(spark, tmp_path):
    import shutil

    store = Store(spark, f"{tmp_path}/s", SCHEMA, SPEC)
    store.batch([lambda t: t.new({"value": "x"}), lambda t: t.new({"value": "y"})])
    shutil.rmtree(tmp_path / "s" / "data")
    again = Store(spark, f"{tmp_path}/s", SCHEMA, SPEC)
    assert ids(again) == ["00000000", "00000001"] and again.new({}).id == "00000002"
    shutil.rmtree(tmp_path / "s" / "log")
    again = Store(spark, f"{tmp_path}/s", SCHEMA, SPEC)
    assert logged(again) == ["00000000", "00000001", "00000002"] and again.new({}).id == "00000003"
    assert ids(Store(spark, f"{tmp_path}/none", SCHEMA, SPEC)) == []


def test_source_storage_and_log_are_options(spark, tmp_path):
    first = Store(spark, f"{tmp_path}/first", SCHEMA, SPEC)
    first.batch([lambda t: t.put("a", {}), lambda t: t.put("b", {})])
    made = []

    def storage(*args):
        made.append(args)
        return Storage(*args)

    options = StoreOptions(source=first.log, storage=storage, log=lambda s, p: ChangeLog(s, f"{p}-own"))
    assert ids(Store(spark, f"{tmp_path}/second", SCHEMA, SPEC, options)) == ["a", "b"] and len(made) == 1
    first.delete("a")
    second = Store(spark, f"{tmp_path}/second", SCHEMA, SPEC, options)
    assert ids(second) == logged(second) == ["b"] and (tmp_path / "second" / "log-own").exists()


def test_cancellation(spark, tmp_path):
    import threading
    import time

    store, context = Store(spark, str(tmp_path), SCHEMA, SPEC), Context()

    def cancelled(t):
        t.put("a", {})
        context.cancel()
        t.put("b", {})

    with pytest.raises(Cancelled):
        store.transaction(cancelled, context)
    with pytest.raises(Cancelled):
        store.read_transaction(lambda r: r.exists("a"), context)
    with pytest.raises(Cancelled):
        store.transaction(lambda t: [t.put("a", {}), time.sleep(0.3)], Context(seconds=0.1))
    assert ids(store) == []
    slow, other = spark.range(4).repartition(4), Context()
    nap = F.udf(lambda x: time.sleep(20) or x, "long")
    threading.Timer(2, other.cancel).start()
    began = time.time()
    with pytest.raises(Cancelled):
        store.read_transaction(lambda r: slow.select(nap("id").alias("x")).write.format("noop").mode("overwrite").save(), other)
    assert time.time() - began < 15


def test_batches_by_time_and_failures(spark, tmp_path):
    store = Store(spark, str(tmp_path), SCHEMA, SPEC, StoreOptions(batch_seconds=0.05))

    def fail(_):
        raise ValueError("no")

    b = store.batcher()
    assert b.add(lambda t: t.put("a", {}).id).result(timeout=60) == "a"  # nobody flushes but the timer
    assert ids(store) == ["a"]
    gone = Context()
    gone.cancel()
    with store.batcher() as b:
        b._timed = False
        got = [b.add(lambda t: t.put("b", {})), b.add(fail), b.add(lambda t: t.put("c", {})), b.add(lambda t: t.put("d", {}), gone), b.add(lambda t: t.put("e", {}).id)]
    assert [type(f.exception()) for f in got] == [BatchSiblingFailed, ValueError, BatchSiblingFailed, Cancelled, type(None)]
    assert ids(store) == ["a", "e"] and len(b.results) == 5


def test_wrappers(spark, tmp_path):
    store = Store(spark, str(tmp_path), SCHEMA, SPEC)
    WriteWrapper(store).put("a", {"value": "v"})
    assert ReadWrapper(store).get("a").value == "v" and Wrapper(store).exists("a") and Wrapper(store).new({}).id == "00000000"
    for wrapper, name in ((ReadWrapper(store), "put"), (WriteWrapper(store), "get"), (Wrapper(store), "reindex")):
        with pytest.raises(AttributeError):
            getattr(wrapper, name)


def test_bulk_numbers_are_unique_and_gapless(spark):
    values = spark.range(0, 400_000, 1, 7).select((F.col("id") * 7919 % 400_009).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("pay"), F.rand(3).alias("r"))
    got = writes.number(values, 10, ["k"]).select("id", "k").toPandas().sort_values("k")
    assert got.id.tolist() == [f"{i + 10:08d}" for i in range(400_000)]
    assert writes.number(values.limit(0), 0, ["k"]).count() == 0
    few = writes.number(spark.createDataFrame([(None, 1), ("a", 1), ("a", 2)], "k string, v int"), 0, ["k"]).collect()
    assert sorted(r.id for r in few) == ["00000000", "00000001", "00000002"]


def test_mirror_parts(spark, tmp_path):
    """Micro-batches are parts of the state; a whole one replaces what came before."""
    rows = [(i, None, 2 if i % 5 == 0 else 1, f"k{i % 7}", None) for i in range(1, 41)]
    log = spark.createDataFrame(rows, writes.LOG_SCHEMA)
    told = []
    mirror = Mirror(spark, ChangeLog(spark, f"{tmp_path}/log"), f"{tmp_path}/m", SCHEMA, on_import=lambda kind, _: told.append(kind))
    for at in range(0, 40, 2):
        mirror.apply(log.where((F.col("seq") > at) & (F.col("seq") <= at + 2)))
        mirror.apply(log.where(F.col("seq") == at + 1))
    want = sorted((r.key, r.seq, r.type) for r in writes.fold(log).collect())
    assert sorted((r.key, r.seq, r.type) for r in mirror.state().collect()) == want and len(mirror._parts()) <= MOST_PARTS
    mirror.load_snapshot(log.where("seq = 1"))
    assert [r.key for r in mirror.state().collect()] == ["k1"] and told[-1] == "snapshot" and told[0] == "log"
