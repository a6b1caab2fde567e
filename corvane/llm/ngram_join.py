"""Exact Jaccard self-join of word shingle sets by set-relation skipping.

Index: every set lists its rarest shingles, as many as any partner must share one of (prefix filter); rarity comes from a
count sketch of all shingles, and any order is exact. An entry far down a set's order can only meet smaller sets, so lists
without an entry near the top are dropped when they are built; the rest is skipped in blocks of neighbouring positions
whose best possible overlap falls short.

Answers: equal sets are one set, and of lists of the same sets one is kept. Members of a list are compared with its leader
first, then with their likeliest partner, and only pairs across the components so found are compared with each other. Contents are read for sets alone that signatures leave in a pair. How many links
each set has is derived from one hub of its component: with each set's differences from the hub known, the overlap of any
two sets is the hub's size, less what either lacks, plus what their differences share. Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, maybe_in, resting, slices
from .common import stage_thin as stage
from .components import connected_components
from .shingles import set_id, sets_of

#: Words in a shingle and least Jaccard similarity of op1, which its contract fixes.
WIDTH, PERCENT = 4, 85
#: Counters of the shingle sketch (a power of two), counters in a piece of it, and bits of a set's parity signature.
SKETCH, PIECE, SIGNATURE = 1 << 20, 1 << 16, 1024
#: List entries of one shingle that share a leader; longer lists are salted. Positions in a block to skip, entries in a block to compare.
SALT, POSITIONS, BLOCK = 50_000, 8, 1024
#: Rounds of likeliest partners end when one takes less than 1 / FALL of the pairs across components and links less than 1 / FEW as many
#: as there are list entries, or all rounds after so many; then all pairs across components are compared.
FALL, FEW, ROUNDS = 16, 1000, 16
#: Texts and candidate pairs that are worked on at once.
TEXTS, CHUNK = 512, 1 << 18
#: Differing shingles in a block whose links are counted, and columns of them that are multiplied out at once.
SHINGLES, COLUMNS = 1 << 19, 4096
#: A set that holds more than this share of all rows is hot; there are at most 1 / HOT of them, so they are broadcast.
HOT = 1e-3


def _sum_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up pieces of counters: a few fixed-size arrays, however many rows come."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for piece, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            counts = np.frombuffer(zstandard.decompress(data), np.uint64)
            total[piece] = total[piece] + counts if piece in total else counts
    yield _pieces(total)


def _pieces(total: dict[int, np.ndarray]) -> pa.RecordBatch:
    packed = [zstandard.compress(c.astype(np.uint64).tobytes(), 1) for c in total.values()]
    return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array(packed, pa.binary())], ["piece", "data"])


def _summed(pieces: DataFrame) -> np.ndarray:
    """The counters as one array of SKETCH numbers, which does not grow with the data."""
    kind = "piece int, data binary"
    some = pieces.repartition(32).mapInArrow(_sum_pieces, kind).repartition(SKETCH // PIECE, "piece").mapInArrow(_sum_pieces, kind)
    out = np.zeros(SKETCH, np.uint64)
    for r in some.collect():
        out[r.piece * PIECE : (r.piece + 1) * PIECE] += np.frombuffer(zstandard.decompress(r.data), np.uint64)
    return out


def _split(counts: np.ndarray) -> dict[int, np.ndarray]:
    return {i: counts[i * PIECE : (i + 1) * PIECE] for i in range(SKETCH // PIECE)}


def _counter(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(SKETCH - 1)).astype(np.int64)


def _signature(s: np.ndarray) -> list[int]:
    """Parity of the set's members in each of SIGNATURE cells; bits that differ bound the symmetric difference from below."""
    odd = np.bincount(((s >> np.uint64(24)) & np.uint64(SIGNATURE - 1)).astype(np.int64), minlength=SIGNATURE) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _scan(docs: DataFrame, width: int) -> DataFrame:
    """One pass: a row a document (n, set_id, sig) and, from each task, its shingle counts."""
    names = ["doc_id", "n", "set_id", "sig", "piece", "data"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.uint64)
        for b in batches:
            n, ids, sigs = [], [], []
            for texts in slices(b.column(1), TEXTS):
                sets = list(sets_of(texts, width))
                n += map(len, sets)
                ids += map(set_id, sets)
                sigs += [_signature(s) if len(s) else None for s in sets]
                counts += np.bincount(_counter(np.concatenate(sets)), minlength=SKETCH).astype(np.uint64)
            none = [pa.nulls(len(n)).cast(k) for k in kinds[4:]]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip((n, ids, sigs), kinds[1:4], strict=True)], *none], names)
        p = _pieces(_split(counts))
        yield pa.RecordBatch.from_arrays([*[pa.nulls(p.num_rows).cast(k) for k in kinds[:4]], p.column(0), p.column(1)], names)

    return docs.select("doc_id", "text").mapInArrow(resting(run), "doc_id bigint, n bigint, set_id bigint, sig array<bigint>, piece int, data binary")


def least_overlap(a: Column, b: Column, percent: int) -> Column:
    """Shared shingles that two sets of these sizes need."""
    return F.ceil((a + b) * percent / (100 + percent) - 1e-9)


def _may_pair(n: Column, pos: Column, m: Column, at: Column, percent: int) -> Column:
    """Whether sets of sizes n and m can link if their first common shingle has these positions."""
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (F.least(n - pos, m - at) >= least_overlap(n, m, percent))


def _postings(docs: DataFrame, counts: np.ndarray, width: int, percent: int) -> DataFrame:
    """(token, salt, set_id, n, pos): the prefix of each set, once a task."""
    # a global order needs no exact counts: their logarithm in 16 bits sorts faster
    rarity = np.minimum(np.log2(counts.astype(np.float64) + 1) * 1024, 65535).astype(np.uint16)
    held, mean = docs.sparkSession.sparkContext.broadcast(rarity), int(counts.mean())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = held.value, set()
        for b in batches:
            for texts in slices(b.column(0), TEXTS):
                cols: list[list[np.ndarray]] = [[], [], [], [], []]
                for s in sets_of(texts, width):
                    if not len(s) or (one := set_id(s)) in seen:
                        continue
                    seen.add(one)
                    n = len(s)
                    k = n - (percent * n + 99) // 100 + 1
                    c = order[_counter(s)]
                    rare = np.argsort(c, kind="stable")[:k]  # s is sorted, so ties go by hash
                    salts = 1 + np.maximum(np.exp2(c[rare] / 1024) - 2 * mean, 0).astype(np.int64) // SALT
                    cols[0].append(s[rare].view(np.int64))
                    cols[1].append(np.where(salts > 1, one % salts, -1))
                    cols[2].append(np.full(k, one, np.int64))
                    cols[3].append(np.full(k, n, np.int32))
                    cols[4].append(np.arange(k, dtype=np.int32))
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["token", "salt", "set_id", "n", "pos"])

    return docs.select("text").mapInArrow(resting(run), "token bigint, salt bigint, set_id bigint, n int, pos int")


def _lists(postings: DataFrame, percent: int) -> DataFrame:
    """Lists that can hold a pair. In a pair's first common shingle the smaller set's entry lies so near the top that it could
    meet an equal set; entries that could not need such a one of fitting size in their list. Salted lists stay whole."""
    w = Window.partitionBy("token", "salt")
    n, pos = F.col("n"), F.col("pos")
    top = n - pos >= least_overlap(n, n, percent)
    seen = {"_low": F.min("set_id").over(w), "_high": F.max("set_id").over(w), "_small": F.min(F.when(top, n)).over(w), "_large": F.max(F.when(top, n)).over(w)}
    fits = (F.col("_low") != F.col("_high")) & F.col("_small").isNotNull() & (top | ((F.col("_small") <= n) & (100 * F.col("_large") >= percent * n)))
    return postings.withColumns(seen).where(fits | (F.col("salt") >= 0)).drop(*seen).dropDuplicates(["token", "set_id"])


def _first_of_equal(lists: DataFrame) -> DataFrame:
    """Of lists of the same sets only the one that comes first in the order of rarity, which all its sets share: no pair has its
    first common shingle in another. Near copies share most of their lists. Lists are taken as equal by 128 bits and their length."""
    key = [F.bit_xor(F.xxhash64("set_id", F.lit(i))).alias(f"_h{i}") for i in (1, 2)]
    by = lists.groupBy("token").agg(*key, F.count(F.lit(1)).alias("_m"), F.sum(F.col("pos").cast("bigint")).alias("_at"))
    kept = by.groupBy("_h1", "_h2", "_m").agg(F.min_by("token", "_at").alias("token")).select("token")
    return lists.join(kept, "token", "left_semi")


def _contents(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(set_id, hashes) of the wanted sets (set_id, rep), read again from the documents that represent them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for texts in slices(b.column(0), TEXTS):
                sets = [s for s in sets_of(texts, width) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array(map(set_id, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["set_id", "hashes"])

    found = maybe_in(docs, "doc_id", wanted.select("rep")).select("text").mapInArrow(resting(run), "set_id bigint, hashes binary")
    return found.join(wanted.select("set_id"), "set_id", "left_semi").dropDuplicates(["set_id"])


def _near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and signatures leave, with the documents that represent them."""
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("set_id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("n", "sig", "rep")]), side)
    bits = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    na, nb = F.col("n_a"), F.col("n_b")
    fits = (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (bits <= na + nb - 2 * least_overlap(na, nb, percent))
    return pairs.where(fits).select("a", "b", "rep_a", "rep_b")


def _verified(near: DataFrame, contents: DataFrame, percent: int) -> DataFrame:
    """Of the pairs those that link, as pairs of representing documents."""
    whole = near
    for side in "ab":
        whole = whole.join(contents.select(F.col("set_id").alias(side), F.col("hashes").alias(f"h_{side}")), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(u, v, assume_unique=True))
                ok.append(100 * shared >= percent * (len(u) + len(v) - shared))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return whole.select("rep_a", "rep_b", "h_a", "h_b").mapInArrow(resting(run), "a bigint, b bigint")


def _leader_pairs(entries: DataFrame, turn: int, percent: int) -> DataFrame:
    """Each entry with its list's leader, where these are not one component yet."""
    key = F.struct(F.xxhash64("set_id", F.lit(turn)).alias("h"), "set_id", "n", "pos", "comp")
    led = entries.withColumn("lead", F.min(key).over(Window.partitionBy("token", "salt")))
    led = led.where((F.col("lead.comp") != F.col("comp")) & _may_pair(F.col("n"), F.col("pos"), F.col("lead.n"), F.col("lead.pos"), percent))
    return led.select(F.least("set_id", "lead.set_id").alias("a"), F.greatest("set_id", "lead.set_id").alias("b")).distinct()


def _units(entries: DataFrame, sets: DataFrame) -> DataFrame:
    """Lists with several components, cut into blocks of about BLOCK entries; a unit (token, u, v) holds two blocks, or one with itself.
    Signatures are folded to half their cells, which is a signature again."""
    open_lists = entries.groupBy("token").agg(F.min("comp").alias("_c0"), F.max("comp").alias("_c1"), F.count(F.lit(1)).alias("_m")).where("_c0 <> _c1")
    half = SIGNATURE // 128
    sig = F.zip_with(F.slice("sig", 1, half), F.slice("sig", half + 1, half), lambda x, y: x.bitwiseXOR(y)).alias("sig")
    rows = entries.join(open_lists.select("token", "_m"), "token").join(sets.select("set_id", sig), "set_id")
    blocks = F.ceil(F.col("_m") / BLOCK).cast("int")
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("set_id", F.lit(9)), blocks).cast("int")).withColumn("_j", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.select("token", F.least("blk", "_j").alias("u"), F.greatest("blk", "_j").alias("v"), "blk", "set_id", "n", "pos", "comp", "sig")


def _expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i the numbers first[i] .. first[i] + count[i] - 1: (i, number)."""
    i = np.repeat(np.arange(len(count)), count)
    return i, first[i] + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)


def _compare(col: dict[str, np.ndarray], nearest: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) across components within whole units, which sizes, positions and signatures leave; with ``nearest`` only the
    likeliest partner of each entry. Entries lie in blocks of neighbouring positions, and an entry skips all blocks whose sizes
    or longest remainder do not suffice."""
    unit = np.cumsum(np.r_[False, np.logical_or.reduce([np.diff(col[k]) != 0 for k in ("token", "u", "v")])])
    one, left = col["u"] == col["v"], col["blk"] == col["u"]
    side = np.where(one | left, 0, 1)
    order = np.lexsort((col["n"], col["pos"] // POSITIONS, side, unit))
    unit, one, side = unit[order], one[order], side[order]
    ids, n, pos, comp = (col[k][order] for k in ("set_id", "n", "pos", "comp"))
    sig = col["sig"][order]
    rest, group = n - pos, 2 * unit + side
    new = np.r_[True, (np.diff(group) != 0) | (np.diff(pos // POSITIONS) != 0)]
    start = np.flatnonzero(new)
    size = np.diff(np.r_[start, len(ids)])
    best, low, high = (f.reduceat(v, start) for f, v in ((np.maximum, rest), (np.minimum, n), (np.maximum, n)))
    # blocks of each group: in a unit of one block its own, else the other side's for each entry on the left
    block_group = group[start]
    x = np.arange(len(ids)) if nearest else np.flatnonzero(one | (side == 0))
    other = np.where(one, group, group ^ 1)[x]
    first = np.searchsorted(block_group, other)
    i, block = _expand(first, np.searchsorted(block_group, other, "right") - first)
    x = x[i]
    least = -(-percent * n[x] // 100)
    fit = (best[block] >= least) & (rest[x] >= least) & (100 * high[block] >= percent * n[x]) & (100 * n[x] >= percent * low[block])
    if not nearest:  # each pair once: from the entry that comes first
        fit &= ~one[x] | (start[block] + size[block] - 1 > x)
    x, block = x[fit], block[fit]
    firsts, seconds, rooms = [], [], []
    upto = np.cumsum(size[block])
    at = 0
    while at < len(x):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHUNK, "right")))
        i, q = _expand(start[block[at:to]], size[block[at:to]])
        p = x[at:to][i]
        at = to
        a, b = n[p], n[q]
        need = -(-percent * (a + b) // (100 + percent))
        ok = (comp[p] != comp[q]) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (np.minimum(rest[p], rest[q]) >= need)
        if not nearest:
            ok &= ~one[p] | (q > p)
        p, q, room = p[ok], q[ok], (a + b - 2 * need)[ok]
        if len(p):
            room = room - np.bitwise_count(sig[p] ^ sig[q]).sum(1, dtype=np.int64)
            p, q, room = p[room >= 0], q[room >= 0], room[room >= 0]
        firsts.append(p)
        seconds.append(q)
        rooms.append(room)
    if not firsts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    p, q, room = map(np.concatenate, (firsts, seconds, rooms))
    if nearest and len(p):
        order = np.lexsort((-room, p))
        order = order[np.r_[True, np.diff(p[order]) != 0]]
        p, q = p[order], q[order]
    both = np.unique(np.stack([np.minimum(ids[p], ids[q]), np.maximum(ids[p], ids[q])]), axis=1)
    return both[0], both[1]


def _whole_units(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Sorted rows in tables that end where a unit ends."""
    held: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if held is not None:
            t = pa.concat_tables([held, t])
        if not len(t):
            continue
        key = [t.column(k).to_numpy() for k in keys]
        other = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in key]))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield t.slice(0, cut)
        held = t.slice(cut)
    if held is not None and len(held):
        yield held


def _unit_edges(*keys: np.ndarray) -> Iterator[tuple[int, int]]:
    new = np.r_[True, np.logical_or.reduce([np.diff(k) != 0 for k in keys])]
    edges = np.r_[np.flatnonzero(new), len(keys[0])]
    return zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)


def _cross_pairs(entries: DataFrame, sets: DataFrame, nearest: bool, percent: int) -> DataFrame:
    """Pairs (a, b) of entries that share a list but no component and may link. Memory: a unit's two blocks, a batch and CHUNK pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_units(batches, ("token", "u", "v")):
            col = {k: t.column(k).to_numpy() for k in ("token", "u", "v", "blk", "set_id", "n", "pos", "comp")}
            col["n"], col["pos"] = col["n"].astype(np.int64), col["pos"].astype(np.int64)
            col["sig"] = t.column("sig").combine_chunks().flatten().to_numpy().reshape(len(t), -1).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _compare(col, nearest, percent)], ["a", "b"])

    units = _units(entries, sets)
    keys = ["token", "u", "v"]
    dealt = units.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(resting(run), "a bigint, b bigint").distinct()


def _crossing(entries: DataFrame) -> tuple[int, int]:
    """(entries of lists with several components, pairs that comparing them all would make)."""
    by = entries.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("token").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("q"), F.count(F.lit(1)).alias("c"))
    got = by.where("c > 1").agg(F.sum("m").alias("m"), F.sum((F.col("m") * F.col("m") - F.col("q")) / 2).alias("p")).first()
    return int(got.m or 0), int(got.p or 0)


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set on the left shares with each on the right."""
    sets, k = [*left, *right], len(left)
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.full((k, len(right)), np.count_nonzero(times == len(sets)), np.int64)
    some = (times > 1) & (times < len(sets))
    keep = some[at]
    row, col = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[keep], (np.cumsum(some) - 1)[at[keep]]
    order = np.argsort(col, kind="stable")
    row, col, width = row[order], col[order], int(some.sum())
    for first in range(0, width, COLUMNS):
        i, j = np.searchsorted(col, (first, first + COLUMNS))
        part = np.zeros((len(sets), min(COLUMNS, width - first)), np.float32)
        part[row[i:j], col[i:j] - first] = 1
        out += (part[:k] @ part[k:].T).astype(np.int64)
    return out


def _differences(nodes: DataFrame, contents: DataFrame) -> DataFrame:
    """(comp, set_id, n, hub_n, common, diff): what each set shares with its component's hub, and the shingles that only one has."""
    rows = nodes.join(contents, "set_id")
    hubs = nodes.where("set_id = hub").select("comp", F.col("set_id")).join(contents, "set_id").select("comp", F.col("hashes").alias("hub_hashes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for x, y in zip(b.column(2), b.column(3), strict=True):
                own, hub = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                diff = np.setxor1d(own, hub, assume_unique=True)
                for c, v in zip(cols, (len(own), len(hub), (len(own) + len(hub) - len(diff)) // 2, diff.tobytes()), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["comp", "set_id", "n", "hub_n", "common", "diff"])

    joined = rows.join(hubs, "comp").select("comp", "set_id", "hashes", "hub_hashes")
    return joined.mapInArrow(resting(run), "comp bigint, set_id bigint, n bigint, hub_n bigint, common bigint, diff binary")


def _links(nodes: DataFrame, sizes: DataFrame, diffs: DataFrame, pairs: bool, percent: int) -> DataFrame:
    """All links: (a, b), or (set_id, n_links) with the number of other sets that each set links with, where it has any.

    An element is in two differences from the same hub only if both sets have it or both lack it, so the overlap of two sets
    is what both have in common with the hub, counted out, plus what their differences share. Memory: a unit's two blocks,
    a batch and a matrix of a unit's pairs.
    """
    whole = diffs.groupBy("comp").agg(F.count(F.lit(1)).alias("_m"), F.sum(F.octet_length("diff") / 8).alias("_n"))
    blocks = F.greatest(F.ceil(F.col("_m") / BLOCK), F.ceil(F.col("_n") / SHINGLES)).cast("int")
    rows = diffs.join(whole.select("comp", blocks.alias("_k")), "comp")
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("set_id", F.lit(9)), "_k").cast("int")).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    rows = rows.select("comp", F.least("blk", "_j").alias("u"), F.greatest("blk", "_j").alias("v"), "blk", "set_id", "n", "hub_n", "common", "diff")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_units(batches, ("comp", "u", "v")):
            comp, u, v, blk, ids, n, hub_n, common = (t.column(k).to_numpy() for k in ("comp", "u", "v", "blk", "set_id", "n", "hub_n", "common"))
            diff = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("diff")]
            for i, j in _unit_edges(comp, u, v):
                one = u[i] == v[i]
                x = np.arange(i, j) if one else i + np.flatnonzero(blk[i:j] == u[i])
                y = x if one else i + np.flatnonzero(blk[i:j] != u[i])
                if not len(x) or not len(y) or (one and len(x) == 1):
                    continue
                shared = common[x][:, None] + common[y][None, :] - hub_n[i] + _shared([diff[k] for k in x], [diff[k] for k in y])
                ok = 100 * shared >= percent * (n[x][:, None] + n[y][None, :] - shared)
                if one:
                    np.fill_diagonal(ok, False)
                if pairs:
                    p, q = np.nonzero(np.triu(ok) if one else ok)
                    found = np.minimum(ids[x[p]], ids[y[q]]), np.maximum(ids[x[p]], ids[y[q]])
                else:
                    found = (ids[x], ok.sum(1)) if one else (np.r_[ids[x], ids[y]], np.r_[ok.sum(1), ok.sum(0)])
                yield pa.RecordBatch.from_arrays([pa.array(f.astype(np.int64)) for f in found], list(names))

    names = ("a", "b") if pairs else ("set_id", "n_links")
    keys = ["comp", "u", "v"]
    found = rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(resting(run), ", ".join(f"{k} bigint" for k in names))
    known = nodes.join(sizes.where("_two").select("comp"), "comp", "left_semi")
    if pairs:
        return found.unionByName(known.groupBy("comp").agg(F.min("set_id").alias("a"), F.max("set_id").alias("b")).select("a", "b"))
    found = found.unionByName(known.select("set_id", F.lit(1).cast("bigint").alias("n_links")))
    return found.groupBy("set_id").agg(F.sum("n_links").alias("n_links"))


class _Join:
    """The join over one table. Rows with a null doc_id take no part.

    members: the set of each row; sets: those on a list that can hold a pair; comps: (node, comp) of components by doc_id and by
    links, nodes being the smallest doc_ids of sets, so that a component's name is its smallest doc_id.
    """

    def __init__(self, docs: DataFrame, width: int, percent: int):
        self.docs, self.width, self.percent = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), width, percent
        self._scanned = stage(_scan(self.docs, width), "sets")
        self.members = self._scanned.where(F.col("piece").isNull()).select("doc_id", "n", "set_id")
        self._contents: list[DataFrame] = []
        self._find()

    def _find(self) -> None:
        counts = _summed(self._scanned.where(F.col("piece").isNotNull()).select("piece", "data"))
        known = self.docs.where(F.col("doc_id").isNotNull())
        whole = stage(_lists(_postings(known, counts, self.width, self.percent), self.percent), "lists")
        lists = stage(_first_of_equal(whole), "lists")
        discard(whole)
        full = self._scanned.where(F.col("piece").isNull() & (F.col("n") > 0) & F.col("doc_id").isNotNull())
        sets = full.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))
        self.sets = stage(sets.join(lists.select("set_id").distinct(), "set_id", "left_semi"), "signed")
        same = _same_documents(self.members)
        self.same = stage(same.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "same")
        self.comps = connected_components(same.where("a <> b"))
        before, led, linked = 0, True, 0
        for turn in range(ROUNDS + 1):
            entries = stage(lists.join(self._named().select("set_id", "comp"), "set_id"), "entries")
            size, pairs = _crossing(entries)
            if not pairs:
                discard(entries)
                break
            # leaders first; once they no longer halve what is left, each entry's likeliest partner while that joins much. Only then all
            # pairs across components: before, most of them lie in one group, and their number grows with the square of its size
            last = turn == ROUNDS or (not led and FALL * (before - pairs) < before and FEW * linked < size)
            led = led and (turn == 0 or 2 * pairs <= before)
            before = pairs
            if last or not led:
                found = _cross_pairs(entries, self.sets, not last, self.percent)
            else:
                found = _leader_pairs(entries, turn, self.percent)
            near = stage(_near(found, self.sets, self.percent), "near")
            discard(entries)
            links = stage(_verified(near, self.contents(near.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()), self.percent), "links")
            linked = links.count()
            comps, self.comps = self.comps, connected_components(links, self.comps)
            discard(near, links, comps)
            if last:
                break
        discard(lists)

    def _named(self) -> DataFrame:
        """sets with comp."""
        return self.sets.drop("sig").join(self.comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))

    def contents(self, wanted: DataFrame) -> DataFrame:
        """Contents of all sets that were ever wanted, the given ones included."""
        fresh = self.sets.select("set_id", "rep").join(wanted, "set_id", "left_semi")
        if self._contents:
            fresh = fresh.join(self._all().select("set_id"), "set_id", "left_anti")
        fresh = stage(fresh, "wanted")
        if not self._contents or not fresh.isEmpty():
            self._contents.append(stage(_contents(self.docs, fresh, self.width), "contents"))
        discard(fresh)
        return self._all()

    def _all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self._contents)

    def links(self, pairs: bool) -> DataFrame:
        """See _links."""
        linked = self.comps.withColumnRenamed("node", "rep")
        nodes = stage(self.sets.select("set_id", "rep").join(linked, "rep").join(self.same.withColumn("_same", F.lit(True)), "rep", "left"), "nodes")
        sizes = nodes.groupBy("comp").agg(F.count(F.lit(1)).alias("_m"), F.min("set_id").alias("hub"), F.max("_same").alias("_same")).where("_m > 1")
        # two sets of one component that no doc_id joined were joined by their link
        sizes = stage(sizes.select("comp", "hub", ((F.col("_m") == 2) & F.col("_same").isNull()).alias("_two")), "sizes")
        many = nodes.select("comp", "set_id").join(sizes.where("not _two").select("comp", "hub"), "comp")
        diffs = stage(_differences(many, self.contents(many.select("set_id"))), "differences")
        out = stage(_links(nodes, sizes, diffs, pairs, self.percent), "counts")
        discard(nodes, sizes, diffs)
        return out

    def labelled(self, counts: DataFrame | None) -> DataFrame:
        """doc_id, n_shingles, component_id, n_links of every row."""
        rows = self.members.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
        names = rows.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("_c"))
        names = names.join(self.comps.withColumnRenamed("node", "rep"), "rep", "left")
        names = names.join(counts, "set_id", "left") if counts is not None else names.withColumn("n_links", F.lit(None).cast("bigint"))
        # sets of one row and without links need no name
        names = names.where((F.col("_c") > 1) | F.col("comp").isNotNull()).select("set_id", "_c", F.coalesce("comp", "rep").alias("component_id"), "n_links")
        names = stage(names, "names")
        most = HOT * self.members.count()
        hot = F.broadcast(names.where(F.col("_c") > most).drop("_c"))
        rest = rows.join(hot.select("set_id"), "set_id", "left_anti").join(names.where(F.col("_c") <= most).drop("_c"), "set_id", "left")
        linked = rows.join(hot, "set_id").select("doc_id", "n", "component_id", "n_links").unionByName(rest.select("doc_id", "n", "component_id", "n_links"))
        linked = linked.withColumn("component_id", F.coalesce("component_id", "doc_id"))
        # a document that also has a text with shingles keeps that component for its empty row
        empty = self.members.where((F.col("n") == 0) | F.col("doc_id").isNull())
        held = linked.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
        empty = empty.join(held, "doc_id", "left").select("doc_id", "n", F.coalesce("component_id", "doc_id").alias("component_id"), F.lit(None).cast("bigint").alias("n_links"))
        out = linked.unionByName(empty).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
        out = stage(out, "labelled")
        discard(names)
        return out

    def close(self) -> None:
        """Delete all staged tables; what was returned was staged on its own."""
        discard(self._scanned, self.sets, self.same, self.comps, *self._contents)


def similarity_classes(docs: DataFrame, links: bool = False, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs, and with ``links`` n_links: with how many other sets its set links.

    Null or empty texts have no shingles and are linked with nothing. Repeated doc_ids are one document with several texts.
    A null doc_id has a null component and links nothing.
    """
    join = _Join(docs, width, percent)
    counts = join.links(False) if links else None
    out = join.labelled(counts)
    discard(counts)
    join.close()
    return out if links else out.drop("n_links")


def links(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_a, doc_b): every link between two different sets, each named by its smallest doc_id."""
    join = _Join(docs, width, percent)
    found = join.links(True)
    for side in "ab":
        found = found.join(join.sets.select(F.col("set_id").alias(side), F.col("rep").alias(f"doc_{side}")), side)
    found = stage(found.select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b")), "pairs")
    join.close()
    return found


def _same_documents(members: DataFrame) -> DataFrame:
    """(a, b): the smallest doc_ids of sets that carry one doc_id."""
    rows = members.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).select("doc_id", "set_id")
    twice = rows.groupBy("doc_id").agg(F.min("set_id").alias("_a"), F.max("set_id").alias("_b")).where("_a <> _b").select("doc_id")
    several = stage(rows.join(twice, "doc_id", "left_semi").distinct(), "several")
    reps = rows.join(several.select("set_id").distinct(), "set_id", "left_semi").groupBy("set_id").agg(F.min("doc_id").alias("rep"))
    named = several.join(reps, "set_id")
    return stage(named.join(named.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").select("a", F.col("rep").alias("b")).distinct(), "same")


def ngram_join(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """op1: doc_id, n_shingles, component_id, and n_links, the number of other sets that the document's set links with."""
    return similarity_classes(docs, links=True)


def keep_one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id. Rows with a null doc_id stay.

    Of rows that repeat a doc_id one stays. Only rows that may go meet in a join; the rest stays where it is.
    """
    names = docs.columns
    found = similarity_classes(docs, width=width, percent=percent)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    repeated = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id")
    odd = stage(gone.withColumn("_gone", F.lit(True)).unionByName(repeated.withColumn("_gone", F.lit(False))), "odd")
    discard(found)
    rows = docs.select(F.col("doc_id").alias("_id"), F.struct(*names).alias("_doc"))
    sure = maybe_in(rows, "_id", odd.select("doc_id"), inside=False)
    asked = maybe_in(rows, "_id", odd.select("doc_id")).join(odd.where("_gone").select(F.col("doc_id").alias("_id")), "_id", "left_anti")
    if not odd.where("not _gone").isEmpty():
        twice = odd.where("not _gone").select(F.col("doc_id").alias("_id")).distinct()
        once = asked.join(twice, "_id", "left_semi").dropDuplicates(["_id"])
        asked = asked.join(twice, "_id", "left_anti").unionByName(once)
    return sure.unionByName(asked).select("_doc.*")
