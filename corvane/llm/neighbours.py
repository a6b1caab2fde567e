"""Approximate nearest neighbours with learned partitions.

A neighbour graph over a bounded sample is cut into balanced parts by recursive bisection with boundary swaps; a small
network learns to tell the parts from the vector. It indexes every row and routes each query to its most probable parts,
whose rows are ranked by exact distance. Rows and queries of a part meet in blocks of bounded size, so a hot part is many
blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Rows, by smallest hash, that graph and network are fitted on: so many for each part, within these bounds; neighbours a node.
SAMPLE_PART, SAMPLE, MOST_SAMPLE, DEGREE = 32, 8192, 65_536, 16
#: Rows for each part; parts, a power of two: at least so many, and no more than the largest sample has rows for.
PART_ROWS, LEAST_PARTS, MOST_PARTS = 1500, 8, MOST_SAMPLE // SAMPLE_PART
#: Every so many-th sampled row is held out of the fit; share of the held-out rows' neighbours that the probed parts must hold.
HELD, COVERAGE = 8, 0.95
BLOCK = 4096
HIDDEN, EPOCHS, BATCH = 96, 24, 256


def _neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row, in blocks."""
    norms, out = (x * x).sum(1), np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        d = norms - 2 * x[at : at + 1024] @ x.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        out[at : at + 1024] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def _bisect(x: np.ndarray, near: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """A balanced cut of the nodes: the median along the main direction, then swaps of nodes that lower the cut."""
    sub = x[nodes] - x[nodes].mean(0)
    v = np.random.default_rng(0).normal(size=x.shape[1])
    for _ in range(20):
        v = sub.T @ (sub @ v)
        v /= np.linalg.norm(v) + 1e-300
    side = np.zeros(len(nodes), bool)
    side[np.argsort(sub @ v, kind="stable")[len(nodes) // 2 :]] = True
    place = np.full(len(x), -1)
    place[nodes] = np.arange(len(nodes))
    edges = place[near[nodes]]
    a = np.repeat(np.arange(len(nodes)), near.shape[1])[edges.ravel() >= 0]
    b = edges.ravel()[edges.ravel() >= 0]
    a, b = np.r_[a, b], np.r_[b, a]
    best, best_cut = side.copy(), (side[a] != side[b]).sum()
    for _ in range(12):
        gain = np.bincount(a, np.where(side[a] != side[b], 1.0, -1.0), len(nodes))
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        n = min(len(left), len(right))
        m = int((gain[left[:n]] + gain[right[:n]] > 0).sum()) // 2
        if not m:
            break
        side[left[:m]], side[right[:m]] = True, False
        cut = (side[a] != side[b]).sum()
        if cut >= best_cut:
            break
        best, best_cut = side.copy(), cut
    return best


def partition_graph(x: np.ndarray, near: np.ndarray, parts: int) -> np.ndarray:
    """Balanced parts (a power of two) of the graph's nodes."""
    out = np.zeros(len(x), np.int64)
    size = 1
    while size < parts:
        fresh = out.copy()
        for p in range(size):
            nodes = np.flatnonzero(out == p)
            if len(nodes) > 1:
                fresh[nodes] = 2 * p + _bisect(x, near, nodes)
            else:
                fresh[nodes] = 2 * p
        out, size = fresh, 2 * size
    return out


@dataclass
class Router:
    """A network with one hidden layer; probes is the number of parts that a query is sent to."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    @property
    def parts(self) -> int:
        return len(self.b2)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def train_router(x: np.ndarray, parts: int, coverage: float = COVERAGE) -> Router:
    """Fit on sampled vectors. Targets are soft: the parts of a row and of its neighbours."""
    held = np.arange(len(x)) % HELD == HELD - 1
    if len(x) <= HELD * DEGREE:
        held[:] = False
    everything, x = x, x[~held]
    k = min(DEGREE, len(x) - 1)
    near = _neighbours(x, k)
    part = partition_graph(x, near, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), k), part[near].ravel()), 0.5 / k)
    target[np.arange(len(x)), part] += 0.5
    rng, dim = np.random.default_rng(1), x.shape[1]
    r = Router(x.mean(0), np.full(dim, x.std() + 1e-12), rng.normal(size=(dim, HIDDEN)) * np.sqrt(2 / dim), np.zeros(HIDDEN), rng.normal(size=(HIDDEN, parts)) * np.sqrt(1 / HIDDEN), np.zeros(parts))
    z = (x - r.mean) / r.scale
    weights = [r.w1, r.b1, r.w2, r.b2]
    m, v, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for epoch in range(EPOCHS):
        rate = 3e-3 * (1 - epoch / EPOCHS) + 1e-4
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // BATCH)):
            h = np.maximum(z[rows] @ r.w1 + r.b1, 0)
            s = h @ r.w2 + r.b2
            p = np.exp(s - s.max(1, keepdims=True))
            g = (p / p.sum(1, keepdims=True) - target[rows]) / len(rows)
            gh = (g @ r.w2.T) * (h > 0)
            t += 1
            for i, d in enumerate((z[rows].T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                m[i] = 0.9 * m[i] + 0.1 * d
                v[i] = 0.999 * v[i] + 0.001 * d * d
                weights[i] -= rate * m[i] / (1 - 0.9**t) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    # probe as many parts as hold the wished share of the neighbours of rows that the network has not seen, by the index that
    # it makes itself
    asked = np.flatnonzero(held) if held.any() else np.arange(len(everything))
    logits = r.logits(everything)
    own, order = logits.argmax(1), np.argsort(-logits[asked], axis=1)
    rank = np.empty_like(order)
    rank[np.arange(len(asked))[:, None], order] = np.arange(parts)
    near = _neighbours(everything, k)[asked]
    needed = np.sort(np.take_along_axis(rank, own[near], axis=1).ravel())
    r.probes = min(parts, int(needed[min(len(needed) - 1, int(coverage * len(needed)))]) + 1)
    return r


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.float64).reshape(len(column), -1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part: not null, not zero, all finite, of the most frequent length."""
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").limit(1).collect()
    return rows.where(F.size("v") == (dims[0].d if dims else 0))


def _sampled(rows: DataFrame, n: int, sample: int) -> list:
    """Vectors of the rows with the smallest hash. The hash's expected range cuts first, so that tasks send no more than they must."""
    key = F.xxhash64("vec_id", F.lit(3))
    low = -(1 << 63) + min(1, Fraction(2 * sample, max(1, n))) * ((1 << 64) - 1) // 1
    for some in (rows.where(key <= low), rows):
        found = some.orderBy(key, "vec_id", "v").select("v").limit(sample).collect()
        if len(found) >= min(sample, n):
            break
    return [r.v for r in found]


def search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, told: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest other rows among the probed parts; ties to the smaller vec_id.

    Rows that cannot take part (see usable) are neither queries nor candidates. A repeated query id counts once, repeated
    candidate rows each count. Parts are searched until they hold 20 k rows, so very small tables are searched whole. ``told``,
    if given, gets the number of rows, parts and probes.
    """
    spark = vectors.sparkSession
    rows, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col).dropDuplicates(["vec_id"])
    n = rows.count()
    parts = LEAST_PARTS
    while parts < MOST_PARTS and parts * 2 * PART_ROWS <= n:
        parts *= 2
    x = np.array(_sampled(rows, n, min(MOST_SAMPLE, max(SAMPLE, SAMPLE_PART * parts))), np.float64)
    if len(x) > 2 * parts:
        router = train_router(x, parts)
    else:  # too few rows for a graph
        parts, router = 1, None
    if told is not None:
        told |= {"rows": n, "parts": parts, "probes": router.probes if router else 1}
    held = spark.sparkContext.broadcast(router)  # some hundred kilobytes, whatever the table's size

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = held.value
            part = np.zeros(b.num_rows, np.int32) if r is None or not b.num_rows else r.logits(_matrix(b.column(1))).argmax(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part)], ["vec_id", "v", "part"])

    kind = rows.schema["v"].dataType.simpleString()
    placed = stage(rows.mapInArrow(index, f"vec_id bigint, v {kind}, part int"), "ann-index")
    sizes = np.zeros(parts, np.int64)
    for r in placed.groupBy("part").count().collect():  # a row a part
        sizes[r.part] = r["count"]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = held.value
            if r is None or not b.num_rows:
                probes = [[0]] * b.num_rows
            else:
                order = np.argsort(-r.logits(_matrix(b.column(1))), axis=1)
                # more parts while those probed hold too few rows to choose from
                enough = (np.cumsum(sizes[order], axis=1) < 20 * k).sum(1) + 1
                probes = [o[: max(r.probes, e)].tolist() for o, e in zip(order, enough, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(probes, pa.list_(pa.int32()))], ["query_id", "q", "parts"])

    routed = asked.mapInArrow(route, f"query_id bigint, q {kind}, parts array<int>")
    routed = stage(routed.select("query_id", "q", F.explode("parts").alias("part")), "ann-queries")
    blocks = np.maximum(1, -(-sizes // BLOCK))
    query_blocks = np.ones(parts, np.int64)
    for r in routed.groupBy("part").count().collect():
        query_blocks[r.part] = -(-r["count"] // BLOCK)
    at = lambda a: F.element_at(F.array(*[F.lit(int(v)) for v in a]), F.col("part") + 1)
    upto = lambda a: F.explode(F.sequence(F.lit(0), at(a) - 1))
    left = placed.withColumn("c", F.pmod(F.xxhash64("vec_id"), at(blocks)).cast("int")).select("*", upto(query_blocks).alias("b"))
    right = routed.withColumn("b", F.pmod(F.xxhash64("query_id", F.lit(5)), at(query_blocks)).cast("int")).select("*", upto(blocks).alias("c"))

    def rerank(candidates: pa.Table, block: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if candidates.num_rows and block.num_rows:
            c = _matrix(candidates.column("v").combine_chunks())
            ids = candidates.column("vec_id").to_numpy()
            q = _matrix(block.column("q").combine_chunks())
            for query_id, v in zip(block.column("query_id").to_pylist(), q, strict=True):
                d = np.sqrt(((c - v) ** 2).sum(1))
                d[ids == query_id] = np.inf
                if len(d) > k:
                    near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
                else:
                    near = np.arange(len(d))
                near = near[np.isfinite(d[near])]
                near = near[np.lexsort((ids[near], d[near]))][:k]
                out[0] += [query_id] * len(near)
                out[1] += ids[near].tolist()
                out[2] += d[near].tolist()
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    keys = ["part", "c", "b"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(rerank, "query_id bigint, vec_id bigint, score double")
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search_embeddings(embeddings: DataFrame) -> DataFrame:
    """op9: queries are the rows whose vec_id is divisible by 100."""
    return search(embeddings, embeddings.where(F.col("vec_id") % 100 == 0))


def brute_force(frame: pd.DataFrame, k: int = 10) -> pd.DataFrame:
    """Exact answers for small fixtures."""
    ids, x = frame.vec_id.to_numpy(), np.stack(frame.embedding.to_numpy()).astype(np.float64)
    out = []
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[i]][:k]
        out += [(ids[i], r + 1, ids[j], d[j]) for r, j in enumerate(order)]
    return pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])
