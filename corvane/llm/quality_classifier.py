"""Compression classifier: zstandard dictionaries of good and of bad texts.

A text that is like the good ones compresses better with their dictionary. Its normalised difference of compressed
sizes, cut into blocks so that the dictionary counts throughout a long text, becomes a probability by logistic calibration.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Labelled rows of each class, by smallest hash, that the dictionaries and (others) the calibration are fitted on at most.
DICTIONARY_ROWS, CALIBRATION_ROWS = 2000, 4000
DICTIONARY_BYTES, BLOCK, LEVEL, SAMPLE_BYTES = 112_640, 4096, 3, 16 << 20
#: Blocks that one text gives to a dictionary at most, evenly spread over it.
TEXT_BLOCKS = 8
THRESHOLD, FOLDS = 0.3, 5


def _blocks(text: str | None) -> list[bytes]:
    data = (text or "").encode()
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


@dataclass
class CompressionModel:
    """Two dictionaries and the calibration score = sigmoid(bias + weights . features); an empty text gets ``empty``."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...] = (0.0, 0.0, 0.0)
    bias: float = 0.0
    empty: float = 0.0

    def __post_init__(self) -> None:
        self._press = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_press": None}

    def features(self, text: str | None) -> tuple[float, float, float] | None:
        """The size difference over the sizes' sum, for the whole text and damped for short ones, and how small both sizes are."""
        blocks = _blocks(text)
        if not blocks:
            return None
        if self._press is None:
            dicts = [zstandard.ZstdCompressionDict(d) if d else None for d in (self.good, self.bad)]
            for d in dicts:
                if d is not None:
                    d.precompute_compress(level=LEVEL)
            options = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
            self._press = [zstandard.ZstdCompressor(dict_data=d, **options) for d in dicts]
        good, bad = (sum(len(p.compress(b)) for b in blocks) for p in self._press)
        d = (bad - good) / (bad + good)
        return d, d * min(1.0, (good + bad) / 1000), math.log((good + bad) / (2 * sum(map(len, blocks)) + 60))

    def score(self, text: str | None) -> float:
        x = self.features(text)
        if x is None:
            return self.empty
        z = self.bias + sum(w * v for w, v in zip(self.weights, x, strict=True))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _spread(text: str | None, most: int = TEXT_BLOCKS) -> list[bytes]:
    """A text's blocks, or ``most`` of them at even distances."""
    blocks = _blocks(text)
    return blocks if len(blocks) <= most else [blocks[i * len(blocks) // most] for i in range(most)]


def _samples(blocks: list[list[bytes]], most: int) -> list[bytes]:
    """All blocks of the texts; if they exceed ``most`` bytes, every text's first block, then every second one, up to it."""
    if sum(len(b) for bs in blocks for b in bs) <= most:
        return [b for bs in blocks for b in bs]
    out, total = [], 0
    for i in range(max(map(len, blocks))):
        for b in (bs[i] for bs in blocks if i < len(bs)):
            total += len(b)
            if total > most:
                return out
            out.append(b)
    return out


def _dictionary(blocks: list[list[bytes]], most: int = SAMPLE_BYTES) -> bytes:
    """A trained dictionary, or where zstandard's trainer finds too little, the sample itself as one (raw content)."""
    samples = _samples(blocks, most)
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-max(size, 1024) :]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method on standardised columns; returns bias and weights for the raw columns."""
    mean, std = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / std]
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * len(x) * np.diag([1e-6, *[1.0] * x.shape[1]]), z.T @ (y - p) - ridge * len(x) * np.r_[0, w[1:]])
        w += step
        if np.abs(step).max() < 1e-8:
            break
    weights = w[1:] / std
    return np.r_[w[0] - weights @ mean, weights]


def held_out(doc_id):
    """crc32 of the id as text modulo FOLDS is 0; a null id counts as an empty text, hence is held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


def _smallest(rows: DataFrame, key, n: int, count: int) -> list:
    """The n rows of (doc_id, ...) with the smallest key, given how many there are: a first cut by the key's expected range keeps
    each task from sending n of its own."""
    low = -(1 << 63) + min(1, Fraction(2 * n, max(1, count))) * ((1 << 64) - 1) // 1
    found = rows.where(key <= low).orderBy(key, "doc_id").limit(n).collect()
    return found if len(found) >= min(n, count) else rows.orderBy(key, "doc_id").limit(n).collect()


def fit(docs: DataFrame, labels: DataFrame, dictionary_rows: int = DICTIONARY_ROWS, calibration_rows: int = CALIBRATION_ROWS, sample_bytes: int = SAMPLE_BYTES) -> CompressionModel:
    """Fit on labelled rows outside the held-out fold, a bounded sample by smallest hash of the id.

    A dictionary is trained on TEXT_BLOCKS blocks of each of its class's sampled texts and sample_bytes of them at most, spread
    evenly; the calibration scores whole texts where they lie, so the driver gets blocks and features only. Of rows that share
    a doc_id one counts. Ids labelled both ways are left out. An empty text scores the share of good labels among the sampled
    empty ones, drawn to that of all by two rows. Without both classes every text scores the share of good labels.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("quality").alias("_high")).where(F.col("quality") == F.col("_high"))
    counts = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    key = F.xxhash64("doc_id", F.lit(11))
    spark, most = docs.sparkSession, dictionary_rows + calibration_rows
    ids = [(r.doc_id, q, i) for q in (0, 1) for i, r in enumerate(_smallest(known.where(F.col("quality") == q).select("doc_id"), key, most, counts.get(q, 0)))]
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    at = lambda rows: F.broadcast(spark.createDataFrame(rows, "doc_id bigint, quality int, place int"))  # noqa: E731  2 * most rows at most
    held = texts.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) > 0).alias("full")).join(at(ids), "doc_id")
    held = held.groupBy("doc_id", "quality", "place").agg(F.max("full").alias("full")).collect()
    empty = [r.quality for r in held if not r.full]
    by = {q: sorted((r.place, r.doc_id) for r in held if r.full and r.quality == q) for q in (0, 1)}
    if min(map(len, by.values())) < 4:
        p = min(max(share, 1e-6), 1 - 1e-6)
        return CompressionModel(b"", b"", bias=math.log(p / (1 - p)), empty=p)
    # rows that made the dictionaries would look better than they are, so the calibration uses others
    cut = {q: min(dictionary_rows, len(rows) // 2) for q, rows in by.items()}

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_spread(t) for texts in slices(b.column(1)) for t in texts], pa.list_(pa.binary()))], ["place", "blocks"])

    dictionaries = {}
    for q in (0, 1):
        chosen = texts.join(at([(i, q, place) for place, i in by[q][: cut[q]]]), "doc_id").where(F.octet_length("text") > 0)
        rows = chosen.select("place", "text").mapInArrow(blocks, "place int, blocks array<binary>").groupBy("place").agg(F.min("blocks").alias("blocks"))
        dictionaries[q] = _dictionary([list(map(bytes, r.blocks)) for r in rows.orderBy("place").collect()], sample_bytes)
    model = CompressionModel(dictionaries[1], dictionaries[0])
    shared = spark.sparkContext.broadcast(model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared.value.features(t) for texts in slices(b.column(2)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.float64()))], ["place", "quality", "x"])

    chosen = texts.join(at([(i, q, place) for q in (0, 1) for place, i in by[q][cut[q] :]]), "doc_id").where(F.octet_length("text") > 0)
    rows = chosen.select("place", "quality", "text").mapInArrow(features, "place int, quality int, x array<double>")
    rows = rows.groupBy("quality", "place").agg(F.min("x").alias("x")).orderBy("quality", "place").collect()
    y = np.array([r.quality for r in rows], float)
    # the sample may hold the classes in other shares than the labels do
    fitted, here = _logistic(np.array([r.x for r in rows]), y), y.mean()
    prior = math.log(share / (1 - share)) - math.log(here / (1 - here))
    model.bias, model.weights = float(fitted[0] + prior), tuple(map(float, fitted[1:]))
    model.empty = (sum(empty) + 2 * share) / (len(empty) + 2)
    return model


def score_column(docs: DataFrame, model: CompressionModel, keep: list[str], name: str = "score") -> DataFrame:
    """The columns ``keep`` of docs plus ``name``, the score."""
    schema = docs.select(*keep).schema.add(name, "double")
    at = keep.index("text") if "text" in keep else len(keep)
    cols = keep if "text" in keep else [*keep, "text"]
    held = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            scores = pa.array([m.score(t) for texts in slices(b.column(at)) for t in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], scores], [*keep, name])

    return docs.select(*cols).mapInArrow(run, schema)


def classify_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op4: doc_id, held_out, score, predicted for every row of docs; repeated rows stay, a null text is empty."""
    out = score_column(docs, fit(docs, labels), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not rejected, with the columns of docs, whatever their names."""
    names, score = docs.columns, "_score"
    while score in {n.lower() for n in names}:
        score += "_"
    return score_column(docs, fit(docs, labels), names, score).where(F.col(score) >= THRESHOLD).select(*names)
