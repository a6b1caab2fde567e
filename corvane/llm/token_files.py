"""Token ids as files: each document compressed alone with one shared zstandard dictionary.

A file is: magic, 8-byte hash of the dictionary, number of documents, then the index (doc_id, offset, ids) and the frames.
One short read of the index and one of a frame give a document. A root folder holds all: the files, under a name of the
writing attempt, the dictionary under its hash, and ``manifest``, written by Spark's committer, which says which files count
and what doc_ids each holds. So any later session can read a document by its id (``read_document``).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_bpe import loaded
from .common import discard, scratch_path, slices
from .common import stage_thin as stage

MAGIC = b"CTOK0001"
END_ID = 2
#: Documents whose ids the dictionary is trained on, by smallest hash of doc_id over all rows; bytes of ids that one of them
#: gives at most, from a place chosen by its hash; and the dictionary's size.
SAMPLE, SAMPLE_BYTES, DICTIONARY = 1500, 64 << 10, 64 << 10
#: Documents a file, about, and compressed bytes after which a file ends whatever its documents.
FILE, FILE_BYTES = 16_384, 128 << 20
_INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("size", "<u4"), ("n", "<u4")])
_FRAMES = "doc_id bigint, n bigint, frame binary"


def sample_ids(docs: DataFrame, tokenizer: str, sample: int = SAMPLE, most: int = SAMPLE_BYTES) -> list[bytes]:
    """Serialized ids of ``sample`` documents, at most ``most`` bytes each. Ids are chosen first, then their texts are read and
    encoded where they lie, so the driver gets sample * most bytes at most. Of rows that share a doc_id one counts."""
    key = F.xxhash64("doc_id", F.lit(7))
    known = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = max(1, docs.count())
    low = -(1 << 63) + min(1, Fraction(3 * sample, rows)) * ((1 << 64) - 1) // 1
    ids = known.where(key <= low).select("doc_id").distinct().orderBy(key, "doc_id").limit(sample).collect()
    if len(ids) < sample and 3 * sample < rows:  # few distinct ids
        ids = known.select("doc_id").distinct().orderBy(key, "doc_id").limit(sample).collect()
    wanted = docs.sparkSession.createDataFrame([(r.doc_id,) for r in ids], "doc_id bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer)
        for b in batches:
            out = []
            for doc_id, x in zip(b.column(0).to_pylist(), bpe.encode(slices(b.column(1))), strict=True):
                blocks = max(1, -(-len(x) // most))
                at = zlib.crc32(str(doc_id).encode()) % blocks * most
                out.append(x[at : at + most])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "ids"])

    found = known.join(F.broadcast(wanted), "doc_id").select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids binary")
    return [bytes(r.ids) for r in found.groupBy("doc_id").agg(F.min("ids").alias("ids")).orderBy("doc_id").collect() if r.ids]


def train(docs: DataFrame, tokenizer: str, sample: int = SAMPLE, size: int = DICTIONARY) -> bytes:
    """A dictionary from sample_ids. Where zstandard's trainer finds too little, the sample itself is the dictionary (raw content)."""
    data = sample_ids(docs, tokenizer, sample)
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, data)) // 8), data).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(data)[-size:]


def dictionary_hash(dictionary: bytes) -> bytes:
    return hashlib.sha256(dictionary).digest()[:8]


def _dict(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def encode_frames(docs: DataFrame, tokenizer: str, dictionary: bytes) -> DataFrame:
    """doc_id, number of ids with the end id, and the compressed ids; a null text is empty."""
    end = np.asarray([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, press = loaded(tokenizer), zstandard.ZstdCompressor(level=3, dict_data=_dict(dictionary))
        for b in batches:
            n, frames = [], []
            for x in bpe.encode(slices(b.column(1))):  # a document's ids go before the next ones come
                n.append(len(x) // 4 + 1)
                frames.append(press.compress(x + end))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(frames, pa.binary())], ["doc_id", "n", "frame"])
        bpe.rest()

    return docs.select("doc_id", "text").mapInArrow(run, _FRAMES)


def file_bytes(rows: list[tuple[int | None, int, bytes]], dictionary: bytes) -> bytes:
    index, offset = np.zeros(len(rows), _INDEX), 0
    for i, (doc_id, n, frame) in enumerate(rows):
        index[i] = (doc_id or 0, doc_id is None, offset, len(frame), n)
        offset += len(frame)
    return b"".join([MAGIC, dictionary_hash(dictionary), struct.pack("<Q", len(rows)), index.tobytes(), *[f for _, _, f in rows]])


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark would use, so that executors and Spark mean the same file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()


def _connect(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """pyarrow's file system for a qualified path; it knows Hadoop's S3 schemes as s3."""
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return pyarrow.fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pyarrow.fs.FileSystem.from_uri("s3:" + rest if scheme in ("s3a", "s3n") else uri)


def write_dictionary(root: str, dictionary: bytes) -> None:
    fs, base = _connect(root)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/{dictionary_hash(dictionary).hex()}.dict") as out:
        out.write(dictionary)


def read_dictionary(root: str, name: bytes) -> bytes:
    """The dictionary with this hash."""
    fs, base = _connect(root)
    with fs.open_input_stream(f"{base}/{name.hex()}.dict") as f:
        data = f.read()
    if dictionary_hash(data) != name:
        raise ValueError("the dictionary does not have the hash that it is named by")
    return data


_MANIFEST = [("part", pa.int32()), ("number", pa.int32()), ("name", pa.string()), ("documents", pa.int64()), ("ids", pa.int64()), ("low", pa.int64()), ("high", pa.int64())]


def write_files(frames: DataFrame, root: str, dictionary: bytes, parts: int) -> DataFrame:
    """Files in ascending doc_id order, null ids first, equal ids by length and content; the manifest has a row a file: part,
    number in it, name, documents and ids in it, smallest and largest doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, number, held = TaskContext.get(), 0, 0
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal rows, number, held
            fs, base = _connect(root)
            fs.create_dir(base, recursive=True)
            name = f"{context.partitionId():06d}-{number:06d}-{context.taskAttemptId()}.ctok"
            with fs.open_output_stream(f"{base}/{name}") as out:
                out.write(file_bytes(rows, dictionary))
            known = [r[0] for r in rows if r[0] is not None]
            row = (context.partitionId(), number, name, len(rows), sum(r[1] for r in rows), min(known, default=None), max(known, default=None))
            rows, number, held = [], number + 1, 0
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, (_, k) in zip(row, _MANIFEST, strict=True)], [n for n, _ in _MANIFEST])

        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                rows.append(row)
                held += len(row[2])
                if len(rows) >= FILE or held >= FILE_BYTES:
                    yield flush()
        if rows:
            yield flush()

    order = ["doc_id", "n", "_h"]
    ordered = frames.withColumn("_h", F.xxhash64("frame")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return ordered.select("doc_id", "n", "frame").mapInArrow(run, "part int, number int, name string, documents bigint, ids bigint, low bigint, high bigint")


class TokenFile:
    """Random access to one file's documents; ``read(offset, size)`` fetches a range of its bytes."""

    HEAD = 24

    def __init__(self, read: Callable[[int, int], bytes], dictionary: bytes | Callable[[bytes], bytes]):
        head = read(0, self.HEAD)
        if head[:8] != MAGIC:
            raise ValueError("not a token file")
        found = dictionary(head[8:16]) if callable(dictionary) else dictionary
        if head[8:16] != dictionary_hash(found):
            raise ValueError("the file was written with another dictionary")
        (n,) = struct.unpack_from("<Q", head, 16)
        self.index = np.frombuffer(read(self.HEAD, n * _INDEX.itemsize), _INDEX, n)
        self._read, self._base = read, self.HEAD + n * _INDEX.itemsize
        self._open = zstandard.ZstdDecompressor(dict_data=_dict(found))

    def ids(self, i: int) -> bytes:
        return self._open.decompress(self._read(self._base + int(self.index["offset"][i]), int(self.index["size"][i])))

    def places(self, doc_id: int) -> range:
        """Places of the rows with this doc_id; ids ascend after the nulls."""
        nulls = int(self.index["null"].sum())
        low, high = (int(np.searchsorted(self.index["doc_id"][nulls:], doc_id, side)) for side in ("left", "right"))
        return range(nulls + low, nulls + high)


def read_document(spark: SparkSession, root: str, doc_id: int) -> list[list[int]]:
    """The ids of each row with this doc_id, end id included: of every file that may hold it, the index and the frames, nothing else."""
    root, out = _qualified(spark, root), []
    fs, base = _connect(root)
    names = spark.read.parquet(f"{root}/manifest").where((F.col("low") <= doc_id) & (F.col("high") >= doc_id)).orderBy("part", "number").select("name").collect()
    for r in names:
        with fs.open_input_file(f"{base}/{r.name}") as f:
            file = TokenFile(lambda at, size, f=f: f.read_at(size, at), lambda h: read_dictionary(root, h))
            out += [np.frombuffer(file.ids(i), "<u4").tolist() for i in file.places(doc_id)]
    return out


def read_files(manifest: DataFrame, root: str, dictionary: bytes) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files that the manifest lists."""
    w = Window.orderBy("part", "number")  # a row a file
    placed = manifest.select("name", (F.sum("ids").over(w) - F.col("ids")).alias("before"))
    spread = placed.repartition(max(1, min(2048, manifest.count())), "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _connect(root)
        for b in batches:
            for name, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(f"{base}/{name}") as f:
                    data = memoryview(f.read())
                file = TokenFile(lambda at, size, data=data: data[at : at + size].tobytes(), dictionary)
                n = file.index["n"].astype(np.int64)
                start = before + np.cumsum(n) - n
                found = [file.ids(i) for i in range(len(n))]
                if any(len(x) != 4 * k for x, k in zip(found, n.tolist(), strict=True)):
                    raise ValueError(f"{name}: index and frames differ")
                ids = pa.array(file.index["doc_id"].astype(np.int64), mask=file.index["null"].astype(bool))
                yield pa.RecordBatch.from_arrays([ids, pa.array(start), pa.array(n), pa.array([zlib.crc32(x) for x in found], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spread.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str, root: str | None = None) -> DataFrame:
    """op6: encode, write in doc_id order, read back. Null ids come first, equal ids in the order of their frames; an empty
    table gives no file."""
    root = _qualified(spark, root or scratch_path(spark, "token-files"))
    dictionary = train(docs, tokenizer)
    write_dictionary(root, dictionary)
    frames = stage(encode_frames(docs, tokenizer, dictionary), "frames")
    parts = max(1, -(-frames.count() // FILE))
    write_files(frames, root, dictionary, parts).write.parquet(f"{root}/manifest")
    discard(frames)
    return read_files(spark.read.parquet(f"{root}/manifest"), root, dictionary)
