"""Best-fit packing by the sum-of-squares rule.

Each piece goes into the open bin for which the sum over all gaps g of (number of open bins with gap g) squared becomes
smallest; a fresh bin is opened only if none takes it, since bins opened to even out the counts would stay half empty
when the pieces end. The rule sees sizes only; pieces are dealt at random into groups of a fixed size and each group is packed in one task, longest
pieces first, so work is linear, memory bounded, and what a group leaves open is a small share of its bins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import loaded
from .common import give_back, slices
from .common import stage_thin as stage

LENGTH = 2048
#: Pieces a group of bins is dealt on average.
GROUP = 65_536
END_ID = 0
_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut_lengths(n: int, length: int = LENGTH) -> list[int]:
    """Lengths of a document's pieces: all full, but the first may be shorter."""
    head = n % length
    return ([head] if head else []) + [length] * (n // length)


def tokenized_pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, remember: bool = True) -> DataFrame:
    """A row for each piece of each document, its end id included; a null text is empty. remember: see pack_documents."""
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what other operators left
        bpe = loaded(tokenizer)
        for b in batches:
            out: list[tuple] = []
            for doc_id, ids in zip(b.column(0).to_pylist(), bpe.encode(slices(b.column(1))), strict=True):
                ids += end
                start = 0
                for i, n in enumerate(cut_lengths(len(ids) // 4, length)):
                    out.append((doc_id, i, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])))
                    start += n
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        bpe.rest(remember)

    return docs.select("doc_id", "text").mapInArrow(run, _PIECES)


def sum_of_squares(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, taken in the given order. Sizes are 1..length; a tie goes to the smallest gap that takes the item."""
    count = np.zeros(length + 1, np.int64)  # open bins by gap
    bins: list[list[int]] = [[] for _ in range(length + 1)]
    where, offset, used = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    for i, s in enumerate(sizes.tolist()):
        gap = -1
        open_gaps = count[s:] > 0
        if open_gaps.any():
            # change of the sum: gap g loses a bin, gap g - s gains one; gap 0 is not counted
            change = count[: length + 1 - s] - count[s:]
            change[1:] *= 2
            change[1:] += 2
            change[0] = 1 - 2 * count[s]
            change[~open_gaps] = np.iinfo(np.int64).max
            gap = int(change.argmin()) + s
        if gap < 0:
            b, at, left = used, 0, length - s
            used += 1
        else:
            b = bins[gap].pop()
            count[gap] -= 1
            at, left = length - gap, gap - s
        where[i], offset[i] = b, at
        if left:
            bins[left].append(b)
            count[left] += 1
    return where, offset


def pack(pieces: DataFrame, groups: int, length: int = LENGTH) -> DataFrame:
    """pieces plus sequence_id and offset. Groups are dealt by each row's place in pieces, which must read the same again
    (a written table does), so that equal rows spread over all groups."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        group = int(pdf["_g"].iloc[0])
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        where, offset = sum_of_squares(pdf["length"].to_numpy(np.int64), length)
        return pdf.assign(sequence_id=where + (group << 40), offset=offset).drop(columns="_g")

    dealt = pieces.withColumn("_g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    return dealt.groupBy("_g").applyInPandas(run, f"{_PIECES}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, group: int = GROUP, remember: bool = True) -> DataFrame:
    """op2: a row for each piece of each row of docs, with its sequence and place.

    A null or empty text is one piece of the end id alone. Repeated rows and null ids are packed like any other. An empty
    table gives no row. remember: Python workers keep known parts of texts for their next task, which saves time, but holds
    memory in workers that other operators use afterwards.
    """
    pieces = stage(tokenized_pieces(docs, tokenizer, length, remember=remember), "pieces")
    return pack(pieces, max(1, pieces.count() // group), length)
