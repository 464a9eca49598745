"""Sum-of-squares packing of token sequences.

A document goes where the sum over all residual gaps of the squared number of open bins with that gap becomes smallest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks
from .tokens import encode_block


def sum_of_squares(lens: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place in it of every item (1 <= length <= size), taken in the given order.

    With N[g] open bins of gap g, an item of length s changes the sum by 2 (N[g - s] - N[g] + 1) in a bin of gap g > s, by 1 - 2 N[s] in
    one of gap s, and by 2 N[size - s] + 1 in a new bin. Ties go to the smallest gap, to a new bin last.
    """
    count = np.zeros(size + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]
    bins, offsets, n = np.empty(len(lens), np.int64), np.empty(len(lens), np.int64), 0
    for i, s in enumerate(lens.tolist()):
        change = np.full(size - s + 2, np.iinfo(np.int64).max)
        here = count[s:]
        change[:-1] = np.where(here > 0, 2 * (count[: size - s + 1] - here + 1), change[:-1])
        if here[0]:
            change[0] = 1 - 2 * here[0]
        change[-1] = 2 * count[size - s] + 1 if s < size else 0
        gap = int(np.argmin(change)) + s
        if gap > size:
            gap, b, n = size, n, n + 1
        else:
            b = open_bins[gap].pop()
            count[gap] -= 1
        bins[i], offsets[i] = b, size - gap
        if gap > s:
            open_bins[gap - s].append(b)
            count[gap - s] += 1
    return bins, offsets


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: whole documents, or pieces of `size` of which the first may be shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in blocks(batches):
            ids, at = encode_block(tokenizer, buf, off, spaced=True)
            ids = np.insert(ids, at[1:], np.uint32(end_id))
            lens = np.diff(at) + 1
            pieces = -(-lens // size)
            row = np.repeat(np.arange(len(lens)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            head = lens - (pieces - 1) * size
            start = np.where(piece == 0, 0, head[row] + (piece - 1) * size)
            length = np.where(piece == 0, head[row], size)
            first = (np.cumsum(lens) - lens)[row] + start
            raw = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, size: int, items_per_task: int = 200_000) -> DataFrame:
    """Adds sequence_id and offset to rows with a length of 1 to size.

    Rows are dealt by a hash of their place into tasks of about items_per_task rows, equal rows like others, and each task packs its own rows,
    longest first. pieces should be written, so that a repeated task finds its rows at the same places.
    """
    names = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got).sort_by([("length", "descending"), *((k, "ascending") for k in names if k != "length")])
        bins, offsets = sum_of_squares(table.column("length").to_numpy(), size)
        ids = bins + (TaskContext.get().partitionId() << 40)
        yield from table.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets)).to_batches(max_chunksize=50_000)

    parts = max(1, -(-pieces.count() // items_per_task))
    schema = pieces.schema.simpleString()[len("struct<") : -1]
    return pieces.repartition(parts, F.monotonically_increasing_id()).mapInArrow(place, f"{schema},sequence_id:long,offset:long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = 2048) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null or empty text is a document of the end id alone. Null doc_ids and repeated rows are packed like others. An empty table gives no
    rows. Only longer documents are cut. Other columns are ignored.
    """
    from .common import checkpointed

    return pack(checkpointed(token_pieces(docs, tokenizer, end_id, size)), size)
