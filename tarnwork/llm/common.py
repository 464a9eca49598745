"""Shared pieces: columnar text kernels on numpy, shared-folder access."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import checkpointed, shared_dir  # noqa: F401  operators take both from here

#: 0x20 and 0x09-0x0D, the separators of a word
WS = np.zeros(256, bool)
WS[[32, 9, 10, 11, 12, 13]] = True
#: text bytes handled at once by a kernel; bounds its temporary arrays
BLOCK_BYTES = 4 << 20
#: bytes that are hashed at once
SPAN_BYTES = 1 << 17
#: stands for a missing doc_id, so that it orders before all others
NO_ID = -(2**63)

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(0, 2**63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FAR = _rng.integers(0, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GRAM = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Held:
    """The files that results made inside `with Held(spark)` still read; they stay until released(). Other results keep theirs."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __enter__(self) -> Held:
        self._token = _OPEN.set(self)
        return self

    def __exit__(self, *_: object) -> None:
        _OPEN.reset(self._token)

    def released(self) -> None:
        """Removes the files: for a caller that has stored these results."""
        deleted(self.spark, *self.paths)
        self.paths.clear()


_OPEN: ContextVar[Held | None] = ContextVar("open", default=None)


def new_dir(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder. Outside of any Held, what is put there stays for the caller to remove."""
    path, held = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}", _OPEN.get()
    if held:
        held.paths.append(path)
    return path


def written(df: DataFrame, kind: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, and the table's path, for deleted()."""
    path = new_dir(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def deleted(spark: SparkSession, *paths: str) -> None:
    """Removes folders that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside hand Python at most so many rows at once: for rows that hold long texts, several of them each."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def few(df: DataFrame, most: int = 200_000) -> DataFrame:
    """df, marked to be sent to every task if a count shows that it has no more than `most` rows; else a join deals both sides."""
    return F.broadcast(df) if df.count() <= most else df


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; any store that pyarrow reaches."""
    return pafs.FileSystem.from_uri(uri) if ":" in uri else (pafs.LocalFileSystem(), uri)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts batches into runs of whole rows with about `limit` bytes of text: rows, bytes, offsets."""
    for batch in batches:
        buf, off = text_bytes(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), buf[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to


def find_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words, and the n + 1 word offsets of the rows."""
    return find_runs(~WS[buf], off)


def find_runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of marked bytes, which end at the end of a row, and the n + 1 offsets of the rows in them."""
    begin, last = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = off[off < len(inside)]
    begin[edge] = inside[edge]
    edge = off[off > 0] - 1
    last[edge] = inside[edge]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def distinct_spans(data: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of consecutive spans of data, none of them empty: one of each distinct span, and for every span its place among those.

    Spans are found equal by a 64-bit hash and then compared byte by byte; should two that differ share a hash, all get another hash.
    """
    starts = np.cumsum(lens) - lens
    for salt in range(256):
        _, where, back = np.unique(hash_spans(data ^ np.uint8(salt), lens), return_index=True, return_inverse=True)
        like = where[back]
        if (lens[like] == lens).all() and _same_bytes(data, starts, starts[like], lens):
            return where, back
    raise RuntimeError("no hash tells the spans apart")


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, lens: np.ndarray) -> bool:
    """Whether each span from a equals the span from b; some at a time."""
    ends, at = np.cumsum(lens), 0
    while at < len(lens):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + SPAN_BYTES * 4, "right")))
        if (data[ragged(a[at:to], lens[at:to])] != data[ragged(b[at:to], lens[at:to])]).any():
            return False
        at = to
    return True


def string_array(data: np.ndarray, lens: np.ndarray) -> pa.Array:
    """Consecutive spans of UTF-8 as a string column."""
    off = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=off[1:])
    return pa.LargeStringArray.from_buffers(len(lens), pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())


def hash_spans(data: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """64-bit hashes of consecutive spans of data, none of them empty; some at a time, so that what is needed for each byte stays small."""
    ends = np.cumsum(lens)
    out, at = np.zeros(len(lens), np.uint64), 0
    while at < len(lens):
        begin = int(ends[at] - lens[at])
        to = max(at + 1, int(np.searchsorted(ends, begin + SPAN_BYTES, "right")))
        out[at:to] = _hash_few(data[begin : int(ends[to - 1])], lens[at:to])
        at = to
    return out


def _hash_few(data: np.ndarray, lens: np.ndarray) -> np.ndarray:
    first = np.cumsum(lens) - lens
    place = np.arange(len(data)) - np.repeat(first, lens)
    with np.errstate(over="ignore"):
        value = _BYTE[data] * _PLACE[place & 1023]
        if lens.max() > 1024:
            value *= _FAR[(place >> 10) & 4095]
        return mix(np.add.reduceat(value, first) ^ (lens.astype(np.uint64) * _GRAM[0]))


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of all words of a block, as find_words gave them."""
    return hash_spans(buf[~WS[buf]], ends - starts)


def hash_grams(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of n word hashes, over the whole block; runs over a row's end are for the caller to leave out."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = words[:m] * _GRAM[1]
        for k in range(1, n):
            total = total + words[k : k + m] * _GRAM[k + 1]
    return mix(total)


def gram_rows(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the runs of n words that stay inside a row, and the row of each."""
    count = np.maximum(np.diff(first) - n + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    start = np.repeat(first[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return start, row


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every run, one run after the other."""
    return np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())


def states_in_block(keys: np.ndarray, members: np.ndarray) -> np.ndarray:
    """For distinct pairs of a key and a member: 0 for a key with one member in this block, else 1 for its least member and 2 for the others."""
    order = np.argsort(keys)
    start = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
    count = np.diff(np.append(start, len(keys)))
    least = np.repeat(np.minimum.reduceat(members[order], start), count)
    state = np.zeros(len(keys), np.int8)
    state[order] = np.where(np.repeat(count, count) == 1, 0, np.where(members[order] == least, 1, 2))
    return state


def shared_members(rows: DataFrame) -> DataFrame:
    """(key, member), two longs, of all keys with two members or more; pairs may come twice. rows: key, member, state (states_in_block).

    Members that share a key inside a block of rows are known to share it, and only the least of them has to meet those of other blocks. So a key that
    a third of all rows have deals one row for each block to its task, and its other rows anywhere. Rows meet in sorted order and stream by.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last row so far, and whether its key had one before
        last: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, bool)]
        for batch in batches:
            key, member, state = (np.concatenate([h, batch.column(k).to_numpy()]) for k, h in enumerate(last[:3]))
            if not len(key):
                continue
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (member[1:] != member[:-1])])
            key, member, state = key[new], member[new], state[new]
            same = key[1:] == key[:-1]
            before = np.concatenate([last[3] if len(last[3]) else [False], same])
            shared = before | np.append(same, False) | (state > 0)
            shared[-1] = False
            last = [key[-1:], member[-1:], state[-1:], before[-1:]]
            if shared.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[shared]), pa.array(member[shared])], ["key", "member"])
        if len(last[0]) and (last[3][0] or last[2][0] > 0):
            yield pa.RecordBatch.from_arrays([pa.array(last[0]), pa.array(last[1])], ["key", "member"])

    place = F.when(F.col("state") < 2, F.col("key")).otherwise(F.xxhash64("key", "member"))
    return rows.repartition(place).sortWithinPartitions("key", "member", F.desc("state")).mapInArrow(meet, "key long, member long")


class Slots:
    """Numbers of 64-bit keys, as two sorted arrays: 16 bytes a key."""

    def __init__(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for those that have none."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.slots[at], -1)

    def add(self, keys: np.ndarray, slots: np.ndarray) -> None:
        """keys: sorted, and new."""
        at = np.searchsorted(self.keys, keys)
        self.keys, self.slots = np.insert(self.keys, at, keys), np.insert(self.slots, at, slots)


def flattened(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all lists, one after the other, and how many each has."""
    lens = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter((i for x in ids for i in x), np.uint32, int(lens.sum())), lens


class ChunkEncoder:
    """Ids of chunks of text; each distinct chunk is encoded once while it is cached. encode: of chunks, all ids one after the other and how many each has."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 700_000) -> None:
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.known = Slots()
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used, self.start, self.len = 0, np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)

    def _add(self, n: int, chunks: list[str]) -> None:
        """Ids of chunks under the numbers from n."""
        flat, lens = self.encode(chunks)
        need = self.used + len(flat)
        if need > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(need // 2, need - self.used), np.uint32)])
        if n + len(lens) > len(self.start):
            more = np.zeros(n // 2 + len(lens), np.int64)
            self.start, self.len = np.concatenate([self.start[:n], more]), np.concatenate([self.len[:n], more.astype(np.int32)])
        self.pool[self.used : need] = flat
        self.start[n : n + len(lens)] = self.used + np.cumsum(lens) - lens
        self.len[n : n + len(lens)] = lens
        self.used = need

    def __call__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, one after the other, and how many each has."""
        if len(self.known) > self.limit:
            self._clear()
        keys, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        slots = self.known.find(keys)
        new = np.flatnonzero(slots < 0)
        if len(new):
            raw, n = buf.tobytes(), len(self.known)
            for at in range(0, len(new), 20_000):
                part = where[new[at : at + 20_000]]
                self._add(n + at, [raw[a:b].decode() for a, b in zip(starts[part].tolist(), ends[part].tolist(), strict=True)])
            slots[new] = np.arange(n, n + len(new))
            self.known.add(keys[new], slots[new])
        slots = slots[back]
        lens = self.len[slots].astype(np.int64)
        return self.pool[ragged(self.start[slots], lens)], lens
