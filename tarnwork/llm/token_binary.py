"""Token-ID shards as wavelet matrices.

A shard file holds the ids of consecutive documents (ascending doc_id) as succinct bit planes, most significant bit first, in compressed
blocks with a directory of where they begin and how many ones come before. So the file answers access, rank (counting) and select (occurrence
lookup) without the plain ids, and without inflating more than the blocks that a question touches.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, new_dir, store, written
from .tokens import encode_block, vocabulary_size

MAGIC = b"TWM2"
#: words of 64 bits in a block of a plane
BLOCK_WORDS = 1024
#: ids after which a task begins another file
SHARD_TOKENS = 1 << 24
#: encoded chunks that a worker keeps; it holds little else
KEPT = 1_500_000


class WaveletMatrix:
    """Bit planes with rank directories over 64-bit words."""

    def __init__(self, n: int, planes: list[np.ndarray]) -> None:
        """planes: 64-bit words, bit i of a plane in word i // 64 at place i % 64, most significant plane first."""
        self.n, self.planes, self.levels = n, planes, len(planes)
        self.ones = [np.concatenate([[0], np.cumsum(np.bitwise_count(p), dtype=np.int64)]) for p in planes]
        self.zeros = [n - int(o[-1]) for o in self.ones]

    @classmethod
    def build(cls, ids: np.ndarray, levels: int | None = None) -> WaveletMatrix:
        if levels is None:
            levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        planes, seq = [], ids.astype(np.uint32)
        for level in range(levels):
            bit = ((seq >> np.uint32(levels - 1 - level)) & np.uint32(1)).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            planes.append(np.concatenate([packed, np.zeros(-len(packed) % 8, np.uint8)]).view(np.uint64))
            seq = np.concatenate([seq[~bit], seq[bit]])
        return cls(len(ids), planes)

    def _bits(self, level: int) -> np.ndarray:
        return np.unpackbits(self.planes[level].view(np.uint8), bitorder="little", count=self.n).astype(bool)

    def _rank1(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        planes = self.planes[level]
        low = planes[np.minimum(word, max(len(planes) - 1, 0))] & ((np.uint64(1) << bit) - np.uint64(1)) if len(planes) else np.zeros(len(at), np.uint64)
        return self.ones[level][word] + np.where(bit > 0, np.bitwise_count(low), 0)

    def _bit(self, level: int, at: np.ndarray) -> np.ndarray:
        return (self.planes[level][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)

    def _places(self, level: int, one: bool, k: np.ndarray) -> np.ndarray:
        """Places of the k-th (from 0, ascending) ones or zeros."""
        bits = self._bits(level)
        return np.flatnonzero(bits if one else ~bits)[k]

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at places."""
        at, out = np.asarray(at, np.int64), np.zeros(len(at), np.uint32)
        for level in range(self.levels):
            ones = self._rank1(level, at)
            bit = self._bit(level, at)
            out = (out << np.uint32(1)) | bit.astype(np.uint32)
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return out

    def ranks(self, symbol: int, to: np.ndarray) -> np.ndarray:
        """How often a symbol occurs before each place."""
        if symbol >> self.levels:
            return np.zeros(len(to), np.int64)
        at = np.concatenate([[0], to]).astype(np.int64)
        for level in range(self.levels):
            ones = self._rank1(level, at)
            at = self.zeros[level] + ones if (symbol >> (self.levels - 1 - level)) & 1 else at - ones
        return at[1:] - at[0]

    def rank(self, symbol: int, to: int) -> int:
        return int(self.ranks(symbol, np.array([to]))[0])

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def select(self, symbol: int, k: np.ndarray) -> np.ndarray:
        """Places of the k-th (from 0, ascending) occurrences of a symbol that has so many, from the last plane up."""
        at = np.zeros(1, np.int64)
        for level in range(self.levels):
            ones = self._rank1(level, at)
            at = self.zeros[level] + ones if (symbol >> (self.levels - 1 - level)) & 1 else at - ones
        at = at + np.asarray(k, np.int64)
        for level in reversed(range(self.levels)):
            one = bool((symbol >> (self.levels - 1 - level)) & 1)
            at = self._places(level, one, at - self.zeros[level] if one else at)
        return at

    def occurrences(self, symbol: int) -> np.ndarray:
        """All places of a symbol, ascending."""
        return self.select(symbol, np.arange(self.count(symbol)))

    def decode(self) -> np.ndarray:
        """All ids, by undoing the stable partitions from the last plane up."""
        seq = np.zeros(self.n, np.uint32)
        for level in reversed(range(self.levels)):
            bits, z = self._bits(level), self.zeros[level]
            up = np.empty(self.n, np.uint32)
            up[~bits] = seq[:z]
            up[bits] = seq[z:] | np.uint32(1 << (self.levels - 1 - level))
            seq = up
        return seq


def dump_shard(matrix: WaveletMatrix, doc_ids: np.ndarray, anonymous: np.ndarray, lens: np.ndarray) -> bytes:
    """header | directory | documents | blocks of planes. All numbers are little-endian.

    The header has the numbers of planes, ids and documents. The directory has, plane after plane, where each block begins, where the last one
    ends, and the ones before each block and in all. A block has BLOCK_WORDS words of a plane, compressed by itself unless that makes it larger.
    """
    pack = zstandard.ZstdCompressor(level=1).compress
    parts = [pack(np.ascontiguousarray(x).tobytes()) for x in (doc_ids.astype("<i8"), anonymous.astype("u1"), lens.astype("<i8"))]
    bodies, places, ones = [], [], []
    at = sum(map(len, parts))
    for level, plane in enumerate(matrix.planes):
        starts = np.arange(0, len(plane), BLOCK_WORDS)
        for start in starts.tolist():
            raw = plane[start : start + BLOCK_WORDS].astype("<u8").tobytes()
            small = pack(raw)
            bodies.append(small if len(small) < len(raw) else raw)
            places.append(at)
            at += len(bodies[-1])
        places.append(at)
        ones += [matrix.ones[level][starts], matrix.ones[level][-1:]]
    head = struct.pack("<4sIQQ3Q", MAGIC, matrix.levels, matrix.n, len(doc_ids), *map(len, parts))
    directory = np.concatenate([np.array(places, np.int64), *ones]).astype("<u8").tobytes() if bodies or matrix.levels else b""
    return b"".join([head, directory, *parts, *bodies])


class ShardFile(WaveletMatrix):
    """A shard read through its directory: access, rank and select read and inflate no more than the blocks that they touch."""

    def __init__(self, file, kept: int = 512) -> None:
        """file: has seek and read. kept: blocks that are held."""
        self.file = file
        file.seek(0)
        magic, self.levels, self.n, self.n_docs, *sizes = struct.unpack("<4sIQQ3Q", file.read(48))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        words = -(-self.n // 64)
        self.blocks = -(-words // BLOCK_WORDS)
        count = self.levels * (self.blocks + 1)
        directory = np.frombuffer(file.read(16 * count), "<u8").astype(np.int64)
        self.data = 48 + 16 * count
        self.places, self.ones = directory[:count].reshape(self.levels, -1), directory[count:].reshape(self.levels, -1)
        self.zeros = [self.n - int(x) for x in self.ones[:, -1]]
        self.sizes, self.words, self.read = sizes, words, lru_cache(maxsize=kept)(self._read)

    def _read(self, level: int, block: int) -> np.ndarray:
        lo, hi = self.places[level, block : block + 2].tolist()
        want = 8 * min(BLOCK_WORDS, self.words - block * BLOCK_WORDS)
        self.file.seek(self.data + lo)
        raw = self.file.read(hi - lo)
        return np.frombuffer(raw if len(raw) == want else zstandard.ZstdDecompressor().decompress(raw, max_output_size=want), "<u8")

    def documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """doc_id, whether it is null, and the number of ids of each document."""
        self.file.seek(self.data)
        parts = [zstandard.ZstdDecompressor().decompress(self.file.read(size), max_output_size=most) if self.n_docs else b"" for size, most in zip(self.sizes, (8 * self.n_docs, self.n_docs, 8 * self.n_docs), strict=True)]
        return np.frombuffer(parts[0], "<i8"), np.frombuffer(parts[1], "u1") > 0, np.frombuffer(parts[2], "<i8")

    def _each_block(self, level: int, block: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        for b in np.unique(block).tolist():
            yield np.flatnonzero(block == b), self.read(level, b), b

    def _bits(self, level: int) -> np.ndarray:
        plane = np.concatenate([self.read(level, b) for b in range(self.blocks)]) if self.blocks else np.zeros(0, np.uint64)
        return np.unpackbits(plane.view(np.uint8), bitorder="little", count=self.n).astype(bool)

    def _bit(self, level: int, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for own, plane, b in self._each_block(level, at // (64 * BLOCK_WORDS)):
            place = at[own] - b * 64 * BLOCK_WORDS
            out[own] = (plane[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)
        return out

    def _rank1(self, level: int, at: np.ndarray) -> np.ndarray:
        out = np.full(len(at), self.ones[level, -1], np.int64)
        inner = np.flatnonzero(at < self.n)
        for own, plane, b in self._each_block(level, at[inner] // (64 * BLOCK_WORDS)):
            place = at[inner[own]] - b * 64 * BLOCK_WORDS
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(plane), dtype=np.int64)])
            low = plane[place >> 6] & ((np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1))
            out[inner[own]] = self.ones[level, b] + before[place >> 6] + np.bitwise_count(low)
        return out

    def _places(self, level: int, one: bool, k: np.ndarray) -> np.ndarray:
        before = self.ones[level, :-1] if one else np.arange(self.blocks) * 64 * BLOCK_WORDS - self.ones[level, :-1]
        out = np.zeros(len(k), np.int64)
        for own, plane, b in self._each_block(level, np.searchsorted(before, k, "right") - 1):
            bits = np.unpackbits(plane.view(np.uint8), bitorder="little").astype(bool)
            out[own] = np.flatnonzero(bits if one else ~bits)[k[own] - before[b]] + b * 64 * BLOCK_WORDS
        return out


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, spaced: bool = False, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes files of about shard_tokens ids in ascending doc_id order; returns (part, number, path, n_docs, n_tokens), a row for each file, in order of part and number.

    Each attempt of a task writes files of its own, and only rows of tasks that ended well name theirs. Planes are as many as the vocabulary
    needs. Rows that share a doc_id, which a third of all may, are dealt by their texts as well and, if these are equal, by their places.
    """
    levels = max(vocabulary_size(tokenizer) - 1, end_id, 1).bit_length()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], [], []]
        size, number = 0, 0

        def flush() -> pa.RecordBatch:
            task = TaskContext.get()
            path = f"{folder}/ids-{task.partitionId():06d}-{number:06d}-{task.taskAttemptId()}.twm"
            ids, lens, doc_ids, anonymous = (np.concatenate(x) for x in held)
            if int(ids.max()) >> levels:
                raise ValueError(f"an id needs more than {levels} planes")
            fs, name = store(path)
            fs.create_dir(name.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(name) as out:
                out.write(dump_shard(WaveletMatrix.build(ids, levels), doc_ids, anonymous, lens))
            return pa.RecordBatch.from_pydict({"part": [task.partitionId()], "number": [number], "path": [path], "n_docs": [len(doc_ids)], "n_tokens": [len(ids)]}, pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        for rows, buf, off in (x for batch in batches for x in blocks(iter([batch]))):
            got, at = encode_block(tokenizer, buf, off, spaced, KEPT)
            for column, value in zip(held, (np.insert(got, at[1:], np.uint32(end_id)), np.diff(at) + 1, rows.column("doc_id").to_numpy(), rows.column("anonymous").to_numpy(zero_copy_only=False)), strict=True):
                column.append(value)
            size += len(held[0][-1])
            if size >= shard_tokens:
                yield flush()
                held, size, number = [[], [], [], []], 0, number + 1
        if held[0]:
            yield flush()

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("anonymous"), text.alias("text"), F.xxhash64(text).alias("_tie"))
    named = ~F.col("anonymous")
    return rows.repartitionByRange(named, "doc_id", "_tie", F.monotonically_increasing_id()).sortWithinPartitions(named, "doc_id", "_tie").drop("_tie").mapInArrow(write, "part int, number int, path string, n_docs long, n_tokens long")


def read_shards(manifest: DataFrame, end_id: int) -> DataFrame:
    """Rows of written shards: doc_id, start, n_tokens, ids_crc32, first_id (by access), n_ends (end ids in it, by rank), end_at (the place of its end id, by select)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(*(batch.column(k).to_pylist() for k in ("path", "base")), strict=True):
                fs, name = store(path)
                with fs.open_input_file(name) as file:
                    shard = ShardFile(io.BytesIO(file.read()), kept=1 << 20)  # here all of it is read
                doc_ids, anonymous, lens = shard.documents()
                ends = np.cumsum(lens)
                raw = shard.decode().astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - lens).tolist(), ends.tolist(), strict=True)]
                ranks = shard.ranks(end_id, np.concatenate([[0], ends]))
                end_at = shard.select(end_id, ranks[1:] - 1) - (ends - lens)
                columns = [pa.array(doc_ids, mask=anonymous), pa.array(base + ends - lens), pa.array(lens), pa.array(crc, pa.int64()), pa.array(shard.access(ends - lens).astype(np.int64)), pa.array(np.diff(ranks)), pa.array(end_at)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "first_id", "n_ends", "end_at"])

    spark = manifest.sparkSession
    files, base = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("files")).orderBy("part").collect(), 0
    bases = []
    for x in files:
        bases.append((x["part"], base))
        base += x["n"]
    before = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("number")) - F.col("n_tokens")
    table = manifest.join(F.broadcast(spark.createDataFrame(bases, "part int, base long")), "part").withColumn("base", F.col("base") + before)
    return table.select("path", "base").repartitionByRange(max(1, sum(x["files"] for x in files)), "base").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, first_id long, n_ends long, end_at long")


def token_shards(docs: DataFrame, tokenizer: str, end_id: int = 2, spaced: bool = False, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encodes whole texts, writes the shards, reads them back.

    Null text counts as empty (only the end id); a null doc_id orders before all others; rows with equal doc_id follow one another by a hash of
    their text. An empty table gives no file and no rows. Columns other than doc_id and text are ignored. The list of files is a table; the
    driver holds a row for each task that wrote some.
    """
    manifest, _ = written(write_shards(docs, new_dir(docs.sparkSession, "token-ids"), tokenizer, end_id, spaced, shard_tokens), "manifest")
    return read_shards(manifest, end_id)
