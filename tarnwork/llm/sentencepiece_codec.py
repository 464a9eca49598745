"""Encoding and decoding with the pieces of a SentencePiece model file.

An Aho-Corasick automaton over the pieces runs over a text once; at each place its output links give all pieces that end there, and the best
score of the place is relaxed from the places where they begin. The segmentation has the largest sum of piece scores; among equals the
longer last piece wins. This is what the library does with the same file marked as a unigram model.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ChunkEncoder, blocks, flattened, hash_spans, ragged

BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: an unknown character costs so much more than the worst piece
UNKNOWN_PENALTY = 10.0


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value, at, shift = value | (byte & 127) << shift, at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protobuf message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = (8, at) if kind == 1 else (4, at) if kind == 5 else _varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Codec:
    """Pieces of a model file. Models that change texts before they cut them are refused."""

    def __init__(self, data: bytes) -> None:
        import ahocorasick

        self.pieces, self.scores, self.kinds, self.dummy = [], [], [], True
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif field == 3:
                spec = dict(_fields(value))
                self.dummy = bool(spec.get(3, 1))
                if spec.get(1, b"identity") != b"identity" or spec.get(4, 1) or not spec.get(5, 1):
                    raise ValueError("only models that keep texts as they are can be used")
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        usable = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER_DEFINED)]
        self.unknown_score = min(self.scores[i] for i in usable) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for i in usable:
            self.automaton.add_word(self.pieces[i], (len(self.pieces[i]), self.scores[i], i))
        self.automaton.make_automaton()
        #: whether every piece has its blanks at its start: then texts may be cut before a blank that follows another character
        self.separable = not any(BLANK in self.pieces[i].lstrip(BLANK) for i in usable)
        raw = [self._raw(i) for i in range(len(self.pieces))]
        self.size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.start, self.pool = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(raw), np.uint8)
        self.encoder = ChunkEncoder(lambda chunks: flattened([self.segment(c.replace(" ", BLANK)) for c in chunks]), limit=250_000)

    def _raw(self, i: int) -> bytes:
        if self.kinds[i] == BYTE:
            return bytes([int(self.pieces[i][1:-1], 16)])
        return {UNKNOWN: " ⁇ ", CONTROL: ""}.get(self.kinds[i], self.pieces[i].replace(BLANK, " ")).encode()

    def segment(self, text: str) -> list[int]:
        """Ids of the best segmentation; characters without a piece become bytes."""
        n = len(text)
        score, origin, used = [0.0] + [-np.inf] * n, [0] * (n + 1), [-1] * (n + 1)
        last, single = 0, True  # the last place relaxed, and whether a piece of one character ends there
        for end, (size, gain, piece) in self.automaton.iter(text):
            end += 1
            while last < end:
                if not single and score[last - 1] + self.unknown_score > score[last]:
                    score[last], origin[last], used[last] = score[last - 1] + self.unknown_score, last - 1, -1
                last, single = last + 1, False
            single = single or size == 1
            if score[end - size] + gain > score[end]:
                score[end], origin[end], used[end] = score[end - size] + gain, end - size, piece
        while last <= n:
            if not single and score[last - 1] + self.unknown_score > score[last]:
                score[last], origin[last], used[last] = score[last - 1] + self.unknown_score, last - 1, -1
            last, single = last + 1, False
        out, at = [], n
        while at:
            if used[at] >= 0:
                out.append(used[at])
            elif self.bytes:
                out.extend(self.bytes[b] for b in reversed(text[origin[at] : at].encode()))
            elif not (out and out[-1] == self.unknown):
                out.append(self.unknown)
            at = origin[at]
        return out[::-1]

    def encode_block(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows of a block, and the n + 1 offsets of the rows in them."""
        size = np.diff(off)
        more = ((size > 0) & self.dummy).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(size + more)])
        text = np.full(at[-1], 32, np.uint8)
        text[ragged(at[:-1] + more, size)] = buf
        cut = np.zeros(len(text), bool)
        if self.separable and len(text):
            cut[1:] = (text[1:] == 32) & (text[:-1] != 32)
        cut[at[:-1][np.diff(at) > 0]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(text))[: len(starts)]
        ids, lens = self.encoder(text, starts, ends, hash_spans(text, ends - starts))
        return ids, np.concatenate([[0], np.cumsum(lens)])[np.searchsorted(starts, at)]

    def decode_block(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """Texts of rows of ids with n + 1 offsets. The blank that was put before a text goes; so does a piece of control."""
        raw = self.pool[ragged(self.start[ids], self.size[ids])].tobytes()
        ends = np.concatenate([[0], np.cumsum(self.size[ids])])[at].tolist()
        texts = [raw[a:b].decode(errors="replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return [t[1:] if self.dummy and t.startswith(" ") else t for t in texts]


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One for each worker process and file."""
    if path not in _CODECS:
        with open(path, "rb") as f:
            _CODECS[path] = Codec(f.read())
    return _CODECS[path]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, text, ids (array<int>), ids_crc32 (of the ids as little-endian 32-bit integers).

    Null and empty text have no ids; null doc_ids and repeated rows are encoded like others; an empty table gives no rows. Other columns are
    ignored. model: a file that every worker can open.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in blocks(batches):
            ids, at = codec(model).encode_block(buf, off)
            raw = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text"), lists, pa.array(crc, pa.int64())], ["doc_id", "text", "ids", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, text string, ids array<int>, ids_crc32 long")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """Adds decoded (string) to rows with ids. A null list decodes to an empty text."""
    schema = encoded.schema.simpleString()[len("struct<") : -1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                rows = batch.slice(start, 1000)
                column = rows.column("ids")
                sizes = np.nan_to_num(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
                texts = codec(model).decode_block(column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)]))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], [*rows.schema.names, "decoded"])

    import pyarrow.compute  # noqa: F401  makes pa.compute there for the workers

    return encoded.mapInArrow(scan, f"{schema},decoded:string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, decoded_sha256, round_trip (whether the decoded ids are the text; U+2581 in a text comes back as a blank)."""
    out = decode(encode(docs, model), model)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))
