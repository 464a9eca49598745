"""Removal of repeated passages, found by matching statistics over compressed FM-indexes.

A window is a run of `span` words. Its anchor is the least hash among its runs of ANCHOR words, so equal windows have equal anchors, and
neighbouring windows mostly share theirs: a text becomes a chain of segments, each with one anchor. Anchors that come in one document only
cannot have a repeated window and end there. Segments of the others go to shards by anchor. A shard indexes its distinct segments: the
Burrows-Wheeler transform of their words in a wavelet matrix. Segments are then streamed against it from the right: backward search
narrows an interval of suffixes word by word and stops at `span` words; for each match of that length the smallest document of its interval
is reported.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, NO_ID, blocks, find_runs, find_words, gram_rows, hash_grams, hash_spans, hash_words, mix, ragged, text_bytes
from .token_binary import WaveletMatrix

#: words of an anchor
ANCHOR = 5
#: of an anchor's hash 48 bits are kept, which shuffle in two bytes less; two anchors of one hash only meet in vain
ANCHOR_BITS = np.uint64(2**64 - 2**16)
#: an anchor in more segments, or with more words in them, is split: each of its windows is dealt by its own hash
HOT, HOT_WORDS = 5_000, 1_000_000
#: words of the segments that one index holds, if no anchor has more
SHARD_WORDS = 250_000
#: suffixes whose smallest document is stored together
RUN = 64
#: bytes of segments in a batch
PIECE_BYTES = 1 << 27


class FMIndex:
    """Backward search over segments of symbols (1, 2, ...); weights: a number for each segment."""

    def __init__(self, symbols: np.ndarray, lens: np.ndarray, weights: np.ndarray) -> None:
        """symbols: those of all segments, one after the other."""
        ends = np.cumsum(lens + 1) - 1
        text = np.zeros(len(symbols) + len(lens), np.int64)
        inside = np.ones(len(text), bool)
        inside[ends] = False
        text[inside] = symbols
        order = self._suffixes(text, inside)
        self.matrix = WaveletMatrix.build(text[order - 1])
        count = np.bincount(text, minlength=int(symbols.max()) + 1 if len(symbols) else 1)
        self.below = np.concatenate([[0], np.cumsum(count)])
        self.base = self._step(np.arange(len(count)), np.zeros(len(count), np.int64))
        self.names, ranks = np.unique(weights, return_inverse=True)
        self.low = np.repeat(ranks.astype(np.int32), lens + 1)[order]
        self.minima = [np.minimum.reduceat(self.low, np.arange(0, len(self.low), RUN))]
        while (half := 1 << (len(self.minima) - 1)) * 2 <= len(self.minima[0]):
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-half], last[half:]))

    def nbytes(self) -> int:
        """Bytes that the index takes: planes with their ranks, numbers of weights, and minima of runs."""
        return sum(p.nbytes for p in self.matrix.planes) + sum(o.nbytes for o in self.matrix.ones) + self.low.nbytes + sum(m.nbytes for m in self.minima) + self.names.nbytes + self.below.nbytes + self.base.nbytes

    @staticmethod
    def _suffixes(text: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Suffix array by doubling; every end of a segment is a symbol of its own, so ranks part after the longest segment."""
        rank = np.where(inside, text + len(text), np.cumsum(~inside))
        step, most = 1, int(rank.max()) + 2 if len(rank) else 2
        while True:
            key = rank * most  # both ranks in one number, which sorts faster than two
            key[:-step] += rank[step:] + 1
            order = np.argsort(key)
            new = np.diff(key[order]) != 0
            rank = np.empty(len(text), np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(new)])
            step, most = step * 2, len(text) + 2
            if new.all() or step >= len(text):
                return order

    def _step(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        levels = len(self.matrix.planes)
        for level in range(levels):
            ones = self.matrix._rank1(level, at)
            at = np.where((symbols >> (levels - 1 - level)) & 1 == 1, self.matrix.zeros[level] + ones, at - ones)
        return at

    def extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of symbol + match, from those of the matches."""
        base = self.below[symbols] - self.base[symbols]
        both = self._step(np.concatenate([symbols, symbols]), np.concatenate([lo, hi]))
        return base + both[: len(symbols)], base + both[len(symbols) :]

    def _scanned(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The smallest number between two places, which are less than two runs apart; beyond all numbers where there is none."""
        out = np.full(len(lo), len(self.names), np.int64)
        some = np.flatnonzero(hi > lo)
        if len(some):
            lens = hi[some] - lo[some]
            out[some] = np.minimum.reduceat(self.low[ragged(lo[some], lens)], np.cumsum(lens) - lens)
        return out

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The smallest weight in each interval, none of them empty: of the whole runs in it by their minima, of its ends by looking at each place."""
        out = np.empty(len(lo), np.int64)
        for at in range(0, len(lo), 1 << 15):
            a, b = lo[at : at + (1 << 15)], hi[at : at + (1 << 15)]
            first, last = -(-a // RUN), b // RUN
            whole = first < last
            best = np.minimum(self._scanned(a, np.where(whole, first * RUN, b)), self._scanned(np.where(whole, last * RUN, b), b))
            level = np.zeros(len(a), np.int64)
            level[whole] = np.int64(np.floor(np.log2((last - first)[whole])))
            for k in np.unique(level[whole]):
                own = np.flatnonzero(whole & (level == k))
                best[own] = np.minimum(best[own], np.minimum(self.minima[k][first[own]], self.minima[k][last[own] - (1 << int(k))]))
            out[at : at + len(a)] = self.names[best]
        return out

    def matches(self, symbols: np.ndarray, ends: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each end (exclusive, 1 at least) in a stream of symbols: the length, up to span, of the longest match that ends there, and its interval."""
        last = symbols[ends - 1]
        lo, hi = self.below[last], self.below[last + 1]  # all suffixes that begin with the last symbol
        length = np.minimum(hi - lo, 1)
        live = np.flatnonzero(length)
        for k in range(2, span + 1):
            live = live[(ends[live] >= k)]
            down, up = self.extend(symbols[ends[live] - k], lo[live], hi[live])
            live = live[found := up > down]
            lo[live], hi[live], length[live] = down[found], up[found], k
        return length, lo, hi


def _segments(buf: np.ndarray, off: np.ndarray, span: int) -> tuple:
    """Runs of windows with one anchor: row, first window (word number in the block), windows, anchor; and the words of the block."""
    starts, ends, first = find_words(buf, off)
    words = hash_words(buf, starts, ends)
    place, row = gram_rows(first, span)
    if not len(place):
        return np.zeros(0, np.int64), place, place, np.zeros(0, np.uint64), starts, ends, first, words
    least, width = hash_grams(words, ANCHOR), 1
    want = span - ANCHOR + 1
    while width * 2 <= want:
        least, width = np.minimum(least[:-width], least[width:]), width * 2
    if width < want:
        least = np.minimum(least[: len(least) - (want - width)], least[want - width :])
    anchor = least[place] & ANCHOR_BITS
    new = np.ones(len(place), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], place[at], np.diff(np.append(at, len(place))), anchor[at], starts, ends, first, words


def _anchors(docs: DataFrame, span: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in blocks(batches):
            row, _, windows, anchor, *_ = _segments(buf, off, span)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), rows.column("doc_id").take(pa.array(row)), pa.array((windows + span - 1).astype(np.int32))], ["anchor", "doc_id", "words"])

    return docs.select("doc_id", "text").mapInArrow(scan, "anchor long, doc_id long, words int")


def _packed(docs: DataFrame) -> DataFrame:
    """docs with each text compressed, and its size: it is shuffled in two thirds of the bytes that a shuffle's own codec, which sees small blocks, brings it to."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            buf, off = text_bytes(batch.column("text"))
            data, at = memoryview(buf), off.tolist()
            packed = [codec.compress(data[a:b], asbytes=True) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "_key", "_anonymous")), pa.array(packed, pa.binary()), pa.array(np.diff(off))], ["doc_id", "_key", "_anonymous", "packed", "size"])

    return docs.select("doc_id", "_key", "_anonymous", "text").mapInArrow(pack, "doc_id long not null, _key long, _anonymous boolean, packed binary, size long")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Like blocks(), of packed texts: rows, bytes, offsets. No more than a block is unpacked at once."""
    codec = pa.Codec("zstd")
    for batch in batches:
        sizes = batch.column("size").to_numpy()
        off, at = np.concatenate([[0], np.cumsum(sizes)]), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + BLOCK_BYTES, "right")) - 1)
            rows = batch.slice(at, to - at)
            data = b"".join(codec.decompress(x.as_buffer(), n, asbytes=True) for x, n in zip(rows.column("packed"), sizes[at:to].tolist(), strict=True))
            yield rows, np.frombuffer(data, np.uint8), off[at : to + 1] - off[at]
            at = to


def _cut(docs: DataFrame, span: int, of_hot: bool) -> DataFrame:
    """A row for each segment of each row of docs (doc_id, _rank, packed, size, shared, hot) whose anchor is shared, and hot or not; those of hot anchors are single windows, and have two hashes of their words (h1, h2)."""
    names = ["doc_id", "_rank", "start", "anchor", *(["h1", "h2"] if of_hot else []), "words"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in _unpacked(batches):
            row, place, windows, anchor, starts, ends, first, words = _segments(buf, off, span)
            shared, hot = rows.column("shared"), rows.column("hot")
            keep, many = np.zeros(len(row), bool), np.zeros(len(row), bool)
            bounds = np.searchsorted(row, np.arange(rows.num_rows + 1))
            for i in np.flatnonzero(shared.is_valid().to_numpy(zero_copy_only=False)):
                own = anchor[bounds[i] : bounds[i + 1]]
                keep[bounds[i] : bounds[i + 1]] = np.isin(own, shared[i].values.to_numpy().view(np.uint64))
                many[bounds[i] : bounds[i + 1]] = np.isin(own, hot[i].values.to_numpy().view(np.uint64))
            lens = ends - starts
            at = np.cumsum(lens + 1) - (lens + 1)
            line = np.full(int((lens + 1).sum()), 32, np.uint8)
            line[ragged(at, lens)] = buf[ragged(starts, lens)]
            own = np.flatnonzero(keep & (many if of_hot else ~many))
            if of_hot:
                s_row, s_at = np.repeat(row[own], windows[own]), ragged(place[own], windows[own])
                s_n = np.full(len(s_at), span)
                s_anchor = mix(hash_grams(words, span)[s_at]) if len(s_at) else np.zeros(0, np.uint64)
            else:
                s_row, s_at, s_n, s_anchor = row[own], place[own], windows[own] + span - 1, anchor[own]
            lo, hi = at[s_at], at[s_at + s_n - 1] + lens[s_at + s_n - 1] if len(s_at) else at[s_at]
            if of_hot:
                word_sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words + np.uint64(77)) * (np.arange(len(words), dtype=np.uint64) * np.uint64(2) + np.uint64(1)), dtype=np.uint64)])
                plain = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words + np.uint64(77)), dtype=np.uint64)])
                with np.errstate(over="ignore"):  # a sum of words times their odd places from the segment's start
                    h2 = mix(word_sums[s_at + s_n] - word_sums[s_at] - (plain[s_at + s_n] - plain[s_at]) * (s_at.astype(np.uint64) * np.uint64(2)))
            size = np.cumsum(hi - lo)
            cuts = np.unique(np.concatenate([[0], np.searchsorted(size, np.arange(PIECE_BYTES, int(size[-1]) if len(size) else 0, PIECE_BYTES)) + 1, [len(lo)]]))
            for p, q in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):  # one very long text makes several batches
                lens = hi[p:q] - lo[p:q]
                data = line[ragged(lo[p:q], lens)]
                edge = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
                blobs = pa.Array.from_buffers(pa.binary(), q - p, [None, pa.py_buffer(edge.tobytes()), pa.py_buffer(data.tobytes())])
                at_row = pa.array(s_row[p:q])
                hashes = [pa.array(hash_spans(data, lens).view(np.int64)), pa.array(h2[p:q].view(np.int64))] if of_hot else []
                columns = [pa.array((s_at - first[s_row])[p:q].astype(np.int32)), pa.array(s_anchor[p:q].view(np.int64)), *hashes, blobs]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(at_row), rows.column("_rank").take(at_row), *columns], names)

    kinds = {"_rank": "int", "start": "int", "words": "binary"}
    return docs.mapInArrow(scan, ", ".join(f"{k} {kinds.get(k, 'long')}" for k in names))


def _answers(segments: list[bytes], first: list[int], span: int) -> tuple[np.ndarray, np.ndarray]:
    """For the windows of all segments, one after the other, the smallest document that holds each; and how many windows each segment has."""
    ids: dict[bytes, int] = {}
    split = [s.split(b" ") for s in segments]
    symbols = np.fromiter((ids.setdefault(w, len(ids) + 1) for words in split for w in words), np.int64)
    lens = np.fromiter(map(len, split), np.int64, len(split))
    index = FMIndex(symbols, lens, np.array(first, np.int64))
    windows = lens - span + 1
    ends = ragged(np.cumsum(lens) - lens, windows) + span
    # windows of equal words stream as one: by a hash, and looked at word by word
    _, where, back = np.unique(hash_grams(mix(symbols.astype(np.uint64)), span)[ends - span], return_index=True, return_inverse=True)
    same, first_of = np.ones(len(ends), bool), where[back]
    for k in range(1, span + 1):
        same &= symbols[ends - k] == symbols[ends[first_of] - k]
    other = np.flatnonzero(~same)
    asked = np.concatenate([where, other])
    found = np.full(len(asked), np.iinfo(np.int64).max)
    for at in range(0, len(asked), 1 << 17):
        part = ends[asked[at : at + (1 << 17)]]
        length, lo, hi = index.matches(symbols, part, span)
        hit = length == span
        found[at : at + len(part)][hit] = index.least(lo[hit], hi[hit])
    least = found[back]
    least[other] = found[len(where) :]
    return least, windows


def _shards(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[list]]:
    """Columns of whole anchors (rows are sorted by anchor) with about SHARD_WORDS words."""
    held: list[list] = [[] for _ in columns]
    last, size = None, 0
    for batch in batches:
        for anchor, *row in zip(*(batch.column(k).to_pylist() for k in ("anchor", *columns)), strict=True):
            if size > SHARD_WORDS and anchor != last:
                yield held
                held, size = [[] for _ in columns], 0
            for column, value in zip(held, row, strict=True):
                column.append(value)
            last, size = anchor, size + row[-1].count(b" ") + 1
    if held[0]:
        yield held


def _gone(rows: DataFrame, span: int) -> DataFrame:
    """(doc_id, _rank, first, n): runs of windows to remove, of each row's segments. An anchor has at most HOT of those, with HOT_WORDS words."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, ranks, starts, words in _shards(batches, ["doc_id", "_rank", "start", "words"]):
            slot: dict[bytes, int] = {}
            at = np.fromiter((slot.setdefault(w, len(slot)) for w in words), np.int64, len(words))
            docs, least_of = np.array(doc_ids, np.int64), np.full(len(slot), np.iinfo(np.int64).max)
            np.minimum.at(least_of, at, docs)
            least, windows = _answers(list(slot), least_of.tolist(), span)
            n = windows[at]
            row, edge = np.repeat(np.arange(len(at)), n), np.concatenate([[0], np.cumsum(n)])
            begin, end, _ = find_runs(least[ragged((np.cumsum(windows) - windows)[at], n)] < docs[row], edge)
            of = row[begin]
            first = np.array(starts, np.int64)[of] + begin - edge[of]
            yield pa.RecordBatch.from_arrays([pa.array(docs[of]), pa.array(np.array(ranks, np.int32)[of]), pa.array(first.astype(np.int32)), pa.array((end - begin).astype(np.int32))], ["doc_id", "_rank", "first", "n"])

    return rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(search, "doc_id long, _rank int, first int, n int")


def _gone_hot(rows: DataFrame, span: int) -> DataFrame:
    """The same for windows of hot anchors, which a third of all rows may share: equal ones meet in an aggregate before they are indexed, and answers go back by a join, which Spark splits where it is skewed."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h1, h2, first, words in _shards(batches, ["h1", "h2", "first", "words"]):
            least, _ = _answers(words, first, span)
            yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(least)], ["h1", "h2", "least"])

    distinct = rows.groupBy("anchor", "h1", "h2", "words").agg(F.min("doc_id").alias("first"))
    least = distinct.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(search, "h1 long, h2 long, least long")
    found = rows.select("doc_id", "_rank", "start", "h1", "h2").join(least, ["h1", "h2"])
    return found.filter(F.col("least") < F.col("doc_id")).select("doc_id", "_rank", F.col("start").alias("first"), F.lit(1).alias("n"))


def _without(cut: DataFrame, span: int) -> DataFrame:
    """Digests of rows (doc_id, _rank, _anonymous, packed, size) that lose the runs of windows in those of `lost` (_rank, first, n) with their rank (null: none)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in _unpacked(batches):
            starts, ends, first = find_words(buf, off)
            runs = rows.column("lost").flatten()
            row = np.repeat(np.arange(rows.num_rows), pc.list_value_length(rows.column("lost")).fill_null(0).to_numpy())
            own = runs.field("_rank").to_numpy() == rows.column("_rank").to_numpy()[row]
            begin = (first[row] + runs.field("first").to_numpy())[own]
            change = np.zeros(len(starts) + 1, np.int64)
            np.add.at(change, begin, 1)
            np.subtract.at(change, begin + runs.field("n").to_numpy()[own] + span - 1, 1)
            keep = np.flatnonzero(np.cumsum(change)[:-1] == 0)
            lens = ends[keep] - starts[keep]
            line = np.full(int((lens + 1).sum()), 32, np.uint8)
            line[ragged(np.cumsum(lens + 1) - (lens + 1), lens)] = buf[ragged(starts[keep], lens)]
            left = np.searchsorted(keep, first)
            edge = np.concatenate([[0], np.cumsum(lens + 1)])[left].tolist()
            digest = [hashlib.sha256(line[a : max(a, b - 1)]).hexdigest() for a, b in zip(edge[:-1], edge[1:], strict=True)]
            named = pc.if_else(rows.column("_anonymous"), pa.nulls(rows.num_rows, pa.int64()), rows.column("doc_id"))
            yield pa.RecordBatch.from_arrays([named, pa.array(np.diff(first)), pa.array(np.diff(first) - np.diff(left)), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return cut.mapInArrow(scan, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def drop_repeats(docs: DataFrame, span: int = 13) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 (of the words that stay, joined by one blank).

    Words are removed that lie in a window of `span` words which also starts in a document with a smaller doc_id; all windows are judged on
    the input. Null text and text with fewer words than span lose nothing. A null doc_id is smaller than all others, and judged as equal to the least long. Repeated rows
    are each judged, and never against one another. An empty table gives no rows. Other columns are ignored.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").isNull().alias("_anonymous"))
    w = Window.partitionBy("anchor")  # one shuffle of three numbers a row, and one sort, which spills
    anchors = _anchors(docs, span).withColumns({"_x": F.min("doc_id").over(w), "_y": F.max("doc_id").over(w), "_hot": (F.count("*").over(w) > HOT) | (F.sum("words").over(w) > HOT_WORDS)})
    hits = anchors.filter("_x <> _y").groupBy("doc_id").agg(F.collect_set("anchor").alias("shared"), F.collect_set(F.when(F.col("_hot"), F.col("anchor"))).alias("hot"))
    # hits and texts are read several times from one shuffle each, for which all of its readers need the same plan: with a doc_id that could be null, joins would filter theirs.
    # A rank tells rows with one doc_id apart in few bytes.
    rank = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("_key"))
    keyed = _packed(docs.withColumn("_key", F.xxhash64("text"))).select("doc_id", rank.alias("_rank"), "_anonymous", "packed", "size")
    holders = hits.filter(F.size("hot") > 0)
    gone = _gone(_cut(keyed.join(hits, "doc_id"), span, of_hot=False), span)
    gone = gone.unionByName(_gone_hot(_cut(keyed.join(holders, "doc_id"), span, of_hot=True), span))
    lost = gone.groupBy("doc_id").agg(F.collect_list(F.struct("_rank", "first", "n")).alias("lost"))
    return _without(keyed.join(lost, "doc_id", "left"), span)
