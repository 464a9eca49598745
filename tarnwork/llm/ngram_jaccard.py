"""Exact Jaccard join of word-shingle sets by PartEnum signatures.

Sets whose sizes fall into a band (or the next one) and whose Jaccard similarity reaches the threshold differ in at most k elements. The
domain of elements is cut into n1 parts, so one part holds at most k // n1 of the differences, and each part into n2 smaller ones. Leaving
out every choice of k2 = k // n1 of these n2 gives C(n2, k2) signatures for a part, of which similar sets share one.

Sets that share a signature are candidates. A set is known by its hash, the node; what most candidates are rejected by is a histogram of the
set, whose distance is never more than the number of elements that two sets differ in. The rest are compared set against set.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, checkpointed, deleted, few, find_words, hash_grams, hash_words, mix, ragged, shared_members, small_batches, states_in_block, text_bytes, written
from .graphs import components

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: nodes of a light signature; of a heavier one only those take part that it can be needed for
LIGHT = 16
#: nodes of a block, where a signature has more
BLOCK = 1024
#: rounds in which a signature with many likely pairs gives only those of a few of its nodes
ROUNDS = 6
#: pairs whose texts a worker holds at once
PAIR_ROWS = 250
#: nodes of which a task remembers that their signatures are out
MOST_SENT = 200_000
#: the lowest bits of a signature: parity of its band, whether its part has three cells, and its part
PART_BITS = 13
_SALT = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=100_000)
def band_of(size: int, percent: int) -> tuple[int, int, int]:
    """Number, least and largest size of the band of a set size. A band's largest size is its least over the threshold, rounded down."""
    band, low = 0, 1
    while size > (high := low * 100 // percent):
        band, low = band + 1, high + 1
    return band, low, high


@lru_cache(maxsize=100_000)
def plan_of(low: int, percent: int) -> tuple[int, int, int]:
    """n1, n2, k2 for pairs of a set in the band that starts at low and one in the same or the next band."""
    high = low * 100 // percent
    most = (high + (high + 1) * 100 // percent) * (100 - percent) // (100 + percent)
    if most == 0:
        return 1, 1, 0
    return most // 2 + 1, 3 if most <= 12 else 2, 1


@lru_cache(maxsize=100_000)
def instances(size: int, percent: int) -> tuple[tuple[int, int, int, int, int, int], ...]:
    """(band, n1, n2, k2, most, spare) for the bands that a set of this size has signatures of: its own and the one before.

    most: elements that it can differ in from a partner there. spare: how many of the differences that would change all its signatures are
    too many for that; see _active.
    """
    band, low, high = band_of(size, percent)
    out = []
    for number, start, partner in [(band, low, size * 100 // percent)] + ([(band - 1, band_of(low - 1, percent)[1], low - 1)] if band else []):
        n1, n2, k2 = plan_of(start, percent)
        most = (size + partner) * (100 - percent) // (100 + percent)
        out.append((number, n1, n2, k2, most, (2 * n1 if n2 > 1 else 1) - most if n1 < 1 << PART_BITS else 0))
    return tuple(out)


def signatures(elements: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of a set, given as sorted, well-mixed 64-bit hashes."""
    if not len(elements):
        return elements
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(elements ^ _SALT), dtype=np.uint64)])
    out = []
    for number, n1, n2, k2, _, _ in instances(len(elements), percent):
        cells = n1 * n2
        bounds = np.searchsorted(elements >> np.uint64(32), (np.arange(cells + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(cells))
        bounds[-1] = len(elements)
        part = np.arange(n1, dtype=np.uint64)
        low = np.uint64(((number & 1) << 1 | (n2 == 3)) << PART_BITS) | (part & np.uint64((1 << PART_BITS) - 1))
        with np.errstate(over="ignore"):
            cell = (sums[bounds[1:]] - sums[bounds[:-1]]).reshape(n1, n2)
            for k, kept in enumerate(combinations(range(n2), n2 - k2)):
                place = (part * np.uint64(16) + np.uint64(k)) * np.uint64(1 << 16) + np.uint64(number)
                value = mix(cell[:, kept].sum(axis=1, dtype=np.uint64) ^ mix(place + _SALT))
                out.append(value >> np.uint64(PART_BITS + 2) << np.uint64(PART_BITS + 2) | low)
    return np.concatenate(out)


class Names(NamedTuple):
    """How sets are named: so many bits of their first hash, and the names that stand for several sets."""

    bits: int
    clash: frozenset[int]


def shingle_sets(buf: np.ndarray, off: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each row, the sorted hashes of its distinct n-word shingles; of the whole sequence if it has fewer words."""
    buf = _LOWER[buf]
    starts, ends, first = find_words(buf, off)
    words = hash_words(buf, starts, ends)
    grams = hash_grams(words, n)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        else:
            yield hash_grams(words[a:b], b - a) ^ np.uint64(b - a) if b > a else words[:0]


def node_of(elements: np.ndarray, names: Names) -> tuple[int, int]:
    """Two 64-bit hashes of a set. The first is its node, unless that is among those that turned out to stand for several sets: then the second."""
    if not len(elements):
        return 0, 0
    with np.errstate(over="ignore"):
        pair = mix(np.array([elements.sum(dtype=np.uint64) ^ np.uint64(len(elements)), (mix(elements + _SALT) | np.uint64(1)).sum(dtype=np.uint64)]))
    node, check = int((pair[0] & np.uint64(2**names.bits - 1)).astype(np.int64)), int(pair[1].astype(np.int64))
    return (check if node in names.clash else node), check


def histogram(elements: np.ndarray) -> bytes:
    """Elements in each of 2^k cells of equal width, 255 standing for as many or more; about four elements a cell."""
    bits = max(3, int(len(elements) // 4).bit_length())
    return np.minimum(np.bincount((elements >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def _keys(docs: DataFrame, n: int, percent: int, names: Names) -> DataFrame:
    """A row per row of docs. spare_0, spare_1: of the instances with an even and an odd band."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in blocks(batches):
            sets = list(shingle_sets(buf, off, n))
            nodes = [node_of(s, names) for s in sets]
            spare = [{x[0] & 1: x[5] for x in instances(len(s), percent)} if len(s) else {} for s in sets]
            columns = [rows.column("doc_id"), rows.column("tag"), pa.array(map(len, sets), pa.int64()), pa.array([x[0] for x in nodes], pa.int64()), pa.array([x[1] for x in nodes], pa.int64())]
            columns += [pa.array([x.get(k) for x in spare], pa.int64()) for k in (0, 1)] + [pa.array([histogram(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tag", "n_shingles", "node", "check", "spare_0", "spare_1", "cells"])

    return docs.mapInArrow(scan, "doc_id long, tag long, n_shingles long, node long, check long, spare_0 long, spare_1 long, cells binary")


def _members(docs: DataFrame, n: int, percent: int, names: Names) -> DataFrame:
    """(signature, node) for all signatures of two nodes or more."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()  # nodes whose signatures this task has given; copies need none, and repeated ones do no harm
        for _, buf, off in blocks(batches):
            signs, nodes = [], []
            for s in shingle_sets(buf, off, n):
                own = node_of(s, names)[0]
                if len(s) and own not in sent:
                    sent.add(own)
                    signs.append(signatures(s, percent))
                    nodes.append(own)
            if len(sent) > MOST_SENT:
                sent = set()
            if not signs:
                continue
            flat, node = np.concatenate(signs), np.repeat(np.array(nodes, np.int64), [len(x) for x in signs])
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(node), pa.array(states_in_block(flat, node))], ["key", "member", "state"])

    return shared_members(docs.select("text").mapInArrow(scan, "key long, member long, state byte")).select(F.col("key").alias("signature"), F.col("member").alias("node"))


def _active(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(signature, node, n): the members through which every pair of similar nodes can be found. n: nodes of the signature.

    Two similar nodes that share a light signature meet there. If all that they share are heavy, then every light signature of either differs,
    and that takes a number of differences that follows from the signatures alone: 2 in a part, less 1 for each heavy signature of a part of
    two cells, less 1, 1 or 2 for one, two or three of a part of three. Nodes for which that is more than similar nodes can differ in are left
    out of heavy signatures. So texts that share a frequent passage, and little else, are not compared by it.
    """
    counts = checkpointed(members.groupBy("signature").agg(F.count("*").alias("n")).filter("n > 1"))
    sized = checkpointed(members.join(counts, "signature"))
    part = F.col("signature").bitwiseAND((1 << PART_BITS) - 1).alias("part")
    wide, odd = (F.shiftright("signature", PART_BITS + k).bitwiseAND(1) == 1 for k in (0, 1))
    heavy = sized.filter(F.col("n") > LIGHT)
    by_part = heavy.groupBy("node", odd.alias("odd"), wide.alias("wide"), part).agg(F.count("*").alias("c"))
    spared = F.when(F.col("wide"), F.when(F.col("c") < 3, 1).otherwise(2)).otherwise(F.col("c"))
    loss = by_part.groupBy("node", "odd").agg(F.sum(spared).alias("loss")).join(nodes.select("node", "spare_0", "spare_1"), "node")
    taking = loss.filter(F.col("loss") >= F.when(F.col("odd"), F.col("spare_1")).otherwise(F.col("spare_0"))).select("node", "odd")
    return sized.filter(F.col("n") <= LIGHT).unionByName(heavy.withColumn("odd", odd).join(taking, ["node", "odd"], "left_semi").select("signature", "node", "n"))


class _Rows:
    """Rows of whole signatures (or blocks of them), for the comparison by histograms."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.node, self.size, self.component = (batch.column(k).to_numpy() for k in ("node", "n_shingles", "component"))
        self.key = np.stack([batch.column(k).to_numpy() for k in ("signature", "i", "j")])
        self.other = batch.column("own").to_numpy() != self.key[1]
        self.flat, self.start = text_bytes(batch.column("cells").cast(pa.large_binary()))
        self.width = np.diff(self.start)
        new = np.concatenate([[True], (self.key[:, 1:] != self.key[:, :-1]).any(axis=0)])
        self.first = np.flatnonzero(new)
        self.count = np.diff(np.append(self.first, len(self.node)))
        self.group = np.cumsum(new) - 1

    def _cells(self, row: np.ndarray, width: int) -> np.ndarray:
        """Histograms of rows of one width, folded to `width` cells."""
        wide = int(self.width[row[0]])
        got = self.flat[self.start[row][:, None] + np.arange(wide)].astype(np.int16)
        return np.minimum(got.reshape(len(row), width, wide // width).sum(axis=2), 255) if wide > width else got

    def near(self, percent: int, step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows of a group and of two components that their sizes and histograms don't tell apart."""
        partners = np.repeat(self.first + self.count, self.count) - np.arange(len(self.node)) - 1
        bounds = np.unique(np.append(np.searchsorted(np.cumsum(partners), np.arange(0, int(partners.sum()), step), "right"), len(partners)))
        lefts, rights = [], []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            left = np.repeat(np.arange(lo, hi), partners[lo:hi])
            right = ragged(np.arange(lo, hi) + 1, partners[lo:hi])
            across = (self.key[1][left] == self.key[2][left]) | (self.other[left] != self.other[right])
            total = (self.size[left] + self.size[right]) * (100 - percent)
            keep = np.flatnonzero(across & (self.component[left] != self.component[right]) & (np.abs(self.size[left] - self.size[right]) * (100 + percent) <= total))
            left, right, total = left[keep], right[keep], total[keep]
            ok = np.zeros(len(left), bool)
            kind = self.width[left] * (1 << 32) + self.width[right]
            for k in np.unique(kind):
                own = np.flatnonzero(kind == k)
                width = int(min(k >> 32, k & 0xFFFFFFFF))
                most = max(1, (1 << 19) // int(max(k >> 32, k & 0xFFFFFFFF)))
                for at in range(0, len(own), most):
                    one = own[at : at + most]
                    apart = np.abs(self._cells(left[one], width) - self._cells(right[one], width)).sum(axis=1, dtype=np.int64)
                    ok[one] = apart * (100 + percent) <= total[one]
            lefts.append(left[ok])
            rights.append(right[ok])
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *lefts]), np.concatenate([none, *rights])

    def candidates(self, percent: int, number: int) -> pa.RecordBatch:
        """Pairs (a, b), and the signatures of groups that have more of them as open.

        In round 0 a group with more pairs than it takes to link all its nodes gives one for each node, with the least other: which is mostly the same
        one in all signatures of a large group of near copies. In later ones a group with many gives only those of its four nodes with most.
        """
        left, right = self.near(percent)
        group = self.group[left]
        many = np.bincount(group, minlength=len(self.count)) > (4 * self.count + 64 if number else self.count - 1)
        keep = np.ones(len(left), bool)
        if number >= ROUNDS or not many.any():
            many[:] = False
        elif number == 0:
            swap = self.node[left] < self.node[right]
            upper, lower = np.where(swap, right, left), np.where(swap, left, right)
            order = np.lexsort((self.node[lower], upper))
            keep = ~many[group]
            keep[order[np.concatenate([[True], upper[order][1:] != upper[order][:-1]])]] = True
        else:
            degree = np.bincount(left, minlength=len(self.node)) + np.bincount(right, minlength=len(self.node))
            hub = np.zeros(len(self.node), bool)
            for g in np.flatnonzero(many):
                own = np.arange(self.first[g], self.first[g] + self.count[g])
                hub[own[np.argsort(-degree[own], kind="stable")[:4]]] = True
            keep = ~many[group] | hub[left] | hub[right]
        a, b = self.node[left[keep]], self.node[right[keep]]
        open_ = np.unique(self.key[0][self.first[many]])
        nothing = pa.nulls(len(open_), pa.int64())
        return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(np.minimum(a, b)), nothing]), pa.concat_arrays([pa.array(np.maximum(a, b)), nothing]), pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(open_)])], ["a", "b", "signature"])


def _candidates(active: DataFrame, nodes: DataFrame, labels: DataFrame | None, percent: int, number: int) -> DataFrame:
    """(a, b, null) for candidates and (null, null, signature) for signatures with more of them. A signature of many nodes is dealt by pairs of blocks."""
    known = nodes.select("node", "n_shingles", "cells")
    known = known.withColumn("component", F.col("node")) if labels is None else known.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    count = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int")
    rows = active.join(known, "node").withColumn("n_blocks", count).withColumn("own", own)
    some = F.explode(F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j"))))
    rows = rows.withColumn("at", some).select("signature", F.col("at.i").cast("long").alias("i"), F.col("at.j").cast("long").alias("j"), F.col("own").cast("long").alias("own"), "node", "n_shingles", "component", "cells")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy() for k in ("signature", "i", "j")])
            change = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            if not held or tuple(held[-1].column(k)[-1].as_py() for k in ("signature", "i", "j")) != tuple(key[:, 0].tolist()):
                change = np.concatenate([[0], change])
            if len(change):
                cut = int(change[-1])
                if got := [x for x in [*held, batch.slice(0, cut)] if x.num_rows]:
                    yield _Rows(pa.Table.from_batches(got).combine_chunks().to_batches()[0]).candidates(percent, number)
                held, batch = [], batch.slice(cut)
            held.append(batch)
        if held:
            yield _Rows(pa.Table.from_batches(held).combine_chunks().to_batches()[0]).candidates(percent, number)

    return rows.repartition("signature", "i", "j").sortWithinPartitions("signature", "i", "j").mapInArrow(compare, "a long, b long, signature long")


def _texts(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, n: int, names: Names) -> DataFrame:
    """(node, text) for the nodes of pairs, one text each."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for rows, buf, off in blocks(batches):
            got = [node_of(s, names)[0] for s in shingle_sets(buf, off, n)]
            new = [i for i, k in enumerate(got) if k not in sent and not sent.add(k)]
            if len(sent) > MOST_SENT:
                sent = set()
            yield pa.RecordBatch.from_arrays([pa.array(np.array(got, np.int64)[new]), rows.column("text").take(pa.array(new, pa.int64()))], ["node", "text"])

    wanted = checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "tag"), "node"))
    rows = docs.join(few(wanted.select("tag").distinct()), "tag", "left_semi").select("text")
    return rows.mapInArrow(scan, "node long, text string").join(few(wanted.select("node")), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))


def _linked(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes whose sets reach the threshold."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, PAIR_ROWS) for whole in batches for at in range(0, whole.num_rows, PAIR_ROWS)):
            sets: dict[int, np.ndarray] = {}
            for side in ("a", "b"):
                nodes, where = np.unique(batch.column(side).to_numpy(), return_index=True)
                new = np.array([i for k, i in zip(nodes.tolist(), where.tolist(), strict=True) if k not in sets], np.int64)
                part = pa.RecordBatch.from_arrays([batch.column(side).take(pa.array(new)), batch.column(f"_{side}").take(pa.array(new))], ["node", "text"])
                for rows, buf, off in blocks(iter([part])):
                    sets.update(zip(rows.column("node").to_pylist(), shingle_sets(buf, off, n), strict=True))
            keep = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                keep.append(100 * both >= percent * (len(sets[a]) + len(sets[b]) - both))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in ("a", "b")], ["a", "b"])

    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("_b")), "b")
    return both.select("a", "b", "_a", "_b").mapInArrow(compare, "a long, b long")


def _components(docs: DataFrame, nodes: DataFrame, n: int, percent: int, names: Names) -> DataFrame:
    """(node, component) for linked nodes.

    A group of near copies has nearly all its pairs. So a signature with many gives a few of them first, and in the next round only what lies
    between components that are still apart, until none has many, or a round has found no link, or ROUNDS are over: then all.
    """
    spark = docs.sparkSession
    members, path = written(_members(docs, n, percent, names), "members")
    active, rows_path = written(_active(members, nodes), "active")
    labels = links = tested = None
    some, number = active, 0
    while True:
        found = checkpointed(_candidates(some, nodes, labels, percent, number))
        pairs = found.filter("signature is null").select("a", "b").distinct()
        pairs = checkpointed(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        tested = pairs if tested is None else tested.union(pairs)
        texts, texts_path = written(_texts(docs, pairs, nodes, n, names), "texts")
        with small_batches(spark, PAIR_ROWS):
            more = checkpointed(_linked(pairs, texts, n, percent))
        deleted(spark, texts_path)
        links = more if links is None else links.union(more)
        labels = components(links)
        open_ = found.filter("signature is not null").select("signature").distinct()
        if number >= ROUNDS or open_.isEmpty():
            break
        number = ROUNDS if number and more.isEmpty() else number + 1
        some = active.join(few(checkpointed(open_)), "signature", "left_semi")
    deleted(spark, path, rows_path)
    return labels


def _prepared(docs: DataFrame, n: int, percent: int, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tag, n_shingles, node) for each row, and (node, component, first, anonymous, tag) for each node. tag: a hash of the text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tag", F.xxhash64("text"))
    names = Names(bits, frozenset())
    while True:
        keys, path = written(_keys(docs, n, percent, names), "keys")
        first = {k: F.first(k).alias(k) for k in ("n_shingles", "spare_0", "spare_1", "cells")}
        nodes = checkpointed(keys.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("anonymous"), F.min("tag").alias("tag"), *first.values(), (F.min("check") != F.max("check")).alias("clash")))
        new = frozenset(x["node"] for x in nodes.filter("clash").select("node").collect())  # about n^2 / 2^65 of n sets: 3 of 10^10
        if not new:
            break
        names = Names(names.bits, names.clash | new)
        deleted(docs.sparkSession, path)
    labels = _components(docs, nodes, n, percent, names)
    named = nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "first", "anonymous", "tag")
    return keys.select("doc_id", "tag", "n_shingles", "node"), named


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Words are lower-cased in A-Z and split at 0x20 and 0x09-0x0D. Texts with the same set are one node. Every two nodes that share a signature
    are candidates, and none is dropped but by a bound that no similar pair passes; of candidates inside a component that is linked already, no
    more are compared than it takes to link it, so a large group of near copies does not become all its pairs.

    Null or empty text, and text without words, has no shingles and links with nothing; so does an empty table. A null doc_id takes part as
    smaller than all others and comes back as null. Repeated rows each get their row. Other columns are ignored.
    """
    keys, named = _prepared(docs, n, percent)
    least = named.groupBy("component").agg(F.min("first").alias("_first"), F.max("anonymous").alias("_anonymous"))
    known = named.join(least, "component").select("node", F.when(~F.col("_anonymous"), F.col("_first")).alias("component_id"))
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return keys.join(known, "node", "left").select("doc_id", "n_shingles", component.alias("component_id"))


def one_of_each_group(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Rows of docs with one row of each group of near duplicates; columns stay as they are. Rows without shingles all stay.

    The row that stays is chosen by row, not by doc_id alone: the smallest doc_id (null before all others), then the least hash of its text.
    Rows that repeat that doc_id and text are one row in the result.
    """
    spark = docs.sparkSession
    keys, named = _prepared(docs, n, percent)
    group = keys.filter("n_shingles > 0").join(named.select("node", "component"), "node").select("component", "doc_id", "tag")
    order = F.struct(F.col("doc_id").isNotNull().alias("no"), F.col("doc_id").alias("id"), F.col("tag").alias("tag"))
    best = group.groupBy("component").agg(F.min(order).alias("best"), F.max(order).alias("other")).select("component", F.col("best.id").alias("_id"), F.col("best.tag").alias("_tag"), (F.col("best") != F.col("other")).alias("_several"))
    several = group.join(best, "component")
    stays = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag"))
    pick = lambda rows, names: rows.select(F.col("doc_id").alias(names[0]), F.col("tag").alias(names[1])).distinct()
    gone, gone_path = written(pick(several.filter(~stays & F.col("_several")), ("_gone", "_gone_tag")), "gone")
    again, again_path = written(several.filter(stays).groupBy("doc_id", "tag").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col("doc_id").alias("_again"), F.col("tag").alias("_again_tag")), "again")
    tag = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    here = lambda other, names: docs["doc_id"].cast("long").eqNullSafe(other[names[0]]) & (tag == other[names[1]])
    out = docs.join(few(gone), here(gone, ("_gone", "_gone_tag")), "left_anti")
    if not again.isEmpty():
        once = docs.join(few(again), here(again, ("_again", "_again_tag")), "left_semi").dropDuplicates(["doc_id", "text"])
        out = out.join(few(again), here(again, ("_again", "_again_tag")), "left_anti").unionByName(once)
    return out
