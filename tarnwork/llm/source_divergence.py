"""How far the term distributions of sources lie apart, by sorted dictionaries of kept terms and dense vectors over ranges of their ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, checkpointed, distinct_spans, find_runs, hash_spans, mix, ragged, string_array, written

#: bytes of terms: letters of ASCII, and all bytes of other code points
_TERM = np.zeros(256, bool)
_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: rows of counts that a task adds up before it sends them
HELD_ROWS = 1_000_000
#: cells, sources by terms, of the dense counts of a chunk
CELLS = 2_000_000
#: parts of a probability's whole, and the count that every term has before it is seen
WHOLE, PRIOR = 1_000_000_000, 5


def parts_of_whole(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(WHOLE * count / total) for 0 <= count <= total < 2**53, exactly: by long division, three digits at a time."""
    left, out = count.astype(np.int64), np.zeros(count.shape, np.int64)
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // total
        left = left % total
    return out + 1


def _counted(rows: list[tuple[np.ndarray, ...]], groups: list[tuple[str, str]]) -> pa.RecordBatch:
    """One batch of (lang, source, term, n, docs) from those of several blocks; rows that differ in spite of equal hashes stay apart."""
    group, key, n, docs = (np.concatenate([r[k] for r in rows]) for k in range(4))
    terms = pa.concat_arrays([r[4] for r in rows])
    with np.errstate(over="ignore"):
        _, where, back = np.unique(mix(key + group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_inverse=True)
    if (group[where][back] == group).all() and pc.all(pc.equal(terms.take(pa.array(where[back])), terms)).as_py():
        total = lambda v: np.bincount(back, weights=v).astype(np.int64)  # noqa: E731  exact below 2**53
        group, n, docs, terms = group[where], total(n), total(docs), terms.take(pa.array(where))
    lang, source = (pa.DictionaryArray.from_arrays(pa.array(group, pa.int32()), pa.array([g[k] for g in groups], pa.string())).cast(pa.string()) for k in (0, 1))
    return pa.RecordBatch.from_arrays([lang, source, terms, pa.array(n), pa.array(docs)], ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and the documents it is in.

    Blocks of texts are counted by numpy and added up in the task, and Spark adds up those of all tasks: a source with a third of all
    rows sends each of its terms once for a million rows of counts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], int] = {}
        rows, held = [], 0
        for batch, buf, off in blocks(batches):
            own = np.array([known.setdefault(g, len(known)) for g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], np.int64)
            starts, ends, first = find_runs(_TERM[buf], off)
            if not len(starts):
                continue
            lens = ends - starts
            data = _LOWER[buf[ragged(starts, lens)]]
            where, back = distinct_spans(data, lens)
            doc = np.repeat(np.arange(len(own)), np.diff(first))
            in_doc, n = np.unique(doc * len(where) + back, return_counts=True)
            in_group, at = np.unique(own[in_doc // len(where)] * len(where) + in_doc % len(where), return_inverse=True)
            term = in_group % len(where)
            begin, size = (np.cumsum(lens) - lens)[where], lens[where]
            packed = data[ragged(begin, size)]
            texts, key = string_array(packed, size), hash_spans(packed, size)
            rows.append((in_group // len(where), key[term], np.bincount(at, weights=n).astype(np.int64), np.bincount(at), texts.take(pa.array(term))))
            held += len(term)
            if held >= HELD_ROWS:
                yield _counted(rows, list(known))
                rows, held = [], 0
        if rows:
            yield _counted(rows, list(known))

    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    counted = docs.select(text("lang"), text("source"), text("text")).mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _chunks(sources: dict[str, list[tuple[str, int]]], sizes: dict[str, int], top: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (lang, term, source, n) of a task, sorted, to partial results: part 0 with the distance of two sources over a chunk of terms,
    part 1 with the terms of a source that stand out in it. sources: those of each language with their counts; sizes: its kept terms."""

    def chunk(lang: str, terms: list[bytes], rows: tuple[list[bytes], list[str], list[int]]) -> Iterator[pa.RecordBatch]:
        names = {s: k for k, (s, _) in enumerate(sources[lang])}
        kept = np.array(terms, object)  # in order of bytes, which is that of UTF-8
        ids = np.searchsorted(kept, np.array(rows[0], object))
        cell = np.array([names[s] for s in rows[1]], np.int64) * len(kept) + ids
        counts = np.zeros(len(names) * len(kept), np.int64)
        np.add.at(counts, cell, np.array(rows[2], np.int64))
        counts = counts.reshape(len(names), len(kept))
        prior = PRIOR * sizes[lang]
        own = np.stack([parts_of_whole(counts[k] + PRIOR, n + prior) for k, (_, n) in enumerate(sources[lang])])
        whole = parts_of_whole(counts.sum(0) + PRIOR, sum(n for _, n in sources[lang]) + prior)
        for a in range(len(names) - 1):
            far = np.abs(own[a + 1 :] - own[a]).sum(1)
            yield batch(lang, 0, [a] * len(far), range(a + 1, len(names)), [None] * len(far), far)
        for a in range(len(names)):
            out = np.flatnonzero((counts[a] > 0) & (own[a] > whole))
            above = own[a][out] - whole[out]
            best = np.lexsort((out, -above))[:top]  # ids stand in order of the terms, so ties go by id
            yield batch(lang, 1, [a] * len(best), [None] * len(best), [kept[i].decode() for i in out[best]], above[best])

    def batch(lang: str, part: int, a: list[int], b: object, terms: list[str | None], value: np.ndarray) -> pa.RecordBatch:
        name = lambda k: None if k is None else sources[lang][k][0]
        columns = [pa.array([lang] * len(a), pa.string()), pa.array([part] * len(a), pa.int32()), pa.array([name(k) for k in a], pa.string()), pa.array([name(k) for k in b], pa.string()), pa.array(terms, pa.string()), pa.array(value, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "part", "source", "other", "term", "value"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, terms, rows = None, [], ([], [], [])
        for got in batches:
            for own, term, source, n in zip(*(got.column(k).to_pylist() for k in range(4)), strict=True):
                term = term.encode()
                new = own != lang or not terms or term != terms[-1]
                if terms and (own != lang or (new and len(terms) >= max(1, CELLS // len(sources[lang])))):
                    yield from chunk(lang, terms, rows)
                    terms, rows = [], ([], [], [])
                lang = own
                if new:
                    terms.append(term)
                for to, value in zip(rows, (term, source, n), strict=True):
                    to.append(value)
        if terms:
            yield from chunk(lang, terms, rows)

    return walk


def divergence(docs: DataFrame, least_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank for the groups (lang, source) of docs (text, lang, source).

    Terms are maximal `[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+` of whole texts, of which only A-Z are lower-cased. A language keeps those in `least_docs` of its
    documents or more, V terms. A group gives a term p = 1 + floor(10**9 * (count + 5) / (N + 5 * V)), with N its occurrences of kept terms; a language
    likewise gives q over all its groups. Part "pair": item is each other source of the language, value the sum of |p - p of the other| over all kept
    terms (0 if there are none), every rank. Part "term": item is each kept term that the group has and gives more than its language does, value
    p - q, ranks to `top`. Ranks are from 1, by value descending, then item in order of UTF-8.

    Null text, lang and source count as ''. Repeated rows count again; an empty table gives no rows; a language with one source has no pairs. Other columns
    are ignored. What is sent to all tasks is a name and a number for each group, while the result has a row for each two of a language.
    Kept counts are dealt by ranges of (lang, term), so that a task has runs of the dictionary in order: it numbers the terms of a chunk by place,
    finds ids by searchsorted and adds up dense vectors, sources by terms, of CELLS cells. Exact while a language has fewer than 2**53 occurrences.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    term = Window.partitionBy("lang", "term")
    kept = term_counts(docs).withColumn("_in", F.sum("docs").over(term)).filter(F.col("_in") >= least_docs).select("lang", "term", "source", "n")
    kept, _ = written(kept, "kept-terms")
    groups = checkpointed(docs.select(text("lang"), text("source")).distinct().join(kept.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")))
    sources: dict[str, list[tuple[str, int]]] = {}
    for r in groups.collect():
        sources.setdefault(r.lang, []).append((r.source, r.n))
    sizes = {r.lang: r.v for r in kept.groupBy("lang").agg(F.count_distinct("term").alias("v")).collect()}
    parts = kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_chunks(sources, sizes, top), "lang string, part int, source string, other string, term string, value long")
    parts, _ = written(parts, "chunks")
    other = groups.select("lang", F.col("source").alias("other"))
    every = groups.select("lang", "source").join(other, "lang").filter("source <> other")
    far = parts.filter("part = 0").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    far = far.union(far.select("lang", "other", "source", "value"))
    pairs = every.join(far, ["lang", "source", "other"], "left").select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), F.coalesce("value", F.lit(0)).alias("value"))
    terms = parts.filter("part = 1").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    rank: Column = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).union(terms.withColumn("rank", rank).filter(F.col("rank") <= top))
