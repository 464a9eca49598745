"""Words of a corpus grouped with their rarer spelling variants, by full neighbourhood generation."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, checkpointed, distinct_spans, find_runs, ragged, string_array, written

#: bytes of A-Z and a-z, and of the lead byte of U+00C0 to U+00FF, whose second byte is any continuation byte
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LEAD = 0xC3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: runs of more bytes are summed one by one
_LONG = 64
#: words whose neighbourhoods are generated and looked up together
BATCH = 50_000
#: candidates of one place that are held at once
CANDIDATES = 1 << 19
#: the shortest words: their halves still tell them apart
SHORTEST = 7
#: bits of the table that most candidates fail at
_BITS = 20

_rng = np.random.default_rng(77)
_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def crc32_spans(data: np.ndarray, lens: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of consecutive spans of data, each carried on from the crc32 of what stands before it."""
    starts = np.cumsum(lens) - lens
    order = np.argsort(-lens, kind="stable")
    at, left = starts[order], lens[order]
    state = before[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    short = int(np.searchsorted(-left, -_LONG, "left"))
    for k in range(min(_LONG, int(left[short]) if short < len(left) else 0)):
        to = int(np.searchsorted(-left, -k, "left"))
        part = state[short:to]
        state[short:to] = _CRC[(part ^ data[at[short:to] + k]) & np.uint32(255)] ^ (part >> np.uint32(8))
    for i in range(short):
        state[i] = zlib.crc32(data[at[i] : at[i] + left[i]].tobytes(), int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty(len(lens), np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def block_words(ids: list, buf: np.ndarray, off: np.ndarray, least_points: int, noise: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of a block, lower-cased: their bytes one after the other, and the length of each."""
    lead = buf == _LEAD
    letter = _LETTER[buf] | lead
    letter[1:] |= lead[:-1]
    starts, ends, first = find_runs(letter, off)
    row = np.repeat(np.arange(len(ids)), np.diff(first))
    leads = np.concatenate([[0], np.cumsum(lead)])
    points = (ends - starts) - (leads[ends] - leads[starts])
    long = points >= least_points
    starts, lens, points, row = starts[long], (ends - starts)[long], points[long], row[long]
    data = _LOWER[buf[ragged(starts, lens)]] if len(starts) else np.zeros(0, np.uint8)
    if noise and len(starts):
        before = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
        crc = crc32_spans(data, lens, before[row])
        hit = np.flatnonzero(crc % np.uint32(noise) == 0)
        second = np.concatenate([[False], data[:-1] == _LEAD])
        heads = np.flatnonzero(~second)  # the first bytes of code points
        at = heads[np.searchsorted(heads, (np.cumsum(lens) - lens)[hit]) + crc[hit] % points[hit]]
        width = 1 + (data[at] == _LEAD)
        gone = np.zeros(len(data), bool)
        gone[at] = True
        gone[at[width == 2] + 1] = True
        lens[hit] -= width
        points[hit] -= 1
        data = data[~gone]
        long = points >= least_points
        data, lens = data[np.repeat(long, lens)], lens[long]
    return data, lens


def vocabulary(docs: DataFrame, least_points: int = 7, least_n: int = 2, noise: int = 0) -> DataFrame:
    """(word, n): the words of whole texts, see spelling_groups. Equal words of a block of texts meet before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in blocks(batches):
            data, lens = block_words(rows.column(0).to_pylist(), buf, off, least_points, noise)
            if len(lens):
                where, back = distinct_spans(data, lens)
                words = string_array(data[ragged((np.cumsum(lens) - lens)[where], lens[where])], lens[where])
                yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(back))], ["word", "n"])

    return docs.select("doc_id", "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)


class _Neighbours:
    """A batch of words, and the pairs of them that one change in the batch's zone makes of each other.

    A candidate is a 64-bit polynomial hash, put together from those of what stands before and after the change. One that is found among the hashes of the
    words is compared with the word itself. Each candidate is generated once: of a run of equal letters the last is deleted, and a letter is
    inserted behind its equals.
    """

    def __init__(self, words: list[bytes], counts: np.ndarray) -> None:
        self.words, self.counts = words, counts
        lens = np.fromiter(map(len, words), np.int64, len(words))
        self.lens = lens
        self.alphabet = np.unique(np.frombuffer(b"".join(words), np.uint8))
        self.of_len = {int(n): np.flatnonzero(lens == n) for n in np.unique(lens)}
        self.codes = {n: np.frombuffer(b"".join([words[i] for i in which.tolist()]), np.uint8).reshape(-1, n) for n, which in self.of_len.items()}
        self.place = np.zeros(len(words), np.int64)
        for which in self.of_len.values():
            self.place[which] = np.arange(len(which))
        for salt in range(64):
            self.base = np.uint64(0x9E3779B97F4A7C15 + 2 * salt)
            whole = np.zeros(len(words), np.uint64)
            for n, which in self.of_len.items():
                whole[which] = self._suffixes(self.codes[n], n)[:, 0]
            self.order = np.argsort(whole)
            self.hashes = whole[self.order]
            if len(words) < 2 or (self.hashes[1:] != self.hashes[:-1]).all():
                break
        else:
            raise RuntimeError("no hash tells the words apart")
        self.filter = np.zeros(1 << _BITS, bool)
        self.filter[self.hashes >> np.uint64(64 - _BITS)] = True

    def _suffixes(self, codes: np.ndarray, n: int) -> np.ndarray:
        """Hashes of what follows each place, 0 for nothing."""
        out = np.zeros((len(codes), n + 1), np.uint64)
        with np.errstate(over="ignore"):
            for p in range(n - 1, -1, -1):
                out[:, p] = _CODE[codes[:, p]] + self.base * out[:, p + 1]
        return out

    def _found(self, candidates: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the candidates that are words, and the numbers of those words."""
        at = np.flatnonzero((self.filter[candidates >> np.uint64(64 - _BITS)] & valid).ravel())
        h = candidates.ravel()[at]
        slot = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        real = self.hashes[slot] == h
        return at[real], self.order[slot[real]]

    def _equal(self, x: np.ndarray, y: np.ndarray, p: int, shift: int, symbols: np.ndarray | None) -> np.ndarray:
        """Whether y is x with one change at place p: shift is 1 for a deletion, 0 for a replacement, -1 for an insertion."""
        n = x.shape[1]
        good = (y[:, :p] == x[:, :p]).all(1)
        good &= (y[:, p + 1 - max(shift, 0) :] == x[:, p + (shift >= 0) :]).all(1)
        return good if symbols is None or n - shift <= p else good & (y[:, p] == symbols)

    def pairs(self, size: int, tail_fixed: bool) -> tuple[np.ndarray, np.ndarray]:
        """(x, y): y is x with one change, the shorter of both has `size` letters; with tail_fixed a change in its first half, else one behind that."""
        xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        letters, values, base = self.alphabet, _CODE[self.alphabet], self.base
        rows = max(1, CANDIDATES // max(len(letters), 1))
        half = size // 2
        for n, which in self.of_len.items():
            for at in range(0, len(which), rows):
                codes, own = self.codes[n][at : at + rows], which[at : at + rows]
                after = self._suffixes(codes, n)
                before, power = np.zeros(len(codes), np.uint64), np.uint64(1)
                with np.errstate(over="ignore"):
                    for p in range(n + 1):
                        if (p < half) == tail_fixed:
                            tries = []
                            if n > size and p < n:
                                last = np.ones(len(codes), bool) if p == n - 1 else codes[:, p] != codes[:, p + 1]
                                tries.append((1, before + power * after[:, p + 1], last, None))
                            if n == size:
                                other = np.ones((len(codes), len(letters)), bool) if p == n else codes[:, p, None] != letters[None, :]
                                tries.append((-1, before[:, None] + power * (values[None, :] + base * after[:, p, None]), other, letters))
                                if p < n:
                                    tries.append((0, before[:, None] + power * (values[None, :] + base * after[:, p + 1, None]), other, letters))
                            for shift, candidates, valid, symbols in tries:
                                hit, y = self._found(candidates, valid)
                                right = self.lens[y] == n - shift
                                hit, y = hit[right], y[right]
                                if not len(hit):
                                    continue
                                x, put = (hit, None) if symbols is None else (hit // len(letters), letters[hit % len(letters)])
                                real = self._equal(codes[x], self.codes[n - shift][self.place[y]], p, shift, put)
                                xs.append(own[x[real]])
                                ys.append(y[real])
                        if p < n:
                            before, power = before + power * _CODE[codes[:, p]], power * base
        return np.concatenate(xs), np.concatenate(ys)

    def best(self, size: int, tail_fixed: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words with near ones, how many those are, and the most frequent of them."""
        x, y = self.pairs(size, tail_fixed)
        rank = np.empty(len(self.words), np.int64)
        rank[sorted(range(len(self.words)), key=self.words.__getitem__)] = np.arange(len(self.words))
        order = np.lexsort((rank[y], -self.counts[y], x))
        x, y = x[order], y[order]
        first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
        return x[first], np.diff(np.append(first, len(x))), y[first]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by size, zone and part; batches are cut where the part changes."""

    def settled(kind: tuple[int, int], words: list[bytes], counts: list[int]) -> Iterator[pa.RecordBatch]:
        if len(words) > 1:
            found = _Neighbours(words, np.array(counts, np.int64))
            x, n, y = found.best(kind[0], kind[1] == 1)
            text = lambda at: pa.array([words[i].decode("latin-1") for i in at.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([text(x), pa.array(n), text(y), pa.array(found.counts[y])], ["word", "n_near", "form", "form_n"])

    kind, part, words, counts = (0, 0), None, [], []
    for batch in batches:
        for size, zone, k, w, n in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if (size, zone) != kind or (k != part and len(words) >= BATCH):
                yield from settled(kind, words, counts)
                words, counts = [], []
            kind, part = (size, zone), k
            words.append(w)
            counts.append(n)
    yield from settled(kind, words, counts)


def _parts(n: Column) -> Column:
    """What a word of n letters meets others by: for both sizes of a shorter word that it can be compared with, the first half and the rest."""

    def halves(size: Column) -> list[Column]:
        half = F.floor(size / 2).cast("int")
        return [
            F.struct(size.alias("size"), F.lit(0).alias("zone"), F.left("word", half).alias("part")),
            F.struct(size.alias("size"), F.lit(1).alias("zone"), F.right("word", size - half).alias("part")),
        ]

    return F.filter(F.array(*halves(n), *halves(n - 1)), lambda z: z["size"] >= SHORTEST)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n) of the words that have near ones, of words (word, n), all of SHORTEST letters or more and below U+0100.

    The shorter of two near words has two halves, one of which the change leaves as it is. So every word meets those of its length or one more by its
    first and by its last letters, and those of one less by theirs, and is there a source of candidates as well as a member of the vocabulary that these
    are looked up in: words are shuffled, four rows each, candidates never are. A task holds the words of one part and size: with halves of three
    letters or more, and a length given, no share of a vocabulary that matters.
    """
    n = F.char_length("word")
    rows = words.select(F.explode(_parts(n)).alias("z"), F.encode("word", "ISO-8859-1").alias("word"), "n").select("z.size", "z.zone", "z.part", "word", "n")
    found = rows.repartition("size", "zone", "part").sortWithinPartitions("size", "zone", "part", "word").mapInArrow(_near, "word string, n_near long, form string, form_n long")
    best: Column = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_best")).select("word", "n_near", F.col("_best.form").alias("form"), (-F.col("_best.n")).alias("form_n"))


def _roots(forms: DataFrame, longest: int) -> DataFrame:
    """(word, root) of forms (word, form). Chains of forms have at most `longest` links; each round doubles the links that a root lies ahead."""
    out, reach = checkpointed(forms.select("word", F.col("form").alias("root"))), 1
    while reach < longest:
        ahead = out.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        out, reach = checkpointed(out.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"))), 2 * reach
    return out


def spelling_groups(docs: DataFrame, least_points: int = 7, least_n: int = 2, factor: int = 10, noise: int = 0) -> DataFrame:
    """One row per word of docs (doc_id, text): word, n, n_near, form, form_n, root.

    Runs are maximal `[A-Za-z\\u00C0-\\u00FF]+` of whole texts, of which only A-Z are lower-cased; words are the distinct runs of at least `least_points`
    code points (7 or more) that come `least_n` times or more. Two words are near if one inserted, deleted or replaced code point makes one of the other.
    All distinct deletions, replacements and insertions of a word, over the letters seen, are generated as hashes and joined to the vocabulary; nothing else is
    compared. form: the near word of largest n (ties: smallest in code-point order) if that n is at least factor times the word's own, else
    null, as is form_n; root: where following forms ends, the word itself without any. With `noise` k, a run of a document is first misspelt:
    where k divides the crc32 of `<doc_id>:<run>`, the code point at crc32 % length is deleted (a null doc_id gives `:<run>`).

    Null and empty texts have no words; repeated rows count again; an empty table gives no rows. Other columns are ignored.
    """
    if least_points < SHORTEST or factor < 2:
        raise ValueError(f"words need {SHORTEST} letters or more, and forms a factor of 2 or more")
    words, _ = written(vocabulary(docs, least_points, least_n, noise), "vocabulary")
    near = near_words(words)
    found = words.join(near, "word", "left").withColumn("_is", F.coalesce(F.col("form_n") >= factor * F.col("n"), F.lit(False)))
    found = checkpointed(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("_is"), F.col("form")).alias("form"), F.when(F.col("_is"), F.col("form_n")).alias("form_n")))
    longest, n = 0, (found.agg(F.max("n").alias("n")).first()["n"] or 0) // least_n
    while n >= factor:
        longest, n = longest + 1, n // factor
    roots = _roots(found.filter(F.col("form").isNotNull()).select("word", "form"), longest)
    return found.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
