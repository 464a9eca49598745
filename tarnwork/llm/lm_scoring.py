"""Pseudo-likelihood of documents under a bidirectional window network, trained on the corpus.

The most frequent words of the corpus are symbols, more of them for a larger corpus; all rarer ones share a symbol, and which of them it is follows
from a model of their spelling. The network sees the two words on either side of a masked word and predicts it: first its class of frequency, then
the symbol in the class, then the bytes of a rarer word. So every word has a probability of its own, those of all words that could stand in a
place add up to one, and a document's score is the sum of the log-probabilities of all its words, each given its neighbours. How often a text
comes in the corpus has no say in it but by training: copies of junk stay junk.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, deleted, find_words, hash_words, mix, ragged, written

#: symbols of the network are in classes of this size; there are as many classes as the fifth root of the words of the corpus, this many at least.
#: The last symbol, RARE, stands for all rarer words
CLASS_SIZE, LEAST_CLASSES = 64, 32
#: as neighbours, rarer words are one of so many buckets by hash, numbered from RARE on; the next number is a place beyond either end of a text
BUCKETS = 1024
#: words on either side, numbers of an embedding and of the hidden layer
SIDE, EMBED, HIDDEN = 2, 12, 32
#: rounds of training; a word is masked in one of them
ROUNDS = 2
#: words of a step of training: fewer in the first steps of a task
RATE, FIRST_STEPS, FIRST_BATCH, BATCH = 0.1, 256, 1024, 8192
#: words that a training task has at least, if there are so many
TASK_WORDS = 4_000_000
#: places before a byte that its probability follows from are hashed to so many cells
CELLS = 1024

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

Params = dict[str, np.ndarray]


def classes_for(words: int) -> int:
    return max(LEAST_CLASSES, round(words**0.2))


def shapes(classes: int) -> dict[str, tuple[int, ...]]:
    """Parameters of the network."""
    return {"embed": (classes * CLASS_SIZE + BUCKETS, EMBED), "mix": (2 * SIDE * EMBED, HIDDEN), "bias": (HIDDEN,), "class": (HIDDEN, classes), "class_bias": (classes,), "word": (classes, HIDDEN, CLASS_SIZE), "word_bias": (classes, CLASS_SIZE)}


def initial(classes: int, counts: np.ndarray | None = None) -> Params:
    """The network before training. counts: occurrences of each symbol, which it predicts in proportion, whatever the neighbours."""
    rng = np.random.default_rng(7)
    out = {k: (rng.normal(0, 0.1, s) if len(s) > 1 and "bias" not in k else np.zeros(s)).astype(np.float32) for k, s in shapes(classes).items()}
    if counts is not None:
        share = (counts + 0.5).reshape(classes, CLASS_SIZE)
        out["class_bias"] = np.log(share.sum(axis=1) / share.sum()).astype(np.float32)
        out["word_bias"] = np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32)
    return out


def flat(params: Params) -> np.ndarray:
    return np.concatenate([params[k].ravel() for k in shapes(len(params["class_bias"]))])


def unflat(values: np.ndarray, classes: int) -> Params:
    out, at = {}, 0
    for k, s in shapes(classes).items():
        n = int(np.prod(s))
        out[k], at = values[at : at + n].reshape(s).astype(np.float32), at + n
    return out


def _exponents(x: np.ndarray) -> np.ndarray:
    """exp of logits, in place. The hidden layer lies in [-1, 1] and weights stay small, so logits need no shift; 60 and more count as 60."""
    np.minimum(x, x.dtype.type(60), out=x)
    return np.exp(x, out=x)


def _log_softmax_at(x: np.ndarray, column: np.ndarray) -> np.ndarray:
    """log of softmax(x)[i, column[i]]. Sums of rows are products with ones, which is faster than sums along short rows."""
    own = x[np.arange(len(x)), column]
    return np.minimum(own, 60) - np.log(_exponents(x) @ np.ones(x.shape[1], x.dtype))


def _minus_softmax(x: np.ndarray) -> np.ndarray:
    _exponents(x)
    x *= (-1 / (x @ np.ones(x.shape[1], x.dtype)))[:, None]
    return x


def _small(x: np.ndarray) -> np.ndarray:
    """Numbers as 16 bits if they fit, which are sorted by radix."""
    return x.astype(np.uint16) if not len(x) or x.max() < 1 << 16 else x


def _by_class(target: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Class, places and symbols inside the class, of all targets."""
    group = _small(target // CLASS_SIZE)
    order = np.argsort(group, kind="stable")
    bounds = np.searchsorted(group[order], np.arange(int(group.max()) + 2)) if len(group) else [0]
    for c in range(len(bounds) - 1):
        own = order[bounds[c] : bounds[c + 1]]
        if len(own):
            yield c, own, target[own] - c * CLASS_SIZE


def log_probs(params: Params, context: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log-probabilities of target symbols given contexts [n][2 * SIDE]. What each neighbour adds to the hidden layer at each place is looked up."""
    tables = [params["embed"] @ params["mix"][k * EMBED : (k + 1) * EMBED] for k in range(2 * SIDE)]
    out = np.empty(len(target), np.float32)
    for at in range(0, len(target), 1 << 15):
        part, want = context[at : at + (1 << 15)], target[at : at + (1 << 15)]
        hidden = tables[0][part[:, 0]] + params["bias"]
        for k in range(1, 2 * SIDE):
            hidden += tables[k][part[:, k]]
        np.tanh(hidden, out=hidden)
        value = _log_softmax_at(hidden @ params["class"] + params["class_bias"], want // CLASS_SIZE)
        for c, own, word in _by_class(want):
            value[own] += _log_softmax_at(hidden[own] @ params["word"][c] + params["word_bias"][c], word)
        out[at : at + len(part)] = value
    return out


def gradients(params: Params, context: np.ndarray, target: np.ndarray) -> Params:
    """Gradients of the summed log-probabilities."""
    seen = params["embed"][context].reshape(len(target), -1)
    hidden = np.tanh(seen @ params["mix"] + params["bias"])
    d_class = _minus_softmax(hidden @ params["class"] + params["class_bias"])
    d_class[np.arange(len(target)), target // CLASS_SIZE] += 1
    out: Params = {"class": hidden.T @ d_class, "class_bias": d_class.sum(axis=0), "word": np.zeros_like(params["word"]), "word_bias": np.zeros_like(params["word_bias"])}
    d_hidden = d_class @ params["class"].T
    for c, own, word in _by_class(target):
        seen_by = hidden[own]
        d = _minus_softmax(seen_by @ params["word"][c] + params["word_bias"][c])
        d[np.arange(len(own)), word] += 1
        out["word"][c], out["word_bias"][c] = seen_by.T @ d, d.sum(axis=0)
        d_hidden[own] += d @ params["word"][c].T
    d_hidden *= 1 - hidden**2
    out["mix"], out["bias"] = seen.T @ d_hidden, d_hidden.sum(axis=0)
    d_seen = (d_hidden @ params["mix"].T).reshape(-1, EMBED)
    out["embed"] = np.zeros_like(params["embed"])
    flat_context = _small(context.ravel())
    order = np.argsort(flat_context, kind="stable")
    ordered = flat_context[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    out["embed"][ordered[first]] = np.add.reduceat(d_seen[order], first, axis=0)
    return out


class Symbols:
    """The corpus vocabulary: hashes of its most frequent words, most frequent first, for a network of so many classes."""

    def __init__(self, hashes: list[int], classes: int) -> None:
        self.classes, self.rare = classes, classes * CLASS_SIZE - 1
        self.edge = self.rare + BUCKETS
        keys = np.array(hashes, np.int64).view(np.uint64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        # where the keys of each value of the highest 16 bits begin, and how many one has at most
        self.begin = np.searchsorted(self.keys >> np.uint64(48), np.arange(1 << 16, dtype=np.uint64)).astype(np.int32)
        self.run = int(np.bincount((self.keys >> np.uint64(48)).astype(np.int64), minlength=1).max()) if len(keys) else 0

    def __call__(self, words: np.ndarray) -> np.ndarray:
        """Words as neighbours: their symbol, or RARE + bucket. As targets, all of the latter are RARE."""
        out = (self.rare + (mix(words) % np.uint64(BUCKETS))).astype(np.int64)
        at = self.begin[(words >> np.uint64(48)).astype(np.int32)]
        for k in range(self.run):
            own = np.minimum(at + k, len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[own] == words)
            out[hit] = self.order[own[hit]]
        return out


class Model(NamedTuple):
    symbols: Symbols
    params: Params
    #: [cell][byte] occurrences in rarer words; 0x20 ends a word
    spelling: np.ndarray


class Words(NamedTuple):
    """Words of a block of texts, in lower case."""

    low: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    #: n + 1 offsets of the rows
    first: np.ndarray
    hashes: np.ndarray


def block_words(buf: np.ndarray, off: np.ndarray) -> Words:
    low = _LOWER[buf]
    starts, ends, first = find_words(low, off)
    return Words(low, starts, ends, first, hash_words(low, starts, ends))


def _contexts(ids: np.ndarray, first: np.ndarray, edge: int) -> np.ndarray:
    """[word][2 * SIDE] neighbours, left to right, of all words of a block of texts."""
    pad = SIDE + len(first) * SIDE
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    place = np.arange(len(ids)) + SIDE * (row + 1)
    wide = np.full(len(ids) + pad, edge, np.int32)
    wide[place] = ids
    return np.stack([wide[place + k] for k in (*range(-SIDE, 0), *range(1, SIDE + 1))], axis=1)


def _letters(words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the bytes of chosen words and the end of each: cell * 256 + byte, and the first of each word."""
    lens = words.ends[which] - words.starts[which] + 1
    first = np.cumsum(lens) - lens
    data = np.full(int(lens.sum()) + 2, 32, np.int64)
    inner = np.ones(len(data) - 2, bool)
    inner[first + lens - 1] = False
    data[2:][inner] = words.low[ragged(words.starts[which], lens - 1)]
    one, two = data[1:-1].copy(), data[:-2].copy()
    one[first], two[first] = 32, 32
    two[(first + 1)[lens > 1]] = 32
    return ((one * 31 + two * 257) * 0x9E3779B1 >> 7) % CELLS * 256 + data[2:], first


def rare_words(words: Words, ids: np.ndarray, rare: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the rarer words of a block: their places, the first of each distinct one, which distinct one each is, and how often each comes."""
    at = np.flatnonzero(ids >= rare)
    _, where, back, n = np.unique(words.hashes[at], return_index=True, return_inverse=True, return_counts=True)
    return at, at[where], back, n


def counted(docs: DataFrame) -> DataFrame:
    """(key, n): the counts of all words of all documents, by the hash of a word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, buf, off in blocks(batches):
            key, n = np.unique(block_words(buf, off).hashes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    return docs.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _merged(rows: DataFrame, tasks: int, classes: int) -> tuple[Params | None, np.ndarray]:
    """The weighted mean of the networks and the sum of the spellings of rows (words, params, spelling), 16 at a time."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, params, spelling = 0, 0.0, np.zeros(CELLS * 256, np.int64)
        for batch in batches:
            for n, p, s in zip(*(batch.column(k).to_pylist() for k in ("words", "params", "spelling")), strict=True):
                words, params = words + n, params + n * np.frombuffer(p, np.float32).astype(np.float64)
                spelling += np.frombuffer(zlib.decompress(s), np.int64)
        if words:
            yield _network_row(words, params / words, spelling)

    while True:
        tasks = -(-tasks // 16)
        rows = rows.repartition(tasks).mapInArrow(merge, "words long, params binary, spelling binary")
        if tasks == 1:
            break
    got = rows.collect()
    return (unflat(np.frombuffer(got[0]["params"], np.float32), classes), np.frombuffer(zlib.decompress(got[0]["spelling"]), np.int64)) if got else (None, np.zeros(CELLS * 256, np.int64))


def _network_row(words: int, params: np.ndarray, spelling: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([words]), pa.array([params.astype(np.float32).tobytes()], pa.binary()), pa.array([zlib.compress(spelling.tobytes(), 1)], pa.binary())], ["words", "params", "spelling"])


def _round(docs: DataFrame, tasks: int, symbols: Symbols, params: Params, number: int) -> tuple[Params, np.ndarray]:
    """One round: every task trains a copy on its words masked in this round; the copies are averaged, each by its words. The first round also counts the bytes of all rarer words."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {k: v.copy() for k, v in params.items()}
        seen = {k: np.full_like(v, 1e-4) for k, v in own.items()}
        spelling, n_words, steps = np.zeros(CELLS * 256, np.int64), 0, 0
        for _, buf, off in blocks(batches):
            words = block_words(buf, off)
            ids = symbols(words.hashes)
            if number == 0 and len(ids):
                _, which, _, n = rare_words(words, ids, symbols.rare)
                cells, first = _letters(words, which)
                spelling += np.bincount(cells, np.repeat(n, np.diff(np.append(first, len(cells)))), CELLS * 256).astype(np.int64)
            place = np.arange(len(ids)) - np.repeat(words.first[:-1], np.diff(words.first))
            masked = np.flatnonzero(mix(words.hashes + mix(place.astype(np.uint64))) % np.uint64(ROUNDS) == number)
            context, target, at = _contexts(ids, words.first, symbols.edge)[masked], np.minimum(ids[masked], symbols.rare), 0
            while at < len(masked):
                n = min(FIRST_BATCH if steps < FIRST_STEPS else BATCH, len(masked) - at)
                for k, g in gradients(own, context[at : at + n], target[at : at + n]).items():
                    g /= n
                    seen[k] += g * g
                    own[k] += RATE * g / np.sqrt(seen[k])
                at, steps = at + n, steps + 1
            n_words += len(masked)
        if n_words:
            yield _network_row(n_words, flat(own), spelling)

    new, spelling = _merged(docs.select("text").coalesce(tasks).mapInArrow(train, "words long, params binary, spelling binary"), tasks, symbols.classes)
    return new or params, spelling


def trained(docs: DataFrame) -> Model:
    """The model of a corpus. Its symbols grow with the corpus, by the fifth root of its words for each class of 64; every word of every text trains the
    network and, if it is a rarer one, the spelling.

    A round has a task for each TASK_WORDS words, so that how rows are dealt has little weight in small corpora; copies start from the same network,
    which predicts words in proportion to their counts.
    """
    words, path = written(counted(docs), "counts")
    total = int(words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    classes = classes_for(total)
    top = words.orderBy(F.desc("n"), "key").limit(classes * CLASS_SIZE - 1).collect()
    deleted(docs.sparkSession, path)
    symbols, known = Symbols([x["key"] for x in top], classes), np.zeros(classes * CLASS_SIZE)
    known[: len(top)] = [x["n"] for x in top]
    known[symbols.rare] = total - known.sum()
    params, spelling = initial(classes, known), np.zeros(CELLS * 256, np.int64)
    tasks = max(1, -(-total // TASK_WORDS))
    for number in range(ROUNDS):
        params, letters = _round(docs, tasks, symbols, params, number)
        spelling = spelling + letters
    return Model(symbols, params, spelling)


def word_log_probs(model: Model, words: Words) -> np.ndarray:
    """log P(word | neighbours) of all words of a block."""
    ids = model.symbols(words.hashes)
    out = log_probs(model.params, _contexts(ids, words.first, model.symbols.edge), np.minimum(ids, model.symbols.rare)).astype(np.float64)
    if len(ids):
        cell = model.spelling.reshape(CELLS, 256) + 0.05
        letter = np.log(cell / cell.sum(axis=1, keepdims=True)).ravel()
        at, which, back, _ = rare_words(words, ids, model.symbols.rare)
        if len(at):
            cells, first = _letters(words, which)
            out[at] += np.add.reduceat(letter[cells], first)[back]
    return out


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_words, log_likelihood (sum over all words), mean_log_likelihood (null without words). Tasks hold the model, which is of bounded size, and shuffle nothing."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in blocks(batches):
            words = block_words(buf, off)
            total = np.concatenate([[0.0], np.cumsum(word_log_probs(model, words))])
            n, value = np.diff(words.first), np.diff(total[words.first])
            mean = pa.array(value / np.maximum(n, 1), mask=n == 0)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n), pa.array(value), mean], ["doc_id", "n_words", "log_likelihood", "mean_log_likelihood"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, n_words long, log_likelihood double, mean_log_likelihood double")


def score_documents(docs: DataFrame) -> DataFrame:
    """Trains on docs and scores them: one row per row of docs.

    Null, empty and blank text has no words and scores 0. Null doc_ids and repeated rows are scored like others. An empty table trains nothing and
    gives no rows. Other columns are ignored. The network follows the order of rows and, beyond TASK_WORDS words, the partitions of docs.
    """
    return scored(docs, trained(docs))
