"""Whole-text encoding with the tokenizers library, by blocks.

Pre-tokenisers of both vocabularies never join text over the places where blocks are cut here, so the ids of a text are those of its
chunks one after the other. Equal chunks are encoded once.
"""

from __future__ import annotations

import os

import numpy as np

from .common import WS, ChunkEncoder, find_words, flattened, hash_spans

_CODECS: dict[str, ChunkEncoder] = {}
#: lead bytes of the other white space of Unicode, and of the control characters that some libraries count as such
_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3, 0x1C, 0x1D, 0x1E, 0x1F]] = True


def public_tokenizer(name: str) -> str:
    """The file of a public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary_size(path: str) -> int:
    """Ids of a vocabulary file, added ones included: the largest and one more."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), default=-1) + 1


def _codec(path: str, kept: int) -> ChunkEncoder:
    """One for each worker process and file, with at most about `kept` encoded chunks."""
    if path not in _CODECS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        marks = [(i, t.content) for i, t in model.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        _CODECS[path] = ChunkEncoder(lambda chunks: _encoded(model, marks, chunks), kept)
    return _CODECS[path]


def _encoded(model, marks: list[tuple[int, str]], chunks: list[str], at_once: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Ids of chunks. The library reads what stands between two marks (added tokens, which it finds first) as texts of their own, and a few long texts faster than many short ones; so chunks are joined by a mark that none of them holds."""
    free = [(i, mark) for i, mark in marks if not any(mark in c for c in chunks)]
    if not free:
        return flattened([x.ids for x in model.encode_batch_fast(chunks, add_special_tokens=False)])
    number, mark = free[0]
    joined = [mark.join(["", *chunks[k : k + at_once]]) for k in range(0, len(chunks), at_once)]
    ids = np.concatenate([np.array(x.ids, np.uint32) for x in model.encode_batch_fast(joined, add_special_tokens=False)])
    begin = np.flatnonzero(ids == number)
    return np.delete(ids, begin), np.diff(np.append(begin, len(ids))) - 1


def _odd_rows(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows that hold white space other than ASCII's."""
    at = np.flatnonzero(_LEAD[buf])
    if not len(at):
        return at
    a, b, c = buf[at], buf[np.minimum(at + 1, len(buf) - 1)], buf[np.minimum(at + 2, len(buf) - 1)]
    odd = (a < 0x20) | ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (((b == 0x9A) & (c == 0x80)) | ((b == 0xA0) & (c == 0x8E))))
    odd |= (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
    odd |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
    return np.unique(np.searchsorted(off, at[odd], "right") - 1)


def _spaced_chunks(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of chunks for vocabularies that bind one blank to the word after it: a text is cut before each single blank between two words."""
    if not len(buf):
        return np.zeros(0, np.int64)
    blank = WS[buf]
    cut = np.zeros(len(buf), bool)
    cut[1:-1] = blank[1:-1] & ~blank[:-2] & ~blank[2:]
    first, end = off[:-1][np.diff(off) > 0], off[1:][np.diff(off) > 0] - 1
    cut[end] = False  # a blank at the end of a text stands before nothing
    for row in _odd_rows(buf, off):
        cut[off[row] : off[row + 1]] = False
    cut[first] = True
    return np.flatnonzero(cut)


def encode_block(path: str, buf: np.ndarray, off: np.ndarray, spaced: bool, kept: int = 700_000) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the rows of a block and the n + 1 offsets of the rows in them. spaced: blanks belong to the words after them; else they are dropped."""
    if spaced:
        starts = _spaced_chunks(buf, off)
        ends = np.append(starts[1:], len(buf)) if len(starts) else starts
        first, data = np.searchsorted(starts, off), buf
    else:
        starts, ends, first = find_words(buf, off)
        data = buf[~WS[buf]]
    ids, lens = _codec(path, kept)(buf, starts, ends, hash_spans(data, ends - starts))
    return ids, np.concatenate([[0], np.cumsum(lens)])[first]
