"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes for what they miss."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Slots, blocks, find_words, hash_words

# Kinds in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: numbers joined by dots, of which each four make an IP match
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")

#: states of the field: none, an address spelled out, a number without a plus sign, a password or key
STATES = ("none", "email", "phone", "secret")
#: signs and markup that stand before and behind a span, and are none of it
BEFORE, AFTER = "\"'`<>#*|[{", ".,;:!?\"'`#*|<>&%$~^()[]{}\\@"
AROUND = ".,;:!?\"'`<>"
CUES = frozenset((
    "at", "dot", "(at)", "(dot)", "[at]", "[dot]", "{at}", "{dot}", "phone", "tel", "telephone", "mobile", "cell", "fax", "call", "ring", "dial", "email", "mail", "ext", "contact", "reach", "write",
    "token", "key", "apikey", "api_key", "secret", "password", "passwd", "pwd", "auth", "bearer", "credential", "=", ":=", "isbn", "order", "page", "pages", "version", "commit", "on", "from", "until", "id",
))

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """As EMAIL.finditer, but looking for a start only before an @, so that long texts take linear time."""
    done = 0
    while (at := text.find("@", done)) >= 0:
        start = at
        while start > done and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        found = EMAIL.match(text, start) if start < at else None
        if found:
            yield "email", found.start(), found.end()
        done = found.end() if found else at + 1


def _ips(text: str) -> Iterator[Span]:
    """As IP.finditer with its check: within numbers joined by dots, matches are each four of them from the left."""
    for run in _DOTTED.finditer(text):
        if run[0].count(".") < 3:
            continue
        parts, at = run[0].split("."), run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(x) <= 3 or len(x.lstrip("0")) <= 3 for x in four) and all(int(x.lstrip("0") or 0) <= 255 for x in four):
                yield "ip", at, at + size
            at += size + 1


def base_spans(text: str) -> list[Span]:
    """Matches of the four patterns, leftmost and not overlapping within a kind, without those that fail their checks; by start, then kind. Takes time linear in the text."""
    out = list(_emails(text)) if "@" in text else []
    if "." in text:
        out += _ips(text)
    for m in CARD.finditer(text):
        if m.end() - m.start() < 12:
            continue
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def shape(word: str) -> str:
    """Capitals X, small letters x, digits 0, other characters as they are; runs of letters count as one, runs of digits keep their length up to 5; at most 24 characters."""
    out = re.sub(r"[a-z]+", "x", re.sub(r"[A-Z]", "X", re.sub(r"[^\x00-\x7f]", "x", word)))
    out = re.sub(r"X+", "X", out)
    return re.sub(r"[0-9]+", lambda m: "0" * min(5, len(m[0])), out)[:24]


@lru_cache(maxsize=5_000)
def word_features(word: str) -> tuple[str, ...]:
    core = word.strip(AROUND)
    bare = core.lower()
    out = [f"shape={shape(core)}", f"digits={min(12, sum(c.isdigit() for c in core))}", f"length={min(10, len(core) // 4)}"]
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(core, core[1:], strict=False))
    if core.isascii() and any(c.isalpha() for c in core) and turns:
        out.append(f"turns={min(6, turns)}")
        if re.fullmatch(r"[0-9a-fA-F]+", core):
            out.append("hex")
        if len({c.isupper() for c in core if c.isalpha()}) == 2:
            out.append("cases")
    if bare.rstrip("=:") in CUES or bare in CUES:
        out.append(f"cue={bare.rstrip('=:') or bare}")
    if word[-1] in "=:":
        out.append("opens")
    return tuple(out)


def labelled_table(seed: int = 11, copies: int = 8) -> list[tuple[list[str], list[int]]]:
    """The small labelled table: words and states of lines. Lines come from short patterns, each filled `copies` times; {e:...}, {p:...} and {s:...} mark the spans.

    In patterns W is a plain word, N a name, D a domain, T its last part, a digit 8 any digit, H a run of hexadecimal digits, K a run of letters
    and digits, P a password.
    """
    rng = random.Random(seed)
    words = ["the", "report", "Garten", "maison", "was", "of", "Casa,", "team", "und", "les", "river", "today.", "Many", "para", "nous", "we"]
    fills = {"W": lambda: rng.choice(words), "N": lambda: rng.choice(["anna", "j.doe", "Peter", "info", "sales7", "marie.k", "office", "k_lang"]), "D": lambda: rng.choice(["example", "mail", "firma", "test-site", "uni", "shop24"]), "T": lambda: rng.choice(["com", "org", "de", "net", "fr", "io"])}
    fills |= {"H": lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([16, 24, 32, 40]))), "K": lambda: "".join(rng.choice("ABCDEFGHJKLMNabcdefghjkmn0123456789") for _ in range(rng.randrange(16, 41)))}
    fills["P"] = lambda: "".join(rng.choice("ABCabcdefgh") for _ in range(rng.randrange(4, 8))) + "".join(rng.choice("0123456789!#_") for _ in range(rng.randrange(3, 6))) + rng.choice("xyz")
    marked = [
        "W W {e:N at D dot T} W W", "W {e:N (at) D (dot) T} W", "W W {e:N [at] D [dot] T}", "email {e:N at D dot T} W W", "contact {e:N [at] D [dot] T} W", "{e:N (at) D (dot) T} W W W", "write {e:N {at} D {dot} T} W", "W mail {e:N at D dot D dot T} W", "reach W {e:N at D dot T}",
        "W call {p:888-888-8888} W", "W W {p:(888) 888-8888} W", "tel {p:088 8888 8888} W", "phone {p:888 888 8888} W W", "{p:(888) 888-8888} W", "W fax {p:(088) 888888} W", "W mobile {p:0888 8888888} W", "W W {p:888-888-8888} W", "call {p:888-888-8888}", "ring {p:088 88888888} W",
        "Tel: {p:08888 888888} W", "W {p:888.888.8888} W", "phone: {p:08 88 88 88 88} W", "W mobile {p:06 88 88 88 88}", "dial {p:888-8888} W", "cell {p:(888)888-8888} W W",
        'token = {s:"H"}', 'W token = {s:"K"} W', "api_key = {s:H} W", "api_key: {s:K}", "secret = {s:'K'}", "password: {s:P} W", 'password = {s:"P"}', "W key: {s:K} W", "auth bearer {s:K}", "apikey {s:H} W", "pwd {s:P} W", "secret: {s:H}", 'W passwd = {s:"P"} W', "credential {s:K} W",
    ]
    plain = [
        "W W W W W W", "W at W W", "W W at the D", "at W dot W", "W the dot at W W", "W 2088 W 88 W", "W 8,888 W 88% W", "on 88-88-2088 W", "W 2088-08-88 W", "version 8.88.8 W", "W 888888888 W", "W 8888 W 8 W", "call W W W", "phone W W", "from 2088-08-88 until 2088-08-88",
        "W W mail W W", "W | W | W | W", "W!! W!! W!!", "W*** W$$$ W%%% W&&&", "W (8) W (88) W", "pages 888-888 W", "W 8,888,888 W", "tel W", "contact W at W", "the token was W", "a key W of W", "password W W", "W secret W W", "W 88:88 W 88:88", "room 888 W 888 888 W", "W 1988-2088 W",
        "ISBN 978-8-88-888888-8 W", "W 88 88 88 W", "order 88888888 W W", "commit H W W", "W id 88888 W", "W W W. W W", "W x8 W b88 W", "W 88.88.2088 W", "W 8888 8888 W", "key = W W", "the W of 88 W 8.8 W", "W 88/88/2088 W", "W mp3 W h264 W", "W A88 W B8 W",
    ]
    out = []
    for _ in range(copies):
        for line in marked + plain:
            got, states = [], []
            for part in re.findall(r"\{[eps]:(?:[^{}]|\{[a-z]+\})*\}|\S+", line):
                inside = re.fullmatch(r"\{([eps]):(.*)\}", part)
                state = {"e": 1, "p": 2, "s": 3}[inside[1]] if inside else 0
                for w in (inside[2] if inside else part).split(" "):
                    m = re.fullmatch(r"(['\"]?)([WNDTHKP])(\W*)", w)
                    got.append(m[1] + fills[m[2]]() + m[3] if m else re.sub("8", lambda _: rng.choice("0123456789"), w))
                    states.append(state)
            out.append((got, states))
    return out


class Field:
    """Weights of the features of a word and its two neighbours for each state, and of the steps between states."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, steps: np.ndarray) -> None:
        """weights: [before, own, after][feature][state]; steps: [state or start][state]."""
        self.names, self.weights, self.steps = names, weights, steps

    def scores(self, words: list[str]) -> np.ndarray:
        """[word][before, own, after][state]: what a word adds to the states of the next word, of itself and of the word before."""
        out, known = np.zeros((len(words), 3, self.steps.shape[1])), {}
        for i, w in enumerate(words):
            core = w.strip(AROUND)
            # words of letters alone, other than cues, differ in case and length only
            plain = (core.islower(), core.isupper(), core.istitle(), core.isascii(), len(core) // 4) if core.isalpha() and w[-1] not in "=:" and core.lower() not in CUES else None
            if plain is not None and core.isascii() and (plain[0] or plain[1] or plain[2]) and plain in known:
                out[i] = known[plain]
                continue
            for f in word_features(w):
                if (k := self.names.get(f)) is not None:
                    out[i] += self.weights[:, k]
            if plain is not None:
                known[plain] = out[i]
        return out


class Labelled:
    """A labelled table as arrays: lines padded to the longest, and which weight counts at which place."""

    def __init__(self, names: dict[str, int], table: list[tuple[list[str], list[int]]]) -> None:
        self.lens = np.array([len(words) for words, _ in table])
        self.width = int(self.lens.max())
        self.states = np.zeros((len(table), self.width), np.int64)
        places, offsets, features = [], [], []
        for i, (words, states) in enumerate(table):
            self.states[i, : len(states)] = states
            for t, w in enumerate(words):
                for f in word_features(w):
                    for offset, to in ((0, t + 1), (1, t), (2, t - 1)):
                        if 0 <= to < len(words) and f in names:
                            places.append(i * self.width + to)
                            offsets.append(offset)
                            features.append(names[f])
        self.places, self.weights = np.array(places), (np.array(offsets), np.array(features))


def likelihood(field: Field, table: Labelled) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of the table and its gradients, by forward and backward sums over all lines side by side."""
    n, width, k = *table.states.shape, field.steps.shape[1]
    s, step = np.zeros((n * width, k)), field.steps[1:]
    np.add.at(s, table.places, field.weights[table.weights])
    s, lines, last = s.reshape(n, width, k), np.arange(n), table.lens - 1
    fwd, bwd = np.zeros((n, width, k)), np.zeros((n, width, k))
    fwd[:, 0] = field.steps[0] + s[:, 0]
    for t in range(1, width):
        fwd[:, t] = s[:, t] + np.logaddexp.reduce(fwd[:, t - 1, :, None] + step, axis=1)
    for t in range(width - 2, -1, -1):
        back = np.logaddexp.reduce(step + (s[:, t + 1] + bwd[:, t + 1])[:, None, :], axis=2)
        bwd[:, t] = np.where((t < last)[:, None], back, 0)
    total = np.logaddexp.reduce(fwd[lines, last], axis=1)
    inside = np.arange(width) < table.lens[:, None]
    d = np.where(inside[:, :, None], -np.exp(fwd + bwd - total[:, None, None]), 0)
    own = np.eye(k)[table.states] * inside[:, :, None]
    value = float((s * own).sum() - total.sum() + field.steps[0, table.states[:, 0]].sum())
    g_w, g_s = np.zeros_like(field.weights), np.zeros_like(field.steps)
    g_s[0] = own[:, 0].sum(axis=0) + d[:, 0].sum(axis=0)
    for t in range(1, width):
        at = inside[:, t]
        value += float(step[table.states[at, t - 1], table.states[at, t]].sum())
        np.add.at(g_s, (table.states[at, t - 1] + 1, table.states[at, t]), 1)
        both = fwd[at, t - 1, :, None] + step + (s[at, t] + bwd[at, t])[:, None, :] - total[at, None, None]
        g_s[1:] -= np.exp(both).sum(axis=0)
    np.add.at(g_w, table.weights, (d + own).reshape(-1, k)[table.places])
    return value, g_w, g_s


@lru_cache(maxsize=1)
def trained(rounds: int = 80, rate: float = 0.5, l2: float = 0.02) -> Field:
    """The field, fitted to the labelled table by gradient ascent with a step for each weight (adagrad)."""
    table = labelled_table()
    names = {f: i for i, f in enumerate(sorted({f for words, _ in table for w in words for f in word_features(w)}))}
    labelled = Labelled(names, table)
    field = Field(names, np.zeros((3, len(names), len(STATES))), np.zeros((len(STATES) + 1, len(STATES))))
    seen_w, seen_s = np.full_like(field.weights, 1e-6), np.full_like(field.steps, 1e-6)
    for _ in range(rounds):
        _, g_w, g_s = likelihood(field, labelled)
        g_w, g_s = g_w - l2 * field.weights, g_s - l2 * field.steps
        seen_w, seen_s = seen_w + g_w**2, seen_s + g_s**2
        field.weights += rate * g_w / np.sqrt(seen_w)
        field.steps += rate * g_s / np.sqrt(seen_s)
    return field


def viterbi(field: Field, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Best states of all words; scores [word][state]; first: n + 1 offsets of the lines. Lines go step by step side by side, longest first."""
    lens = np.diff(first)
    order = np.argsort(-lens, kind="stable")
    lens, start = lens[order], first[:-1][order]
    k, step = field.steps.shape[1], field.steps[1:]
    back, out = np.zeros((len(scores), k), np.int8), np.zeros(len(scores), np.int8)
    if not len(lens) or lens[0] == 0:
        return out
    active = np.searchsorted(-lens, -np.arange(lens[0]), "left")  # lines longer than t
    best = np.zeros((len(lens), k))
    best[: active[0]] = field.steps[0] + scores[start[: active[0]]]
    for t in range(1, int(lens[0])):
        a = active[t]
        ways = best[:a, :, None] + step
        back[start[:a] + t] = ways.argmax(axis=1)
        best[:a] = ways.max(axis=1) + scores[start[:a] + t]
    state = best.argmax(axis=1)
    for t in range(int(lens[0]) - 1, -1, -1):
        a = active[t]
        at = start[:a] + t
        out[at] = state[:a]
        state[:a] = back[at, state[:a]]
    return out


def _plausible(kind: str, text: str) -> bool:
    """The exact check after the field: whether a span can be of its kind at all."""
    if kind == "phone":
        return 7 <= sum(c.isdigit() for c in text) <= 15 and bool(re.fullmatch(r"[0-9() ./-]+", text))
    if kind == "secret":
        return len(text) >= 8 and not any(c in " \t" for c in text) and any(c.isdigit() for c in text)
    return bool(re.search(r"[A-Za-z0-9] [\[({]?at[\])}]? [A-Za-z0-9-]+( [\[({]?dot[\])}]? [A-Za-z0-9-]+)+", text))


class Finder:
    """Spans of the rows of a block; what a distinct word adds is kept from block to block."""

    def __init__(self, field: Field, limit: int = 300_000) -> None:
        self.field, self.limit, self.seen, self.table = field, limit, Slots(), np.zeros((1 << 12, 3, len(STATES)), np.float32)

    def _word_scores(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, where, back = np.unique(hash_words(buf, starts, ends), return_index=True, return_inverse=True)
        if len(self.seen) > self.limit:
            self.seen = Slots()
        slots = self.seen.find(keys)
        new = np.flatnonzero(slots < 0)
        if len(new):
            raw, n = buf.tobytes(), len(self.seen)
            if n + len(new) > len(self.table):
                self.table = np.concatenate([self.table[:n], np.zeros((n // 2 + len(new), 3, len(STATES)), np.float32)])
            for at in range(0, len(new), 20_000):
                part = where[new[at : at + 20_000]]
                self.table[n + at : n + at + len(part)] = self.field.scores([raw[a:b].decode() for a, b in zip(starts[part].tolist(), ends[part].tolist(), strict=True)])
            slots[new] = np.arange(n, n + len(new))
            self.seen.add(keys[new], slots[new])
        return self.table, slots[back]

    def __call__(self, buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[list[Span], list[Span]]]:
        """For each row, the base spans and all spans."""
        starts, ends, first = find_words(buf, off)
        breaks = np.flatnonzero(buf == 10)
        lines = np.unique(np.concatenate([first, np.searchsorted(starts, breaks)]))
        states = np.zeros(len(starts), np.int8)
        if len(starts):
            table, slot = self._word_scores(buf, starts, ends)
            scores = table[slot, 1]
            inner = np.ones(len(starts), bool)
            inner[lines[lines < len(starts)]] = False  # words with one before them on their line
            at = np.flatnonzero(inner)
            scores[at] += table[slot[at - 1], 0]
            scores[at - 1] += table[slot[at], 2]
            states = viterbi(self.field, scores, lines)
        marked = np.flatnonzero(states)
        starts_line = np.zeros(len(starts) + 1, bool)
        starts_line[lines] = True
        digits = np.concatenate([[0], np.cumsum(((buf >= 48) & (buf <= 57)) | (buf == 64))])  # every base span has a digit or an @
        some = digits[off[1:]] > digits[off[:-1]]
        bounds = np.searchsorted(marked, first)
        points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])  # code points before each byte
        for i in range(len(off) - 1):
            own = marked[bounds[i] : bounds[i + 1]]
            if not (some[i] or len(own)):
                yield [], []
                continue
            raw = buf[off[i] : off[i + 1]].tobytes()
            text = raw.decode()
            base = base_spans(text)
            more, k = [], 0
            while k < len(own):
                j = k
                while j + 1 < len(own) and own[j + 1] == own[j] + 1 and states[own[j + 1]] == states[own[k]] and not starts_line[own[j + 1]]:
                    j += 1
                a, b = int(starts[own[k]] - off[i]), int(ends[own[j]] - off[i])
                words, kind = raw[a:b].decode(), STATES[states[own[k]]]
                short = words.rstrip(AFTER)
                lead = len(short) - len(short.lstrip(BEFORE))
                short, lo = short[lead:], int(points[off[i] + a] - points[off[i]]) + lead
                if short and _plausible(kind, short) and not any(x < lo + len(short) and lo < y for _, x, y in base):
                    more.append((kind, lo, lo + len(short)))
                k = j + 1
            yield base, sorted(base + more, key=lambda s: (s[1], ALL_KINDS.index(s[0])))


def personal_spans(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added ones), n_spans.

    Null and empty text have no spans; null doc_ids and repeated rows are searched like others; an empty table gives no rows. Added spans never
    overlap base ones, and stay on one line. Other columns are ignored.
    """
    field = trained()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(field)
        for rows, buf, off in blocks(batches):
            found = list(find(buf, off))
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            digest = [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *counts, pa.array(digest, pa.string()), pa.array([written(x) for _, x in found], pa.string()), pa.array([len(x) for _, x in found], pa.int64())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; overlapping spans by that of the first. n_chars, where it is there, follows; null text stays null."""
    field, schema = trained(), docs.schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(field)
        for rows, buf, off in blocks(batches):
            at = rows.schema.get_field_index("text")
            texts, valid = [], rows.column(at).is_valid().to_pylist()
            for i, (_, spans) in enumerate(find(buf, off)):
                text, out, done = buf[off[i] : off[i + 1]].tobytes().decode(), [], 0
                for kind, a, b in spans:
                    if a >= done:
                        out += [text[done:a], f"<{kind}>"]
                    done = max(done, b)
                texts.append("".join([*out, text[done:]]) if valid[i] else None)
            columns = list(rows.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, rows.schema.names)

    out = docs.mapInArrow(scan, schema)
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(schema["n_chars"].dataType), F.col("n_chars"))) if "n_chars" in docs.columns else out
