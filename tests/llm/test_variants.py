import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tarnwork.llm import common, embedding_dedup, source_divergence, spelling_variants
from tarnwork.llm.embedding_dedup import near_vectors
from tarnwork.llm.source_divergence import divergence, parts_of_whole
from tarnwork.llm.spelling_variants import crc32_spans, spelling_groups
from tarnwork.llm.token_binary import token_shards
from tarnwork.llm.tokens import public_tokenizer
from tarnwork.llm.warc import through_archives

lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)


def one_change(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_groups(docs, noise=0, least_n=2, factor=10):
    n = Counter()
    for i, t in docs:
        for w in map(lower, re.findall("[A-Za-zÀ-ÿ]+", t or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if noise and h % noise == 0 else w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= least_n}
    out, up = {}, {}
    for w in n:
        near = [v for v in n if one_change(v, w)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        up[w] = best if best and n[best] >= factor * n[w] else None
        out[w] = (n[w], len(near), up[w], n.get(up[w]))
    root = lambda w: root(up[w]) if up[w] else w
    return sorted((w, *v, root(w)) for w, v in out.items())


@pytest.mark.parametrize("noise, batch", [(0, 50_000), (3, 50_000), (3, 5)])
def test_spelling_groups(spark, noise, batch, monkeypatch):
    monkeypatch.setattr(spelling_variants, "BATCH", batch)
    rng = random.Random(4)
    words = ["aaaaaaa", "abababab", "Maßstäbe", "Übergröße", "naïveté", "gouvernement", "GOUVERNEMENT", "zzzzzzzzzz", "x" * 90, "ÀÉÎÕÜÿÿ", "short", "×÷×÷×÷×÷"]
    for w in list(words):
        for _ in range(6):
            k = rng.randrange(len(w))
            words += [w[:k] + w[k + 1 :], w[:k] + rng.choice("abxÿ") + w[k + 1 :], w[:k] + rng.choice("abxÿ") + w[k:]]
    docs = [(i, " ".join(rng.choices(words, [300 if k < 12 else 3 for k in range(len(words))], k=60))) for i in range(60)]
    docs += [(60, None), (61, ""), (62, "aaaaaaa1bbbbbbb-aaaaaaa\x00ŒŒŒŒŒŒŒŒ"), (None, docs[3][1]), (5, docs[5][1]), (5, docs[5][1]), (70, "ab" * 30_000 + " " + "ab" * 30_000)]
    table = spark.createDataFrame([(i, t, "w", 1) for i, t in docs], "doc_id long, text string, word string, n int")
    got = spelling_groups(table.repartition(5), noise=noise).collect()
    short = [(i, t if i != 70 else "") for i, t in docs]  # the one long word has no near ones
    want = brute_groups(short, noise)
    tail = (("ab" * 30_000, 2, 0, None, None, "ab" * 30_000),) if noise == 0 or zlib.crc32(b"70:" + b"ab" * 30_000) % noise else ()
    seen = {r.word: tuple(r) for r in got}
    assert sorted(map(str, want + list(tail))) == sorted(str((r.word, r.n, r.n_near, r.form, r.form_n, r.root)) for r in got) and len(seen) == len(got)
    assert any(r.form for r in got) and any(r.n_near > 2 for r in got)
    assert spelling_groups(table.limit(0)).count() == 0


def test_chains_of_forms(spark):
    chain = ["abcdefg", "abcdefgh", "abcdefghi", "abcdefghij"]
    docs = spark.createDataFrame([(1, " ".join(w for k, w in enumerate(chain) for _ in range(2 * 10**k)))], "doc_id long, text string")
    got = {r.word: (r.form, r.root) for r in spelling_groups(docs).collect()}
    assert got == {w: (chain[k + 1] if k < 3 else None, chain[3]) for k, w in enumerate(chain)}


def test_crc_of_spans():
    rng = random.Random(1)
    spans = [bytes(rng.randrange(256) for _ in range(rng.choice([1, 5, 63, 64, 65, 300]))) for _ in range(200)]
    before = np.array([zlib.crc32(b"%d:" % k) for k in range(200)], np.uint32)
    got = crc32_spans(np.frombuffer(b"".join(spans), np.uint8), np.array([len(s) for s in spans]), before)
    assert got.tolist() == [zlib.crc32(b"%d:" % k + s) for k, s in enumerate(spans)]


def test_spans_are_told_apart_by_bytes(monkeypatch):
    spans = [b"ab", b"cd", b"ab", b"abc", b"cd", b"x"]
    real, salts = common.hash_spans, []
    monkeypatch.setattr(common, "hash_spans", lambda d, n: (salts.append(1), real(d, n) % np.uint64(2) if len(salts) < 4 else real(d, n))[1])
    where, back = common.distinct_spans(np.frombuffer(b"".join(spans), np.uint8), np.array([len(s) for s in spans]))
    assert len(where) == 4 and [spans[where[k]] for k in back] == spans and len(salts) == 4


def brute_divergence(docs, least, top):
    docs = [(t or "", lang or "", s or "") for t, lang, s in docs]
    out = []
    for lang in {d[1] for d in docs}:
        own = [(Counter(lower(x) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)), s) for t, la, s in docs if la == lang]
        df = Counter(x for c, _ in own for x in c)
        kept = sorted((x for x in df if df[x] >= least), key=str.encode)
        sources = {s for _, s in own}
        count = {s: Counter() for s in sources}
        for c, s in own:
            count[s].update({x: k for x, k in c.items() if df[x] >= least})
        p = lambda c: {x: 1 + 10**9 * (c[x] + 5) // (sum(c.values()) + 5 * len(kept)) for x in kept}
        of, q = {s: p(c) for s, c in count.items()}, p(sum(count.values(), Counter()))
        for s in sources:
            far = [(sum(abs(of[s][x] - of[o][x]) for x in kept), o) for o in sources - {s}]
            high = [(of[s][x] - q[x], x) for x in kept if count[s][x] and of[s][x] > q[x]]
            for part, items, most in (("pair", far, None), ("term", high, top)):
                ranked = sorted(items, key=lambda v: (-v[0], v[1].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("cells, held", [(2_000_000, 1_000_000), (20, 10)])
def test_divergence(spark, cells, held, monkeypatch):
    monkeypatch.setattr(source_divergence, "CELLS", cells)
    monkeypatch.setattr(source_divergence, "HELD_ROWS", held)
    rng = random.Random(9)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)] + ["Ünicode", "ünicode", "日本語", "ABC", "abc", "﷐x", "𝔘n", "a" * 5000]
    docs = [(" ".join(rng.choices(words, [1 + (k + 7 * s) % 11 for k in range(len(words))], k=rng.randrange(40))), lang, f"s{s}") for lang in ("de", "en") for s in range(4) for _ in range(12)]
    docs += [(None, "de", "s9"), ("", "de", None), (" 1 2 \n_", None, "s1"), ("abc abc", None, None), ("abc", "xx", "s1"), ("wort", "xx", "s2"), docs[0], docs[0]] + [("de", "one", "s1")] * 7
    table = spark.createDataFrame([(t, la, s, "t", 1, 2) for t, la, s in docs], "text string, lang string, source string, term string, n int, rank int")
    got = divergence(table.repartition(3), least_docs=6, top=5)
    assert sorted(map(tuple, got.collect())) == brute_divergence(docs, 6, 5)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert divergence(table.limit(0)).count() == 0


def test_parts_are_exact_for_large_counts():
    rng = random.Random(2)
    for _ in range(300):
        total = rng.randrange(1, 2 ** rng.randrange(1, 53))
        count = rng.randrange(total + 1)
        assert parts_of_whole(np.array([count]), total)[0] == 1 + 10**9 * count // total


def brute_links(rows, cosine):
    def unit(v):
        x = np.array([np.nan if c is None else c for c in v or []], float)
        return x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max()) if len(x) and np.isfinite(x).all() and x.any() else None

    units = [None if label is None else unit(v) for _, v, label in rows]
    near = [[k for k in range(len(rows)) if k != i and u is not None and units[k] is not None and rows[k][2] == rows[i][2] and len(u) == len(units[k]) and u @ units[k] >= cosine] for i, u in enumerate(units)]
    out = []
    for i, row in enumerate(rows):
        reach, todo = {i}, [i]
        while todo:
            for k in near[todo.pop()]:
                if k not in reach:
                    reach.add(k)
                    todo.append(k)
        least = min((rows[k][0] for k in reach if rows[k][0] is not None), default=None)
        out.append((row[0], len(near[i]), least, row[0] == least))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard", [8192, 40])
def test_near_vectors(spark, shard, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD", shard)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 22))
    rows = []
    for i in range(500):
        x = centres[i % 12] + rng.normal(size=22) * [0.02, 0.1, 0.2, 0.5][i % 4]
        rows.append((1000 - i, x.tolist(), [0, 0, 1, None][i // 7 % 4]))
    walk = rng.normal(size=22)
    for i in range(60):  # a chain: neighbours link, ends do not
        walk = walk / np.linalg.norm(walk) + rng.normal(size=22) * 0.03
        rows.append((2000 + i, walk.tolist(), 5))
    same = rng.normal(size=22)
    rows += [(3000 + i, (same * 2.0 ** (i % 3)).tolist(), 7) for i in range(90)]  # copies, some of them longer
    nan, inf = float("nan"), float("inf")
    rows += [(4000, None, 0), (4001, [], 0), (4002, [0.0, -0.0], 0), (4003, [1.0, None], 0), (4004, [nan, 1.0], 0), (4005, [inf, 1.0], 0), (4006, [1.0, 0.0], 0), (4007, [1e300, 0.0], 0), (4008, [1e-300, -0.0], 0), (None, [1.0, 0.0], 0), (4006, [1.0, 0.0], 0), (None, [9.0] * 5, 3)]
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<double>, label int, node long, list long, vector int")
    got = sorted(map(tuple, near_vectors(table.repartition(4)).collect()), key=str)
    assert got == brute_links(rows, 0.98)
    assert sum(r[1] > 0 for r in got) > 200
    assert near_vectors(table.limit(0)).count() == 0
    assert [tuple(r) for r in near_vectors(table.filter("vec_id = 4000")).collect()] == [(4000, 0, 4000, True)]


def test_sufficient_probes_and_bounds_lose_nothing():
    """Lists, codes and bounds alone, with few lists and coarse codes: every pair within reach is found."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16))
    x[1500:] = x[:1500] + rng.normal(size=(1500, 16)) * 0.08
    x /= np.linalg.norm(x, axis=1)[:, None]
    model = embedding_dedup.fitted(x[:200], 24)
    own, codes, missed, probes = embedding_dedup.coded(model, x, 0.2)
    shard = embedding_dedup.Shard(model, 0.98, np.arange(3000), np.ones(3000, np.int64), own, codes, missed, x)
    probed = np.zeros((3000, len(shard.ids)), bool)
    for q, lists in enumerate(probes):
        probed[q, np.searchsorted(shard.ids, lists[np.isin(lists, shard.ids)])] = True
    node, n, _ = shard.links(np.arange(3000), x, probed)
    want = ((x @ x.T) >= 0.98).sum(1) - 1
    assert probed.mean() < 0.9 and dict(zip(node.tolist(), n.tolist(), strict=True)) == {k: v for k, v in enumerate(want.tolist()) if v}


def test_files_are_held_by_result(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x</p>"), (2, "u", "y")], "page_id long, url string, html string")
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    first, second = common.Held(spark), common.Held(spark)
    with first:
        archives = through_archives(pages)
    with second:
        shards = token_shards(docs, public_tokenizer("word_bpe_49k.json"), end_id=2)
    first.released()
    assert shards.count() == 2
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|No such file"):
        archives.count()
    assert len(second.paths) == 2  # the shards and their manifest
    at = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in second.paths]
    second.released()
    assert not any(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) for p in at)
