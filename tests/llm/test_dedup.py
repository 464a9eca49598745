import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.llm import graphs, ngram_jaccard, substring_dedup
from tarnwork.llm.exact_dedup import ascii_lower, drop_duplicates, duplicate_groups
from tarnwork.llm.ngram_jaccard import jaccard_components, one_of_each_group
from tarnwork.llm.substring_dedup import FMIndex, drop_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, _text string, _row int, n_words int"


def table(spark, docs):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "x", 7, 1) for i, t in docs], SCHEMA)


def odd_docs():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["É", "ß", "Ab"]
    base = [rng.choice(words) for _ in range(80)]
    docs = [(i, " ".join(base[: 40 + i % 30] + [rng.choice(words) for _ in range(rng.randrange(30))])) for i in range(40)]
    docs += [(40 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(20)))) for i in range(20)]
    return docs + [(60, None), (61, ""), (62, " \t\n"), (63, docs[3][1]), (64, docs[3][1].upper()), (None, docs[5][1]), (65, "a  b\n" * 3000), (66, docs[7][1]), (66, docs[7][1])]


def test_exact_groups(spark):
    docs = odd_docs()
    low = [(i, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t in docs]
    want = sorted(
        ((i, max((j for j, u in low if u == t and j is not None), default=None), sum(u == t for _, u in low), hashlib.sha256(t.encode()).hexdigest()) for i, t in low), key=str
    )
    for digest in (F.md5, lambda c: F.substring(F.md5(c), 1, 1)):  # the second collides all the time
        got = duplicate_groups(table(spark, docs), ascii_lower, keep="max", digest=digest).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
        assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_exact_drop(spark):
    docs = table(spark, odd_docs())
    got = drop_duplicates(docs)
    assert got.schema.simpleString() == docs.schema.simpleString()
    rows = [(r.doc_id, r.text) for r in got.collect()]
    first = {}
    for i, t in odd_docs():
        k = t or ""
        if k not in first or (first[k] is None) or (i is not None and i < first[k]):
            first[k] = i
    assert sorted((i, t or "") for i, t in rows) == sorted((i, k) for k, i in first.items())


def test_exact_drop_with_maps(spark):
    rows = [(2, "t", {"b": 1}), (1, "t", {"c": 2}), (1, "t", {"a": 9}), (3, None, None), (4, "", {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `m.x` map<string,int>")
    got = drop_duplicates(docs)
    assert got.schema.simpleString() == docs.schema.simpleString()
    assert sorted(tuple(r) for r in got.collect()) == [(1, "t", {"a": 9}), (3, None, None)]


def brute_components(docs, n, percent):
    sets = []
    for i, t in docs:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())))
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            c = len(sets[a][1] & sets[b][1])
            if c and 100 * c >= percent * (len(sets[a][1]) + len(sets[b][1]) - c):
                up[root(a)] = root(b)
    low = lambda i: -(2**63) if i is None else i
    least = {}
    for x, (i, _) in enumerate(sets):
        least[root(x)] = min(low(i), least.get(root(x), 2**63))
    return sorted((low(i), len(s), least[root(x)]) for x, (i, s) in enumerate(sets))


@pytest.mark.parametrize(("n", "percent", "light", "block"), [(3, 90, 16, 1024), (5, 80, 1, 4), (2, 60, 2, 8), (1, 50, 3, 30)])
def test_jaccard(spark, monkeypatch, n, percent, light, block):
    monkeypatch.setattr(ngram_jaccard, "LIGHT", light)
    monkeypatch.setattr(ngram_jaccard, "BLOCK", block)
    low = lambda i: -(2**63) if i is None else i
    got = sorted((low(r.doc_id), r.n_shingles, low(r.component_id)) for r in jaccard_components(table(spark, odd_docs()), n, percent).collect())
    assert got == brute_components(odd_docs(), n, percent)


def test_jaccard_keeps_one(spark):
    docs = table(spark, odd_docs())
    got = one_of_each_group(docs, 5, 80)
    assert got.columns == docs.columns
    low = lambda i: -(2**63) if i is None else i
    assert sorted(low(r.doc_id) for r in got.collect()) == sorted(i for i, _, c in brute_components(odd_docs(), 5, 80) if i == c)


@pytest.mark.parametrize("small", [1_000_000, 0])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(graphs, "SMALL", small)
    rng = random.Random(small)
    edges = [(i, i + 1) for i in range(-40, 60)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)] + [(2000, 2000 + k) for k in range(50)] + [(9, 9)]
    up = {x: x for e in edges for x in e}
    for _ in range(len(up)):
        new = {x: min([up[x], *(up[b] for a, b in edges if a == x), *(up[a] for a, b in edges if b == x)]) for x in up}
        if new == up:
            break
        up = new
    got = graphs.components(spark.createDataFrame(edges, "a long, b long").repartition(3))
    assert {r.node: r.component for r in got.collect()} == up
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard_with_colliding_names(spark, monkeypatch):
    """With names of five bits nearly all sets collide at first; all get other names."""
    prepared = ngram_jaccard._prepared
    monkeypatch.setattr(ngram_jaccard, "_prepared", lambda docs, n, percent: prepared(docs, n, percent, bits=5))
    low = lambda i: -(2**63) if i is None else i
    got = sorted((low(r.doc_id), r.n_shingles, low(r.component_id)) for r in jaccard_components(table(spark, odd_docs()), 5, 80).collect())
    assert got == brute_components(odd_docs(), 5, 80)


def test_jaccard_keeps_rows_not_ids(spark):
    t, u = " ".join(f"a{i}" for i in range(100)), " ".join(f"b{i}" for i in range(100))
    docs = [(1, t), (5, t + " zz"), (5, u), (-(2**63), u + " y"), (9, "c d e f g h"), (9, "c d e f g h"), (7, None), (7, None), (None, "x1 x2 x3 x4 x5 x6"), (3, "x1  x2 x3 x4 x5 x6")]
    got = sorted(((r.doc_id, r.text) for r in one_of_each_group(table(spark, docs), 5, 80).collect()), key=str)
    want = [(1, t), (-(2**63), u + " y"), (9, "c d e f g h"), (7, None), (7, None), (None, "x1 x2 x3 x4 x5 x6")]
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("hot", [5_000, 1])
def test_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr("tarnwork.llm.substring_dedup.HOT", hot)
    docs, low = odd_docs(), lambda i: -(2**63) if i is None else i
    words = [(low(i), WORD.findall(t or "")) for i, t in docs]
    first = {}
    for i, w in words:
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, i), i)
    want = []
    for i, w in words:
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        want.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    assert sorted((low(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in drop_repeats(table(spark, docs), 13).collect()) == sorted(want)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    for got in (duplicate_groups(none), drop_duplicates(none), jaccard_components(none), one_of_each_group(none), drop_repeats(none)):
        assert got.count() == 0


def test_index_finds_the_least_document():
    rng = np.random.default_rng(3)
    lens = rng.integers(13, 60, 300)
    symbols = rng.integers(1, 6, int(lens.sum()))
    weights = rng.integers(-(2**60), 2**60, len(lens))
    index = FMIndex(symbols, lens, weights)
    ends = np.cumsum(lens)
    for size in (1, 2, 3, 7):
        for _ in range(12):
            s = int(rng.integers(0, len(lens)))
            at = int(ends[s] - lens[s] + rng.integers(size, lens[s]))
            length, lo, hi = index.matches(symbols, np.array([at]), size)
            got = symbols[at - size : at].tolist()
            holders = [int(w) for k, w in enumerate(weights) if any(symbols[i : i + size].tolist() == got for i in range(int(ends[k] - lens[k]), int(ends[k]) - size + 1))]
            assert length[0] == size and int(index.least(lo, hi)[0]) == min(holders)
    big = FMIndex(rng.integers(1, 30_000, 100_000), np.full(1000, 100), np.arange(1000))
    assert big.nbytes() / 100_000 < 14  # planes, ranks, a number for each suffix, symbols' counts


def test_segments_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "PIECE_BYTES", 300)
    rows = [(1, " ".join(f"w{i}" for i in range(400))), (2, "x " + " ".join(f"w{i}" for i in range(100, 300)))]
    got = {r.doc_id: r.n_removed for r in drop_repeats(table(spark, rows), 13).collect()}
    assert got == {1: 0, 2: 200}


def test_texts_that_repeat_themselves_fill_no_index(spark, monkeypatch):
    """Long texts of one passage over and over are one segment each; by their words their anchor is hot, and what is indexed stays small."""
    monkeypatch.setattr(substring_dedup, "HOT_WORDS", 3_000)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 3_000)
    passage = " ".join(f"w{k}" for k in range(5))
    docs = [(i, " ".join([passage] * 300 + [f"own{i}"])) for i in range(12)] + [(50, " ".join(f"x{k}" for k in range(40)))]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in drop_repeats(table(spark, docs)).collect()}
    assert got == {0: (1501, 0), **{i: (1501, 1500) for i in range(1, 12)}, 50: (40, 0)}
    docs_ = table(spark, docs).selectExpr("doc_id", "text")
    sizes = substring_dedup._anchors(docs_, 13).groupBy("anchor").agg(F.sum("words").alias("n")).filter(f"n > {substring_dedup.HOT_WORDS}").count()
    assert sizes > 0


def shuffled(spark):
    """Bytes that the session's stages have written to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_repeats_shuffle_few_bytes(spark, tmp_path):
    """Texts are shuffled once and packed, segments without hashes, and removed windows as runs."""
    rng = random.Random(8)
    words = ["".join(rng.choices("aeinrstlomd", k=rng.randrange(2, 11))) for _ in range(2_000)]
    docs = [(i, " ".join(rng.choices(words, k=300))) for i in range(600)]
    docs += [(1_000 + i, " ".join(rng.choices(words, k=20)) + " " + t) for i, t in docs[:240]]
    table(spark, docs).write.parquet(str(tmp_path / "docs"))
    before = shuffled(spark)
    drop_repeats(spark.read.parquet(str(tmp_path / "docs"))).write.parquet(str(tmp_path / "out"))
    x = (shuffled(spark) - before) / sum(len(t) for _, t in docs)
    assert x < 2.8
    got = {r.doc_id: r.n_removed for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {i: 300 * (i >= 1_000) for i, _ in docs}


def test_rows_with_one_id_lose_their_own_windows(spark):
    """Rows with one doc_id are told apart by their texts, also where these are packed in several blocks."""
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    docs = [(1, a), (2, b + " " + a), (2, c), (2, "x " + b), (3, c + " " + b), (3, ""), (3, None), (None, c), (None, a + " y")]
    got = sorted(((r.doc_id or 0, r.n_words, r.n_removed) for r in drop_repeats(table(spark, docs)).collect()))
    assert got == sorted([(1, 40, 40), (2, 80, 40), (2, 40, 40), (2, 41, 0), (3, 80, 80), (3, 0, 0), (3, 0, 0), (0, 40, 0), (0, 41, 0)])
