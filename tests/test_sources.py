"""The layout source and job state on streams."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tarnwork.operators import features, grids, ruled
from tarnwork.plans import catalog
from tarnwork.shared import checkpointed
from tarnwork.sources import files, latest, layout
from tarnwork.streaming import jobs


def span(text, x, y, size=10.0, chars=False):
    out = {"text": text, "size": size, "bbox": [x, y, x + 5.0 * len(text), y + size]}
    return out | {"chars": [{"c": c, "bbox": [x + 5.0 * k, y, x + 5.0 * k + 5, y + size]} for k, c in enumerate(text)]} if chars else out


def page(doc, n, *spans, drawings=None, dir=(1.0, 0.0)):
    blocks = [{"bbox": s["bbox"], "lines": [{"dir": list(dir), "spans": [s]}]} for s in spans]
    return {"doc_id": doc, "page": n, "blocks": blocks} | ({"drawings": drawings} if drawings else {})


@pytest.fixture
def export(tmp_path):
    rng = random.Random(3)
    files = {"a": [page("a", n, *(span(f"line {n} {k} " + "é" * rng.randrange(40), 10, 20.0 * k, rng.choice([9.0, 14.0]), k % 2 == 0) for k in range(rng.randrange(1, 9)))) for n in range(1, 60)], "b": [page("b", 1, span("only", 1, 2)), page("b", 2)]}
    for name, pages in files.items():
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps(p, ensure_ascii=False) + "\n" for p in pages))
    (tmp_path / "_SUCCESS").write_text("")
    return str(tmp_path), [p for pages in files.values() for p in pages]


@pytest.mark.parametrize("piece", [100, 1000, 1 << 24])
def test_layout_pages_belong_to_one_piece(spark, export, piece):
    path, pages = export
    layout.register(spark)
    got = spark.read.format("layout").option("pieceBytes", piece).load(path).orderBy("doc_id", "ord").collect()
    want = [(p["doc_id"], p["page"], b["lines"][0]["spans"][0]["text"].strip(), b["lines"][0]["spans"][0]["size"], *b["bbox"]) for p in pages for b in p["blocks"]]
    assert [(r.doc_id, r.page, r.text, r.size, r.x0, r.y0, r.x1, r.y1) for r in got] == want


def test_layout_filters_and_columns(spark, export):
    path, pages = export
    layout.register(spark)
    read = spark.read.format("layout").option("rows", "spans")
    some = read.load(path).filter("page >= 58 and doc_id = 'a' and size > 10")
    want = [s for p in pages for b in p["blocks"] for s in b["lines"][0]["spans"] if p["doc_id"] == "a" and p["page"] >= 58 and s["size"] > 10]
    assert sorted(r.text for r in some.collect()) == sorted(s["text"] for s in want) and want
    two = spark.read.format("layout").option("rows", "spans").schema("text string, page int").load(path)
    assert two.columns == ["text", "page"] and two.count() == sum(len(p["blocks"]) for p in pages)
    assert sorted(two.filter("page = 1").collect()) == sorted((s["text"], 1) for p in pages for b in p["blocks"] for s in b["lines"][0]["spans"] if p["page"] == 1)
    with pytest.raises(Exception, match="rows are one of"):
        spark.read.format("layout").option("rows", "figures").load(path)
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("layout").load(f"{path}/nowhere").collect()


def test_scanned_documents_are_refused(spark, export, tmp_path):
    path, _ = export
    (tmp_path / "c.jsonl").write_text("".join(json.dumps(page("c", n, *([span("t", 1, 1)] if n == 1 else []))) + "\n" for n in range(1, 11)))
    got = {r.doc_id: (r.n_pages, r.thin_pages, r.refused) for r in layout.scanned(spark, path).collect()}
    assert got == {"a": (59, 0, False), "b": (2, 1, False), "c": (10, 10, True)}
    assert {r.doc_id for r in layout.read_layout(spark, path, refuse=False).select("doc_id").distinct().collect()} == {"a", "b"}
    with pytest.raises(Exception, match="no text layer: c"):
        layout.read_layout(spark, path).collect()


def test_documents_of_a_letter_are_no_scans(spark, tmp_path):
    rows = [(1, "a"), (2, None), (3, "One line that is longer.\nx\n\nyz"), (4, "q\n" * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.page, r.text) for r in catalog.QUERIES["layout_blocks"](spark, str(tmp_path)).collect()}
    assert got == {(1, 1, "a"), (3, 1, "One line that is longer."), (3, 1, "x"), (3, 1, "yz"), (4, 1, "q"), (4, 2, "q")}


def test_layout_words_by_gaps_and_turns(spark, tmp_path):
    wide = span("abcd", 0, 0, chars=True)
    for c in wide["chars"][2:]:
        c["bbox"] = [c["bbox"][0] + 20, 0.0, c["bbox"][2] + 20, 10.0]
    up = {"text": "up it", "size": 10.0, "bbox": [50.0, 10.0, 60.0, 60.0]}
    pages = [page("d", 1, wide, span("two words", 0, 30)), page("d", 2, up, dir=(0.0, -1.0)), page("d", 3, up, dir=(0.0, 1.0)), {"doc_id": "d", "page": 4}]
    (tmp_path / "d.jsonl").write_text("\n".join(map(json.dumps, pages)))
    layout.register(spark)
    got = spark.read.format("layout").option("rows", "words").load(str(tmp_path)).orderBy("page", "y0", "x0").collect()
    assert [(r.page, r.text, r.turn, r.x0, r.y0, r.x1, r.y1) for r in got] == [
        (1, "ab", 0, 0.0, 0.0, 10.0, 10.0), (1, "cd", 0, 30.0, 0.0, 40.0, 10.0), (1, "two", 0, 0.0, 30.0, 15.0, 40.0), (1, "words", 0, 20.0, 30.0, 45.0, 40.0),
        (2, "it", 1, 50.0, 10.0, 60.0, 30.0), (2, "up", 1, 50.0, 40.0, 60.0, 60.0), (3, "up", -1, 50.0, 10.0, 60.0, 30.0), (3, "it", -1, 50.0, 40.0, 60.0, 60.0),
    ]


def test_from_layout_to_schedule(spark, tmp_path):
    """An export with a drawn table, read to words and lines, to cells, to marks."""
    xs, ys = [0, 60, 120, 180], [0, 20, 40, 60]
    items = [["l", x, 0, x, 60] for x in xs[:2]] + [["re", x - 0.5, 0, x + 0.5, 60] for x in xs[2:]] + [["l", 0, y, 180, y] for y in ys[1:]] + [["re", 0, 0, 180, 60]]
    words = [("ECG", 5, 44), ("D1", 65, 24), ("D2", 125, 24), ("Period", 65, 4), ("x", 130, 44)]
    pages = spark.createDataFrame([json.dumps(page("s", 1, *(span(t, x, y) for t, x, y in words), drawings=[{"stroked": True, "items": items}]))], "string").select("value")
    pages.write.text(str(tmp_path / "out"))
    read = lambda rows: layout.read_layout(spark, str(tmp_path / "out"), rows)
    cells = checkpointed(ruled.ruled_cells(read("lines"), read("words"), ["doc_id", "page"]))
    assert [(r.activity, r.visit_col, r.visit) for r in grids.read_ruled(cells, ["doc_id", "page"]).collect()] == [("ECG", 2, "D2")]


def test_written_exports_are_read_again(spark, export, tmp_path_factory):
    (path, _), tmp_path = export, tmp_path_factory.mktemp("exports")
    schema = "doc_id string, page int, blocks array<struct<bbox:array<double>,lines:array<struct<dir:array<double>,spans:array<struct<text:string,size:double,bbox:array<double>>>>>>>"
    layout.write_layout(spark.read.schema(schema).json(f"{path}/*.jsonl"), str(tmp_path / "again"))
    layout.register(spark)
    read = lambda p: sorted(map(tuple, spark.read.format("layout").load(p).collect()))
    assert read(str(tmp_path / "again")) == read(path)


def test_job_states_on_a_stream(spark, tmp_path):
    """Late, repeated and missing events: the stream's last word on each job is the batch result, and silent jobs fail."""
    jobs.use_job_state(spark)
    start = dt.datetime(2024, 1, 1)
    at = lambda s: start + dt.timedelta(seconds=s)
    first = [("a", "running", at(0), 1), ("b", "running", at(5), 1), ("c", "running", at(8), 1), ("c", "done", at(9), 2), ("a", "queued", at(0), 0)]
    second = [("a", "running", at(250), 2), ("a", "running", at(250), 2), ("b", "queued", at(1), 0), ("d", "running", at(300), 1)]
    third = [("e", "running", at(700), 1), ("a", "done", at(640), 3)]
    fourth = [("f", "running", at(6000), 1)]
    source = tmp_path / "in"
    source.mkdir()
    schema = "job string, state string, at timestamp, seq long"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    told = []
    for k, batch in enumerate((first, second, third, fourth)):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(str(source))
        query = jobs.job_changes(stream, silent="300 seconds", ttl="1000 seconds", lateness="30 seconds").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda df, _: told.extend(df.collect())).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    last = {}
    for r in told:
        last[r.job] = r
    assert {j: (r.state, r.by_timer) for j, r in last.items()} == {"a": ("done", False), "b": ("failed", True), "c": ("done", False), "d": ("failed", True), "e": ("failed", True), "f": ("running", False)}
    assert {j: (last[j].at - start).total_seconds() for j in "bde"} == {"b": 305.0, "d": 600.0, "e": 1000.0}
    assert sum(r.job == "a" for r in told) == 3  # repeated and older events tell nothing
    log = spark.createDataFrame([x for b in (first, second, third, fourth) for x in b], schema)
    batch = {r.job: r.state for r in features.live_jobs(log, F.lit(at(6000)), ttl_seconds=100_000).collect()}
    assert all(last[j].state == s for j, s in batch.items() if not last[j].by_timer)


def test_newest_rows_through_compactions(spark, tmp_path):
    """Late, repeated and equal rows; a reader sees the same before, during and after each compaction, and a dead one counts for nothing."""
    rng, path, state = random.Random(2), str(tmp_path / "cache"), {}
    assert files.read_cache(spark, path).count() == 0 and latest.vacuum(spark, path) == 0

    def read():
        return {r.key: (r.seq, r.response) for r in files.read_cache(spark, path).collect()}

    seqs = rng.sample(range(1000), 240)
    for k in range(4):
        rows = [(f"k{rng.randrange(40)}", s, rng.choice(["a", "b", " ", None])) for s in seqs[60 * k : 60 * k + 60]]
        files.write_cache(spark.createDataFrame(rows, files.CACHE), path)
        for key, seq, text in rows:
            if text and text.strip() and (seq, text) > state.get(key, (-1, "")):
                state[key] = (seq, text)
        assert read() == state
        assert latest.compact(spark, path, ["key"], files.CACHE) == k + 1
        assert read() == state
        if k == 1:
            assert latest.vacuum(spark, path) > 0 and read() == state
    (tmp_path / "cache/state/gen=99").mkdir()  # begun, never finished
    before = files.read_cache(spark, path)
    files.write_cache(spark.createDataFrame([("new", 5000, "x")], files.CACHE), path)
    assert latest.compact(spark, path, ["key"], files.CACHE) == 5
    assert {r.key: (r.seq, r.response) for r in before.collect()} == state
    latest.vacuum(spark, path)
    assert read() == state | {"new": (5000, "x")}
    assert {p.name for p in (tmp_path / "cache/state").iterdir()} == {"gen=5", "gen=99"} and not list((tmp_path / "cache/log").glob("part*"))


def test_corrections_of_many_documents_are_few_files(spark, tmp_path):
    docs = spark.range(100_000).select(F.col("id").alias("doc_id"))
    fixes = docs.filter("doc_id % 10 = 0").select("doc_id", F.lit("f").alias("field"), F.col("doc_id").cast("string").alias("value"))
    files.write_corrections(fixes, str(tmp_path / "c"), docs, seq=1)
    got = files.read_corrections(spark, str(tmp_path / "c"), "field string, value string")
    assert got.count() == 100_000 and got.filter("size(corrections) > 0").count() == 10_000
    assert len(list((tmp_path / "c/log").iterdir())) < 50
