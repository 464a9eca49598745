"""Layout exports as a data source: pages as JSON lines to blocks, spans, words, ruling lines or page counts.

A line is a page: {"doc_id", "page", "blocks": [{"bbox", "lines": [{"dir", "spans": [{"text", "size", "bbox", "chars": [{"c", "bbox"}]}]}]}],
"drawings": [{"stroked", "items": [["l", x0, y0, x1, y1], ["re", x0, y0, x1, y1]]}]}, in points from the top left. chars and drawings may be missing.

    layout.register(spark)
    spark.read.format("layout").option("rows", "words").load(folder)
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

BOX = "x0 double, y0 double, x1 double, y1 double"
#: columns of each kind of rows; ord orders the blocks of a document
ROWS = {
    "blocks": f"doc_id string, ord long, page int, {BOX}, size double, text string",
    "spans": f"doc_id string, page int, block int, span int, {BOX}, size double, text string",
    "words": f"doc_id string, page int, {BOX}, size double, turn int, text string",
    "lines": f"doc_id string, page int, {BOX}",
    "pages": "doc_id string, page int, n_chars long",
}
_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
# Fixed values, in points: sizes of type where a page has none, rectangles that are rules, the share of its size that parts two words, the slope from which
# text is turned; and from which share of pages with fewer characters than that a document has no text layer.
USUAL_SIZE, THIN, LONG, WIDE_GAP, TURNED, PAGE_CHARS, SCANNED = 10.0, 2.0, 4.0, 0.5, 0.7, 3, 0.8


@dataclass
class Piece(InputPartition):
    """The pages that begin in a range of bytes of a file."""

    path: str
    start: int
    end: int


def _spans(block: dict) -> Iterator[tuple[dict, dict]]:
    for line in block.get("lines") or ():
        for span in line.get("spans") or ():
            yield line, span


def _text(span: dict) -> str:
    return span["text"] if span.get("text") is not None else "".join(c["c"] for c in span.get("chars") or ())


def _letters(line: dict, span: dict) -> list[tuple[str, list[float]]]:
    """Characters with their boxes; those of a span without any share its box in equal parts, along its text."""
    if span.get("chars"):
        return [(c["c"], c["bbox"]) for c in span["chars"]]
    text, (x0, y0, x1, y1) = _text(span), span["bbox"]
    turn, n = _turn(line), max(len(text), 1)
    part = lambda lo, hi, k: lo + (hi - lo) * k / n
    if turn == 0:
        return [(c, [part(x0, x1, k), y0, part(x0, x1, k + 1), y1]) for k, c in enumerate(text)]
    if turn > 0:
        return [(c, [x0, part(y1, y0, k + 1), x1, part(y1, y0, k)]) for k, c in enumerate(text)]
    return [(c, [x0, part(y0, y1, k), x1, part(y0, y1, k + 1)]) for k, c in enumerate(text)]


def _turn(line: dict) -> int:
    dx, dy = line.get("dir") or (1.0, 0.0)
    return 0 if abs(dx) >= TURNED else 1 if dy < 0 else -1


def _around(boxes: list[list[float]]) -> tuple[float, float, float, float]:
    x0, y0, x1, y1 = zip(*boxes, strict=True)
    return float(min(x0)), float(min(y0)), float(max(x1)), float(max(y1))


def _blocks(page: dict) -> Iterator[tuple]:
    sizes = sorted(s["size"] for b in page.get("blocks") or () for _, s in _spans(b) if s.get("size") is not None)
    usual = sizes[len(sizes) // 2] if sizes else USUAL_SIZE
    for k, block in enumerate(page.get("blocks") or ()):
        text = " ".join(_text(s) for _, s in _spans(block)).strip()
        if text:
            size = max((s["size"] for _, s in _spans(block) if s.get("size") is not None), default=usual)
            yield page["doc_id"], page["page"] * 1_000_000 + k, page["page"], *map(float, block["bbox"]), float(size), text


def _span_rows(page: dict) -> Iterator[tuple]:
    for k, block in enumerate(page.get("blocks") or ()):
        for i, (_, s) in enumerate(_spans(block)):
            yield page["doc_id"], page["page"], k, i, *map(float, s["bbox"]), float(s.get("size") or USUAL_SIZE), _text(s)


def _words(page: dict) -> Iterator[tuple]:
    for block in page.get("blocks") or ():
        for line, s in _spans(block):
            turn, size, word = _turn(line), float(s.get("size") or USUAL_SIZE), []
            for c, box in [*_letters(line, s), (" ", None)]:
                if word and not c.isspace():
                    last = word[-1][1]
                    gap = (box[0] - last[2]) if turn == 0 else (last[1] - box[3]) if turn > 0 else (box[1] - last[3])
                if word and (c.isspace() or gap > WIDE_GAP * size):
                    yield page["doc_id"], page["page"], *_around([b for _, b in word]), size, turn, "".join(x for x, _ in word)
                    word = []
                if not c.isspace():
                    word.append((c, box))


def _lines(page: dict) -> Iterator[tuple]:
    for drawing in page.get("drawings") or ():
        for kind, x0, y0, x1, y1 in drawing.get("items") or ():
            wide, high = x1 - x0, y1 - y0
            sides: list[tuple] = []
            if kind == "l":
                sides = [(x0, y0, x1, y1)]
            elif kind == "re" and wide <= THIN and high > LONG:
                sides = [((x0 + x1) / 2, y0, (x0 + x1) / 2, y1)]
            elif kind == "re" and high <= THIN and wide > LONG:
                sides = [(x0, (y0 + y1) / 2, x1, (y0 + y1) / 2)]
            elif kind == "re" and drawing.get("stroked") and wide > THIN and high > THIN:
                sides = [(x0, y0, x0, y1), (x1, y0, x1, y1), (x0, y0, x1, y0), (x0, y1, x1, y1)]
            for side in sides:
                yield page["doc_id"], page["page"], *map(float, side)


def _pages(page: dict) -> Iterator[tuple]:
    yield page["doc_id"], page["page"], sum(len(row[-1]) for row in _blocks(page))


_MAKE = {"blocks": _blocks, "spans": _span_rows, "words": _words, "lines": _lines, "pages": _pages}
_TEST = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


class LayoutReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.kind, self.path = options.get("rows", "blocks"), options["path"]
        self.piece, self.at_once = int(options.get("pieceBytes", 16 << 20)), int(options.get("batchRows", 10_000))
        self.columns = [f.name for f in schema.fields]
        self.wanted: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions on doc_id and page leave pages out before their rows are made; all others stay with Spark."""
        for f in filters:
            if type(f) in _TEST and len(f.attribute) == 1 and f.attribute[0] in ("doc_id", "page"):
                self.wanted.append(f)
            else:
                yield f

    def partitions(self) -> list[Piece]:
        """Files in pieces of pieceBytes; only names and sizes are read here."""
        fs, root = pafs.FileSystem.from_uri(self.path) if ":" in self.path else (pafs.LocalFileSystem(), self.path)
        found = fs.get_file_info(root)
        if found.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [found] if found.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        files = [f for f in files if f.type == pafs.FileType.File and not f.base_name.startswith(("_", ".")) and f.size]
        return [Piece(f.path, at, min(at + self.piece, f.size)) for f in sorted(files, key=lambda f: f.path) for at in range(0, f.size, self.piece)] or [Piece("", 0, 0)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in ROWS[self.kind].split(", ")]
        kinds = {part.split()[0]: _TYPES[part.split()[1]] for part in ROWS[self.kind].split(", ")}
        keep = [names.index(c) for c in self.columns]
        rows: list[tuple] = []
        for page in self._read_pages(piece):
            rows += (tuple(row[k] for k in keep) for row in _MAKE[self.kind](page))
            if len(rows) >= self.at_once:
                yield self._batch(rows, kinds)
                rows = []
        if rows:
            yield self._batch(rows, kinds)

    def _batch(self, rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if self.columns else ()
        return pa.RecordBatch.from_arrays([pa.array(v, kinds[c]) for c, v in zip(self.columns, columns, strict=True)], self.columns)

    def _read_pages(self, piece: Piece) -> Iterator[dict]:
        if not piece.path:
            return
        fs = pafs.FileSystem.from_uri(self.path)[0] if ":" in self.path else pafs.LocalFileSystem()
        with fs.open_input_file(piece.path) as raw:
            f = io.BufferedReader(raw, 1 << 20)
            f.seek(max(piece.start - 1, 0))
            if piece.start:
                f.readline()  # the end of a page that begins before
            while f.tell() < piece.end and (line := f.readline()):
                if line.strip():
                    page = json.loads(line)
                    if all(_TEST[type(w)](page[w.attribute[0]], w.value) for w in self.wanted):
                        yield page


class LayoutSource(DataSource):
    """format("layout"); option rows: one of ROWS. A schema with some of the columns makes only these."""

    @classmethod
    def name(cls) -> str:
        return "layout"

    def schema(self) -> str:
        kind = self.options.get("rows", "blocks")
        if kind not in ROWS:
            raise ValueError(f"rows are one of {', '.join(ROWS)}")
        return ROWS[kind]

    def reader(self, schema: StructType) -> LayoutReader:
        return LayoutReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes format("layout") known to the session, and lets Spark hand filters to sources written in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LayoutSource)


def scanned(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, n_pages, thin_pages, refused) of an export: documents of which SCANNED of the pages have fewer than PAGE_CHARS characters have no text layer."""
    register(spark)
    pages = spark.read.format("layout").option("rows", "pages").load(path)
    out = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.count_if(F.col("n_chars") < PAGE_CHARS).alias("thin_pages"))
    return out.withColumn("refused", F.col("thin_pages") >= SCANNED * F.col("n_pages"))


def read_layout(spark: SparkSession, path: str, rows: str = "blocks", refuse: bool | None = True) -> DataFrame:
    """Rows of an export without its scanned documents; with refuse, any of those fails the job, by name, as a reader of texts would otherwise miss them in silence.

    None: rows of all documents, none taken for a scan. For exports made of texts, of which the shortest have as few characters as a scan.
    """
    register(spark)
    own = spark.read.format("layout").option("rows", rows).load(path)
    if refuse is None:
        return own
    seen = scanned(spark, path).filter("refused").select("doc_id", F.lit(True).alias("_scanned"))
    if not refuse:
        return own.join(seen, "doc_id", "left_anti")
    stop = F.raise_error(F.concat(F.lit("no text layer: "), F.col("doc_id"))).cast("string")
    out = own.join(seen, "doc_id", "full_outer")  # a scanned document may have no rows at all
    return out.withColumn("doc_id", F.when(F.col("_scanned"), stop).otherwise(F.col("doc_id"))).select(*own.columns)


def write_layout(pages: DataFrame, path: str) -> None:
    """Writes an export. pages: doc_id, page, blocks and, if there are any, drawings, as above; other columns are left out."""
    known = [c for c in ("doc_id", "page", "blocks", "drawings") if c in pages.columns]
    pages.select(F.to_json(F.struct(*(F.col(c).cast("string").alias(c) if c == "doc_id" else F.col(c) for c in known))).alias("value")).write.text(path)
