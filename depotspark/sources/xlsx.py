"""Spreadsheets of the zipped XML format: all values as text, empty cells null, whole numbers without a decimal point, dates
as the serial numbers that are stored. The older binary format needs a conversion.

`read_workbook` reads large ones with all tasks. One task for each workbook inflates the sheet and the shared texts and cuts the
streams at row and text tags into pieces of a few megabytes, a table in the shared folder; it holds the zipped file and one
piece. Then all tasks parse pieces, and cells that name a shared text by its number meet the table of texts in joins, which Spark
broadcasts or shuffles by the table's size. Files are read through Spark, from any file system that it knows.

`read_small` is a data source of one task for each workbook on a mounted path, for previews: it reads no further than asked.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Callable, Iterator
from typing import IO
from xml.etree.ElementTree import Element, fromstring, iterparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from depotspark.operators.graph import cut_lineage

SHEET = "訂單資料"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    """Place of a cell from its reference: A is 0."""
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _text(v: str) -> str:
    """Numbers as they are shown: 3.0 is 3."""
    try:
        f = float(v)
    except ValueError:
        return v
    return str(int(f)) if f.is_integer() and abs(f) < 1e15 else v


def _member(z: zipfile.ZipFile, path: str, sheet: str | None) -> str:
    """The archive's member that holds a sheet: by name, else the one called SHEET, else the first."""
    names = {}
    with z.open("xl/_rels/workbook.xml.rels") as f:
        targets = {e.get("Id"): e.get("Target") for _, e in iterparse(f) if e.get("Target")}
    with z.open("xl/workbook.xml") as f:
        for _, e in iterparse(f):
            if e.tag == _MAIN + "sheet":
                names[e.get("name")] = targets[e.get(_REL)]
    if sheet is not None and sheet not in names:
        raise ValueError(f"no sheet {sheet!r} in {path}; there are {list(names)}")
    target = names[sheet] if sheet is not None else names.get(SHEET) or next(iter(names.values()))
    return target.lstrip("/") if target.startswith("/") else "xl/" + target


def _cells(row: Element) -> list[tuple[str | None, int | None]]:
    """Of each cell of a row its text, or the number of its shared text."""
    out: list[tuple[str | None, int | None]] = []
    for c in row.iter(_MAIN + "c"):
        at = _column(c.get("r")) if c.get("r") else len(out)
        out += [(None, None)] * (at - len(out))
        v, kind = c.find(_MAIN + "v"), c.get("t")
        if kind == "inlineStr":
            out.append(("".join(t.text or "" for t in c.iter(_MAIN + "t")) or None, None))
        elif v is None or v.text is None:
            out.append((None, None))
        elif kind == "s":
            out.append((None, int(v.text)))
        else:
            out.append((v.text if kind in ("str", "b", "e") else _text(v.text), None))
    return out


def sheet_rows(path: str, sheet: str | None = None) -> Iterator[list[str | None]]:
    """Rows of one sheet; only the shared texts are held in memory."""
    with zipfile.ZipFile(path) as z:
        target = _member(z, path, sheet)
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as f:
                for _, e in iterparse(f):
                    if e.tag == _MAIN + "si":
                        shared.append("".join(t.text or "" for t in e.iter(_MAIN + "t")))
                        e.clear()
        with z.open(target) as f:
            for _, e in iterparse(f):
                if e.tag == _MAIN + "row":
                    yield [t if n is None else shared[n] for t, n in _cells(e)]
                    e.clear()


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.path, self.sheet = schema.names, options["path"], options.get("sheet")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        n = len(self.names)
        rows = sheet_rows(partition.value, self.sheet)
        next(rows, None)
        for row in rows:
            if any(x is not None for x in row):
                yield tuple((row + [None] * n)[:n])


class Workbook(DataSource):
    """Columns are the texts of the first row; unnamed ones are c<place>."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> StructType:
        head = next(sheet_rows(self.options["path"], self.options.get("sheet")), [])
        return StructType([StructField((x or f"c{i}").strip(), StringType()) for i, x in enumerate(head)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))


def read_small(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    spark.dataSource.register(Workbook)
    reader = spark.read.format("workbook")
    return (reader.option("sheet", sheet) if sheet else reader).load(path)


#: Bytes of XML in a piece.
PIECE = 4 << 20


def _cut(stream: IO[bytes], tag: bytes, size: int) -> Iterator[tuple[bytes, bytes, int]]:
    """(opening of the document, piece, elements before it) of a stream: each piece holds whole elements of that tag. Nothing but a piece is held."""
    start, buffer, before, head = None, b"", 0, b""
    while chunk := stream.read(size):
        buffer += chunk
        if start is None:
            root = re.search(rb"<(?:([A-Za-z_][\w.-]*):)?(?:worksheet|sst)(?:\s[^>]*)?>", buffer)
            if not root:
                continue
            prefix = root[1] + b":" if root[1] else b""
            head, start = root[0], re.compile(rb"<" + prefix + tag + rb"[\s/>]")
            buffer = buffer[root.end() :]
        last = None
        for last in start.finditer(buffer):
            pass
        if last and last.start():
            piece, buffer = buffer[: last.start()], buffer[last.start() :]
            if n := len(start.findall(piece)):
                yield head, piece[start.search(piece).start() :], before
                before += n
    if start is not None and (first := start.search(buffer)):
        end = re.search(rb"</(?:[A-Za-z_][\w.-]*:)?(?:sheetData|sst)\s*>", buffer)
        yield head, buffer[first.start() : end.start() if end else len(buffer)], before


def _elements(head: bytes, piece: bytes, tag: str) -> Iterator[Element]:
    name = re.match(rb"<([^\s>/]+)", head)[1]
    doc = fromstring(head.removesuffix(b"/>").removesuffix(b">") + b">" + piece + b"</" + name + b">")
    return doc.iter(_MAIN + tag)


def _pieces(spark: SparkSession, path: str, sheet: str | None, size: int) -> DataFrame:
    """file, kind (row or text), k, before (elements in earlier pieces), head, xml."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content")):
                with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as z:
                    wanted = [("row", _member(z, file.as_py(), sheet)), *([("text", "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in z.namelist() else [])]
                    for kind, member in wanted:
                        with z.open(member) as f:
                            for k, (head, xml, before) in enumerate(_cut(f, b"row" if kind == "row" else b"si", size)):
                                yield pa.RecordBatch.from_pydict({"file": [file.as_py()], "kind": [kind], "k": [k], "before": [before], "head": [head], "xml": [xml]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, kind string, k long, before long, head binary, xml binary")


def _each(pieces: DataFrame, kind: str, schema: str, make: Callable[..., Iterator[tuple]]) -> DataFrame:
    """Rows that make(file, k, before, head, xml) gives for the pieces of a kind, dealt over the tasks one by one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                got = list(make(r["file"], r["k"], r["before"], r["head"], r["xml"]))
                if got:
                    yield _batch(got, schema)

    rows = pieces.where(F.col("kind") == kind).drop("kind")
    return rows.repartition(max(1, min(rows.count(), MOST_TASKS)), "file", "k").mapInArrow(run, schema)


#: Tasks that parse pieces, at most.
MOST_TASKS = 10_000

_TYPES = {"string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None, row_id: bool = False, piece: int = PIECE) -> DataFrame:
    """A workbook, or a folder of workbooks with one header, as text columns named by the first row (c<place> without a name).
    Rows without a value are left out. row_id adds a long that grows with the place in the sheet."""
    pieces = cut_lineage(_pieces(spark, path, sheet, piece))

    def texts(file: str, k: int, before: int, head: bytes, xml: bytes) -> Iterator[tuple]:
        for i, e in enumerate(_elements(head, xml, "si")):
            yield file, before + i, "".join(t.text or "" for t in e.iter(_MAIN + "t"))

    def rows(file: str, k: int, before: int, head: bytes, xml: bytes) -> Iterator[tuple]:
        for i, e in enumerate(_elements(head, xml, "row")):
            cells = _cells(e)
            yield file, before + i, [t for t, _ in cells], [n for _, n in cells]

    shared = cut_lineage(_each(pieces, "text", "file string, n long, text string", texts))
    cells = cut_lineage(_each(pieces, "row", "file string, i long, v array<string>, s array<long>", rows))
    # headers: one row for each file, and the texts that they name
    top = cells.where("i = 0").select("file", F.posexplode(F.arrays_zip("v", "s")).alias("at", "c")).select("file", "at", F.col("c.v").alias("v"), F.col("c.s").alias("n"))
    top = top.join(shared, ["file", "n"], "left").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("v", "text", F.concat(F.lit("c"), F.col("at").cast("string"))).alias("name")))).alias("h"))
    heads = top.select("h.name").distinct().limit(2).collect()
    if len(heads) > 1:
        raise ValueError(f"workbooks with different headers in {path}: {[h[0] for h in heads]}")
    names = [x.strip() for x in heads[0][0]] if heads else []
    out = cells.where("i > 0").select("file", "i", *[x for k in range(len(names)) for x in (F.get("v", F.lit(k)).alias(f"v{k}"), F.get("s", F.lit(k)).alias(f"s{k}"))])
    used = cells.select(F.explode("s").alias("n")).where("n is not null").limit(1).count() > 0
    for k in range(len(names)) if used else ():
        # cells without a shared text get numbers of their own, so they are no hot group
        own = F.coalesce(f"s{k}", -1 - F.pmod(F.xxhash64("i"), F.lit(1 << 16)))
        side = shared.select(F.col("file").alias("file_"), F.col("n").alias("n_"), F.col("text").alias(f"t{k}"))
        out = out.join(side, (F.col("file") == F.col("file_")) & (own == F.col("n_")), "left").drop("file_", "n_")
    value = lambda k: F.coalesce(f"v{k}", f"t{k}") if used else F.col(f"v{k}")
    out = out.select(*([F.col("i").alias("row_id")] if row_id else []), *[value(k).alias(n) for k, n in enumerate(names)])
    return out.where(F.coalesce(*[F.col(f"`{n}`") for n in names]).isNotNull()) if names else out
