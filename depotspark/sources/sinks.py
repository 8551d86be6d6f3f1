"""Writers of a cleaning result: tables, CSV files, one ZIP of CSV files, one workbook, JSON rows.

Tasks write the rows; archives are put together from the tasks' files by streams of the JVM (see hadoop.write_archive), on any
file system that Spark reads.
"""

from __future__ import annotations

import uuid
from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from depotspark.operators.graph import shared_dir
from depotspark.sources.hadoop import Member, part_files, remove, write_archive

BOM = "\ufeff"
#: Rows of a sheet's part file, and part files of a sheet: a sheet may have 1,048,576 rows, its header among them.
PART_ROWS, SHEET_PARTS = 100_000, 10


def write_tables(frames: dict[str, DataFrame], folder: str) -> None:
    """Each frame as Parquet under its name."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_csv(frames: dict[str, DataFrame], folder: str) -> None:
    """Each frame as CSV files with header and CRLF, in the order given; written by the tasks, not through the driver."""
    for name, df in frames.items():
        df.write.mode("overwrite").option("header", True).option("lineSep", "\r\n").option("emptyValue", "").csv(f"{folder}/{name}.csv")


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"' if any(c in name for c in ',"\r\n') else name


def _assemble(frames: dict[str, DataFrame], write, build, target: str) -> None:
    """Has the tasks write each frame to a folder of its own, builds the archive's members from the part files, and removes the folders."""
    spark = next(iter(frames.values())).sparkSession
    folder = f"{shared_dir(spark)}/export/{uuid.uuid4().hex}"
    try:
        parts = {}
        for k, (name, df) in enumerate(frames.items()):
            write(df, f"{folder}/{k}")
            parts[name] = part_files(spark, f"{folder}/{k}")
        write_archive(spark, target, build(parts))
    finally:
        remove(spark, folder)


def zip_csv(frames: dict[str, DataFrame], target: str, readme: str) -> None:
    """The frames as one ZIP for a spreadsheet user: one CSV for each, with a byte order mark, one header and CRLF, and a readme."""
    def write(df: DataFrame, folder: str) -> None:
        df.write.option("lineSep", "\r\n").option("emptyValue", "").option("escape", '"').csv(folder)

    def build(parts: dict[str, list[str]]) -> list[Member]:
        head = lambda df: (BOM + ",".join(map(_quoted, df.columns)) + "\r\n").encode()
        return [Member("readme.txt", (BOM + readme.replace("\n", "\r\n")).encode()), *[Member(f"{name}.csv", head(df), parts[name]) for name, df in frames.items()]]

    _assemble(frames, write, build, target)


# ---- workbooks


def _text_cell(c: Column) -> Column:
    """A cell with its text inside; characters that XML doesn't know are left out."""
    known = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", "")
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
        known = F.replace(known, F.lit(old), F.lit(new))
    return F.concat(F.lit('<c t="inlineStr"><is><t xml:space="preserve">'), known, F.lit("</t></is></c>"))


def _cell(name: str, kind: Ty.DataType) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(kind, Ty.BooleanType):
        value = F.concat(F.lit('<c t="b"><v>'), c.cast("int").cast("string"), F.lit("</v></c>"))
    elif isinstance(kind, (Ty.DoubleType, Ty.FloatType)):
        value = F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.concat(F.lit("<c><v>"), c.cast("string"), F.lit("</v></c>")))
    elif isinstance(kind, Ty.NumericType):
        value = F.concat(F.lit("<c><v>"), c.cast("string"), F.lit("</v></c>"))
    elif isinstance(kind, (Ty.ArrayType, Ty.MapType, Ty.StructType)):
        value = _text_cell(F.to_json(c))
    else:
        value = _text_cell(c.cast("string"))
    return F.coalesce(value, F.lit("<c/>"))


def sheet_rows(df: DataFrame) -> DataFrame:
    """One column with the XML of each row. Numbers are numbers, dates ISO texts, null and not finite ones empty cells."""
    return df.select(F.concat(F.lit("<row>"), *[_cell(f.name, f.dataType) for f in df.schema], F.lit("</row>")).alias("value"))


_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_DOC = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_PKG, _OFFICE = "http://schemas.openxmlformats.org/package/2006", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def write_workbook(frames: dict[str, DataFrame], target: str) -> None:
    """The frames as one .xlsx, a sheet for each in the order given, the first row the column names. A frame with more than a
    million rows goes on in sheets "name (2)", "name (3)", ... Names of sheets have at most 31 characters."""
    def write(df: DataFrame, folder: str) -> None:
        sheet_rows(df).write.option("maxRecordsPerFile", PART_ROWS).text(folder)

    def build(parts: dict[str, list[str]]) -> list[Member]:
        sheets, members = [], []
        for name, files in parts.items():
            head = "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(c, False)}</t></is></c>' for c in frames[name].columns)
            for k, at in enumerate(range(0, max(1, len(files)), SHEET_PARTS)):
                sheets.append(name if not k else f"{name} ({k + 1})")
                members.append(Member(f"xl/worksheets/sheet{len(sheets)}.xml", f"{_DOC}<worksheet {_NS}><sheetData><row>{head}</row>\n".encode(), files[at : at + SHEET_PARTS], b"</sheetData></worksheet>"))
        bad = [s for s in sheets if len(s) > 31 or any(c in s for c in "[]:*?/\\")]
        if bad:
            raise ValueError(f"no names of sheets: {bad}")
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(len(sheets)))
        listed = "".join(f'<sheet name="{escape(s)}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, s in enumerate(sheets))
        linked = "".join(f'<Relationship Id="rId{i + 1}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets)))
        texts = {
            "[Content_Types].xml": f'<Types xmlns="{_PKG}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>',
            "_rels/.rels": f'<Relationships xmlns="{_PKG}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'<workbook {_NS} xmlns:r="{_OFFICE}"><sheets>{listed}</sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PKG}/relationships">{linked}</Relationships>',
        }
        return [*[Member(n, (_DOC + t).encode()) for n, t in texts.items()], *members]

    _assemble(frames, write, build, target)


# ---- JSON


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def _whole(c: Column, kind: Ty.DataType) -> Column:
    """A map's key as JSON writes it: whole numbers without a decimal point, dates as yyyy-MM-dd."""
    if isinstance(kind, (Ty.DoubleType, Ty.FloatType)):
        return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("long").cast("string")).otherwise(c.cast("string"))
    if isinstance(kind, (Ty.DateType, Ty.TimestampType, Ty.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd")
    return c.cast("string")


def json_safe(c: Column, kind: Ty.DataType) -> Column:
    """c with what JSON can't hold made safe at every depth: NaN and infinities null, dates yyyy-MM-dd, keys of maps texts. Made from the type alone."""
    if isinstance(kind, (Ty.DoubleType, Ty.FloatType)):
        return _finite(c)
    if isinstance(kind, (Ty.DateType, Ty.TimestampType, Ty.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(kind, Ty.StructType):
        return F.when(c.isNotNull(), F.struct(*[json_safe(c[f.name], f.dataType).alias(f.name) for f in kind])) if kind.fields else c
    if isinstance(kind, Ty.ArrayType):
        return F.transform(c, lambda x: json_safe(x, kind.elementType))
    if isinstance(kind, Ty.MapType):
        pairs = F.transform(F.map_entries(c), lambda e: F.struct(_whole(e["key"], kind.keyType).alias("key"), json_safe(e["value"], kind.valueType).alias("value")))
        return F.map_from_entries(pairs)
    return c


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON text for each row, see json_safe; nulls are written."""
    clean = [json_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema]
    return df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("json"))
