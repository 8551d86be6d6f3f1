"""Workbooks read in pieces and written from tasks, archives, previews, JSON of nested values."""

import datetime
import json
import random
import zipfile
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from depotspark import reference_values as R
from depotspark.operators import graph
from depotspark.sources import files, sinks, xlsx

NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(path, rows, prefix="", shared=True):
    """A workbook by hand: texts shared or inline, numbers, empty cells; rows: lists of str, number or None."""
    p, texts = f"{prefix}:" if prefix else "", {}
    at = lambda j: chr(65 + j) if j < 26 else chr(64 + j // 26) + chr(65 + j % 26)

    def cell(i, j, v):
        ref = f'r="{at(j)}{i + 1}"'
        if v is None:
            return "" if j % 2 else f"<{p}c {ref}/>"
        if isinstance(v, str):
            if shared:
                return f'<{p}c {ref} t="s"><{p}v>{texts.setdefault(v, len(texts))}</{p}v></{p}c>'
            return f'<{p}c {ref} t="inlineStr"><{p}is><{p}t>{escape(v)}</{p}t></{p}is></{p}c>'
        return f"<{p}c {ref}><{p}v>{v}</{p}v></{p}c>"

    body = "".join(f'<{p}row r="{i + 1}">{"".join(cell(i, j, v) for j, v in enumerate(r))}</{p}row>' for i, r in enumerate(rows))
    xmlns = f'xmlns{":" + prefix if prefix else ""}="{NS}"'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{NS}" xmlns:r="{REL}"><sheets><sheet name="s" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<?xml version="1.0"?><{p}worksheet {xmlns}><{p}sheetViews/><{p}sheetData>{body}</{p}sheetData><{p}rowBreaks count="0"/></{p}worksheet>')
        if texts:
            z.writestr("xl/sharedStrings.xml", f'<{p}sst {xmlns} count="{len(texts)}">{"".join(f"<{p}si><{p}t>{escape(t)}</{p}t></{p}si>" for t in texts)}</{p}sst>')


def some_rows(n, seed=1):
    r = random.Random(seed)
    value = lambda: r.choice([None, r.randrange(1000), round(r.random() * 100, 3), 7.0, r.choice(["甲", "b & <c>", "same text", f"text {r.randrange(50)}"])])
    return [["id", "name ", None, "qty", "e"], *[[i, *[value() for _ in range(4)]] for i in range(n)]]


@pytest.mark.parametrize(("prefix", "shared"), [("", True), ("x", True), ("", False)])
def test_pieces_equal_the_small_reader(spark, tmp_path, prefix, shared):
    path = str(tmp_path / "a.xlsx")
    workbook(path, some_rows(3000), prefix, shared)
    one = xlsx.read_small(spark, path)
    many = xlsx.read_workbook(spark, path, piece=1 << 12, row_id=True)
    assert many.columns == ["row_id", "id", "name", "c2", "qty", "e"] == ["row_id", *one.columns]
    got = many.orderBy("row_id").collect()
    assert [tuple(r)[1:] for r in got] == [tuple(r) for r in one.collect()] and len({r.row_id for r in got}) == 3000
    assert xlsx._pieces(spark, path, None, 1 << 12).where("kind = 'row'").count() > 20


def test_folder_of_workbooks(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", some_rows(40, 1))
    workbook(tmp_path / "b.xlsx", some_rows(60, 2))
    both = xlsx.read_workbook(spark, str(tmp_path))
    assert both.count() == 100
    workbook(tmp_path / "c.xlsx", [["other"], ["x"]])
    with pytest.raises(ValueError):
        xlsx.read_workbook(spark, str(tmp_path))


def test_empty_sheets(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", [])
    assert xlsx.read_workbook(spark, str(tmp_path / "a.xlsx")).count() == 0
    workbook(tmp_path / "b.xlsx", [["only", "header"]])
    df = xlsx.read_workbook(spark, str(tmp_path / "b.xlsx"))
    assert df.columns == ["only", "header"] and df.count() == 0


def test_workbook_sink_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "PART_ROWS", 30)
    monkeypatch.setattr(sinks, "SHEET_PARTS", 2)
    day = datetime.date(2024, 2, 29)
    data = [(i, f"a<b>&'\"\u0001 \n{i}" if i % 7 else None, i / 4, i % 2 == 0, day) for i in range(200)] + [(None, "  kept  ", float("nan"), None, None)]
    df = spark.createDataFrame(data, "n long, t string, x double, b boolean, d date").coalesce(1)
    frames = {R.SHEETS["clean"]: df, **{R.SHEETS[k]: df.limit(int(k == "items")) for k in ("isolated", "categories", "changes", "items")}}
    path = str(tmp_path / "out.xlsx")
    sinks.write_workbook(frames, path)
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        names = [s.split('"')[0] for s in z.read("xl/workbook.xml").decode().split('sheet name="')[1:]]
    assert names == [*[R.SHEETS["clean"] + x for x in ("", " (2)", " (3)", " (4)")], *list(R.SHEETS.values())[1:]]
    back = [r for s in names[:4] for r in xlsx.read_workbook(spark, path, s, row_id=True).orderBy("row_id").collect()]
    want = [(None if n is None else str(n), None if t is None else t.replace("\u0001", ""), None if x != x else str(int(x)) if x == int(x) else str(x), None if b is None else str(int(b)), d and d.isoformat()) for n, t, x, b, d in data]
    assert [tuple(r)[1:] for r in back] == want
    assert xlsx.read_workbook(spark, path, R.SHEETS["isolated"]).columns == df.columns
    assert not [f for f in (tmp_path).iterdir() if f.suffix != ".crc" and f.name != "out.xlsx"]
    with pytest.raises(ValueError):
        sinks.write_workbook({"a/b": df}, path)


def test_preview(spark):
    df = spark.createDataFrame([("1", "2")] * 30, "` item_id ` string, x string")
    got = files.preview(df, 20)
    assert got["row_count"] == 30 and got["rows"].count() == 20 and got["columns"] == ["item_id", "x"]
    assert got["mapping"]["item_id"] == " item_id " and got["mapping"]["qty"] is None and "qty" in got["missing"] and "item_id" not in got["missing"]


def test_json_of_nested_values(spark):
    df = spark.sql("""select 1 as a, cast('nan' as double) as b, array(1.5D, cast('infinity' as double), null) as c, date'2024-02-29' as d,
      named_struct('x', cast('nan' as float), 'y', timestamp_ntz'2024-03-01 10:00:00', 'z', array(named_struct('w', -cast('infinity' as double)))) as e,
      map(15.0D, date'2024-01-02', 1.5D, null) as f, map(date'2024-01-02', map(2, cast('nan' as double))) as g, cast(null as struct<q: double>) as h""")
    got = json.loads(sinks.json_rows(df).first().json)
    assert got == {"a": 1, "b": None, "c": [1.5, None, None], "d": "2024-02-29", "e": {"x": None, "y": "2024-03-01", "z": [{"w": None}]}, "f": {"15": "2024-01-02", "1.5": None}, "g": {"2024-01-02": {"2": None}}, "h": None}


def test_scopes_delete_scratch_tables(spark):
    import os

    held = lambda: set(os.listdir(f"{graph.shared_dir(spark)}/tables")) if os.path.isdir(f"{graph.shared_dir(spark)}/tables") else set()
    before = held()

    def make():
        a = graph.cut_lineage(spark.range(10))
        return graph.cut_lineage(a.where("id > 2")), a.where("id > 4")

    x, y = graph.settled(spark, make)
    assert x.count() == 7 and y.count() == 5 and len(held() - before) == 2
    with pytest.raises(ZeroDivisionError), graph.scratch(spark):
        graph.cut_lineage(spark.range(3))
        raise ZeroDivisionError
    assert len(held() - before) == 2
    graph.delete(spark, [graph.disown(x), graph.disown(y)])
    assert held() == before
