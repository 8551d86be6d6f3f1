"""Literal cases and invariants."""

import math
import random
import statistics
import zipfile

import pytest
from pyspark.sql import functions as F

from depotspark import reference_values as R
from depotspark.functions import address as A
from depotspark.functions import series as S
from depotspark.functions import text as T
from depotspark.operators import abc, addresses, cleaning, copick, dimensions, forecast, graph, layout, pipeline, waves
from depotspark.sources import files, sinks, xlsx
from depotspark.sources.star import sales
from conftest import SF


def col(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(f(F.col("v"))).collect()]


def test_addresses(spark):
    cases = {
        "鳳山市海洋一路121號": "高雄市鳳山區海洋一路121號", "高縣茄萣鄉民生路8號": "高雄市茄萣區民生路8號", "屏東市自由路": "屏東縣屏東市自由路",
        "新北市板橋區文化路": "新北市板橋區文化路", "高雄縣三民鄉民權路": "高雄市那瑪夏區民權路", "111台北市士林區": "台北市士林區", "123不明": "123不明", "": "",
    }
    assert col(spark, list(cases), A.normalize) == list(cases.values())
    assert col(spark, ["高雄市前鎮區中山路", "桃園市平鎮區x", "台南市左鎮區x"], A.district) == ["前鎮區", "平鎮區", "左鎮區"]
    assert col(spark, ["忠孝東路四段561號", "光榮里光榮街90號", "士東路100號", "100號", None], A.road) == ["忠孝東路", "光榮街", "士東路", None, None]
    assert col(spark, ["光榮里光榮街90號", "士東路100號"], A.village) == ["光榮里", None]


def test_gazetteer_paths(spark):
    roads = spark.createDataFrame([("甲市", "甲市A區", "中山路"), ("甲市", "甲市B區", "中山路"), ("乙市", "乙市C區", "中山路"), ("丙市", "丙市X區", "獨有路"), ("甲市", "甲市A區", "共用路"), ("乙市", "乙市C區", "共用路")], "city string, site_id string, road string")
    vills = spark.createDataFrame([("甲市", "B區", "光復里"), ("丁市", "D區", "光復里"), ("戊市", "Y區", "獨有里"), ("丁市", "D區", "共用里"), ("戊市", "Y區", "共用里")], "city string, district string, village string")
    cases = {"光復里中山路5號": "甲市B區", "獨有路1號": "丙市X區", "獨有里9號": "戊市Y區", "中山路5號": None, "共用里共用路7號": None}
    rows = spark.createDataFrame([(a, None, 1, "無法處理") for a in cases], "address_final string, region string, address_pending int, address_source string")
    got = {r.address_final: r.region for r in addresses.resolve(rows, addresses.gazetteer(roads, vills)).collect()}
    assert got == cases
    assert {r.address_match for r in addresses.resolve(rows, None).collect()} == {"未載入參考資料"}


def test_text(spark):
    assert col(spark, ["2.5", "3.5", "x", None, " 15.0 "], T.to_int) == [2, 4, None, None, 15]
    assert col(spark, [" n/a ", "-", "", "SO1", None], T.null_tokens) == [None, None, None, "SO1", None]
    assert col(spark, ["(60) 10/15", "抽#2", "(82)", "好奇", "", None], T.nondescriptive) == [True, True, True, False, False, False]
    assert col(spark, ["測試商品", "好奇 純水濕巾", "好奇褲", "沒有"], T.keyword_category) == [-1, 62, 58, None]
    assert [str(x) for x in col(spark, ["OU20240229000001", "OU20230229000001", "OU1"], T.ship_date)] == ["2024-02-29", "None", "None"]


def test_series_against_loops(spark):
    def ses(h):
        level = h[0]
        for v in h[1:]:
            level = 0.3 * v + 0.7 * level
        return level

    def croston(h):
        z = x = last = None
        for i, v in enumerate(h):
            if v > 0:
                z, x = (v, i + 1.0) if z is None else (0.1 * v + 0.9 * z, 0.1 * (i - last) + 0.9 * x)
                last = i
        return 0.0 if z is None else z / x

    data = [[1.0], [0.0, 0.0], [5.0, 0.0, 0.0, 3.0, 1.0], [float(i % 5) for i in range(15)]]
    for f, want in ((S.ses, ses), (S.croston, croston), (S.naive, lambda h: h[-1]), (S.ma3, lambda h: sum(h[-3:]) / len(h[-3:])), (S.seasonal_naive, lambda h: h[-12] if len(h) >= 12 else h[-1])):
        assert all(math.isclose(a, want(h), abs_tol=1e-9) for a, h in zip(col(spark, data, f, "array<double>"), data))
    assert col(spark, [[]], S.naive, "array<double>") == [0.0]
    assert col(spark, [[7.0], [4.0, 2.0]], S.holt, "array<double>")[0] == 7.0


def test_flat_series_selects_the_first_model(spark):
    d = spark.createDataFrame([(1, [2.0] * 12)], "key int, s array<double>")
    r = forecast.accuracy(forecast.select(d)).first()
    assert (r.model, r.mase, r.wape) == ("Naive", None, 0.0)


def test_components(spark):
    nodes = spark.range(8)
    edges = spark.createDataFrame([(7, 3), (3, 5), (1, 2)], "a long, b long")
    assert {r.id: r.component for r in graph.components(nodes, edges).collect()} == {0: 0, 1: 1, 2: 1, 3: 3, 4: 4, 5: 3, 6: 6, 7: 3}


def test_layout_invariants(spark):
    pool = layout.slot_pool(layout.zones(spark))
    freq = spark.createDataFrame([(1, 50), (2, 30), (3, 20), (4, 0)], "key int, freq long")
    got = layout.largest_remainder(freq, pool).collect()
    assert sum(r.cell_count for r in got) == pool.count()


def test_wave_invariants(spark):
    s = sales(spark, SF)
    orders, _ = waves.rollup(s)
    table = waves.strategies(s, layout.zones(spark), 2, 5).first()
    assert table.orders == waves.in_window(orders).count()
    assert table.seed_rounds >= table.waves


def test_bounds(spark):
    with pytest.raises(ValueError):
        copick.top_pairs(spark.createDataFrame([(1, 2, 3, 1.0)], "a int, b int, count int, lift double"), "x")
    with pytest.raises(ValueError):
        files.apply_mapping(spark.createDataFrame([(1,)], "x int"), {"ship_no": "y"})


def test_empty_tables(spark):
    s = sales(spark, SF).where("false")
    assert forecast.dense(s, "item_id").count() == 0
    assert waves.simple_batch(s).first().improvement == 0.0
    assert copick.pairs(s, "item_id", 1).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ship_no, x\n1,\"a,b\"\n", encoding="utf-8")
    df = files.read_any(spark, str(tmp_path / "a.csv"))
    assert df.first()[1] == "a,b"
    (tmp_path / "a.json").write_text('{"headers": ["a", "b"], "rows": [["1", "2"], ["3", "4"]]}')
    assert [tuple(r) for r in files.read_any(spark, str(tmp_path / "a.json")).collect()] == [("1", "2"), ("3", "4")]
    assert files.read_gazetteer(spark, str(tmp_path / "none.csv")) is None
    mapped = files.apply_mapping(spark.createDataFrame([(1, 2)], "no int, ship_no int"), {"ship_no": "no"})
    assert mapped.columns == ["ship_no"] and mapped.first()[0] == 1
    sinks.write_csv({"clean": df}, str(tmp_path / "out"))
    sinks.write_tables({"clean": df.toDF("a", "b")}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/clean")).count() == 1
    assert sinks.json_rows(spark.sql("select double('NaN') as x, date'2024-01-02' as d")).first()[0] == '{"x":null,"d":"2024-01-02"}'
    assert len(R.CATEGORIES) == 69


def test_weekly_naive_for_all_items(spark):
    """Every item, 13 test weeks, against brute force; queries over all sales see every item."""
    import datetime
    import random

    r, start = random.Random(4), datetime.date(2024, 1, 1)
    sold = [(r.randrange(1, 8), r.randrange(0, 30 * 7)) for _ in range(400)] + [(1, 0), (1, 209)]
    df = spark.createDataFrame([(i, start + datetime.timedelta(days=x), 1.0) for i, x in sold], "item_id long, ship_date date, qty double")
    got = {x.key: x for x in forecast.weekly_naive(df).collect()}
    assert set(got) == {i for i, _ in sold}
    for i, x in got.items():
        s = [sum(1 for j, k in sold if j == i and k // 7 == w) for w in range(30)]
        assert (x.n, x.total, x.naive, x.actual) == (30, sum(s), s[16], sum(s[17:]))
        assert abs(x.mae - sum(abs(v - s[16]) for v in s[17:]) / 13) < 1e-9
    short = forecast.weekly_naive(df.where("ship_date < date'2024-01-20'")).first()
    assert (short.n, short.naive) == (3, 0.0)


def test_forecast_queries_over_all_sales(spark):
    from conftest import SF

    from depotspark.plans.queries import QUERIES
    from depotspark.sources.star import sales

    items = sales(spark, SF).where("ship_date is not null and qty > 0 and item_id is not null").select("item_id").distinct().count()
    assert QUERIES["fc_weekly_naive_items"](spark, SF).count() == items
    assert QUERIES["predicted_items_all"](spark, SF).count() >= QUERIES["predicted_items"](spark, SF).count()


def test_digits_of_any_script(spark):
    assert col(spark, ["１１１台北市士林區士東路", "(４０７６８)台中市西屯區朝富路8號"], A.normalize) == ["台北市士林區士東路", "台中市西屯區朝富路8號"]
    assert col(spark, ["台北市１２區x", "忠孝東路４段"], A.district) == [None, None]
    assert col(spark, ["忠孝東路４段561號"], A.road) == ["忠孝東路"]


def test_gazetteer_with_one_file(spark):
    rows = spark.createDataFrame([("獨有路1號", None, 1, "無法處理"), ("獨有里9號", None, 1, "無法處理"), ("特有路2號", None, 1, "無法處理")], "address_final string, region string, address_pending int, address_source string")
    roads = spark.createDataFrame([("丙市", "丙市X區", "獨有路"), ("臺中市", "Z區", "特有路"), ("", "丙市X區", "無名路")], "city string, site_id string, road string")
    vills = spark.createDataFrame([("戊市", "戊市Y區", "獨有里")], "city string, site_id string, village string")
    found = lambda *g: {r.address_final: r.region for r in addresses.resolve(rows, addresses.gazetteer(*g)).collect()}
    assert found(roads, None) == {"獨有路1號": "丙市X區", "獨有里9號": None, "特有路2號": "台中市Z區"}
    assert found(None, vills) == {"獨有路1號": None, "獨有里9號": "戊市Y區", "特有路2號": None}
    assert addresses.gazetteer(None, None) is None


def test_row_keys_tell_nulls_apart(spark):
    rows = [("1", "a", None), ("2", None, "a"), ("3", "a", ""), ("4", "a", None), ("5", None, None), ("6", "", "")]
    df = spark.createDataFrame(rows, "row_id string, x string, y string")
    assert {r.row_id for r in cleaning.with_repeat(df, ["x", "y"], "again").where("again").collect()} == {"4"}


def test_ranks_over_ranges(spark):
    r = random.Random(3)
    rows = [(i, r.randrange(20), f"g{i % 2}" if i % 17 else None) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, v long, g string").repartition(7)
    got = abc.ranked(df, ["g"], [F.desc("v"), F.asc("id")], "rank", "v").collect()
    for g in ("g0", "g1", None):
        mine = sorted((x for x in rows if x[2] == g), key=lambda x: (-x[1], x[0]))
        have = sorted((x for x in got if x.g == g), key=lambda x: x["rank"])
        assert [x.id for x in have] == [x[0] for x in mine] and [x["rank"] for x in have] == list(range(1, len(mine) + 1))
        assert [x.rank_run for x in have] == [sum(m[1] for m in mine[: k + 1]) for k in range(len(mine))] and {x.rank_all for x in have} == {sum(m[1] for m in mine)}


def test_medians_from_counts(spark):
    r = random.Random(5)
    rows = [(k, float(r.randrange(6)), r.randrange(1, 4)) for k in "abcd" for _ in range(r.randrange(1, 9))]
    got = {x.k: (x.med, x.n) for x in dimensions.weighted_median(spark.createDataFrame(rows, "k string, v double, n long"), ["k"]).collect()}
    for k in "abcd":
        every = [v for a, v, n in rows if a == k for _ in range(n)]
        assert got[k] == (statistics.median(every), len(every))


def test_workbook(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    sheet = lambda body: f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="other" sheetId="1" r:id="r1"/><sheet name="{xlsx.SHEET}" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>item</t></si><si><r><t>q</t></r><r><t>ty</t></r></si><si><t>好</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", sheet('<row><c t="inlineStr"><is><t>x</t></is></c></row>'))
        z.writestr("xl/worksheets/sheet2.xml", sheet('<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="s"><v>2</v></c><c r="C2"><v>3.0</v></c></row><row r="3"/><row r="4"><c r="B4"><v>1.5</v></c></row>'))
    df = files.read_any(spark, path)
    assert df.columns == ["item", "c1", "qty"] and sorted(map(tuple, df.collect()), key=str) == [("好", None, "3"), (None, "1.5", None)]
    assert xlsx.read_workbook(spark, path, "other").columns == ["x"]
    with pytest.raises(ValueError):
        next(xlsx.sheet_rows(path, "none"))
    with pytest.raises(ValueError):
        files.read_any(spark, "a.xls")


def test_zip_export(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, 'b "x"'), (3, None)], "n int, t string").repartition(2, "n")
    sinks.zip_csv({"clean": df, "isolated": df.limit(0)}, str(tmp_path / "x.zip"), "two\nlines")
    with zipfile.ZipFile(tmp_path / "x.zip") as z:
        assert z.namelist() == ["readme.txt", "clean.csv", "isolated.csv"] and z.read("readme.txt").decode("utf-8-sig") == "two\r\nlines"
        raw = z.read("clean.csv")
        assert raw.startswith(b"\xef\xbb\xbf") and raw.count(b"n,t\r\n") == 1 and raw.count(b"\r\n") == 4


def test_cleaning_run_keeps_every_row(spark):
    from depotspark.plans.queries import roads_villages
    from depotspark.sources.star import raw_lines

    raw = raw_lines(spark, SF)
    rows, master = pipeline.run(raw, *roads_villages(spark))
    assert rows.count() == raw.count() == rows.select("row_id").distinct().count()
    assert rows.where("item_id is null and storage_class <> '未分類(無商品ID)'").count() == 0
    frames = pipeline.result_frames(rows, master)
    assert list(frames) == ["clean", "isolated", "categories", "changes", "items"] == list(R.SHEETS)
    assert frames["clean"].count() + frames["isolated"].count() == rows.count()
    log = frames["changes"]
    assert log.where("before <=> after").count() == 0 and {r.column for r in log.select("column").distinct().collect()} >= {"item_name", "category_id", "len_cm", "address"}


def test_layout_record_and_kpis(spark):
    from depotspark.plans.queries import QUERIES

    rec = QUERIES["layout_record"](spark, SF).cache()
    assert rec.count() == rec.select("id").distinct().count() == sales(spark, SF).select("item_id").distinct().count()
    assert rec.where("after_material <> material or before_zone is null or after_zone is null").count() == 0
    by = {r.cls: r.d for r in rec.where("not flex and material = 'shelf'").groupBy("cls").agg(F.avg("after_distance").alias("d")).collect()}
    assert by["A"] <= by["C"]
    assert QUERIES["kpi_from_layout"](spark, SF).count() == 1


def test_nearest_rounds_like_the_sql(spark, duck):
    """Halves in decimal that are a little more or less as doubles: a rank over rounded values follows the SQL only if these do."""
    from depotspark.functions import series as S

    values = [k / 100000.0 * j for k in (2290995, 1113525, 3237405, 4545045, 5, 15, 25) for j in (1.0, 3.0, -1.0)] + [0.0, 1e9 + 0.00005]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(S.nearest(F.col("v"), 4)).collect()]
    want = [duck.execute("select round(?::double, 4)", [v]).fetchall()[0][0] for v in values]
    assert got == want


@pytest.mark.parametrize("name", ["category_labels", "clean_projection"])
def test_typing_alone_writes_no_table(spark, monkeypatch, name):
    """Queries that need no repeats must not write the typed rows and look for them."""
    from depotspark.plans.queries import QUERIES

    def refuse(*args):
        raise AssertionError("rows were written")

    monkeypatch.setattr(cleaning, "cut_lineage", refuse)
    assert QUERIES[name](spark, SF).columns


def test_known_regions_are_not_parsed_again(spark, monkeypatch):
    """Rows with a trusted address, and those that take a whole version, have their region without parsing it once more."""
    data = [(i, f"OU19960102{i:06d}", "S1", a) for i, a in enumerate(["台北市士林區士東路100號", "北市士林區士東路100號", "台北市士林區", None])]
    rows = graph.cut_lineage(spark.createDataFrame(data, "row_id long, ship_no string, store_code string, address string"))
    real_pairs = addresses.pairs

    def pairs(r):
        out = real_pairs(r)
        monkeypatch.setattr(addresses.A, "district", lambda a: F.when(F.raise_error(F.lit("parsed again")).cast("string").isNull(), a))
        return out

    monkeypatch.setattr(addresses, "pairs", pairs)
    got = {r.row_id: r.region for r in addresses.backfill(rows).collect()}
    assert got[0] == got[1] == got[3] == "台北市士林區" and got[2] == "台北市士林區"


def test_kpi_from_layout_keeps_the_sales_once(spark, monkeypatch):
    """Lines are written once, keys of orders once, items of orders for the window only; the layout's tables are gone before the waves."""
    import os

    from depotspark.operators import abc, copick, waves
    from depotspark.plans import queries

    written, plain = [], graph.cut_lineage

    def kept(df, *by):
        out = plain(df, *by)
        written.append((set(df.columns), out._scratch))
        return out

    for module in (graph, abc, copick, waves, queries):
        monkeypatch.setattr(module, "cut_lineage", kept)
    assert queries.QUERIES["kpi_from_layout"](spark, SF).count() == 1
    lines = [c for c, _ in written if {"ship_no", "row_id"} <= c]
    assert len(lines) == 1 and not lines[0] & {"item_name", "item_code", "zone"}
    assert sum({"ship_no", "k"} <= c for c, _ in written) <= 2  # all keys, and those of no rare key where some are rare
    assert [c for c, p in written if os.path.exists(p) and {"ship_no", "k"} <= c] == []
    s = sales(spark, SF)
    few = s.select("ship_no").distinct().where("crc32(ship_no) % 20 = 3")
    assert waves.of_orders(s.select("ship_no", "item_id", "qty"), few).count() == s.join(few, "ship_no", "left_semi").count() > 0


def test_pairs_are_shuffled_without_frequencies(spark):
    keys = spark.createDataFrame([("O1", 1), ("O1", 2), ("O2", 3)], "ship_no string, k long")
    from depotspark.operators import copick

    assert [(r.a, r.b) for r in copick.pair_rows(keys).collect()] == [(1, 2)] and copick.pair_rows(keys).columns == ["a", "b"]
