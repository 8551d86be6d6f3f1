"""The cleaning step shuffles only rows that have to meet others."""

from pyspark.sql import functions as F

from depotspark.functions import text as T
from depotspark.operators import addresses, cleaning, dimensions, graph, pipeline


def test_filter_of_keys_is_bounded_and_loses_none(spark):
    rows = spark.range(20_000).withColumn("k", F.xxhash64("id"))
    keys = rows.where("id % 500 = 0").select("k")
    met = cleaning.may_meet(rows, keys, "k").where("_may").select("id").collect()
    assert {r.id for r in met} >= set(range(0, 20_000, 500)) and len(met) < 60


def _raw(spark, changes):
    base = dict(row_id=0, ship_no="OU19960102000001", store_order_no="SO1", store_code="S1", address="x", item_id="7", item_code="P7", item_name="soap", category_id="12", qty="3", unit="PCS", len_cm="1", wid_cm="2", hgt_cm="3", weight_kg="4")
    rows = [tuple({**base, "row_id": i, **c}.values()) for i, c in enumerate(changes)]
    return spark.createDataFrame(rows, "row_id long, " + ", ".join(f"{c} string" for c in cleaning.RAW_COLUMNS))


def test_repeats_of_both_kinds_and_what_never_meets(spark, monkeypatch):
    """Row 1 repeats 0; 2 is equal after stripping; 3 and 4 are equal once a name and a category are filled; 5 and 6 are alone."""
    raw = _raw(spark, [{}, {}, {"item_name": " soap "}, {"item_name": None}, {"category_id": None}, {"qty": "4"}, {"qty": "5", "item_name": None}])
    written, plain = [], graph.cut_lineage

    def kept(df, *by):
        written.append((df.columns, plain(df, *by)))
        return written[-1][1]

    monkeypatch.setattr(cleaning, "cut_lineage", kept)
    out = {r.row_id: (r.raw_dup, r.norm_dup, r.name_filled, r.category_filled) for r in cleaning.isolate(raw).collect()}
    assert out == {0: (False, False, "soap", 12), 1: (True, True, "soap", 12), **{i: (False, True, "soap", 12) for i in (2, 3, 4)}, 5: (False, False, "soap", 12), 6: (False, False, "soap", 12)}
    # the rows are written once: every other table is of counts, keys or rows that share what no rule fills
    assert sum("address" in columns for columns, _ in written) == 1

def test_rows_are_counted_before_they_are_unpivoted(spark):
    """One item with a thousand equal rows: four rows, not four thousand, leave the first count."""
    df = dimensions.typed(spark.range(1_000).selectExpr("id as row_id", "cast(7 as bigint) as item_id", "12 as category_final", "'1' as len_cm", "'2' as wid_cm", "'9999999' as hgt_cm", "cast(null as string) as weight_kg"))
    plan = dimensions.value_counts(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline") < plan.rindex("Aggregate")
    got = {r.c: (r.v, r.x, r.n, r.row_id) for r in dimensions.value_counts(df).collect()}
    assert got["hgt_cm"] == (9999999.0, True, 1000, 0) and {c: got[c][:3] for c in ("len_cm", "wid_cm", "weight_kg")} == {"len_cm": (1.0, False, 1000), "wid_cm": (2.0, False, 1000), "weight_kg": (None, False, 1000)}


def test_numbers_and_names_as_before(spark):
    texts = ["5", " 5\t", "\n-0.5 ", "", " ", "1e3", "NaN", " Infinity ", "5 5", "x", None, "　5", "0x1p3", "5d", "\x0b7\f", " 5", " 5 ", "5\u0085"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.number(F.col("t")).alias("a"), T.strip(F.col("t")).try_cast("double").alias("b"), T.nondescriptive(F.col("t")).alias("odd")).collect()
    assert [str(r.a) for r in got] == [str(r.b) for r in got]
    names = ["(12)", "a", "ab", "a1b", "a-", "1中2", "中1中", "  ", "", None, "\n", "\u0085", "a\nb", "1\n"]
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(names)], "i int, t string").select("i", T.nondescriptive(F.col("t")).alias("odd")).orderBy("i").collect()
    assert [r.odd for r in odd] == [True, True, False, False, True, True, False, False, False, False, False, True, False, True]


def test_rows_with_nothing_to_mend_meet_no_findings(spark, monkeypatch):
    rows = [(1, 7, 12, "1", "2", "3", "4"), (2, 7, 12, None, "2", "3", "4"), (3, 8, 12, "1", "x", "3", "4"), (4, None, None, "1", "2", "3", "0")]
    df = spark.createDataFrame(rows, "row_id long, item_id long, category_final int, len_cm string, wid_cm string, hgt_cm string, weight_kg string")
    met, plain = [], dimensions._mended
    monkeypatch.setattr(dimensions, "_mended", lambda d, found: met.extend(r.row_id for r in d.collect()) or plain(d, found))
    out = {r.row_id: tuple(r[f"{c}_source"] for c in dimensions.ALL) for r in dimensions.repair(df).collect()}
    o = "original"
    assert sorted(met) == [2, 3, 4] and out == {1: (o, o, o, o), 2: ("item mode", o, o, o), 3: (o, "missing", o, o), 4: (o, o, o, "missing")}


def test_storage_classes_and_matches_shuffle_no_rows(spark, monkeypatch):
    """Tables of 32 words for 600 items: many items may be of both classes at first, and several levels of tables tell them apart."""
    rows = spark.range(3_000).selectExpr("id as row_id", "if(id % 7 = 0, null, id % 600) as item_id", "repeat('wide', 20) as rest")
    shelf = lambda i: i * 7919 % 10 < 4
    master = spark.createDataFrame([(i, "貨架" if shelf(i) else "棧板") for i in range(600)], "item_id long, storage_class string")
    monkeypatch.setattr(cleaning, "WORDS", 32)
    found = pipeline.with_storage_class(rows, master)
    # no join on the item: only tables of bits, which are broadcast
    assert "hashpartitioning(item_id" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.row_id: r.storage_class for r in found.collect()}
    assert got == {i: "未分類(無商品ID)" if i % 7 == 0 else "貨架" if shelf(i % 600) else "棧板" for i in range(3_000)}
    monkeypatch.setattr(cleaning, "WORDS", 4)  # more items than tables can part: rows meet the master
    assert {r.row_id: r.storage_class for r in pipeline.with_storage_class(rows, master).collect()} == got


def test_rows_meet_what_is_known_of_few_addresses_without_a_shuffle(spark):
    filled = spark.range(1_000).selectExpr("id as row_id", "concat('中山路', id % 3, '號') as address_final", "cast(null as string) as region", "1 as address_pending", "'無法處理' as address_source")
    roads = spark.createDataFrame([("甲市", "A區", "中山路")], "city string, district string, road string")
    out = addresses.resolve(filled, addresses.gazetteer(roads, None))
    # that of the rows was by address_final, of all rows
    assert "hashpartitioning(address_final" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.region, r.address_pending) for r in out.collect()} == {("甲市A區", 0)}


def test_scorecard_writes_no_measured_rows(spark):
    """The scorecard is a few percentages: the repaired rows, with all their columns, aren't written for it."""
    from conftest import SF

    from depotspark.operators.cache import cache_of
    from depotspark.plans.queries import QUERIES

    cache_of(spark).close()
    assert QUERIES["quality_scorecard"](spark, SF).count() == 1
    assert not [e for e in cache_of(spark).entries if e.name.endswith(".measured")]


def test_repairs_of_equal_rows_are_those_of_each_row(spark):
    """Rows that are alike are repaired once, and rows with nothing to mend meet no repair."""
    from conftest import SF

    from depotspark.sources.star import raw_lines

    rows = graph.cut_lineage(pipeline.cleaned(raw_lines(spark, SF)))
    alike, every = dimensions.repairs(rows), dimensions.measure(rows)
    alike = graph.cut_lineage(alike)
    assert alike.count() < rows.count() and alike.agg(F.sum("n")).first()[0] == rows.count()
    out = dimensions.mended(rows, alike).select(every.columns)
    assert sorted(map(str, out.collect())) == sorted(map(str, every.collect()))
    assert sorted(map(str, dimensions.item_master(alike, "n").collect())) == sorted(map(str, dimensions.item_master(every).collect()))


def test_cleaning_run_writes_its_rows_only_once(spark, monkeypatch):
    """The isolation is the only table that has the rows: neither repaired rows nor the result are written on the way."""
    from conftest import SF

    from depotspark.operators import cache
    from depotspark.plans.queries import QUERIES

    cache.cache_of(spark).close()
    written, plain = [], graph.cut_lineage

    def kept(df, *by):
        written.append(df.columns)
        return plain(df, *by)

    for module in (graph, cleaning, dimensions, addresses, pipeline):
        monkeypatch.setattr(module, "cut_lineage", kept)
    made = {name: QUERIES[name](spark, SF) for name in ("cleaning_run", "change_log_all", "run_metrics")}
    assert [c for c in written if {"row_id", "address"} <= set(c) and "_k1" not in c and "isolation_reason" not in c] == []
    assert sum({"row_id", "isolation_reason"} <= set(c) for c in written) == 1
    assert made["cleaning_run"].count() == made["run_metrics"].first().n_rows > 0


def test_strip_looks_for_white_space_only_where_there_is_some(spark):
    texts = ["a", " a", "a ", "\ta\n", "", " ", None, "a\u0085", "a \u0085", "\u0085a", "a ", "a  ", "　a　", "箱", " 個 ", "a b", "\x01a", "a\x1f", "\x0ba\f", "a\r\n", "a \n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", T.strip(F.col("t")).alias("a"), F.regexp_replace("t", r"^\s+|\s+$", "").alias("b")).orderBy("i").collect()
    assert [r.a for r in got] == [r.b for r in got] and got[18].a == "a"
