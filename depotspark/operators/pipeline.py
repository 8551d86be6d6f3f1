"""The cleaning run: isolation, categories, dimensions, addresses and storage classes in one result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from depotspark.operators import addresses, cleaning, dimensions
from depotspark.operators.cache import cached
from depotspark.operators.graph import cut_lineage


def cleaned(raw: DataFrame) -> DataFrame:
    """Isolation reasons and final categories; the isolation runs once for the session."""
    return cleaning.reclassify(cached(cleaning.isolate, raw))


def measured(raw: DataFrame) -> DataFrame:
    """cleaned with repaired dimensions and volumes."""
    return dimensions.measure(cleaned(raw))


def master(raw: DataFrame) -> DataFrame:
    """The item master, from the repairs, which are made once for the session."""
    return dimensions.item_master(cached(repairs, raw), "n")


def repairs(raw: DataFrame) -> DataFrame:
    """Repaired dimensions and volumes, once for rows that are alike."""
    return dimensions.repairs(cleaned(raw))


def places(raw: DataFrame, *given: DataFrame | tuple[bool, bool]) -> tuple[DataFrame, ...]:
    """What rows meet for their addresses: known places, nearest versions and, with a gazetteer, what it tells of final addresses.
    given: roads and villages, those that are there, and which of both are."""
    *files, there = given
    names = addresses.gazetteer(*[files.pop(0) if x else None for x in there])
    rows = cached(cleaning.isolate, raw).select("row_id", "ship_no", "store_code", "address")
    known = addresses.known_places(rows)
    return known if names is None else (*known, addresses.looked_up(addresses.backfill(rows, known), names))


def run(raw: DataFrame, roads: DataFrame | None = None, villages: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, master): every raw row once, clean and isolated, with its isolation reason, filled and repaired columns, volume,
    address and the storage class of its item; and the item master. Rows without a known item are 未分類(無商品ID)."""
    items = cached(master, raw)
    return located(raw, roads, villages, items), items


def located(raw: DataFrame, roads: DataFrame | None = None, villages: DataFrame | None = None, items: DataFrame | None = None, columns: list[str] | None = None) -> DataFrame:
    """The rows of run, with storage classes if items (the master) are given, and those of columns alone, if given. What rows meet is
    made once for the session; they themselves are written nowhere on the way, and what nobody asks for is never read."""
    there = (roads is not None, villages is not None)
    known, nearest, *looked = cached(places, raw, *[x for x in (roads, villages) if x is not None], params=(there,))
    rows = dimensions.mended(cleaned(raw), cached(repairs, raw))
    # what no join here asks for is one column on the way: joins copy a row column by column
    asked, every = ["row_id", "ship_no", "store_code", "address", "item_id"], rows.columns
    rest = [c for c in every if c not in asked and (columns is None or c in columns)]
    rows = rows.select(*asked, F.struct(*(rest or [F.lit(True)])).alias("_row"))
    rows = addresses.matched(addresses.backfill(rows, (known, nearest)), looked[0] if looked else None)
    rows = rows if items is None else with_storage_class(rows, items)
    new = [c for c in rows.columns if c not in asked and c != "_row"]
    return rows.select(*[F.col("_row")[c].alias(c) if c in rest else c for c in columns or [*every, *new]])


CLASSES = ("貨架", "棧板")  # of text.storage_class
REASONS = ["bad_ship_no", "duplicate", "no_item", "no_name", "no_category", "bad_qty", "bad_unit", "normalized_duplicate", "test_category", "nondescriptive_name"]


METERED = ["isolation_reason", "keyword", "qty", "unit", "address_match", "address_pending", "volume_review"]  # what metrics ask for


def metrics() -> list[Column]:
    """What a run tells about itself, as aggregations over its rows."""
    reason, hit, bad = F.col("isolation_reason"), F.col("keyword") >= 0, cleaning.bad_qty() | cleaning.bad_unit()
    n = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    return [
        F.count(F.lit(1)).alias("n_rows"), n(reason.isNull(), "n_clean"), n(reason.isNotNull(), "n_isolated"), *[n(reason == r, f"reason_{r}") for r in REASONS],
        n(F.col("keyword").isNotNull() | (reason == "no_category"), "reclass_target"), n(hit & ~bad, "reclass_moved"), n(F.col("keyword") < 0, "reclass_test"), n(hit & bad, "reclass_still_bad"),
        *[n(F.col("address_match") == m, f"match_{k}") for k, m in (("filled", "路名回推補齊"), ("verified", "路名相符(已驗證)"), ("none", "未比對"), ("absent", "未載入參考資料"))],
        n(F.col("address_pending") == 1, "address_pending"), n(F.col("volume_review") == 1, "volume_review"),
    ]


def observed_run(raw: DataFrame, roads: DataFrame | None = None, villages: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """run, and one row of its metrics, which are filled while the rows are written: no second look at them."""
    rows, items = run(raw, roads, villages)
    seen = Observation("run")
    rows = cut_lineage(rows.observe(seen, *metrics()))
    told = seen.get
    return rows, items, raw.sparkSession.createDataFrame([tuple(told.values())], ", ".join(f"{k} long" for k in told))


def with_storage_class(rows: DataFrame, master: DataFrame) -> DataFrame:
    """rows with the storage class of their item. master: of the same rows, so it has every item.

    Rows aren't shuffled: the items of either class are a table of bits (see cleaning.may_meet), and an item that only one of both
    may hold is of that class. Items that both may hold are told apart by tables of their own, with other hashes, until none is
    left. Only with more items than such tables can part do rows meet the master itself.
    """
    left = master.where("item_id is not null").select("item_id", "storage_class")
    n, level = left.count(), 0
    found = rows.withColumn("storage_class", F.lit(None).cast("string"))
    while 0 < n <= cleaning.WORDS * 32:
        key, level = F.xxhash64("item_id", F.lit(level)), level + 1
        held = {c: F.bit_or(F.when(F.col("storage_class") == c, cleaning.bit_of(key))).alias(f"_{i}") for i, c in enumerate(CLASSES)}
        words = cut_lineage(left.groupBy(cleaning.word_of(key).alias("_word")).agg(*held.values()))
        meet = lambda df: df.withColumn("_word", cleaning.word_of(key)).join(F.broadcast(words), "_word", "left")  # noqa: B023, E731  at most WORDS rows
        a, b = (F.coalesce(F.col(f"_{i}").bitwiseAND(cleaning.bit_of(key)) != 0, F.lit(False)) for i in range(2))
        told = F.when(F.col("item_id").isNotNull(), F.when(a & ~b, CLASSES[0]).when(b & ~a, CLASSES[1]))
        found = meet(found).withColumn("storage_class", F.coalesce("storage_class", told)).drop("_word", "_0", "_1")
        left = cut_lineage(meet(left).where(a & b).select("item_id", "storage_class"))
        n = left.count()
    if n:
        found = cleaning._left(found, left.withColumnRenamed("storage_class", "_class"), "item_id").withColumn("storage_class", F.coalesce("storage_class", "_class")).drop("_class")
    return found.withColumn("storage_class", F.coalesce("storage_class", F.lit("未分類(無商品ID)")))


LOGGED = ["row_id", "item_name", "name_filled", "category_id", "category_filled", "category_final", *[f"{c}{s}" for c in dimensions.ALL for s in ("", "_source", "_before")], "address", "address_source", "address_final"]


def change_log(rows: DataFrame) -> DataFrame:
    """row_id, column, rule, before, after of every change that the run made: names, categories, dimensions, addresses."""
    text = lambda c: F.round(F.col(c), 6).cast("string")
    changed = [
        F.when(~F.col(f"{c}_source").isin("original", "missing", "extreme"), F.struct(F.lit(c).alias("column"), F.col(f"{c}_source").alias("rule"), text(f"{c}_before").alias("before"), text(c).alias("after")))
        for c in dimensions.ALL
    ]
    moved = F.col("address_final").isNotNull() & ~F.col("address_final").eqNullSafe(F.col("address"))
    changed.append(F.when(moved, F.struct(F.lit("address").alias("column"), F.col("address_source").alias("rule"), F.col("address").alias("before"), F.col("address_final").alias("after"))))
    return rows.select("row_id", F.inline(F.filter(F.array(*cleaning.changes(), *changed), lambda x: x.isNotNull())))  # one look at the rows


def result_frames(rows: DataFrame, master: DataFrame) -> dict[str, DataFrame]:
    """The tables of an export in their order: clean rows, isolated rows, categories, changes, items. R.SHEETS has their names as sheets."""
    categories = rows.where("isolation_reason is null").groupBy("category_final").agg(F.count("*").alias("n_rows"), F.count_distinct("item_id").alias("n_items"))
    return {"clean": rows.where("isolation_reason is null"), "isolated": rows.where("isolation_reason is not null"), "categories": categories, "changes": change_log(rows), "items": master}
