"""Delivery addresses: back-fill from trusted versions of the same store, and resolution by a gazetteer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depotspark import reference_values as R
from depotspark.functions import address as A
from depotspark.functions import text as T
from depotspark.operators.graph import cut_lineage


def pairs(rows: DataFrame) -> DataFrame:
    """rows (row_id, ship_no, store_code, address) -> one row for each (address, store_code): rows n, dated rows, first and last date,
    and the address parsed. Everything about addresses is taken from these; a hot address or store is combined before it is shuffled."""
    dated = rows.select("address", "store_code", T.ship_date(F.col("ship_no")).alias("ship_date"))
    every = cut_lineage(dated.groupBy("address", "store_code").agg(F.count("*").alias("n"), F.count("ship_date").alias("dated"), F.min("ship_date").alias("lo"), F.max("ship_date").alias("hi")))
    one = every.where("address is not null").select("address").distinct().withColumn("norm", A.normalize(F.col("address")))
    one = cut_lineage(one.select("address", "norm", A.city(F.col("norm")).alias("city"), A.district(F.col("norm")).alias("district"), A.rest(F.col("norm")).alias("rest")))
    return every.join(one, "address", "left").withColumn("rest", F.coalesce("rest", F.lit("")))


def shared_addresses(p: DataFrame) -> DataFrame:
    """(norm, store_code) pairs with few rows, of full addresses that many stores share so sparsely: likely defaults. p: see pairs."""
    sparse = p.where("city is not null and district is not null and store_code is not null").groupBy("norm", "store_code").agg(F.sum("n").alias("n")).where(F.col("n") <= R.SHARED_ADDRESS_ROWS)
    many = sparse.groupBy("norm").agg(F.count("*").alias("stores")).where(F.col("stores") >= R.SHARED_ADDRESS_STORES).select("norm")
    return sparse.join(many, "norm", "left_semi").select("norm", "store_code")


def trusted(p: DataFrame) -> DataFrame:
    """p with placeholder and trusted flags."""
    bad = shared_addresses(p).withColumn("placeholder", F.lit(True))
    out = p.join(bad, ["norm", "store_code"], "left").withColumn("placeholder", F.coalesce("placeholder", F.lit(False)))
    return out.withColumn("trusted", F.col("city").isNotNull() & F.col("district").isNotNull() & ~F.col("placeholder") & F.col("store_code").isNotNull())


def variants(t: DataFrame) -> DataFrame:
    """Trusted versions of each store's address: first and last date, dated rows."""
    return t.where("trusted").groupBy("store_code", "city", "district", "rest").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("dated").alias("n"))




def _text() -> Column:
    return F.struct("city", "district", "rest")


def _day(c: str) -> Column:
    return F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))


def _blocks(lo: Column, hi: Column) -> Column:
    """The days lo..hi as blocks (level, block) of 2**level days, aligned: at most two of each level."""
    empty = F.array().cast("array<struct<level:int,block:int>>")
    one = lambda at, level: F.array(F.struct(level.cast("int").alias("level"), at.cast("int").alias("block")))

    def step(a: Column, level: Column) -> Column:
        some, left, right = a["l"] < a["r"], F.pmod(a["l"], F.lit(2)) == 1, F.pmod(a["r"], F.lit(2)) == 1
        blocks = F.concat(a["out"], F.when(some & left, one(a["l"], level)).otherwise(empty), F.when(some & right, one(a["r"] - 1, level)).otherwise(empty))
        return F.struct(F.shiftright(F.when(left, a["l"] + 1).otherwise(a["l"]), 1).alias("l"), F.shiftright(F.when(right, a["r"] - 1).otherwise(a["r"]), 1).alias("r"), blocks.alias("out"))

    start = F.struct(lo.cast("int").alias("l"), (hi + 1).cast("int").alias("r"), empty.alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(23)), start, step, lambda a: a["out"])


def nearest_versions(asks: DataFrame, v: DataFrame) -> DataFrame:
    """asks (store_code, day), distinct, and versions v (store_code, city, district, rest, lo, hi) -> store_code, day, best: the version
    that covers the day or else is nearest to it; ties by city, district and rest; undated versions come last.

    An interval join by equality only. A version's days are cut into aligned blocks of 1, 2, 4, ... days, at most two of each
    size, and each block keeps its first version; a day lies in one block of each size. Ends before and after a day come from
    ordered windows over a store's days. No store's versions meet all its days, and every group is bounded by the calendar.
    """
    dated = v.where("lo is not null").select("store_code", _text().alias("x"), _day("lo").alias("lo"), _day("hi").alias("hi"))
    dated = cut_lineage(dated)
    days = asks.select("store_code", _day("day").alias("d"))
    blocks = cut_lineage(dated.select("store_code", "x", F.inline(_blocks(F.col("lo"), F.col("hi")))).groupBy("store_code", "level", "block").agg(F.min("x").alias("x")))
    sizes = blocks.agg(F.sort_array(F.collect_set("level")).alias("levels"))  # one row of at most 24 numbers
    inside = days.crossJoin(F.broadcast(sizes)).select("store_code", "d", F.explode("levels").alias("level")).withColumn("block", F.expr("shiftright(d, level)"))
    cover = inside.join(blocks, ["store_code", "level", "block"]).groupBy("store_code", "d").agg(F.min("x").alias("cover"))
    # a store's days in order: ends of versions, starts of versions, and days asked for
    none = F.lit(None).cast(dict(dated.dtypes)["x"])
    ends = dated.groupBy("store_code", F.col("hi").alias("d")).agg(F.min("x").alias("end")).select("store_code", "d", "end", none.alias("start"), F.lit(False).alias("asked"))
    starts = dated.groupBy("store_code", F.col("lo").alias("d")).agg(F.min("x").alias("start")).select("store_code", "d", none.alias("end"), "start", F.lit(False).alias("asked"))
    line = ends.unionByName(starts).unionByName(days.select("store_code", "d", none.alias("end"), none.alias("start"), F.lit(True).alias("asked")))
    line = line.groupBy("store_code", "d").agg(F.min("end").alias("end"), F.min("start").alias("start"), F.max("asked").alias("asked"))
    by = Window.partitionBy("store_code").orderBy("d")
    at = lambda c: F.when(F.col(c).isNotNull(), F.struct("d", F.col(c).alias("x")))
    near = line.withColumn("before", F.last(at("end"), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))).withColumn("after", F.first(at("start"), ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing)))
    near = near.where("asked").join(cover, ["store_code", "d"], "left")
    side = lambda c, gap: F.when(F.col(c).isNotNull(), F.struct(gap.alias("gap"), F.col(c)["x"].alias("x")))
    best = F.least(side("before", F.col("d") - F.col("before")["d"]), side("after", F.col("after")["d"] - F.col("d")))
    undated = v.where("lo is null").groupBy("store_code").agg(F.min(_text()).alias("undated"))
    out = near.join(undated, "store_code", "left")
    return out.select("store_code", F.date_add(F.lit("1970-01-01").cast("date"), F.col("d")).alias("day"), F.coalesce("cover", best["x"], "undated").alias("best"))


def known_places(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (row_id, ship_no, store_code, address), a table that can be read twice -> what is known of each (address, store_code), and
    the version that is nearest for each (store_code, day) that asks for one."""
    t = cut_lineage(trusted(pairs(rows)))
    v = cut_lineage(variants(t))
    stores = v.groupBy("store_code").agg(F.count("*").alias("n_versions"), F.min(F.struct((-F.col("n")).alias("n"), _text().alias("x")))["x"].alias("common"))  # for rows without a date
    known = t.select(F.col("address").alias("_address"), "store_code", "norm", "city", "district", "rest", "placeholder", "trusted").join(stores, "store_code", "left").withColumnRenamed("store_code", "_store")
    known = cut_lineage(known)
    asks = cut_lineage(_meet(rows, known).where(_asking()).select("store_code", F.col("ship_date").alias("day")).distinct())
    return known, cut_lineage(nearest_versions(asks, v).select(F.col("store_code").alias("_store"), F.col("day").alias("_day"), "best"))


def _asking() -> Column:
    return ~F.col("trusted") & F.col("ship_date").isNotNull() & F.col("n_versions").isNotNull()


def _meet(rows: DataFrame, known: DataFrame) -> DataFrame:
    on = rows["address"].eqNullSafe(known["_address"]) & rows["store_code"].eqNullSafe(known["_store"])
    return rows.join(known, on).drop("_address", "_store").withColumn("ship_date", T.ship_date(F.col("ship_no")))


def backfill(rows: DataFrame, places: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """rows (row_id, ship_no, store_code, address and others) with ship_date, address_final, address_source, address_pending, region
    and rest. They meet what is known of their (address, store_code), and those that need another version what is nearest for their
    (store_code, day). places: known_places of these rows; without it rows are a table that can be read twice."""
    columns = rows.columns
    known, nearest = places or known_places(rows)
    t, asking = _meet(rows, known), _asking()
    t = t.join(nearest, (F.when(asking, F.col("store_code")) == F.col("_store")) & (F.col("ship_date") == F.col("_day")), "left")
    many = F.col("n_versions") > 1
    t = t.withColumn("best", F.when(F.col("ship_date").isNull(), F.col("common")).otherwise(F.col("best")))
    own_blank = F.trim("rest") == ""
    whole = F.col("placeholder") | own_blank
    filled = F.when(whole, F.concat("best.city", "best.district", "best.rest")).otherwise(F.concat(F.col("best.city"), F.coalesce(F.col("district"), F.col("best.district")), F.col("rest")))
    fill_it = ~F.col("trusted") & F.col("best").isNotNull()
    t = t.withColumn("address_final", F.when(fill_it, filled).otherwise(F.col("norm")))
    t = t.withColumn("address_pending", (~F.col("trusted") & F.col("best").isNull()).cast("int"))
    source = F.when(F.col("trusted"), F.when(F.col("norm") == F.col("address"), "原始完整").otherwise("前綴正規化")).when(F.col("best").isNull(), "無法處理").when(many, "多版本回填").otherwise("單一版本回填")
    t = t.withColumn("address_source", source)
    # a trusted address and a whole version are parsed already; only addresses put together from both are parsed row by row
    region = F.when(F.col("trusted"), F.concat("city", "district")).when(whole, F.concat("best.city", "best.district")).otherwise(F.concat(A.city(F.col("address_final")), A.district(F.col("address_final"))))
    return t.withColumn("region", F.when(F.col("address_pending") == 0, region)).select(*columns, "ship_date", "address_final", "address_source", "address_pending", "region", "rest")


def _places(df: DataFrame, name: str) -> DataFrame:
    """city, district and name without variants of 台; district from its own column, else what follows the city in site_id (or all of it)."""
    of = lambda c: A.canonical(F.trim(F.col(c)))
    site = of("site_id") if "site_id" in df.columns else None
    district = of("district") if "district" in df.columns else F.when(site.startswith(of("city")), site.substr(F.length(of("city")) + 1, F.length(site))).otherwise(site)
    return df.select(of("city").alias("city"), district.alias("district"), of(name).alias(name)).where(f"city <> '' and district <> '' and {name} <> ''")


def gazetteer(roads: DataFrame | None, villages: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(road -> regions, village -> regions, triples); None when neither file is there; one of them may be absent.

    roads: city, site_id, road; villages: city, district (or site_id), village.
    """
    if roads is None and villages is None:
        return None
    spark = (roads if roads is not None else villages).sparkSession
    none = lambda name: spark.createDataFrame([], f"city string, district string, {name} string")
    r = _places(roads if roads is not None else none("road"), "road")
    v = _places(villages if villages is not None else none("village"), "village")
    by = lambda df, k: df.groupBy(k).agg(F.collect_set(F.concat("city", "district")).alias(f"{k}_regions"))
    return by(r, "road"), by(v, "village"), r.select("city", "district", "road").distinct()


def match_counts(resolved: DataFrame) -> DataFrame:
    """Rows by what the gazetteer found, all kinds listed."""
    kinds = resolved.sparkSession.createDataFrame([(k,) for k in ("未載入參考資料", "未比對", "路名回推補齊", "路名相符(已驗證)")], "address_match string")
    n = resolved.groupBy("address_match").agg(F.count("*").alias("n"))
    return kinds.join(n, "address_match", "left").select("address_match", F.coalesce("n", F.lit(0)).alias("n"))


def resolve(filled: DataFrame, names: tuple[DataFrame, DataFrame, DataFrame] | None) -> DataFrame:
    """filled (see backfill) with address_match; regions of incomplete addresses come from unique roads and villages."""
    # written, as its size is known then: where addresses are few the rows meet them without a shuffle
    return matched(filled, names and cut_lineage(looked_up(filled, names)))


def looked_up(filled: DataFrame, names: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """address_final of filled (once each): the region found, and whether its road is known."""
    roads, villages, triples = names
    one = filled.where("address_final is not null").select("address_final").distinct()
    one = one.select("address_final", A.city(F.col("address_final")).alias("c"), A.district(F.col("address_final")).alias("d"), A.rest(F.col("address_final")).alias("r"))
    one = one.withColumn("road", A.road(F.col("r"))).withColumn("village", A.village(F.col("r")))
    one = one.join(roads, "road", "left").join(villages, "village", "left")
    both = F.array_intersect("road_regions", "village_regions")
    found = F.when(F.size(both) == 1, F.get(both, F.lit(0))).when(F.size("road_regions") == 1, F.get("road_regions", F.lit(0))).when(F.size("village_regions") == 1, F.get("village_regions", F.lit(0)))
    one = one.withColumn("found", F.when(F.col("c").isNull() | F.col("d").isNull(), found))
    known = triples.select(F.col("city").alias("tc"), F.col("district").alias("td"), F.col("road").alias("tr"), F.lit(True).alias("known"))
    one = one.join(known, (A.canonical(F.col("c")) == F.col("tc")) & (A.canonical(F.col("d")) == F.col("td")) & (F.col("road") == F.col("tr")), "left")
    return one.select("address_final", "found", "known")


def matched(filled: DataFrame, looked: DataFrame | None) -> DataFrame:
    """resolve with what looked_up gave; None without a gazetteer."""
    if looked is None:
        return filled.withColumn("address_match", F.lit("未載入參考資料"))
    out = filled.join(looked, "address_final", "left")
    match = F.when(F.col("found").isNotNull(), "路名回推補齊").when(F.col("known"), "路名相符(已驗證)").otherwise("未比對")
    out = out.withColumn("address_match", match).withColumn("region", F.coalesce("region", "found")).withColumn("address_pending", F.when(F.col("found").isNotNull(), 0).otherwise(F.col("address_pending")))
    return out.withColumn("address_source", F.when(F.col("found").isNotNull(), F.concat("address_source", F.lit("；路名回推"))).otherwise(F.col("address_source"))).drop("found", "known")


def source_buckets(filled: DataFrame) -> DataFrame:
    """Rows by kind of source: suffix first, then prefix, else 其他."""
    s = F.col("address_source")
    bucket = F.when(s.endswith("路名回推"), "路名回推").when(s.startswith("原始"), "原始").when(s.startswith("前綴"), "正規化").when(s.startswith("單一"), "單一版本").when(s.startswith("多版本"), "多版本").when(s.startswith("無法"), "待確認").otherwise("其他")
    return filled.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
